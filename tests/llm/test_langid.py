import random

import numpy as np

from embedmesh.llm import langid

SYLLABLES = {"aa": ["ka", "ro", "mi", "tu", "len"], "bb": ["sch", "ung", "keit", "ein", "pf"], "cc": ["é", "eau", "tion", "oi", "ç"]}


def made(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def rows(n=400, seed=5):
    rng = random.Random(seed)
    return [(i, made(lang := rng.choice("aa bb cc".split()), rng.randrange(5, 200), rng), lang) for i in range(n)]


def test_held_out_accuracy_and_edges(spark):
    data = [*rows(), (1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "aa"), (1003, made("cc", 30000, random.Random(2)), None), (1004, "ka", None), (1004, "ka", None)]
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs.where(~langid.held_out()), max_rows=200)
    got = langid.identify(docs, model).withColumn("held", langid.held_out()).collect()
    assert len(got) == len(data)
    tested = [r for r in got if r.held and r.doc_id < 1000]
    assert len(tested) > 40 and np.mean([r.lang == r.lang_pred for r in tested]) > 0.95
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "cc" and 0 <= by[1003].score <= 1
    one, other = (r for r in got if r.doc_id == 1004)
    assert one.lang_pred == other.lang_pred and np.isclose(one.score, other.score)


def test_prediction_uses_the_whole_text():
    data = rows()
    model = langid.train([t.encode()[:260] for _, t, _ in data], [x for _, _, x in data], epochs=4)
    rng = random.Random(1)
    text = made("aa", 60, rng) + " " + made("bb", 900, rng)
    assert langid.predict(model, [text])[0] == ["bb"]
    whole, again = langid.predict(model, [text, None, "x"]), langid.predict(model, ["x", text])
    assert np.isclose(whole[1][0], again[1][1])


def test_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(none) is None
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, None).collect()] == [("und", 0.0)]
    assert langid.identify(none, None).collect() == []


def slow_probabilities(model, text):
    """Byte by byte, filter by filter."""
    raw = text.encode().lower()
    rows, weights = [], []
    for at in range(0, len(raw), langid.WINDOW):
        own = raw[at : at + langid.WINDOW + langid.REACH - 1]
        pooled = []
        for f in range(model.filters.shape[1]):
            best = -np.inf
            for i in range(langid.WINDOW):
                total = 0.0
                for j in range(langid.REACH):
                    byte = own[i + j] if i + j < len(own) else 0
                    total += float(model.embed[byte] @ model.filters[j * langid.DIM : (j + 1) * langid.DIM, f])
                best = max(best, total)
            pooled.append(max(0.0, best + float(model.bias[f])))
        z = np.array(pooled) @ model.out + model.out_bias
        e = np.exp(z - z.max())
        rows.append(e / e.sum())
        weights.append(sum(chr(b).isalpha() and b < 128 or b >= 128 for b in raw[at : at + langid.WINDOW]) + 1e-3)
    return np.average(rows, axis=0, weights=weights)


def test_prediction_against_a_slow_forward_pass():
    rng = np.random.default_rng(3)
    words = {"aa": ["lo", "mi", "tané"], "bb": ["sch", "ung", "über"]}
    windows, langs = zip(*[(" ".join(rng.choice(words[x], 40)).encode(), x) for x in ("aa", "bb") for _ in range(40)])
    model = langid.train(list(windows), list(langs), epochs=2)
    texts = ["lo mi tané", " ".join(rng.choice(words["aa"], 30)) + " " + " ".join(rng.choice(words["bb"], 60)), "UNG 12"]
    got, scores = langid.predict(model, texts)
    for text, lang, score in zip(texts, got, scores, strict=True):
        slow = slow_probabilities(model, text)
        assert model.languages[int(slow.argmax())] == lang and abs(slow.max() - score) < 1e-4


def test_gradients_against_differences():
    """One step of plain descent direction: the loss falls along what train() follows."""
    rng = np.random.default_rng(4)
    windows, langs = zip(*[(" ".join(rng.choice(w, 30)).encode(), x) for x, w in (("aa", ["lo", "mi"]), ("bb", ["sch", "ung"])) for _ in range(32)])

    def loss(model):
        p = langid.window_probabilities(model, np.stack([np.frombuffer(w[: langid.WINDOW + 4].ljust(langid.WINDOW + 4, b"\0"), np.uint8) for w in windows]))
        return -np.log(p[np.arange(len(langs)), [model.languages.index(x) for x in langs]]).mean()

    losses = [loss(langid.train(list(windows), list(langs), epochs=n)) for n in (1, 4, 12)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.05


def test_null_ids(spark):
    row = spark.createDataFrame([(None,), (1,)], "doc_id long").select(langid.held_out().alias("h")).collect()
    assert [r.h for r in row] == [True, 2212294583 % 5 == 0]
