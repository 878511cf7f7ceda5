import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)

from embedmesh.llm import langid, mergedrop, simhash  # noqa: E402

SYLLABLES = {"aa": ["ka", "ro", "mi", "tu", "len"], "bb": ["sch", "ung", "keit", "ein", "pf"]}
ITEM = "When the old mill turns for 12 hours it grinds 40 kg of grain and the miller sells all of it at noon for 9 coins"


def made(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i, made(lang := rng.choice(["aa", "bb"]), rng.randrange(40, 120), rng), lang) for i in range(120)]
    for i in range(200, 215):  # exact copies
        rows.append((i, rows[i - 200][1], rows[i - 200][2]))
    for i in range(300, 315):  # one word in some hundred differs
        words = rows[i - 270][1].split(" ")
        words[3] = "kakaka"
        rows.append((i, " ".join(words), rows[i - 270][2]))
    rows += [(400 + i, made("aa", 30, rng) + ". " + ITEM.replace("40", str(50 + i)), "aa") for i in range(4)]
    rows += [(500, None, "aa"), (501, "", None), (502, "123 $$", "bb")]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5, 0).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_pipeline_against_brute_force(spark, corpus):
    folder, rows = corpus
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    left = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    parent = {r[0]: r[0] for r in left}
    for k, (i, t, _) in enumerate(left):
        for j, u, _ in left[:k]:
            if jaccard(t, u) >= 0.8:
                a, b = sorted((parent[i], parent[j]))
                parent = {d: a if p == b else p for d, p in parent.items()}
    want = {i for i, p in parent.items() if i == p and not 400 <= i < 500}
    assert set(got) == want and len(want) == 120
    texts = {r[0]: r[1] for r in rows}
    codec = mergedrop.Codec(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"), 1, 0.1)
    assert all(r.lossless and r.piece_ids == codec.encode(texts[i], i).tolist() for i, r in got.items())


def test_stages_keep_the_columns(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_one_of_each(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (3, "b"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 3)], "doc_id long, component_id long")
    assert sorted((r.doc_id or -1, r.text) for r in simhash.one_of_each(docs, classes).collect()) == [(-1, "a"), (-1, "c"), (1, "a"), (3, "b")]
    assert simhash.one_of_each(docs.limit(0), classes.limit(0)).collect() == []


def test_model_is_none_without_labels(spark):
    assert langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


@pytest.mark.parametrize("rows", [[], [(None, "no id here", None), (None, "no id here", None), (2, "no label here", None), (2, "no label here", None), (3, None, None), (4, "...", None)]])
def test_empty_tables_null_ids_and_no_labels(spark, tmp_path, rows):
    """Without labels all documents with a letter stay; rows of a null id stay unless their text has an id."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame([(i, t, x, "s", 1, "extra") for i, t, x in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.lossless) for r in got) == ([(-1, True), (-1, True), (2, True)] if rows else [])
