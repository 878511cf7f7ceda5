import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from embedmesh.llm import mergedrop

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "   a", "a  b\n\nc ", "tabs\tand\r\n", "é ½ ﬁ Ａ 中文 кот", "\U0001f600\U0001f468‍\U0001f469", "x" * 3000, "▁", "a▁ ▁b", "\x00\x7f", "日本語のテキスト", " lead", "trail "]


def noise(rng, n):
    return "".join(rng.choice(["the", "ing", " ", " ", "\n", "é", "q", "中", "😀", "tion", "A", "1"]) for _ in range(n))


def test_no_dropout_is_the_librarys_encoding():
    c, sp, rng = mergedrop.Codec(PATH, 1, 0.0), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(1)
    for text in [*(t for t in HARD if "▁" not in t), *(noise(rng, rng.randrange(1, 200)) for _ in range(300))]:
        assert c.encode(text).tolist() == sp.encode(text), text


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_lossless_at_every_rate(rate):
    c, rng = mergedrop.Codec(PATH, 9, rate), random.Random(2)
    for k, text in enumerate([*HARD, *(noise(rng, rng.randrange(1, 200)) for _ in range(200))]):
        assert c.decode(c.encode(text, k)) == text


def slow_unit(model, unit, key, limit):
    """The same rule without an agenda: among the live, unskipped candidates the best is merged."""
    parts, gone = [(i, i + 1) for i in range(len(unit))], set()
    while True:
        options = []
        for (i, j), (_, k) in zip(parts, parts[1:]):
            if unit[i:k] in model.rank and (i, j, k) not in gone:
                options.append((model.rank[unit[i:k]], i, j, k))
        if not options:
            break
        _, i, j, k = min(options)
        h = (key ^ (i * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F + k * 0x165667B19E3779F9)) & (2**64 - 1)
        if (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)) >> 32 < limit:
            gone.add((i, j, k))
            continue
        at = next(x for x, p in enumerate(parts) if p[0] == i)
        parts[at : at + 2] = [(i, k)]
    out = []
    for i, k in parts:
        out += [model.piece_id[unit[i:k]]] if unit[i:k] in model.piece_id else [model.byte_ids[b] for b in unit[i:k].encode()]
    return out


def test_agenda_against_brute_force():
    model, rng = mergedrop.Model(PATH), random.Random(3)
    for _ in range(800):
        unit = " " * rng.randrange(3) + "".join(rng.choice("thenigor") for _ in range(rng.randrange(1, 16)))
        key, limit = rng.getrandbits(64), int(rng.choice([0, 0.1, 0.6]) * 2**32)
        assert model.unit(unit, key, limit) == slow_unit(model, unit, key, limit)


def slow_text(codec, text, key):
    """Unit by unit, each under its own key."""
    units, _, _, breaks = mergedrop.cut([" " + text], codec.pairs.of_code)
    numbers, document = np.arange(breaks[0]), np.full(breaks[0], codec.document(key), np.uint64)
    found = []
    for unit, k in zip(units.to_pylist(), mergedrop.occurrence_keys(document, numbers).tolist()):
        found += [codec.model.byte_ids[b] for b in unit.encode()] if unit == mergedrop.BLANK else slow_unit(codec.model, unit, k, codec.limit)
    return found


@pytest.mark.parametrize("rate", [0.0, 0.2, 0.9])
def test_many_at_once_are_each_alone(rate):
    c, rng = mergedrop.Codec(PATH, 5, rate), random.Random(4)
    texts = [*HARD[1:7], *HARD[8:], *(noise(rng, rng.randrange(1, 200)) for _ in range(60)), "x" * 60 + " the the"]
    keys = [rng.randrange(1 << 40) for _ in texts]
    for text, key, ids in zip(texts, keys, c.encode_many(texts, keys), strict=True):
        assert ids.tolist() == slow_text(c, text, key), text


def test_parts_of_long_texts_change_nothing(monkeypatch):
    c, rng = mergedrop.Codec(PATH, 5, 0.3), random.Random(6)
    texts = [noise(rng, 900), "x" * 900, " " * 50 + "the  end " * 60, noise(rng, 5)]
    whole = c.encode_many(texts, [1, 2, 3, 4])
    monkeypatch.setattr(mergedrop, "_CHUNK", 37)
    monkeypatch.setattr(mergedrop, "_UNITS", 3)
    monkeypatch.setattr(mergedrop, "_TRACED", 5)
    assert all(np.array_equal(a, b) for a, b in zip(whole, c.encode_many(texts, [1, 2, 3, 4]), strict=True))


def test_segmentations_vary_and_repeat():
    c, again = (mergedrop.Codec(PATH, 1, 0.2) for _ in range(2))
    text = "international considerations " * 5
    assert len({tuple(c.encode(text, k).tolist()) for k in range(40)}) > 35
    # and inside one document
    words = [x.decode() for x in b"|".join(c.model.bytes_of[i] for i in c.encode("international " * 300, 3).tolist()).replace(b"| ", b"\0").split(b"\0")]
    assert len(set(words)) > 10
    assert np.array_equal(c.encode(text, 17), again.encode(text, 17))
    assert len({tuple(mergedrop.Codec(PATH, s, 0.2).encode(text).tolist()) for s in range(8)}) > 4


def test_share_of_skipped_merges():
    """A word of one merge is cut in about the dropout rate of its occurrences."""
    c = mergedrop.Codec(PATH, 1, 0.1)
    one = next(w for w in ("to", "in", "on", "is") if len(mergedrop.Codec(PATH, 1, 0.0).encode(w)) == 1)
    n = 20_000
    got = c.encode(" ".join([one] * n), 1)
    least = mergedrop.Codec(PATH, 1, 0.0).encode(" ".join([one] * n))
    assert len(least) == n and 0.1 * n < len(got) - n < 0.5 * n


def test_frames(spark):
    rows = [*((i, t, "x") for i, t in enumerate(HARD)), (50, None, "x"), (None, "no key", "x"), (51, "word " * 30000, "x"), (52, "same", "x"), (52, "same", "x")]
    got = mergedrop.decode(mergedrop.encode(spark.createDataFrame(rows, "doc_id long, text string, n_pieces string"), PATH), PATH).collect()
    assert len(got) == len(rows) and all(r.lossless and r.decoded == (r.text or "") and r.n_pieces == len(r.piece_ids) for r in got)
    none = mergedrop.encode(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert none.collect() == []
    odd = mergedrop.decode(spark.createDataFrame([(None,), ([-1],), ([99999],), ([],)], "piece_ids array<int>"), PATH)
    assert [r.decoded for r in odd.collect()] == [None, None, None, ""]
