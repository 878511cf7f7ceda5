import random

import numpy as np
import pytest
import xxhash

from embedmesh.llm.simhash import fingerprints, segment_keys, simhash_components


def slow_print(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def slow_components(prints):
    parent = {d: d for d, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[:i]:
            if bin(p ^ q).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d, _ in prints}


def texts(n=160, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Éa", "ÀB"]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 260))))
    return [*out, None, "", " \t\n", "One", "one", "a b c", "A  b\tC", "long " * 3000]


def test_fingerprints():
    given = texts()
    assert [int(x) for x in fingerprints(given, 4)[:, 0]] == [slow_print(t) for t in given]


def test_segment_keys_are_complete():
    rng = np.random.default_rng(1)
    keys = segment_keys(4, 6)
    for _ in range(3000):
        flips = set(rng.choice(64, rng.integers(0, 5), replace=False).tolist())
        assert any(not flips & set(bits) for bits in keys.bits)


@pytest.mark.parametrize("block", [20_000, 3])
def test_components(spark, block):
    rows = [(i, t, i) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp int"), block=block).collect()}
    want = slow_components([(i, slow_print(t)) for i, t, _ in rows])
    assert {k: r.component_id for k, r in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_edges_of_input(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "x y"), (5, "x y"), (5, "x y"), (None, "other words here"), (7, None)]
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 7)]
