import random

import numpy as np

from embedmesh.llm.topk import Best, Turned, search_block, top_k, turn_of


def brute(rows, k, asked):
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, e in {(i, tuple(v)) for i, v in good if asked(i)}:
        scored = sorted((-sum(a * b for a, b in zip(e, v)), i) for i, v in good if i != q and len(v) == len(e))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(40)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.3))) for c in rng.choice(centres)]) for i in range(700)]
    rows += [(800 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(901, None), (902, [None] * 40), (903, [float("nan")] + [0.0] * 39), (904, [float("inf")] * 40), (None, [1.0] * 40), (905, [0.0] * 40)]
    rows += [(1000, [1.0, 2.0]), (1020, [0.5, -2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string").repartition(3)
    got = top_k(df, df.where("vec_id % 20 = 0"), k=7, block=100, query_block=8, step=8, round_queries=16)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7, lambda i: i % 20 == 0)


def test_repeated_query_ids_cross_no_round(spark):
    rng = random.Random(4)
    rows = [(i // 3, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(18)] + [(0, [1.0] * 6)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = brute(rows, 4, lambda i: i % 2 == 0)
    for size in (1, 4, 100):
        assert sorted(map(tuple, top_k(df, df.where("vec_id % 2 = 0"), k=4, round_queries=size, step=2, probe=2).collect())) == want


def test_large_values_stay_exact():
    q = np.array([[1 << 40, 3], [5, -(1 << 20)]])
    c = np.array([[1 << 20, 7, 1], [1, 1 << 30, -9]])
    for turn in (np.eye(2), turn_of(c.T, 2)):
        best = Best(2, 3)
        search_block(best, 0, Turned(q, turn), np.array([100, 101]), Turned(c.T, turn), np.array([0, 1, 2]), step=1)
        want = q @ c
        assert [sorted(r, reverse=True) for r in want.tolist()] == best.scores.tolist()


def test_pairs_are_pruned():
    """Vectors whose mass lies in few directions, which no single component shows."""
    rng = np.random.default_rng(1)
    base = np.linalg.qr(rng.normal(size=(64, 64)))[0] * 0.7 ** np.arange(64)
    x = np.floor(64 * 8 * rng.normal(size=(3000, 64)) @ base.T).astype(np.int64)
    turned, best, shares = Turned(x, turn_of(x[:500], 64)), Best(50, 10), []
    for at in range(0, 3000, 500):
        shares = []
        search_block(best, 0, turned[:50], np.arange(50), turned[at : at + 500], np.arange(at, at + 500), shares=shares)
    assert shares[0] < 0.1
    scores = x[:50] @ x.T
    scores[np.arange(50), np.arange(50)] = np.iinfo(np.int64).min
    assert np.array_equal(best.scores, np.sort(scores, 1)[:, ::-1][:, :10])


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, df).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(one, one).collect() == []
