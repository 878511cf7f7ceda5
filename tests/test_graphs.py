import math

import pytest
from pyspark.sql import functions as F

from embedmesh.operators import degrees, encode, iterate, labels, rankings
from embedmesh.operators import cooccurrence as co
from embedmesh.operators.components import connected_components


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, target long")


def test_components(spark):
    got = {r.vertex: r.component for r in connected_components(edges(spark, (1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (None, 9))).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7}
    path = connected_components(edges(spark, *((i, i + 1) for i in range(60)))).collect()
    assert {r.component for r in path} == {0} and len(path) == 61
    star = connected_components(edges(spark, *((500, i) for i in range(200)))).collect()
    assert {r.component for r in star} == {0}
    assert {(r["size"], r.components) for r in iterate.component_sizes(edges(spark, (1, 2), (2, 3), (4, 5))).collect()} == {(3, 1), (2, 1)}


def test_pagerank(spark):
    e = edges(spark, (1, 2), (1, 3), (2, 3))
    v = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rank = {i: 1 / 3 for i in (1, 2, 3)}
    for _ in range(5):
        d = rank[3]
        rank = {1: (d / 3) * 0.85 + 0.05, 2: (rank[1] / 2 + d / 3) * 0.85 + 0.05, 3: (rank[1] / 2 + rank[2] + d / 3) * 0.85 + 0.05}
    got = {r.id: r["rank"] for r in iterate.pagerank(e, v, max_iter=5, eps=None).collect()}
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1)
    assert sum(r["rank"] for r in iterate.pagerank(e, v, eps=1e-4).collect()) == pytest.approx(1)
    with pytest.raises(ValueError, match="not vertices"):
        iterate.pagerank(e, v.where("id < 3"))
    cycle = iterate.pagerank(edges(spark, (1, 2), (2, 1)), v.where("id < 3"), max_iter=3).collect()
    assert [r["rank"] for r in cycle] == pytest.approx([0.5, 0.5])


def test_reachability(spark):
    got = {r.id: r for r in iterate.reachability_counters(edges(spark, (1, 2), (2, 3), (3, 4))).collect()}
    from embedmesh.functions.sketch import NAMES

    for n in NAMES:
        assert got[1][n] >= got[2][n] >= got[3][n] >= got[4][n]
    assert got[4].reachable == 1 and got[1].reachable >= got[3].reachable


def test_power_law(spark):
    e = edges(spark, (1, 9), *((2, i) for i in (8, 9)), *((3, i) for i in (6, 7, 8, 9)))
    r = degrees.power_law_exponent(e).first()
    s = math.log(2) + math.log(4)
    assert (r.gamma, r.sigma) == pytest.approx((1 + 3 / s, math.sqrt(3) / s))
    assert degrees.power_law_exponent(edges(spark, (1, 2), (3, 4))).first().gamma == math.inf


def test_repeated_edges_count(spark):
    assert [(r.degree, r.vertices) for r in degrees.degree_distribution(edges(spark, (1, 2), (1, 2))).collect()] == [(2, 1)]


def test_cooccurrence(spark):
    sites = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("c", "y"), ("c", "z"), ("c", None)], "domain string, t string")
    pairs = co.pair_counts(sites, "t")
    assert {(r.i, r.j): r["count"] for r in pairs.collect()} == {("x", "x"): 2, ("x", "y"): 2, ("y", "y"): 2, ("x", "z"): 1, ("y", "z"): 1, ("z", "z"): 1}
    assert {r.i: r.m for r in co.marginals(pairs).collect()} == {"x": 5, "y": 5, "z": 3}
    assert {r.i: r.m for r in co.marginals(pairs, "domains").collect()} == {"x": 2, "y": 2, "z": 1}
    assert ("x", "y", 1.0) in {(r["row"], r["col"], r.p) for r in co.conditional_probability(pairs).collect()}
    names = spark.createDataFrame([("x",), ("w",)], "third_party string")
    lift = {(r["row"], r["col"]): r.lift for r in co.lift(pairs, names, 10).collect()}
    assert lift["x", "x"] == pytest.approx(5) and math.isnan(lift["w", "w"]) and len(lift) == 4


def test_empty_group_and_ratios(spark):
    tp = spark.createDataFrame([("a.com", "t.net"), ("b.xx", "t.net")], "domain string, third_party string")
    got = rankings.top_third_parties_per_tld(tp, tp.select("third_party")).collect()
    assert {(r.tld, r.domains, r.share) for r in got} == {("overall", 2, 1.0), ("com", 1, 1.0)}
    own = spark.createDataFrame([("Beacon", 4, 2, 1), ("Other", 2, 2, 0)], "category string, occurrences int, occurrences_dynamic int, occurrences_static int")
    rows = {r.category: r for r in labels.embedding_ratios(own).collect()}
    assert set(rows) == {"Beacon", "Overall"} and rows["Overall"].dynamic_mean == 0.75 and math.isnan(rows["Beacon"].dynamic_std)


def test_encoding_follows_the_lines(spark):
    lines = spark.createDataFrame([(1, "b", [("t",), ("a",)]), (2, "a", [("u",)]), (3, "lone", [])], "line int, domain string, trackers array<struct<domain:string>>")
    e, added = encode.encode_graph(lines, spark.createDataFrame([("t", 7)], "name string, id long"), last_id=100)
    assert {(r.name, r.id) for r in added.collect()} == {("b", 101), ("a", 102), ("u", 103), ("lone", 104)}
    assert {(r.src, r.target) for r in e.collect()} == {(101, 7), (101, 102), (102, 103)}


def test_squares_of_labels_are_spread(spark, monkeypatch):
    """Tables of every two labels: rows even by task, whatever the shuffle partitions, and equal to what the counts say."""
    monkeypatch.setattr(co, "SQUARE_ROWS", 2000, raising=False)
    sites = spark.createDataFrame([(f"s{k}", f"t{(k * m) % 190:03d}") for k in range(60) for m in (1, 7, 31)], "domain string, t string")
    pairs, names = co.pair_counts(sites, "t"), spark.createDataFrame([(f"t{k:03d}",) for k in range(200)], "third_party string")
    count = {**{(r.i, r.j): r["count"] for r in pairs.collect()}, **{(r.j, r.i): r["count"] for r in pairs.collect()}}
    number = {f"t{k:03d}": k for k in range(200)}
    own = {a: count.get((a, a), 0) for a in number}
    table, lift = co.probability_table(pairs, names), co.lift(pairs, names, 10)
    assert {(r.i, r.j): r.p for r in table.collect()} == {(number[a], number[b]): count.get((a, b), 0) / own[b] if own[b] else 0.0 for a in number for b in number}
    got = {(r["row"], r["col"]): r.lift for r in lift.collect()}
    assert len(got) == 200 * 200 and all(math.isnan(x) == (not own[a] or not own[b]) for (a, b), x in got.items())
    assert all(x == pytest.approx(count.get((a, b), 0) / own[b] / (own[a] / 10)) for (a, b), x in got.items() if own[a] and own[b])
    for whole in (table, lift):
        assert whole.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2 * 2000
