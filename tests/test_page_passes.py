from pyspark.sql import functions as F

from embedmesh.operators import pages
from embedmesh.plans import fixtures
from embedmesh.sources import tables


def test_pages_and_parsed_pages_agree(spark):
    html = "<script src='http://t.net/a.js'></script><img src='http://www.u.org/x.gif'><img src='http://1.2.3/y'><a href='http://v.com/'></a><iframe src='//t.net/f'></iframe><link href='x.nowhere'>"
    rows = [(f"http://www.s{k % 7}.com/{k}", 0, html if k % 3 else None) for k in range(2500)] + [(None, 0, html), ("nonsense", 0, html), ("http://a.t.net/", 0, html)]
    raw = spark.createDataFrame(rows, "url string, archive_ms long, html string").coalesce(1)
    parsed = pages.parse_pages(raw)
    for a, b in zip(pages.third_party_rows(raw), pages.third_party_rows(parsed), strict=True):
        found = sorted(map(repr, a.collect()))
        assert found and found == sorted(map(repr, b.collect()))
    lines = [tables.format_third_party_lines(pages.third_party_table(x)) for x in (raw, parsed)]
    assert sorted(lines[0].collect()) == sorted(lines[1].collect())
    # one Python worker a task
    assert pages.third_party_table(raw)._jdf.queryExecution().toString().split("Physical Plan")[1].count("MapInArrow") == 1


def test_lines_become_rows_at_once(spark):
    values = ["a.com\t3\t[t.net,1,0,2,0]\t[u.net,0,0,0,1]\t", "b.com\t1", "c.com", "d.com\t2\t\t[v.net,0,1,0,0]", "e.com\t5\t[w.net,1,1,0,0]"]
    lines = spark.createDataFrame([(v,) for v in values], "value string")
    got = sorted(map(repr, tables.long_third_party_lines(lines).collect()))
    assert got == sorted(map(repr, tables.long_third_parties(tables.parse_third_party_lines(lines)).collect())) and len(got) == 4


def test_pages_are_spread_by_their_number(spark, tmp_path, monkeypatch):
    """Also where one side of the join is small enough for a broadcast, and beyond the shuffle partitions."""
    monkeypatch.setattr(fixtures, "PAGES_A_TASK", 100, raising=False)
    spark.range(1000).selectExpr("id as l_orderkey", "id % 9 as l_suppkey", "int(id % 4) as l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(2000).selectExpr("id as o_orderkey", "id % 7 as o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = fixtures.synthetic_pages(spark, str(tmp_path))
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 200
