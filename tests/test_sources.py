import gzip
from xml.etree import ElementTree

from pyspark.sql import functions as F

from embedmesh.functions.whois import registrant, whois_fields
from embedmesh.operators import pages
from embedmesh.sources import arc, tables


def member(head: bytes, body: bytes) -> bytes:
    return gzip.compress(head + b"\n" + body)


def test_arc(spark, tmp_path):
    page = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<img src='http://t.net/1.gif'>é".encode()
    odd = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n\r\n\xe9"
    parts = [
        member(b"filedesc://x.arc 0.0.0.0 20120101000000 text/plain 10", b"1 0 x\n"),
        member(b"http://a.com/1 1.2.3.4 20120102030405 text/html %d" % len(page), page + b"\n"),
        member(b"broken header", b"zz"),
        member(b"http://a.com/2 1.2.3.4 20120102030405 image/gif 3", b"GIF"),
        member(b"ftp://a.com/3 1.2.3.4 20120102030405 text/html 4", b"abcd"),
        member(b"http://b.com/4 1.2.3.4 20120102030405 text/html %d" % (len(odd) + 9), odd),
    ]
    (tmp_path / "one.arc.gz").write_bytes(b"".join(parts))
    (tmp_path / "two.arc.gz").write_bytes(parts[0] + parts[3])
    arc.register(spark)
    records = spark.read.format("arc").load(str(tmp_path))
    rows = records.collect()
    assert len(rows) == 6 and [r.problem for r in rows if r.problem] == ["broken header", "short"]
    good, bad = arc.html_pages(records)
    found = {r.url: (r.archive_ms, r.html) for r in good.collect()}
    assert found == {"http://a.com/1": (1325473445000, "<img src='http://t.net/1.gif'>é"), "http://b.com/4": (1325473445000, "é")}
    assert {r.kind: r["count"] for r in bad.collect()} == {"HEADER": 1, "OTHER_TYPE": 2, "NO_RESPONSE": 1}
    parsed = pages.parse_pages(good)
    out = str(tmp_path / "pages")
    tables.write_parsed_pages(parsed, out)
    table = pages.third_party_table(tables.read_parsed_pages(spark, out))
    assert sorted(r.value for r in tables.format_third_party_lines(table).collect()) == ["a.com\t1\t[t.net,0,0,1,0]", "b.com\t1"]
    tables.compact(spark, out, str(tmp_path / "compact"))
    assert len(list((tmp_path / "compact").glob("*.parquet"))) == 1


def test_third_parties_of_pages(spark):
    rows = [
        ("http://a.com/1", 0, ["x.net", "cdn.x.net"], [], ["www.a.com"], ["bad"]),
        ("http://www.a.com/2", 0, ["x.net"], ["x.net"], None, []),
        ("nonsense", 0, ["x.net"], [], [], []),
        ("http://b.org/", 0, [], [], [], []),
    ]
    parsed = spark.createDataFrame(rows, tables.PARSED_PAGE)
    long, sites, problems = pages.third_party_rows(parsed)
    assert [tuple(r) for r in long.collect()] == [("a.com", "x.net", 2, 1, 0, 0)]
    assert {(r.domain, r.num_pages) for r in sites.collect()} == {("a.com", 2), ("b.org", 1)}
    assert {(r.marker, r.value) for r in problems.collect()} == {("INVALID_TRACKED_HOST", "nonsense"), ("INVALID_TRACKING_HOST", "bad")}


def test_lines(spark):
    lines = spark.createDataFrame([("a.com\t3\t[t.net,1,0,2,0]\t[u.net,0,0,0,1]\t",), ("b.com\t1",)], "value string")
    parsed = tables.parse_third_party_lines(lines)
    assert [(r.domain, r.num_pages, len(r.trackers)) for r in parsed.collect()] == [("a.com", 3, 2), ("b.com", 1, 0)]
    assert [tuple(r) for r in tables.long_third_parties(parsed).collect()] == [("a.com", 3, "t.net", 1, 0, 2, 0), ("a.com", 3, "u.net", 0, 0, 0, 1)]
    assert [r.value for r in tables.format_third_party_lines(parsed).collect()] == ["a.com\t3\t[t.net,1,0,2,0]\t[u.net,0,0,0,1]", "b.com\t1"]


def test_tsv_and_labels(spark, tmp_path):
    row = "d{0}\t{1}\tDE\t{0}\t1\t2\t3\t4\t5\t6\t{2}\t#\t{3}\tx\ty\tz\tw"
    (tmp_path / "l.tsv").write_text("\n".join([row.format(1, "#", "Beacon", "#"), row.format(5, "org", "#", "co"), row.format(3, "org", "Beacon", "co")]))
    got = tables.read_labelled(spark, str(tmp_path / "l.tsv")).collect()
    assert [(r.occurrences, r.registration_org, r.category, r.company, r.comment) for r in got] == [(5, "org", None, "co", "#"), (3, "org", "Beacon", "co", "#"), (1, None, "Beacon", None, "#")]
    assert tables.read_labelled(spark, str(tmp_path / "l.tsv"), ("Beacon",)).count() == 2
    edges = spark.createDataFrame([(1, 2), (3, 4)], tables.EDGES)
    tables.write_tsv(edges, str(tmp_path / "e"))
    assert sorted(map(tuple, tables.read_tsv(spark, str(tmp_path / "e"), tables.EDGES).collect())) == [(1, 2), (3, 4)]
    tables.write_text(edges, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1\t2", "3\t4"]


def test_gexf(spark, tmp_path):
    nodes = spark.createDataFrame([("x", "X", 1.5), ("y", "Y", 2.0)], "id string, label string, value double")
    edges = spark.createDataFrame([("x", "y", 3.0)], "i string, j string, weight double")
    tables.write_gexf(nodes, edges, str(tmp_path / "g.gexf"), directed=True)
    root = ElementTree.parse(tmp_path / "g.gexf").getroot()
    assert len(root.findall(".//{*}node")) == 2 and root.find(".//{*}edge").get("weight") == "3.0" and root.find(".//{*}graph").get("defaultedgetype") == "directed"


def test_whois(spark):
    df = spark.createDataFrame([("no value\nRegistrant Organization: A: B\r\nRegistrant Country: X\nRegistrant Country:  Y ",), ("",)], "o string")
    got = df.select(registrant(F.col("o")).alias("w"), whois_fields(F.col("o")).alias("m")).collect()
    assert tuple(got[0].w) == ("A: B", "Y") and tuple(got[1].w) == ("#", "#") and got[0].m["Registrant Country"] == "Y"
