import pytest

from embedmesh.functions.resources import code_strings, extract_resources, resources_column


@pytest.mark.parametrize(
    ("source", "page", "want"),
    [
        ("zalando.de", '<link rel="x" href="ftp://media.ztat.net/a.css"/></script>', [("media.ztat.net", "LINK")]),
        ("a.com", '<script src="http://i.po.st/x.js\n#pub=1"></script>', [("i.po.st", "SCRIPT")]),
        ("a.com", '<script>var p = "http://pixel.tradekey.com:8080/x";</script>', [("pixel.tradekey.com", "SCRIPT")]),
        ("a.com", "<script>var h = ssl + '.google-analytics.com/ga.js';</script>", [("google-analytics.com", "SCRIPT")]),
        ("n49.ca", "<script>document.write('<img x=' + k + '&amp;domain=cruise-ships.ca');</script>", [("cruise-ships.ca", "SCRIPT")]),
        ("a.com", '<SCRIPT SRC=" http://w.sharethis.com/b.js"></SCRIPT>', [("w.sharethis.com", "SCRIPT")]),
        ("a.com", '<iframe src="http://ad.doubleclick.net/a"><script src="http://b.com/x.js"></script><img src="http://c.com/p.gif"></iframe>', [("ad.doubleclick.net", "IFRAME")]),
        ("a.com", '<a href="http://out.com/x.html"><img src="http://skin.ztat.net/p.png"></a>', [("skin.ztat.net", "IMAGE")]),
        ("a.com", "<script>x('http://a+b.de/x', 'me@web.de', 'a(at)b.de')</script>", []),
        ("a.com", '<script>(function() { var s = d.createElement("script"); s.src = "//sonar.sociomantic.com/js?', [("sonar.sociomantic.com", "SCRIPT")]),
        ("http://www.spiegel.de/", '<script src="/static/x.js"></script>', [("www.spiegel.de", "SCRIPT")]),
        ("a.com", "<noscript><img src='http://n.com/1.gif'></noscript><!-- <img src='http://no.com/1.gif'> -->", [("n.com", "IMAGE")]),
        ("a.com", "<script>if (/tracker\\.example\\.com/.test(u)) { a = b / c; }</script>", [("tracker.example.com", "SCRIPT")]),
        ("a.com", '<script src="http://x.com/1.js"></script><script src="http://x.com/2.js"></script>', [("x.com", "SCRIPT")]),
        ("a.com", "<img src='http://nope.invalidtld/1.gif'><img alt=x>", []),
        (None, None, []),
    ],
)
def test_extraction(source, page, want):
    assert extract_resources(source, page) == want


def test_code_strings():
    assert code_strings("a = 'x\\'y' // 'no'\n + \"b\\u0041\" /* 'no' */; c = `t` ; d = 1 / 2 / 3; e = 'open\n'z'") == ["x'y", "bA", "t", "open", "z"]
    assert code_strings("x" * 100_000 + "'" + "a" * 100_000) == ["a" * 100_000]


def test_column(spark):
    df = spark.createDataFrame([("http://a.com/", "<img src='http://b.com/1.gif'>"), (None, None)], "u string, h string")
    assert [[tuple(x) for x in r[0]] for r in df.select(resources_column(df.u, df.h)).collect()] == [[("b.com", "IMAGE")], []]
