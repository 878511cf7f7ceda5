import pytest

from embedmesh.functions import domains as d
from embedmesh.functions.suffixes import Suffixes


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("s3.amazonaws.com", "amazonaws.com"), ("s3-eu-west-1.amazonaws.com", "amazonaws.com"), ("a.b.trustkeeper.net", "trustkeeper.net"), ("http://someone.blogspot.com/", "blogspot.com"),
        ("blogspot.com", "blogspot.com"), ("CloudFront.net", "cloudfront.net"), ("httpoolro.nuggad.net", "nuggad.net"), ("http://packet_loss.blueprograms.com/", "blueprograms.com"),
        ("http://www.hrpraktijk.nl/x-[.5.lynkx", "hrpraktijk.nl"), ("http://www.slovreme.net/a%20[HD]/b", "slovreme.net"), ("http://www.grbj.com/x?{3DD0-B4}", "grbj.com"),
        ("http://www.adriatica.net/x>%20y", "adriatica.net"), ("http://address4sex.com/a<br%20/>", "address4sex.com"), ("http://www.upromise.com/a|b", "upromise.com"),
        ("http://www.globaljet.com.au/x.html^^", "globaljet.com.au"), ("http://www.birthdayinabox.com/a\\=\\&b", "birthdayinabox.com"), ("http://sinohome.org/page%", "sinohome.org"),
        ("http://forum.hardware.fr/x|1*hfr|", "hardware.fr"), ("http://woodstock-tell-a-vision.com/%&(%7B$", "woodstock-tell-a-vision.com"), ("https://m.ththth.example.net/en/25#top", "example.net"),
        ("com", None), ("", None), (None, None), ("http:///x", None), ("co.uk", None), ("http://u:p@a.b.co.uk:80/x", "b.co.uk"), ("http://10.0.0.1/x", None), ("no spaces.com x", None),
    ],
)
def test_private_domain(url, want):
    assert d.private_domain(url) == want


def test_https_can_be_rejected():
    assert d.private_domain("https://a.example.net/", "reject") is None
    assert d.private_domain("http://a.example.net/", "reject") == "example.net"


def test_url_parts():
    assert len(d.extract_host("lala.co.uk")) == len(d.extract_host("lala.co.uk:8080")) == 10
    assert d.extract_host("uk") is None and d.extract_host(".uk") is None and d.extract_host("") == ""
    assert not d.could_be_url("user@example.com") and not d.could_be_url("a b.c") and d.could_be_url("a.b")
    assert d.internal_prefix("http://a.com/x/y") == "http://a.com/x/" and d.internal_prefix("a.com") == "a.com/" and d.internal_prefix("http://host") == "http://"
    assert d.expand_internal("http://a.com/", "//b.com/x") == "http://b.com/x" and d.expand_internal("http://a.com/", "x.js") == "http://a.com/x.js"
    assert d.expand_internal("p/", "ftp://b.com/x") == "ftp://b.com/x"
    assert d.parse_domain("&amp;domain=cruise-ships.ca") == "cruise-ships.ca"
    assert d.parse_domain("http://a.b.com/x?y=c.d") == "a.b.com" and d.parse_domain("x.y=z.w/1") == "z.w" and d.parse_domain("a/b") == "b"


def test_columns(spark):
    rows = spark.createDataFrame([("http://a.b.com/1",), (None,), ("x",), ("http://a.b.com/1",)], "u string")
    got = rows.select(d.private_domain_column(rows.u).alias("p"), d.last_two_labels(rows.u).alias("l")).collect()
    assert [r.p for r in got] == ["b.com", None, None, "b.com"]


def test_bare_names_of_providers():
    assert [d.private_domain(x) for x in ("amazonaws.com", "googleapis.com", "blogspot.com", "x.appspot.com")] == [None, None, "blogspot.com", "appspot.com"]


def test_suffixes_of_a_file():
    own = Suffixes.read(["// a comment", "", "com", "zz", "*.ck", "!www.ck", "co.zz extra"])
    assert [d.private_domain(x, suffixes=own) for x in ("a.b.com", "a.b.co.zz", "y.ck", "a.x.y.ck", "www.ck", "a.de")] == ["b.com", "b.co.zz", None, "x.y.ck", "www.ck", None]
    assert d.extract_host("http://a.zz/1", own) == "a.zz" and d.extract_host("http://a.de/1", own) is None


def test_host_column(spark):
    rows = spark.createDataFrame([("http://a.b.com/1",), (None,), ("x",)], "u string")
    assert [r.h for r in rows.select(d.host_column(rows.u).alias("h")).collect()] == ["a.b.com", None, None]
