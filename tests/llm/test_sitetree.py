from embedmesh.llm.sitetree import extract, main_text


def test_roles_and_markup():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a>menu</a><li>more</ul></nav><div class="ad">buy</div><div id="cookieNotice">cookies</div>
    <article><header><h1>Caf&eacute; &amp;amp; <i>B</i>ar</h1></header><p><b>One
       two.<br><p>Three&nbsp;f<em>ou</em>r<!-- no --> &#x35;<script>x()</script><p title="a>b">six</p><div class="share">tweet</div>
    <form><input> name</form><ul><li>x<li>y</ul><section class="comments"><p>me too</p></section></article>
    <article class="comment">reader</article><aside>side</aside><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Café &amp; Bar One two. Three four 5 six x y"


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<article></article>") == ""
    assert main_text("<p>a<p>b") == "a b"
    assert main_text("plain & text") == "plain & text"
    assert main_text("<article>a <div>b</span></div> c < d <b") == "a b c < d <b"
    assert main_text("<article><script>x") == ""
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<article>" + "<p>word</p>" * 50000).count("word") == 50000
    assert main_text("<article><a href='x\"y'>q</a><p class=\"unclosed>z</p></article>") in ("q", "q z")


def test_template_branches_go_and_prose_stays(spark):
    rows = [(i, f"https://a.example/{i}", f'<body><div class="x1">Call us now, friends</div><div class="body"><p>Story {i} of {i * 7}</p></div><div class="x2"><p>Our motto</p></div></body>', 1) for i in range(9)]
    rows += [(100 + i, f"http://b.example/{i}", "<article><p>The same story</p></article>", 1) for i in range(8)]
    rows += [(200, None, "<div>no site</div>", 1), (201, "x", None, 1), (202, "http://c.example", "", 1), (203, "http://c.example", "<div>few</div>", 1), (203, "http://c.example", "<div>few</div>", 1), (None, None, None, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, low int")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == f"Story {i} of {i * 7}" for i in range(9))
    assert all(by[100 + i] == "The same story" for i in range(8))
    assert (by[200], by[201], by[202], by[203], by[None]) == ("no site", "", "", "few", "")
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
