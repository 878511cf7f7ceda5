import math
import random
import time
from collections import Counter

import pytest

from embedmesh.llm.sitetree import Flat, extract, importances, main_text


def test_regions_beside_articles_stay():
    assert main_text("<main><h1>Head</h1><div>story</div><article>teaser</article></main>") == "Head story teaser"
    assert main_text("<body><article>one</article><main><article>two</article></main></body>") == "one two"
    assert main_text('<body><div id="content">The story</div><article>card</article></body>') == "The story card"


def test_templates_beside_and_inside_articles_go(spark):
    page = """<body><div class="x1">Call us</div><main><h1>Title {0}</h1><div>Story {0} has many words</div><article><p>card</p></article>
    <ul><li>About the author</li></ul><p>Part {1} goes on</p><p>Sent from our newsroom</p></main></body>"""
    rows = [(i, f"http://a.example/{i}", page.format(i, i * 7)) for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", f'<body><div id="content"><p>Tale {i} without an article</p><p>Our motto</p></div></body>') for i in range(9)]
    rows += [(200 + i, f"http://c.example/{i}", f"<article><p>Piece {i}</p>{'<p>Now and then</p>' if i < 6 else ''}</article>") for i in range(20)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} Story {i} has many words Part {i * 7} goes on" for i in range(20))
    assert all(got[100 + i] == f"Tale {i} without an article" for i in range(9))
    assert all(got[200 + i] == f"Piece {i}" + (" Now and then" if i < 6 else "") for i in range(20))


SITE = """<body><div class="zeta"><a href="/">Home</a> <a href="/a">About us</a></div><section id="q1"><span>Buy our things today</span></section>
<article><h1>Title {0}</h1><p>Body of {0} has {1} words</p></article><div class="k9">All rights reserved</div></body>"""


def test_importance_alone_removes_menus_adverts_and_footers(spark):
    """Nothing on these pages says what it is, and the lists are off."""
    rows = [(i, f"http://a.example/{i}", SITE.format(i, i * 3)) for i in range(12)]
    rows += [(100 + i, f"http://named.example/{i}", f"<body><nav>Home</nav><div class=ad>Buy</div><p>Text {i}</p><footer>(c) us</footer></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df, lists=False).collect()}
    assert all(got[i] == f"Title {i} Body of {i} has {i * 3} words" and got[100 + i] == f"Text {i}" for i in range(12))


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://a.example/{i}", SITE.format(min(i, 6), 5)) for i in range(60)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {min(i, 6)} Body of {min(i, 6)} has 5 words" for i in range(60))


def test_importances_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta"]
    block = lambda: f"<div class=c{rng.randrange(3)}>{rng.choice(words)}<section><b>{rng.choice(words)}</b></section></div><p>{rng.choice(words)}</p>"
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", "<body>" + "".join(block() for _ in range(rng.randrange(1, 6))) + f"<article>{i % 25}</article></body>") for i in range(80)]
    trees: dict = {}
    for _, url, html in rows:
        flat = Flat(html)
        trees.setdefault((url[7:16], main_text(html)), []).append(list(flat.nodes()))
    counts, pages = {}, Counter(h for h, _ in trees)
    least = lambda n: [tuple((x is not None, x) for x in t) for t in n]
    for (site, _), several in trees.items():
        for path, inside, style, content in min(several, key=least):
            counts.setdefault((site, path, inside), []).append((style, content))
    want = {}
    for key, seen in counts.items():
        m = len(seen)
        if m < 2:
            continue
        low = lambda k: sum(c / m * math.log(c, m) for c in Counter(x[k] for x in seen).values())
        prose = seen[0][0] is None
        want[key] = (m, 1 - math.log(m) / math.log(max(2, pages[key[0]])) if prose else 0.9 * (1 - low(1)) + 0.1 * (1 - low(0)))
    got = {(r.host, r.path): (r.nodes, r.importance) for r in importances(spark.createDataFrame(rows, "page_id long, url string, html string"), bonus=0.0).collect()}
    assert set(got) == {k[:2] for k in want} and all(got[k[:2]] == (m, pytest.approx(x)) for k, (m, x) in want.items()) and len(want) >= 20


@pytest.mark.parametrize("unit", ["<a '", "<a ", "<div>", "</span>", "<b>", "<li>", "<p><b>", "<td><li>", "<b><hr>", "<div>x", "<a x='>' ", "<div></span>"])
def test_time_is_linear(unit):
    took = []
    for n in (125_000, 250_000):
        began = time.perf_counter()
        list(Flat(unit * (n // len(unit)) + "x").nodes())
        took.append(time.perf_counter() - began)
    assert took[1] < 3.5 * took[0] + 0.5 and took[1] < 8, took
