import time

import pytest

from embedmesh.functions.markup import Tags
from embedmesh.functions.resources import extract_resources, judged_resources


def read(page):
    tags, found = Tags(page), []
    while t := tags.next():
        found.append((t[1], t[2].strip(), t[3]))
    return found


def test_tags():
    assert read("a <b x='1>2' y=\"'\">c</B ><!-- <i> --><!doctype x><br/>< p>1<2") == [("b", "x='1>2' y=\"'\"", False), ("b", "", True), ("", "", False), ("", "", False), ("br", "/", False)]
    assert read("<p class=it's>don't</p>") == [("p", "class=it's", False), ("p", "", True)]
    # a quote that is never closed is no quote
    assert read("<a x='1><b y='2'>t</b>") == [("a", "x='1><b y='2'", False), ("b", "", True)]
    assert read("<a x='>' <b>") == [("a", "x='>' <b", False)] and read("<a x='>") == [("a", "x='", False)]
    assert read("<!-- <b>") == [("", "", False)] and read("<b") == []


@pytest.mark.parametrize("unit", ["<a '", "<a ", "<a x='", "<a x='>' ", "<div>", "</span>", "<", "<!", "<script>", "<a x=\"'>", "<a<"])
def test_time_is_linear(unit):
    took = []
    for n in (500_000, 1_000_000):
        page = unit * (n // len(unit)) + "'"
        began = time.perf_counter()
        extract_resources("http://a.com/", page)
        took.append(time.perf_counter() - began)
    assert took[1] < 6 and took[1] < 4 * took[0] + 0.5, took


def test_what_is_dropped():
    page = "<img src='http://ok.com/1.gif'><img src='http://nope.invalidtld/1.gif'><script src='http://a_b.com/x'></script>"
    assert judged_resources("a.com", page) == ([("ok.com", "IMAGE")], ["http://nope.invalidtld/1.gif", "http://a_b.com/x"])
