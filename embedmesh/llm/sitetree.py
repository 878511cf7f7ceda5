"""Main text of HTML pages by a site style tree.

The DOMs of one host are merged by path (tag, id and class names from the root). For each merged node two entropies are
taken over the m nodes that it stands for, both in units of log m:

* presentation: the entropy of the children's layout. A node that always looks the same carries little.
* content: 1 - sum over distinct subtree texts of share * log_m(count). Text that repeats from page to page scores 0.

The tree spans the whole body of every page. A node whose weighted importance is under the threshold is a branch of the
template and goes. Elements that carry prose by themselves (p, h1 to h6, li, td, blockquote, pre) share their path with unlike
neighbours, so they are merged by path and text: one on n of a host's N pages has the importance 1 - log_N(n). Inside article
and main every importance has a bonus; what lies beside them is judged like all else. Pages of a host with the same article
count once, so that a page with many copies isn't taken for a template.

Importance can't tell what differs from page to page and still isn't article text (reader comments, rotating adverts, menus of
related links), nor judge a host of few pages. So elements whose name, role or class says what they are (menus, headers,
footers, sidebars, notices, adverts, reader comments) go too, on every page; ``lists=False`` leaves all to importance. Forms,
scripts, styles and the like are no text in either case.

The statistics are counts by (host, path, kind, digest), summed before and after the shuffle: a host with a third of all
pages is no group of its own anywhere. Only low branches leave the aggregation. Everything done to a page is linear in it.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmesh.functions.markup import ATTRIBUTE, RAW, Tags
from embedmesh.plans.storage import saved

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr",
}
#: Never text; and what says by its name that it isn't the article's.
_NOISE = {
    "form", "script", "style", "template", "button", "select", "textarea", "iframe", "svg", "canvas", "object", "head", "title", "noembed",
    "noframes", "applet", "audio", "video", "datalist", "input", "noscript", "map", "fieldset",
}
_LISTED = {"nav", "footer", "aside", "dialog", "menu"}
_PROSE = {"html", "body", "main", "article", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td"}
_LEAVES = _PROSE - {"html", "body", "main", "article"}
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
_SCOPE = {"ul", "ol", "dl", "table", "select", "td", "th", "div", "article", "section", "body", "html", "nav", "main"}
_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "commentlist", "disqus", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal",
    "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "masthead", "login", "search", "topbar",
    "skip", "reply", "replies", "discussion", "aside", "paywall",
}
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_MASK = (1 << 64) - 1
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "names", "noise", "listed", "main", "inside", "kids", "path")

    def __init__(self, tag: str, names: tuple[str, ...], noise: bool, listed: bool, parent: Node | None):
        self.tag, self.names, self.noise, self.listed = tag, names, noise, listed
        self.main = tag in ("article", "main")
        self.inside = self.main or (parent is not None and parent.inside)
        self.kids: list[Node | str] = []
        self.path = xxhash.xxh64_intdigest(f"{'.'.join((tag, *names))}", parent.path if parent else 0)


def _judged(tag: str, raw: str, inside: bool) -> tuple[tuple[str, ...], bool, bool]:
    """The names by which nodes of different pages are merged, whether the element is never text, and whether it says that
    it isn't article text."""
    names, noise, listed = [], tag in _NOISE, tag in _LISTED or (tag == "header" and not inside)
    if raw.strip(" /\n\t"):
        for key, value in ATTRIBUTE.findall(raw):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                names += value.split()
                words = {w.lower() for w in _SPLIT.split(value)}
                listed |= bool(words & (_COMMENTS if tag in ("article", "main") else _WORDS)) and tag not in ("html", "body")
                listed |= "header" in words and not inside and tag in ("div", "section", "table")
            elif key == "role":
                listed |= value.lower() in _ROLES
            elif key == "hidden" or (key == "style" and _HIDDEN.search(value)):
                noise = True
    return tuple(names), noise, listed


def parse(page: str) -> Node:
    """A tolerant DOM: unclosed and stray tags are mended as browsers mend them. Linear in the page: of the open elements of a
    name their depths are known, so no tag looks for its partner."""
    root = Node("", (), False, False, None)
    path, depths, tags, at, inside = [root], {}, Tags(page), 0, 0

    def close(depth: int) -> None:
        nonlocal inside
        while len(path) > depth:
            x = path.pop()
            depths[x.tag].pop()
            inside -= x.main

    while found := tags.next():
        start, tag, raw, closing = found
        if start > at:
            path[-1].kids.append(page[at:start])
        at = tags.at
        if not tag:
            continue
        if closing:
            if depths.get(tag):
                close(depths[tag][-1])
            continue
        if (tag not in _INLINE and tag not in _VOID or tag == "hr") and depths.get("p"):
            # a block ends an open paragraph; only inline elements can be open in one
            close(depths["p"][-1])
        if tag in _CLOSES:
            ended = _CLOSES[tag]
            border = max((depths[x][-1] for x in _SCOPE if x not in ended and depths.get(x)), default=0)
            within = [d[k] for x in ended if (d := depths.get(x)) and (k := bisect_right(d, border)) < len(d)]
            if within:
                close(min(within))
        names, noise, listed = _judged(tag, raw, inside > 0)
        node = Node(tag, names, noise, listed, path[-1])
        path[-1].kids.append(node)
        if tag in RAW:
            begin, end = tags.raw(tag)
            if not noise:
                node.kids.append(page[begin:end])
            at = tags.at
        elif tag not in _VOID and not raw.rstrip().endswith("/") or tag in ("p", "div", "b", "i"):
            depths.setdefault(tag, []).append(len(path))
            path.append(node)
            inside += node.main
    if at < len(page):
        path[-1].kids.append(page[at:])
    return root


class Flat:
    """A page laid flat: its pieces of text in order, and the blocks (and listed elements) as spans of these, with a digest of
    each one's text: the sum of its pieces' hashes."""

    def __init__(self, page: str):
        self.pieces: list[str] = []
        self.spans: list[tuple[Node, int, int]] = []
        # without recursion: pages can nest deeper than Python does
        stack: list = [parse(page)]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                self.pieces.append(x)
            elif isinstance(x, tuple):
                if x[0].tag not in _INLINE:
                    self.pieces.append(" ")
                self.spans.append((*x, len(self.pieces)))
            elif x.noise:
                self.pieces.append(" ")
            else:
                if x.tag not in _INLINE or x.listed:
                    stack.append((x, len(self.pieces)))
                if x.tag not in _INLINE:
                    self.pieces.append(" ")
                stack.extend(reversed(x.kids))
        total, self.sums = 0, [0]
        for piece in self.pieces:
            if words := piece.split():
                total += xxhash.xxh64_intdigest(" ".join(words))
            self.sums.append(total)

    def digest(self, start: int, end: int) -> int:
        return (self.sums[end] - self.sums[start]) & _MASK

    def key(self, node: Node, start: int, end: int) -> int:
        """By which prose elements are merged: their path and text."""
        return xxhash.xxh64_intdigest(self.digest(start, end).to_bytes(8), node.path ^ 1)

    def kept(self, low: frozenset[int] | set[int], lists: bool) -> list[str]:
        """The pieces outside of what goes; what goes still parts the text before from that after it."""
        step = [0] * (len(self.pieces) + 1)
        for node, start, end in self.spans:
            if (lists and node.listed) or (low and (node.path in low and node.tag not in _PROSE or node.tag in _LEAVES and self.key(node, start, end) in low)):
                step[start] += 1
                step[end] -= 1
        out, depth = [], 0
        for piece, change in zip(self.pieces, step, strict=False):
            depth += change
            out.append(" " if depth else piece)
        return out

    def nodes(self) -> Iterator[tuple[int, bool, int | None, int | None]]:
        """(path, whether inside article or main, digest of the children's layout, digest of the text) of the block elements
        that may go; (key, inside, None, None) of the prose, once a page."""
        seen = set()
        for node, start, end in self.spans:
            if node.tag and node.tag not in _INLINE and node.tag not in _VOID and node.tag not in _PROSE:
                layout = "|".join(k.tag + "." + ".".join(k.names) for k in node.kids if not isinstance(k, str))
                yield _signed(node.path), node.inside, _signed(xxhash.xxh64_intdigest(layout)), _signed(self.digest(start, end))
            elif node.tag in _LEAVES and (key := self.key(node, start, end)) not in seen:
                seen.add(key)
                yield _signed(key), node.inside, None, None


def _joined(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


def main_text(page: str | None, low: frozenset[int] = frozenset(), lists: bool = True) -> str:
    """The article's text of one page. low: paths (of prose: keys) of the site's low-importance branches."""
    return _joined(Flat(page).kept(low, lists)) if page else ""


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def importances(pages: DataFrame, weight: float = 0.9, bonus: float = 0.1, lists: bool = True) -> DataFrame:
    """(host, path, nodes, importance) of the merged nodes. weight: of content against presentation. bonus: of a node inside
    article or main."""

    kinds = [("path", pa.int64()), ("inside", pa.bool_()), ("style", pa.int64()), ("content", pa.int64())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column("host")
            for at in range(0, batch.num_rows, 256):
                copies, ends, held = [], [0], []
                for page in batch.column("html")[at : at + 256]:
                    flat = Flat(page.as_py())
                    copies.append(_signed(xxhash.xxh64_intdigest(_joined(flat.kept((), lists)))))
                    held += flat.nodes()
                    ends.append(len(held))
                columns = zip(*held, strict=True) if held else [()] * 4
                nodes = pa.StructArray.from_arrays([pa.array(list(x), k) for x, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])
                yield pa.RecordBatch.from_arrays([hosts[at : at + 256], pa.array(copies, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)], ["host", "copy", "nodes"])

    found = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("host is not null and html is not null")
    trees = found.mapInArrow(rows, "host string, copy long, nodes array<struct<path:long,inside:boolean,style:long,content:long>>")
    # of pages with the same article one speaks for all, whichever has the least nodes in their order
    once = saved(trees.groupBy("host", "copy").agg(F.min("nodes").alias("nodes")))
    nodes = once.select("host", F.inline("nodes"))
    prose = F.create_map(F.lit("prose"), F.lit(0).cast("long"))
    kinds = F.explode(F.when(F.col("style").isNull(), prose).otherwise(F.create_map(F.lit("style"), F.col("style"), F.lit("content"), F.col("content")))).alias("kind", "digest")
    counts = nodes.select("host", "path", "inside", kinds).groupBy("host", "path", "inside", "kind", "digest").count()
    spread = counts.groupBy("host", "path", "inside").agg(
        F.sum(F.when(F.col("kind") != "content", F.col("count"))).alias("nodes"),
        F.sum(F.when(F.col("kind") == "style", F.col("count") * F.ln("count")).otherwise(0.0)).alias("style"),
        F.sum(F.when(F.col("kind") == "content", F.col("count") * F.ln("count")).otherwise(0.0)).alias("content"),
        F.max(F.col("kind") == "prose").alias("prose"),
    )
    shared = lambda c: F.when(F.col("nodes") > 1, F.col(c) / F.col("nodes") / F.ln("nodes")).otherwise(0.0)
    # what a host has once can't be low; that leaves few prose rows for the join
    often = spread.where("nodes > 1").join(once.groupBy("host").agg(F.count("*").alias("of")), "host")
    own = F.when(F.col("prose"), 1 - F.ln("nodes") / F.ln(F.greatest("of", F.lit(2)))).otherwise(weight * (1 - shared("content")) + (1 - weight) * (1 - shared("style")))
    return often.select("host", "path", "nodes", (own + F.when(F.col("inside"), bonus).otherwise(0.0)).alias("importance"))


def extract(pages: DataFrame, threshold: float = 0.2, least: int = 5, broadcast_rows: int = 200_000, lists: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page (page_id, url, html) from its whole html.

    A null or empty page, or one without article text, gives an empty text. A null url or one without a host has no site
    to compare with. Repeated rows stay repeated. Empty table: no rows. Extra columns are left out. least: a branch that
    fewer different pages have isn't judged by importance. The low branches of all hosts are broadcast if they are at most
    ``broadcast_rows``, joined else. lists: whether what an element says of itself counts as well.
    """
    low = saved(importances(pages, lists=lists).where((F.col("nodes") >= least) & (F.col("importance") < threshold)).select("host", "path"))
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    n = low.count()
    by_host = low.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("low"))
    joined = own.join(F.broadcast(by_host) if n <= broadcast_rows else by_host, "host", "left") if n else own.withColumn("low", F.lit(None).cast("array<long>"))

    @F.pandas_udf("string")
    def text(page: pd.Series, low: pd.Series) -> pd.Series:
        known: dict[bytes, frozenset[int]] = {}
        out = []
        for p, x in zip(page, low, strict=True):
            paths: frozenset[int] = frozenset()
            if x is not None and len(x):
                key = np.asarray(x, np.int64).tobytes()
                paths = known.setdefault(key, frozenset(int(v) & 0xFFFFFFFFFFFFFFFF for v in x))
            out.append(main_text(p, paths, lists))
        return pd.Series(out, dtype=object)

    return joined.withColumn("text", text("html", "low")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


SQL = r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM inner_html),
decoded AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&') AS t
  FROM bare),
flat AS (
  SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM flat
"""
