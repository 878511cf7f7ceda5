"""From pages to the third-party table: extraction, then aggregation by site.

What a page embeds is judged inside the page, as arrays; pages need no numbers, so a task that runs again on rows in another
order counts the same, and one shuffle by (site, third party) is all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmesh.functions.domains import extract_host, private_domain
from embedmesh.functions.resources import judged_resources
from embedmesh.functions.suffixes import DEFAULT, Suffixes

_LISTS = {"SCRIPT": "scripts", "IFRAME": "iframes", "LINK": "links", "IMAGE": "images"}
_KINDS = ("script", "iframe", "image", "link")
_OF = {"scripts": 0, "iframes": 1, "images": 2, "links": 3}
_NAMES = pa.list_(pa.string())


def parse_pages(pages: DataFrame, suffixes: Suffixes = DEFAULT, with_dropped: bool = False) -> DataFrame:
    """(url, archive_ms, html) -> (url, archive_ms, scripts, iframes, links, images), each a list of distinct hosts.
    with_dropped: and dropped, the URLs without a well-formed host under a known top-level domain."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {n: [] for n in _LISTS.values()}
            dropped = []
            for url, page in zip(batch.column("url"), batch.column("html"), strict=True):
                hosts, bad = judged_resources(url.as_py(), page.as_py(), suffixes)
                for kind, name in _LISTS.items():
                    found[name].append([h for h, k in hosts if k == kind])
                dropped.append(bad)
            columns = [batch.column("url"), batch.column("archive_ms"), *(pa.array(x, _NAMES) for x in found.values())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(dropped, _NAMES)] * with_dropped)], ["url", "archive_ms", *found, *["dropped"] * with_dropped])

    lists = ", ".join(f"{n} array<string>" for n in (*_LISTS.values(), *["dropped"] * with_dropped))
    return pages.select(F.col("url").cast("string"), F.col("archive_ms").cast("long"), F.col("html").cast("string")).mapInArrow(rows, f"url string, archive_ms long, {lists}")


def dropped_hosts(pages: DataFrame, suffixes: Suffixes = DEFAULT) -> DataFrame:
    """(value, count): URLs in pages that were left out for their hosts, with the pages that hold them."""
    return parse_pages(pages, suffixes, with_dropped=True).select(F.explode("dropped").alias("value")).groupBy("value").count()


_SITE = "domain string, url string, trackers array<struct<domain:string,script:int,iframe:int,image:int,link:int>>, bad array<string>"


#: Pages that are Python objects at a time.
_PAGES = 1000


def _sites(parsed: DataFrame, https_mode: str, suffixes: Suffixes) -> DataFrame:
    """(domain, url, trackers, bad): of each page its registrable domain, the distinct ones of its hosts with a flag by type
    (without its own), and the hosts that have none. parsed: parsed pages, or (url, html), which are parsed in the same pass."""
    raw = "html" in parsed.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(1 << 14)
        def domain(name: str | None) -> str | None:
            return private_domain(name, https_mode, suffixes)

        @lru_cache(1 << 14)
        def host_of(url: str) -> str | None:
            return extract_host(url, suffixes)

        def by_type(batch: pa.RecordBatch, urls: list[str | None]) -> Iterator[list[list[str] | None]]:
            """For each page its hosts by type, in the order of _OF."""
            if not raw:
                yield from zip(*(batch.column(n).to_pylist() for n in _OF), strict=True)
                return
            for url, page in zip(urls, batch.column("html").to_pylist(), strict=True):
                own: list[list[str]] = [[], [], [], []]
                for host, kind in judged_resources(url, page, suffixes, host_of)[0]:
                    own[_OF[_LISTS[kind]]].append(host)
                yield own

        kind = pa.list_(pa.struct([("domain", pa.string()), *((k, pa.int32()) for k in _KINDS)]))
        for batch in (b.slice(at, _PAGES) for b in batches for at in range(0, b.num_rows, _PAGES)):
            urls = batch.column("url").to_pylist()
            domains, trackers, bad = [domain(u) for u in urls], [], []
            for own, lists in zip(domains, by_type(batch, urls), strict=True):
                flags: dict[str, list[int]] = {}
                odd: dict[str, None] = {}
                for at, hosts in enumerate(lists) if own is not None else ():
                    for host in hosts or ():
                        name = domain(host)
                        if name is None:
                            odd[host] = None
                        elif name.lower() != own.lower():
                            flags.setdefault(name, [0, 0, 0, 0])[at] = 1
                trackers.append([{"domain": n, **dict(zip(_KINDS, x, strict=True))} for n, x in flags.items()])
                bad.append([h for h in odd if h is not None])
            yield pa.RecordBatch.from_arrays([pa.array(domains, pa.string()), batch.column("url"), pa.array(trackers, kind), pa.array(bad, _NAMES)], ["domain", "url", "trackers", "bad"])

    needed = [F.col("html").cast("string")] if raw else list(map(F.col, _OF))
    return parsed.select(F.col("url").cast("string"), *needed).mapInArrow(rows, _SITE)


def _counts(sites: DataFrame) -> DataFrame:
    """(domain, third_party, pages, by type): of each site the pages that embed each third party, and with a null third party
    all its pages."""
    nothing = F.from_json(F.lit("[{}]"), sites.schema["trackers"].dataType)
    each = sites.where("domain is not null").select("domain", F.explode(F.concat(nothing, "trackers")).alias("t"))
    return each.groupBy("domain", F.col("t.domain").alias("third_party")).agg(F.count("*").alias("pages"), *[F.sum(f"t.{k}").alias(k) for k in _KINDS])


def third_party_rows(parsed: DataFrame, https_mode: str = "accept", suffixes: Suffixes = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((domain, third_party, script, iframe, image, link): pages of the site that embed it by each type; (domain, num_pages);
    (marker, value, count) of pages and hosts without a registrable domain).

    A page counts for its site even if it embeds nothing; third parties of the site's own domain don't count. The three are
    views of parsed: one that took work is better written first. For one view, parsed can be the pages (url, html) themselves:
    extraction and aggregation by site then share a pass, and a task one Python worker.
    """
    sites = _sites(parsed, https_mode, suffixes)
    named = sites.where("domain is not null")
    rows = named.select("domain", F.explode("trackers").alias("t")).groupBy("domain", F.col("t.domain").alias("third_party")).agg(*[F.sum(f"t.{k}").alias(k) for k in _KINDS])
    bad_pages = sites.where("domain is null").select(F.lit("INVALID_TRACKED_HOST").alias("marker"), F.col("url").alias("value"))
    bad_hosts = named.select(F.lit("INVALID_TRACKING_HOST").alias("marker"), F.explode("bad").alias("value"))
    return rows, named.groupBy("domain").agg(F.count("*").alias("num_pages")), bad_pages.unionAll(bad_hosts).groupBy("marker", "value").count()


def third_party_table(parsed: DataFrame, https_mode: str = "accept", suffixes: Suffixes = DEFAULT) -> DataFrame:
    """(domain, num_pages, trackers array<struct>), one row a site, from one pass over parsed, or over pages (url, html)."""
    tracker = F.struct(F.col("third_party").alias("domain"), *_KINDS)
    return _counts(_sites(parsed, https_mode, suffixes)).groupBy("domain").agg(
        F.sum(F.when(F.col("third_party").isNull(), F.col("pages"))).alias("num_pages"), F.collect_list(F.when(F.col("third_party").isNotNull(), tracker)).alias("trackers")
    )
