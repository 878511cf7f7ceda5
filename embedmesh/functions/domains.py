"""Hosts of URLs as they occur in pages and scripts, and registrable domains."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from embedmesh.functions.suffixes import DEFAULT, Suffixes

_STOP = re.compile(r"[/:]")
_LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\Z")
_ODD = re.compile(r"[\[\]{}_<>|^\\%]")
#: Providers whose customers' hosts count as the provider.
PROVIDERS = ("amazonaws.com", "cloudfront.net", "googlecode.com", "blogspot.com", "googleapis.com", "appspot.com")
#: Of these the bare names count too; those of the others are suffixes without an owner.
BARE = {"cloudfront.net", "blogspot.com"}


def could_be_url(text: str) -> bool:
    return "." in text and not re.search(r"[ \t\r\n@]", text)


def internal_prefix(source_url: str) -> str:
    """What relative links of a page are appended to."""
    head, slash, _ = source_url.rpartition("/")
    return head + slash if slash else source_url + "/"


def expand_internal(prefix: str, link: str) -> str:
    if link.startswith(("http", "ftp")):
        return link
    return "http:" + link if link.startswith("//") else prefix + link


def parse_domain(url: str) -> str:
    """The host part of anything URL-like: it ends at the first slash or colon after the first dot, and begins after the last
    slash before that dot or after the last equals sign (as in ``&domain=host``), whichever is later."""
    dot = url.find(".")
    stop = _STOP.search(url, dot) if dot >= 0 else None
    end = stop.start() if stop else len(url)
    slash = url.rfind("/", 0, dot if dot >= 0 else len(url))
    return url[max(slash, url.rfind("=", 0, end)) + 1 : end]


def is_domain(name: str, suffixes: Suffixes = DEFAULT) -> bool:
    """At least two well-formed labels, the last a known top-level domain."""
    labels = name.removesuffix(".").split(".")
    return len(labels) > 1 and len(name) <= 253 and all(map(_LABEL.match, labels)) and suffixes.known(labels[-1].lower())


def extract_host(candidate: str, suffixes: Suffixes = DEFAULT) -> str | None:
    """The host, empty for an empty candidate, None for a malformed one."""
    if not candidate:
        return ""
    found = parse_domain(candidate).removeprefix(".")
    return found if is_domain(found, suffixes) else None


def private_domain(url: str | None, https_mode: str = "accept", suffixes: Suffixes = DEFAULT) -> str | None:
    """The registrable domain of a URL or bare host; None where there is none. https_mode "reject": only http:// is taken off,
    so that https URLs have no domain."""
    if not url:
        return None
    plain = _ODD.sub("", url)
    scheme = plain.startswith("http://") or (https_mode == "accept" and plain.startswith("https://"))
    if scheme:
        host = plain.split("://", 1)[1]
        host = re.split(r"[/?#]", host, maxsplit=1)[0].rsplit("@", 1)[-1].split(":", 1)[0]
    else:
        host = plain
    host = host.lower()
    for provider in PROVIDERS:
        if host.endswith("." + provider):
            return provider
        if host == provider:
            return provider if provider in BARE else None
    labels = host.removesuffix(".").split(".")
    if not suffixes.known(labels[-1]) or not all(map(_LABEL.match, labels)):
        return None
    size = suffixes.size(labels)
    return ".".join(labels[-size - 1 :]) if len(labels) > size else None


def private_domain_column(url: Column, https_mode: str = "accept", suffixes: Suffixes = DEFAULT) -> Column:
    """Vectorised; repeated URLs of a batch are worked out once."""

    @F.pandas_udf("string")
    def found(urls: pd.Series) -> pd.Series:
        known = {u: private_domain(u, https_mode, suffixes) for u in urls.dropna().unique()}
        return urls.map(known).astype(object).where(urls.notna(), None)

    return found(url)


def host_column(url: Column, suffixes: Suffixes = DEFAULT) -> Column:
    """extract_host of each; null for null."""

    @F.pandas_udf("string")
    def found(urls: pd.Series) -> pd.Series:
        known = {u: extract_host(u, suffixes) for u in urls.dropna().unique()}
        return urls.map(known).astype(object).where(urls.notna(), None)

    return found(url)


def last_two_labels(domain: Column) -> Column:
    return F.substring_index(domain, ".", -2)
