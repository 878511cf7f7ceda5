"""External resources of a page: the hosts of its script, iframe, image and link tags, and of the URLs in its scripts."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from embedmesh.functions.domains import could_be_url, expand_internal, extract_host, internal_prefix
from embedmesh.functions.markup import ATTRIBUTE, RAW, Tags
from embedmesh.functions.suffixes import DEFAULT, Suffixes

TYPES = {"script": "SCRIPT", "iframe": "IFRAME", "img": "IMAGE", "link": "LINK"}
SCHEMA = "array<struct<url:string,type:string>>"
#: Comments, strings (an unterminated one ends with its line) and template strings of a script; then what can precede a regular expression.
_CODE = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"((?:[^"\\\n]|\\.)*+)"?|'((?:[^'\\\n]|\\.)*+)'?|`((?:[^`\\]|\\.)*+)`?|(\breturn|\btypeof|[(,=:\[!&|?{};+*%~^<>-])\s*/((?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+)/""", re.S
)
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|\r?\n|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "xu" and len(x) > 1:
            return chr(int(x[1:], 16))
        return "" if x[-1] == "\n" else _PLAIN.get(x, x)

    return _ESCAPE.sub(one, text) if "\\" in text else text


def code_strings(code: str) -> list[str]:
    """String literals (unescaped) and the patterns of regular expressions, of code that need not be whole."""
    found, at = [], 0
    while m := _CODE.search(code, at):
        quoted = m[1] if m[1] is not None else m[2] if m[2] is not None else m[3]
        if quoted is not None:
            found.append(_unescaped(quoted))
        elif m[5] is not None:
            found.append(m[5])
        at = max(m.end(), at + 1)
    return found


def _script_urls(code: str) -> list[str]:
    found = []
    for text in code_strings(code):
        if "." not in text:
            continue
        for token in re.split("[\"']", text):
            token = token.strip()
            if could_be_url(token):
                found.append(token.replace("\\.", "."))
    return found


def _uris(prefix: str, page: str) -> list[tuple[str, str]]:
    """(URL as it stands, type) of everything that the page takes from elsewhere, in the order in which it occurs."""
    found, tags = [], Tags(page)
    while tag := tags.next():
        _, name, raw, closing = tag
        if closing or not name:
            continue
        if name in TYPES:
            own = {}
            for key, value in ATTRIBUTE.findall(raw):
                if value:
                    own.setdefault(key.lower(), html.unescape(value.strip("\"'") if value[0] in "\"'" else value).strip())
            needed = {"iframe": "src", "img": "src", "link": "href"}.get(name)
            if needed is None or needed in own:
                uri = own.get("src", "")
                uri = uri if "." in uri else own.get("href", "")
                if "." in uri:
                    found.append((expand_internal(prefix, uri), TYPES[name]))
        if name in RAW:
            begin, end = tags.raw(name)
            if name == "script" and end - begin > 1:
                found += [(u, "SCRIPT") for u in _script_urls(page[begin:end])]
    return found


def judged_resources(
    source_url: str | None, page: str | None, suffixes: Suffixes = DEFAULT, host_of: Callable[[str], str | None] | None = None
) -> tuple[list[tuple[str, str]], list[str]]:
    """(distinct (host, type), in the order in which they occur; distinct URLs whose host is malformed or under no known
    top-level domain). host_of: extract_host under the suffixes, for callers that keep what it found."""
    found: dict[tuple[str, str], None] = {}
    bad: dict[str, None] = {}
    for uri, kind in _uris(internal_prefix(source_url or ""), page or ""):
        host = host_of(uri) if host_of else extract_host(uri, suffixes)
        if host:
            found[host, kind] = None
        elif host is None:
            bad[uri] = None
    return list(found), list(bad)


def extract_resources(source_url: str | None, page: str | None, suffixes: Suffixes = DEFAULT) -> list[tuple[str, str]]:
    """Distinct (host, type), in the order in which they occur. Linear in the page; malformed hosts are left out."""
    return judged_resources(source_url, page, suffixes)[0]


def resources_column(url: Column, page: Column) -> Column:
    @F.pandas_udf(SCHEMA)
    def found(urls: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([[{"url": h, "type": t} for h, t in extract_resources(u, p)] for u, p in zip(urls, pages, strict=True)], dtype=object)

    return found(url, page)
