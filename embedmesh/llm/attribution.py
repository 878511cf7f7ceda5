"""Token counts by section, from token spans.

Every document is encoded once, whole. A byte-level vocabulary spells each token's bytes, so a running sum of token lengths
gives the tokens' byte spans, and the text's own bytes turn these into character spans. The spans are interval-joined with
the sections (both are sorted, so one binary search does it) and a token that crosses a border goes to one section by an
explicit rule:

* ``first``: the section of its first byte,
* ``last``: that of its last byte,
* ``most``: the one that holds most of its bytes, the earlier one on ties.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most")


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for raw, i in ranks.items():
            self.length[i] = len(raw)

    def ends(self, text: str) -> np.ndarray:
        """The byte after each token of the whole text."""
        return np.cumsum(self.length[self.encoding.encode_to_numpy(text, disallowed_special=())])


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def paragraphs(text: str) -> list[int]:
    """Where sections begin, as characters: after every line break. Section 0 begins at 0."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def allocate(token_ends: np.ndarray, borders: np.ndarray, rule: str = "first") -> np.ndarray:
    """The section of each token. borders: byte at which each section begins, ascending, the first 0."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    begins = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    first = np.searchsorted(borders, begins, "right") - 1
    last = np.searchsorted(borders, token_ends - 1, "right") - 1
    if rule == "first":
        return first
    if rule == "last":
        return last
    out = first.copy()
    limits = np.append(borders, np.iinfo(np.int64).max)
    for k in np.flatnonzero(first != last).tolist():
        over = range(int(first[k]), int(last[k]) + 1)
        out[k] = max(over, key=lambda s: (min(token_ends[k], limits[s + 1]) - max(begins[k], limits[s]), -s))
    return out


def count_text(text: str | None, own: Encoder, rule: str, sections: Callable[[str], list[int]] = paragraphs) -> list[tuple[int, int, int, int]]:
    """(section, first character, character after, tokens) of each section; a null or empty text has one, empty."""
    if not text:
        return [(0, 0, 0, 0)]
    starts = sections(text)
    if text.isascii():
        borders = np.array(starts, np.int64)
    else:
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        borders = np.flatnonzero((raw & 0xC0) != 0x80)
        borders = np.append(borders, len(raw))[np.array(starts)]
    counts = np.bincount(allocate(own.ends(text), borders, rule), minlength=len(starts)) if len(starts) else np.zeros(0, int)
    # an empty last section begins where the text ends
    return list(zip(range(len(starts)), starts, [*starts[1:], len(text)], counts.tolist(), strict=True))


def count_sections(docs: DataFrame, path: str, pattern: str, rule: str = "first", sections: Callable[[str], list[int]] = paragraphs) -> DataFrame:
    """(doc_id, section, start, end, n_tokens): the sections of each whole text with their character spans and tokens; the
    counts of a document add up to its tokens.

    A null or empty text has one empty section. A null doc_id is kept; repeated rows give their sections again. Empty
    table: no rows. Extra columns are left out. sections: text -> ascending characters at which sections begin, the first 0.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern)
        names = ["doc_id", "section", "start", "end", "n_tokens"]
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                found = count_text(text if isinstance(text, str) else None, own, rule, sections)
                out += [(doc_id, *x) for x in found]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
                    out = []
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    thin = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return thin.mapInPandas(rows, "doc_id long, section int, start long, end long, n_tokens long")
