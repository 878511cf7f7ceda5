"""Byte-level BPE ids at corpus speed: the text is cut where the tokenizer's own pattern cuts it, and each distinct piece is
encoded once by the tokenizers library and remembered. Texts with characters outside well-settled ranges, or with the
string of a special token, go to the library whole."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE, _BREAK = range(6)
#: Blocks whose characters have had the same categories for many versions of Unicode.
_SETTLED = ((0x0, 0x370), (0x400, 0x482), (0x2010, 0x2028), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
#: Pieces in each of two generations of the memory.
_KEEP = 400_000
#: Characters that are cut at a time.
_CHUNK = 1 << 21


@lru_cache(1)
def _classes() -> np.ndarray:
    found = np.full(0x110001, _UNSURE, np.uint8)
    for a, b in _SETTLED:
        chars = [chr(c) for c in range(a, b)]
        for name, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE)):
            test = regex.compile(name)
            for c in chars:
                if test.match(c):
                    found[ord(c)] = kind
        own = found[a:b]
        own[own == _UNSURE] = _OTHER
    # not spaces to the pattern, whatever a library thinks of them
    found[0x1C:0x20] = _UNSURE
    return found


def cut(texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The pieces that PATTERN finds in each text, found with array operations; after each text's pieces comes one that is
    the break between texts. Also the places of the breaks, and which texts hold a character outside the settled ranges
    (their pieces don't count)."""
    raw = "\0".join([*texts, ""]).encode("utf-8")
    data = np.frombuffer(raw, np.uint8)
    at_byte = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[code]
    breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind[breaks] = _BREAK
    unsure = np.zeros(len(texts), bool)
    unsure[np.searchsorted(breaks, np.flatnonzero(kind == _UNSURE))] = True
    n = len(code)
    space = kind == _SPACE
    solid = ~space & (kind != _BREAK)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    # a word takes one blank before it
    start[1:] &= ~((code[:-1] == 32) & solid[1:])
    # the last of several spaces before a word stands alone (or leads the word)
    start[:-1] |= space[:-1] & solid[1:]
    # contractions are pieces of their own where a piece begins with the apostrophe
    quote = np.flatnonzero((code == 39) & start)
    if len(quote):
        after = np.concatenate((code, np.zeros(3, np.uint32)))
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (one == ord(x)) & (two == ord(y))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    start[breaks] = True
    where = np.flatnonzero(start)
    offsets = np.append(at_byte[where], len(data)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(raw))
    return found, np.searchsorted(where, breaks), unsure


def pieces(text: str) -> list[str] | None:
    """The pieces of one text; None where a character isn't in a settled range."""
    found, breaks, unsure = cut([text])
    return None if unsure[0] else found[: breaks[0]].to_pylist()


def _byte_chars() -> list[str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    table |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in table)}
    return [table[b] for b in range(256)]


class Encoder(dict):
    """Piece -> its ids as little-endian unsigned 16- or 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.model = self.tokenizer.model
        self.chars = dict(enumerate(_byte_chars()))
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def number(self, id_: int) -> np.ndarray:
        return np.array([id_], self.kind)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _KEEP:
            self.older = dict(self)
            self.clear()
        if (found := self.older.get(piece)) is not None:
            self[piece] = found
            return found
        mapped = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.chars)
        found = np.array([t.id for t in self.model.tokenize(mapped)], self.kind).tobytes()
        if len(piece) <= 40:
            self[piece] = found
        return found

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text; null: none."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= _CHUNK:
                out += self._ids(some)
                some, size = [], 0
        return out + self._ids(some)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        found, breaks, whole = cut(texts)
        if self.special is not None:
            whole |= [self.special.search(t) is not None for t in texts]
        coded = found.dictionary_encode()
        each = [self[p] for p in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy()
        width = int(self.kind[-1])
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // width
        flat = np.frombuffer(b"".join(each), self.kind)
        first = np.cumsum(sizes) - sizes
        count = sizes[codes]
        count[breaks] = 0
        ends = np.cumsum(count)
        ids = flat[np.repeat(first[codes] - (ends - count), count) + np.arange(ends[-1])]
        out = np.split(ids, ends[breaks][:-1])
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.kind)
        return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)
