"""SentencePiece BPE encoding with seeded merge dropout, and decoding.

Merging works on units (a run of blanks and the word after it: no piece crosses into the next). Each unit's candidate
merges wait in an agenda ordered by score, then place. A candidate taken from the agenda is skipped if a keyed hash of
(seed, document key, number of the unit in its document, the candidate's three borders) falls under the dropout rate. So
every occurrence of a word is cut on its own, the variety grows with the corpus, and a task that runs again gives the same
ids. Only merges make pieces, so every segmentation decodes to the text: characters without a piece fall back to bytes, and
so does U+2581, which would otherwise decode to a blank.

A block's distinct units are first merged without dropout, with a trace of the candidates that were taken. An occurrence
none of whose traced candidates is skipped ends in just that segmentation; all others are merged again under their own key.
Both run for many units at a time, and nothing is remembered from block to block.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedmesh.llm.common import in_blocks

BLANK = "▁"
_MASK = (1 << 64) - 1
#: The longest unit that is merged along with others.
_LONG = 48
#: Characters of texts, units, and traced candidates that are worked on at a time.
_CHUNK = 1 << 20
_UNITS = 1 << 14
_TRACED = 1 << 18
#: The rank of what can't merge.
NONE = np.iinfo(np.int32).max


class Model:
    """The pieces of a BPE model with byte fallback."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        merges = []
        self.piece_id: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(BLANK, " ")
                self.piece_id[text] = i
                self.bytes_of.append(text.encode())
                merges.append((-sp.get_score(i), text))
        #: a smaller rank merges first; equal scores share a rank
        scores = {s: r for r, s in enumerate(sorted({s for s, _ in merges}))}
        self.rank = {text: scores[s] for s, text in merges}

    def unit(self, unit: str, key: int, limit: int) -> list[int]:
        """Ids of one unit. limit: dropout rate times 2**32."""
        n = len(unit)
        rank = self.rank
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        agenda = []
        for i in range(n - 1):
            if (r := rank.get(unit[i : i + 2])) is not None:
                agenda.append((r, i, i + 1, i + 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, k = heapq.heappop(agenda)
            if end[i] != j or end[j] != k:
                continue
            if limit:
                h = (key ^ (i * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F + k * 0x165667B19E3779F9)) & _MASK
                h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
                if h >> 32 < limit:
                    continue
            end[i], end[j] = k, 0
            before[k] = i
            if k < n and (r := rank.get(unit[i : end[k]])) is not None:
                heapq.heappush(agenda, (r, i, k, end[k]))
            p = before[i]
            if p >= 0 and (r := rank.get(unit[p:k])) is not None:
                heapq.heappush(agenda, (r, p, i, k))
        out, i = [], 0
        while i < n:
            k = end[i]
            if (found := self.piece_id.get(unit[i:k])) is not None:
                out.append(found)
            else:
                out += [self.byte_ids[b] for b in unit[i:k].encode("utf-8")]
            i = k
        return out


class Pairs:
    """(left symbol, right symbol) -> rank and merged symbol, looked up for arrays at once (open addressing). Symbols are
    piece ids, and numbers after them for characters that only occur inside pieces."""

    def __init__(self, model: Model):
        n = len(model.bytes_of)
        known = dict(model.piece_id)
        for text in list(known):
            for ch in text:
                known.setdefault(ch, n + len(known))
        self.symbol = known
        self.span = max(known.values(), default=0) + 1
        #: code point -> symbol; -1: it never merges
        self.of_code = np.full(0x110000, -1, np.int32)
        for text, k in known.items():
            if len(text) == 1:
                self.of_code[ord(text)] = k
        keys, ranks, merged = [], [], []
        for text, r in model.rank.items():
            for k in range(1, len(text)):
                if text[:k] in known and text[k:] in known:
                    keys.append(known[text[:k]] * self.span + known[text[k:]])
                    ranks.append(r)
                    merged.append(known[text])
        self.bits = max(4, len(keys).bit_length() + 3)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        self.probes = 1
        for key, r, m, h in zip(keys, ranks, merged, self._hash(np.array(keys, np.int64)).tolist(), strict=True):
            p = 0
            while self.keys[(h + p) & ((1 << self.bits) - 1)] >= 0:
                p += 1
            at = (h + p) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at], self.merged[at] = key, r, m
            self.probes = max(self.probes, p + 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in ranks and merged; a place whose rank is NONE where there is no such pair."""
        keys = left.astype(np.int64) * self.span + right
        at = self._hash(keys)
        miss = self.keys[at] != keys
        for _ in range(self.probes - 1):
            todo = np.flatnonzero(miss & (self.keys[at] >= 0))
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            miss[todo] = self.keys[at[todo]] != keys[todo]
        at[miss] = self.empty
        return at

    @property
    def empty(self) -> int:
        if not hasattr(self, "_empty"):
            self._empty = int(np.flatnonzero(self.keys < 0)[0])
        return self._empty


def _place(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    return i.astype(np.uint64) * a + j.astype(np.uint64) * b + k.astype(np.uint64) * c


def _skipped(keys: np.ndarray, place: np.ndarray, limit: int) -> np.ndarray:
    """Model.unit's test, for arrays."""
    h = keys ^ place
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)) < np.uint64(limit)


def occurrence_keys(document: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of the unit with that number in the document with that (hashed) key."""
    h = document + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def merge_many(pairs: Pairs, symbols: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Many units of one length at once, each with its own agenda: a row of ranks whose least (then leftmost) candidate is
    merged. A candidate that the hash skips never gets a rank. Returns (symbols, number of symbols, places of the merges in
    their order) of each unit."""
    m, n = symbols.shape
    out, count, taken = np.zeros((m, n), np.int32), np.full(m, n), np.zeros((m, max(1, n - 1)), np.uint64)
    sym = symbols.astype(np.int32)
    # borders[:, x] is where symbol x begins; one more column for the end, then padding with the end
    borders = np.tile(np.arange(n + 2, dtype=np.int16).clip(max=n), (m, 1))
    where = np.arange(m)

    def ranked(left, right, key, i, j, k):
        at = pairs.find(left, right)
        rank = pairs.ranks[at]
        if limit:
            able = np.flatnonzero(rank != NONE)
            rank[able[_skipped(key[able], _place(i[able], j[able], k[able]), limit)]] = NONE
        return rank

    rank = np.full((m, n), NONE, np.int32)
    if n > 1:
        grid = np.arange(n - 1)
        rank[:, :-1] = ranked(
            sym[:, :-1].ravel(), sym[:, 1:].ravel(), np.repeat(keys, n - 1), np.tile(grid, m), np.tile(grid + 1, m), np.tile(grid + 2, m)
        ).reshape(m, n - 1)
    size = np.full(m, n)
    while len(where):
        best = rank.argmin(1)
        rows = np.arange(len(where))
        live = rank[rows, best] != NONE
        if not live.all():
            over = ~live
            out[where[over], : sym.shape[1]] = sym[over]
            count[where[over]] = size[over]
            sym, borders, rank, keys, where, size, best = (x[live] for x in (sym, borders, rank, keys, where, size, best))
            if not len(where):
                break
            rows = np.arange(len(where))
        width = sym.shape[1]
        taken[where, n - width] = _place(borders[rows, best], borders[rows, best + 1], borders[rows, best + 2])
        new = pairs.merged[pairs.find(sym[rows, best], sym[rows, best + 1])]
        shift = np.arange(width - 1)[None] + (np.arange(width - 1)[None] > best[:, None])
        sym = np.take_along_axis(sym, shift, 1)
        sym[rows, best] = new
        rank = np.take_along_axis(rank, shift, 1)
        shift = np.arange(borders.shape[1] - 1)[None] + (np.arange(borders.shape[1] - 1)[None] > best[:, None])
        borders = np.take_along_axis(borders, shift, 1)
        size = size - 1
        rank[rows, best] = NONE
        for at in (best, best - 1):
            ok = np.flatnonzero((at >= 0) & (at + 1 < size))
            x = at[ok]
            rank[ok, x] = ranked(sym[ok, x], sym[ok, x + 1], keys[ok], borders[ok, x], borders[ok, x + 1], borders[ok, x + 2])
    return out, count, taken


def cut(texts: list[str], of_code: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of all texts, each followed by a break (a unit of its own); all code points; where each unit begins among them;
    the places of the breaks among the units. A character that never merges is a unit of its own."""
    raw = "\0".join([*texts, ""]).encode("utf-8")
    data = np.frombuffer(raw, np.uint8)
    at_byte = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    blank, own = code == 32, of_code[code] < 0
    start = np.empty(len(code), bool)
    start[0] = True
    start[1:] = (blank[1:] & ~blank[:-1]) | own[1:] | own[:-1]
    start[breaks] = True
    start[breaks[:-1] + 1] = True
    where = np.flatnonzero(start)
    offsets = np.append(at_byte[where], len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(raw)), code, where, np.searchsorted(where, breaks)


class Pool:
    """Runs of values, added in any order and laid end to end; size and first of each run by its number."""

    def __init__(self, runs: int, kind):
        self.size, self.first, self.held, self.end = np.zeros(runs, np.int64), np.zeros(runs, np.int64), [np.empty(0, kind)], 0

    def add(self, numbers: np.ndarray, matrix: np.ndarray, count: np.ndarray) -> None:
        """The first ``count`` values of each row."""
        self.held.append(matrix[np.arange(matrix.shape[1])[None] < count[:, None]].astype(self.held[0].dtype))
        self.size[numbers], self.first[numbers] = count, self.end + np.cumsum(count) - count
        self.end += int(count.sum())

    def values(self, size: np.ndarray, first: np.ndarray, flat: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        return flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def flat(self) -> np.ndarray:
        self.held = [np.concatenate(self.held)]
        return self.held[0]


class Codec:
    def __init__(self, path: str, seed: int, rate: float):
        self.model = Model(path)
        self.pairs = Pairs(self.model)
        self.salt = xxhash.xxh64_intdigest(str(seed))
        self.limit = min(1 << 32, round(rate * (1 << 32)))
        self.kind = "<u2" if len(self.model.bytes_of) <= 1 << 16 else "<u4"

    def document(self, key: int) -> int:
        return xxhash.xxh64_intdigest(str(key), self.salt)

    def encode(self, text: str | None, key: int = 0) -> np.ndarray:
        return self.encode_many([text], [key])[0]

    def encode_many(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray]:
        """The ids of each whole text; the first piece leads with a blank that isn't the text's, as such models want. Texts
        over _CHUNK characters are worked on in parts that end where a unit does."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        base = [0] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            if not held:
                return
            documents = np.array([self.document(keys[i]) for i, _ in held], np.uint64)
            for (i, _), (ids, units) in zip(held, self._encoded([t for _, t in held], documents, np.array([base[i] for i, _ in held])), strict=True):
                out[i].append(ids)
                base[i] += units
            held.clear()

        for i, text in enumerate(texts):
            for part in _in_parts(" " + text) if text else ():
                held.append((i, part))
                size += len(part)
                if size >= _CHUNK:
                    flush()
                    size = 0
        flush()
        return [np.concatenate(x) if len(x) != 1 else x[0] for x in ([np.empty(0, self.kind)] if not y else y for y in out)]

    def _encoded(self, texts: list[str], documents: np.ndarray, base: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(ids, number of units) of each text. base: the number of its first unit."""
        units, code, where, breaks = cut(texts, self.pairs.of_code)
        length = np.diff(np.append(where, len(code)))
        coded = units.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        number = len(coded.dictionary)
        seen = np.empty(number, np.int64)
        seen[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        ids, trace = Pool(number, self.kind), Pool(number, np.uint64)
        # characters that occur inside pieces only can end up without an id: such units go alone, as do long ones
        symbol = self.pairs.of_code[code]
        odd = np.maximum.reduceat(symbol, where) >= len(self.model.bytes_of)
        alone = (odd | (length > _LONG))[seen] | (symbol[where[seen]] < 0)
        self._merged(ids, trace, np.flatnonzero(~alone), seen[~alone], length, where, symbol, np.zeros(len(codes), np.uint64), 0)
        for k in np.flatnonzero(alone).tolist():
            text = coded.dictionary[k].as_py()
            if len(text) == 1 or not self.limit:
                self._one(ids, k, text, 0, 0)
        size, first, flat = ids.size[codes], ids.first[codes], ids.flat()
        size[breaks] = 0
        counted = np.diff(np.concatenate(([-1], breaks)))
        if self.limit:
            document = np.repeat(np.arange(len(texts)), counted)
            start = np.concatenate(([0], breaks[:-1] + 1))
            key = occurrence_keys(documents[document], np.arange(len(codes)) - start[document] + base[document])
            again = self._changed(trace, codes, key)
            slow = np.flatnonzero(alone[codes] & (length > 1))
            again[slow] = again[breaks] = False
            again = np.flatnonzero(again)
            own = Pool(len(again) + len(slow), self.kind)
            self._merged(own, None, np.arange(len(again)), again, length, where, symbol, key, self.limit)
            for n, (at, k) in enumerate(zip(slow.tolist(), codes[slow].tolist(), strict=True), len(again)):
                self._one(own, n, coded.dictionary[k].as_py(), int(key[at]), self.limit)
            changed = np.concatenate((again, slow))
            size[changed], first[changed] = own.size, own.first + len(flat)
            flat = np.concatenate((flat, own.flat()))
        got = ids.values(size, first, flat)
        ends = np.cumsum(size)[breaks]
        return list(zip(np.split(got, ends[:-1]), (counted - 1).tolist(), strict=True))

    def _one(self, pool: Pool, number: int, text: str, key: int, limit: int) -> None:
        found = [self.model.byte_ids[b] for b in text.encode()] if text == BLANK else self.model.unit(text, key, limit)
        pool.add(np.array([number]), np.array([found]), np.array([len(found)]))

    def _merged(self, ids: Pool, trace: Pool | None, numbers: np.ndarray, at: np.ndarray, length: np.ndarray, where: np.ndarray, symbol: np.ndarray, key: np.ndarray, limit: int) -> None:
        """Merges the units at those places and adds them to the pools under their numbers."""
        for n in np.unique(length[at]).tolist():
            own = np.flatnonzero(length[at] == n)
            for some in np.split(own, range(_UNITS, len(own), _UNITS)):
                got, count, taken = merge_many(self.pairs, symbol[where[at[some]][:, None] + np.arange(n)], key[at[some]], limit)
                ids.add(numbers[some], got, count)
                if trace is not None:
                    trace.add(numbers[some], taken, n - count)

    def _changed(self, trace: Pool, codes: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether one of the unit's traced candidates is skipped at each occurrence."""
        found, flat, size = np.zeros(len(codes), bool), trace.flat(), trace.size[codes]
        which = np.flatnonzero(size)
        if not len(which):
            return found
        total = np.cumsum(size[which])
        for some in np.split(which, np.unique(np.searchsorted(total, np.arange(_TRACED, total[-1], _TRACED), "left"))):
            if len(some):
                places = trace.values(size[some], trace.first[codes[some]], flat)
                skipped = _skipped(np.repeat(key[some], size[some]), places, self.limit)
                found[some] = np.logical_or.reduceat(skipped, np.cumsum(size[some]) - size[some])
        return found

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.model.bytes_of.__getitem__, ids.tolist()))[1:].decode("utf-8")


def _in_parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _CHUNK:
        # a unit begins at a blank after another character
        end = at + _CHUNK
        while 0 <= (end := text.find(" ", end)) and text[end - 1] == " ":
            end += 1
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


@lru_cache(4)
def codec(path: str, seed: int, rate: float) -> Codec:
    """One for each worker process."""
    return Codec(path, seed, rate)


def encode(docs: DataFrame, path: str, seed: int = 1, rate: float = 0.1, key: str = "doc_id", with_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs and the columns piece_ids array<int> (if with_ids), n_pieces long, ids_crc32 long (of the ids as little-endian
    unsigned 32-bit numbers) and lossless boolean (whether they decode to the very text); columns of those names are
    replaced. keep: the columns of docs that come back from the workers; None: all.

    Null or empty text: no ids, lossless. A null key counts as 0. Repeated rows get equal ids. Empty table: no rows. rate 0
    gives the model's own best segmentation, rate 1 single characters.
    """
    made = T.StructType([T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())])
    if with_ids:
        made.add("piece_ids", T.ArrayType(T.IntegerType()))
    own = docs.drop(*made.names)
    keep = [c for c in own.columns if keep is None or c in keep]
    plain = T.StructType([own.schema[c] for c in keep])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, seed, rate)
        for batch in batches:
            at = 0
            for texts in in_blocks(batch.column("text"), _CHUNK):
                part = batch.slice(at, len(texts))
                at += len(texts)
                keys = part.column("_key").to_pylist()
                found = c.encode_many(texts, keys)
                columns = [
                    pa.array(list(map(len, found)), pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    pa.array([c.decode(x) == (t or "") for t, x in zip(texts, found, strict=True)], pa.bool_()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), *columns], [*keep, *made.names])

    keyed = own.select(*dict.fromkeys([*keep, "text"]), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_key"))
    return keyed.mapInArrow(work, T.StructType([*plain.fields, *made.fields]))


def decode(ids: DataFrame, path: str, column: str = "piece_ids") -> DataFrame:
    """ids and the column decoded string. Null ids: null; none: the empty text. Ids out of the model's range: null."""

    @F.pandas_udf("string")
    def work(column: pd.Series) -> pd.Series:
        c = codec(path, 0, 0.0)
        n = len(c.model.bytes_of)

        def text(x) -> str | None:
            if x is None:
                return None
            x = np.asarray(x, np.float64)
            if not (np.isfinite(x).all() and (x >= 0).all() and (x < n).all()):
                return None
            raw = b"".join(map(c.model.bytes_of.__getitem__, x.astype(np.int64).tolist()))
            return raw[1:].decode("utf-8", "replace")

        return pd.Series([text(x) for x in column], dtype=object)

    return ids.withColumn("decoded", work(F.col(column)))

