"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are linked when they differ in few bits; documents of one connected component are near-duplicates.

* Equal fingerprints collapse first (pre-aggregated), so copies never meet in pairs.
* ``segment_keys``: a fingerprint is a ring of m segments. If two fingerprints differ in at most d bits, then by the
  pigeonring principle some segment starts a chain whose first l segments differ, for every l, in at most l * d / m bits.
  With m > d the first of them is equal, and the budget of the prefix of ``chain`` segments leaves another equal one. So
  pairs of (start, other) equal segments are complete as join keys, while no bucket is only one segment wide.
* Inside a bucket every candidate must pass the chain test before the full Hamming check.
* ``sampled_keys`` serve wide radii (where no complete key set is selective): each key is a random choice of bits.
* A bucket gives the edges of a spanning forest of its links, found by breadth-first search in vectors, not all pairs.
  Buckets over ``block`` fingerprints are cut into blocks, and each pair of blocks is a task group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmesh.llm.common import in_blocks, parts
from embedmesh.operators.components import connected_components
from embedmesh.plans.storage import saved

_CHUNK = 1 << 15


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) words; fewer words than ``width``: one shingle; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit word of hashes: splitmix64 of h + k; word 0 is h itself."""
    if not k:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _bit_counts(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each run of hashes between cuts, how many have each bit set (bit 63 first)."""
    out = np.zeros((len(cuts) - 1, 64), np.int64)
    run = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for at in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = run[at : at + _CHUNK]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        edges = np.append(first, len(own))
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            # bytes add up without overflow in spans of 255
            part = bits[a:b]
            if len(part) > 255:
                out[own[first[k]]] += np.add.reduceat(part, np.arange(0, len(part), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
            else:
                out[own[first[k]]] += np.add.reduce(part, axis=0, dtype=np.uint8)
    return out


def fingerprints(texts: list[str | None], width: int, seed: int = 42, words: int = 1) -> np.ndarray:
    """(n, words) unsigned 64-bit fingerprints. A bit is 1 if set in over half of the shingle hashes."""
    return _prints([shingle_hashes(t, width, seed) for t in texts], words)


def _prints(hashes: list[np.ndarray], words: int) -> np.ndarray:
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    out = np.zeros((len(hashes), words), np.uint64)
    for k in range(words):
        ones = 2 * _bit_counts(_mixed(h, k), cuts) > sizes[:, None]
        out[:, k] = np.packbits(ones, axis=1).reshape(-1, 8).copy().view(">u8").reshape(-1).astype(np.uint64)
    return out


@dataclass(frozen=True)
class Keys:
    """bits: for each key the bit numbers that it takes (0: the first word's highest). ring: the segments' widths and
    the difference budget for the chain test, or None."""

    bits: tuple[tuple[int, ...], ...]
    ring: tuple[int, ...] | None = None
    starts: tuple[tuple[int, int], ...] = ()


def segment_keys(radius: int = 4, segments: int = 6, total: int = 64) -> Keys:
    """Complete for any two fingerprints of ``total`` bits that differ in at most ``radius``; needs segments > radius + 1."""
    assert segments > radius + 1
    widths = tuple(total // segments + (k < total % segments) for k in range(segments))
    ends = np.cumsum((0, *widths))
    # the shortest chain whose budget leaves a second equal segment
    chain = next(n for n in range(2, segments + 1) if n * radius // segments <= n - 2)
    pairs = sorted({tuple(sorted((i, (i + g) % segments))) for i in range(segments) for g in range(1, chain)})
    take = [range(ends[k], ends[k + 1]) for k in range(segments)]
    return Keys(tuple((*take[a], *take[b]) for a, b in pairs), widths, tuple(pairs))


def sampled_keys(number: int, width: int, total: int, seed: int = 7) -> Keys:
    rng = np.random.default_rng(seed)
    return Keys(tuple(tuple(sorted(rng.choice(total, width, replace=False).tolist())) for _ in range(number)))


def _key_rows(keys: Keys, carried: int):
    """Rows (key, rep, fp): keys from all bits; fp is cut to the ``carried`` words that buckets compare."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rep, prints = batch.column("rep"), batch.column("fp")
            whole = _matrix(prints).astype(">u8")
            bits = np.unpackbits(whole.view(np.uint8).reshape(n, -1), axis=1)
            prints = pa.array([x.tobytes() for x in whole[:, :carried]], pa.binary())
            for k, chosen in enumerate(keys.bits):
                value = np.zeros(n, np.int64)
                for j in chosen:
                    value = (value << 1) | bits[:, j]
                yield pa.RecordBatch.from_arrays([pa.array(value | (k << 48)), rep, prints], ["key", "rep", "fp"])

    return rows


def _matrix(prints: pa.Array) -> np.ndarray:
    """(n, words) from binary values of equal length, big-endian."""
    raw = prints.to_pylist()
    return np.frombuffer(b"".join(raw), ">u8").reshape(len(raw), -1).astype(np.uint64)


def _ring_test(x: np.ndarray, widths: tuple[int, ...], radius: int) -> np.ndarray:
    """Whether some segment starts a chain within the proportional budget at every length."""
    m, at, parts_ = len(widths), 64, []
    for w in widths:
        at -= w
        parts_.append(np.bitwise_count((x >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int8))
    found = np.zeros(len(x), bool)
    for i in range(m):
        fits, total = np.ones(len(x), bool), np.zeros(len(x), np.int8)
        for n in range(1, m + 1):
            total = total + parts_[(i + n - 1) % m]
            fits &= total <= n * radius // m
        found |= fits
    return found


def _linked(one: np.ndarray, other: np.ndarray, radius: int, ring: tuple[int, ...] | None) -> np.ndarray:
    """Row by row (or one row against many): whether they differ in at most radius bits."""
    x = one ^ other
    if ring is None:
        return np.bitwise_count(x).sum(1, dtype=np.int64) <= radius
    passed = _ring_test(x[:, 0], ring, radius)
    found = np.zeros(len(x), bool)
    at = np.flatnonzero(passed)
    found[at] = np.bitwise_count(x[at, 0]) <= radius
    return found


def _forest(prints: np.ndarray, side: np.ndarray, radius: int, ring: tuple[int, ...] | None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in one bucket. side: 0 and 1 for the two blocks of a cut bucket (links
    inside one block are found elsewhere), or 2 for all."""
    edges, left = [], np.arange(len(prints))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _linked(prints[at], prints[left], radius, ring)
            if side[at] != 2:
                near &= side[left] != side[at]
            if near.any():
                hit = left[near]
                edges += [(at, int(x)) for x in hit]
                queue += hit.tolist()
                left = left[~near]
    return edges


def _links_of_buckets(radius: int, ring: tuple[int, ...] | None, small: int = 48):
    def solve(key: np.ndarray, side: np.ndarray, rep: np.ndarray, prints: np.ndarray, *_) -> pa.RecordBatch:
        sizes, first = _sizes(key)
        src, target = _pairs_of_few(key, side, rep, sizes, small, lambda a, b: _linked(prints[a], prints[b], radius, ring))
        for at, n in zip(first[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            for p, q in _forest(prints[at : at + n], side[at : at + n], radius, ring):
                src.append(rep[at + p : at + p + 1])
                target.append(rep[at + q : at + q + 1])
        return _edge_batch(src, target)

    return _by_bucket(solve)


def _sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return np.diff(np.append(first, len(key))), first


def _pairs_of_few(key: np.ndarray, side: np.ndarray, rep: np.ndarray, sizes: np.ndarray, small: int, linked) -> tuple[list, list]:
    """All linked pairs of the buckets of at most ``small`` rows."""
    src, target = [], []
    few = np.flatnonzero(np.repeat(sizes, sizes) <= small)
    for shift in range(1, small):
        a = few[(few + shift < len(key))]
        a = a[key[a] == key[np.minimum(a + shift, len(key) - 1)]]
        if not len(a):
            break
        hit = a[linked(a, a + shift) & ((side[a] == 2) | (side[a] != side[a + shift]))]
        src.append(rep[hit])
        target.append(rep[hit + shift])
    return src, target


def _edge_batch(src: list[np.ndarray], target: list[np.ndarray]) -> pa.RecordBatch:
    s, t = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (src, target))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(s, t)), pa.array(np.maximum(s, t))], ["src", "target"])


def _by_bucket(solve):
    """Input rows are sorted by (key, cell); one bucket may span batches, so its rows are kept until it ends."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # the cell makes a bucket's key unique; groups are runs of (key, cell)
            pair = np.stack([batch.column("key").to_numpy(), batch.column("cell").to_numpy()], 1)
            part = [batch.column("part").to_numpy()] if "part" in batch.schema.names else []
            now = (pair, batch.column("side").to_numpy(), batch.column("rep").to_numpy(), _matrix(batch.column("fp")), *part)
            end = pair[-1]
            changes = np.flatnonzero((pair != end).any(1))
            done = int(changes[-1]) + 1 if len(changes) else 0
            if done or (last is not None and (last != end).any()):
                kept.append(tuple(x[:done] for x in now))
                yield from _solved(kept)
                kept = [tuple(x[done:] for x in now)]
            else:
                kept.append(now)
            last = end
        if kept:
            yield from _solved(kept)

    def _solved(kept: list[tuple]) -> Iterator[pa.RecordBatch]:
        pair, *rest = (np.concatenate(x) for x in zip(*kept, strict=True))
        run = np.cumsum(np.concatenate(([False], (pair[1:] != pair[:-1]).any(1)))) if len(pair) else np.empty(0, np.int64)
        found = solve(run, *rest, pair[:, 0])
        yield from [found] if isinstance(found, pa.RecordBatch) else found

    return links


def links(prints: DataFrame, radius: int, keys: Keys, block: int = 20_000, carried: int = 1, broadcast_keys: int = 500_000) -> DataFrame:
    """(src, target) reps such that linked fingerprints are connected. prints: (rep long, fp binary), distinct fp; the first
    ``carried`` words decide a link. At most one key in ``block`` rows is crowded; these are counted before a broadcast."""
    keyed = prints.mapInArrow(_key_rows(keys, carried), "key long, rep long, fp binary")
    return _cells(keyed, block, broadcast_keys).mapInArrow(_links_of_buckets(radius, keys.ring), "src long, target long").distinct()


def _cells(keyed: DataFrame, block: int, broadcast_keys: int) -> DataFrame:
    """The rows (key, rep, fp, ...) of keyed with their cell and side, sorted by (key, cell)."""
    spark = keyed.sparkSession
    n = parts(spark)
    crowded = saved(keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    crowded = F.broadcast(crowded) if crowded.count() <= broadcast_keys else crowded
    # a bucket of b blocks becomes the cells (i, j), i <= j < b; a fingerprint of block x goes to all cells with an x
    celled = (
        keyed.join(crowded, "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            *keyed.columns, (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("cell"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    return celled.repartition(n, "key", "cell").sortWithinPartitions("key", "cell")


def fingerprint_table(docs: DataFrame, width: int, seed: int = 42, words: int = 1) -> DataFrame:
    """(doc_id, fp binary of 8 * words bytes, big-endian)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[bytes] = []
            for texts in in_blocks(batch.column("text")):
                values += [x.tobytes() for x in fingerprints(texts, width, seed, words).astype(">u8")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, fp binary")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42, words: int = 1, keys: Keys | None = None, block: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most ``radius`` bits.

    A null or empty text has no words and the fingerprint zero, linked like any other. Rows with a null doc_id belong to
    their fingerprint's component but never name it; where all are null, component_id is null. Repeated rows stay
    repeated. Empty table: no rows. Extra columns are left out.
    """
    keys = keys or segment_keys(radius, radius + 2, 64 * words)
    own = saved(fingerprint_table(docs, width, seed, words))
    prints = saved(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    known = prints.where("rep is not null")
    found = connected_components(links(known, radius, keys, block, words))
    classes = prints.join(found, prints.rep == found.vertex, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def share_of_bits(similarity: float) -> float:
    """The expected share of differing bits at a Jaccard similarity of shingle sets: their cosine is 2j / (1 + j)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Cuts:
    """Most differing bits of a candidate in the first ``few`` words, and in all; ``sure``: of an edge of a first forest."""

    few: int
    first: int
    all: int
    sure: int

    def near(self, one: np.ndarray, other: np.ndarray, radius: int | None = None) -> np.ndarray:
        """Row by row (or one row against many): whether they are candidates."""
        found = np.bitwise_count(one[..., : self.few] ^ other[..., : self.few]).sum(-1, dtype=np.int64) <= self.first
        at = np.flatnonzero(found)
        own = one[at] if one.ndim == 2 else one
        found[at] = np.bitwise_count(own ^ other[at]).sum(-1, dtype=np.int64) <= (self.all if radius is None else radius)
        return found


def _apart(side: np.ndarray, k: int) -> np.ndarray:
    return (side[k] == 2) | (side[k + 1 :] != side[k])


def _candidates_of_buckets(cuts: Cuts, small: int = 48, dense: int = 16):
    """All candidate pairs of a bucket. A bucket with over ``dense`` pairs a row gives a forest of its sure links instead,
    and a row (null, key): its other pairs are for _pairs_across to give."""

    def solve(key: np.ndarray, side: np.ndarray, rep: np.ndarray, prints: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        sizes, first = _sizes(key)
        src, target = _pairs_of_few(key, side, rep, sizes, small, lambda a, b: cuts.near(prints[a], prints[b]))
        marked = []
        for at, n in zip(first[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            p, s, r = (x[at : at + n] for x in (prints, side, rep))
            here, total = [], 0
            for k in range(n - 1):
                hit = k + 1 + np.flatnonzero(cuts.near(p[k], p[k + 1 :]) & _apart(s, k))
                total += len(hit)
                if total > dense * n:
                    break
                here.append((k, hit))
            if total > dense * n:
                marked.append(int(name[at]))
                here = [(a, np.array([b])) for a, b in _sure_forest(p, s, cuts)]
            for k, hit in here:
                src.append(np.full(len(hit), r[k], np.int64))
                target.append(r[hit])
        found = _edge_batch(src, target)
        if not marked:
            return found
        more = pa.RecordBatch.from_arrays([pa.nulls(len(marked), pa.int64()), pa.array(marked, pa.int64())], ["src", "target"])
        return pa.concat_batches([found, more])

    return _by_bucket(solve)


def _sure_forest(prints: np.ndarray, side: np.ndarray, cuts: Cuts) -> list[tuple[int, int]]:
    edges, left = [], np.arange(len(prints))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = cuts.near(prints[at], prints[left], cuts.sure)
            if side[at] != 2:
                near &= side[left] != side[at]
            hit = left[near]
            edges += [(at, int(x)) for x in hit]
            queue += hit.tolist()
            left = left[~near]
    return edges


def _pairs_across(cuts: Cuts, most: int = 1 << 16):
    """All candidate pairs of a bucket whose ends are of different parts, in batches of bounded size."""

    def solve(key: np.ndarray, side: np.ndarray, rep: np.ndarray, prints: np.ndarray, part: np.ndarray, _) -> Iterator[pa.RecordBatch]:
        sizes, first = _sizes(key)
        src, target, held = [], [], 0
        for at, n in zip(first.tolist(), sizes.tolist(), strict=True):
            p, s, r, c = (x[at : at + n] for x in (prints, side, rep, part))
            for k in range(n - 1):
                hit = k + 1 + np.flatnonzero(c[k + 1 :] != c[k])
                hit = hit[_apart(s, k)[hit - k - 1]]
                hit = hit[cuts.near(p[k], p[hit])]
                src.append(np.full(len(hit), r[k], np.int64))
                target.append(r[hit])
                held += len(hit)
                if held > most:
                    yield _edge_batch(src, target)
                    src, target, held = [], [], 0
        yield _edge_batch(src, target)

    return _by_bucket(solve)


def _set_table(docs: DataFrame, width: int, seed: int, words: int) -> DataFrame:
    """(doc_id, fp, digest) of the set of distinct shingles; digest tells sets of one fingerprint apart."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, digests = [], []
            for texts in in_blocks(batch.column("text")):
                sets = [np.unique(shingle_hashes(t, width, seed)) for t in texts]
                values += [x.tobytes() for x in _prints(sets, words).astype(">u8")]
                digests += [xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.binary()), pa.array(digests, pa.int64())], ["doc_id", "fp", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, fp binary, digest long")


def _shingle_sets(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(rep, sets): the sorted distinct shingle hashes of all texts that a doc_id has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width, seed)).tobytes() for texts in in_blocks(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "one"])

    found = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).mapInArrow(rows, "rep long, one binary")
    return found.groupBy("rep").agg(F.collect_set("one").alias("sets"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of sorted distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _alike(similarity: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = [
                    any(jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x in a.as_py() for y in b.as_py())
                    for a, b in zip(batch.column("a"), batch.column("b"), strict=True)
                ]
                yield batch.select(["src", "target"]).filter(pa.array(kept, pa.bool_()))

    return rows


def _verified(docs: DataFrame, pairs: DataFrame, width: int, similarity: float, seed: int, broadcast_ids: int = 500_000) -> DataFrame:
    """The (src, target) whose sets of shingles have the Jaccard similarity or more."""
    ids = saved(pairs.select(F.explode(F.array("src", "target")).alias("id")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    sets = _shingle_sets(docs.join(wanted, F.col("doc_id").cast("long") == wanted.id, "left_semi"), width, seed)
    both = pairs.join(sets.select(F.col("rep").alias("src"), F.col("sets").alias("a")), "src").join(sets.select(F.col("rep").alias("target"), F.col("sets").alias("b")), "target")
    return both.select("src", "target", "a", "b").mapInArrow(_alike(similarity), "src long, target long")


def tables_for(n: int, similarity: float, recall: float, bucket: int, least_bits: int = 16) -> tuple[int, int]:
    """(tables, bits of a key) for n fingerprints: so many bits that ``bucket`` unrelated ones share a key at most, and so many
    tables that a pair at the similarity meets in one with the chance ``recall``."""
    bits = max(least_bits, math.ceil(math.log2(max(1, n) / bucket)))
    meets = (1 - share_of_bits(similarity)) ** bits
    return math.ceil(math.log(1 - recall) / math.log1p(-meets)), bits


def near_duplicates(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, words: int = 8, carried: int = 2, recall: float = 0.973, bucket: int = 256, block: int = 20_000, broadcast_keys: int = 500_000
) -> DataFrame:
    """(doc_id, component_id): components of documents whose sets of ``width``-word shingles have a Jaccard similarity of
    ``similarity`` or more. Every link is decided on the sets themselves; 64 * words bits only choose what is compared.

    Candidates share the sampled bits of one of the tables and are near in the first ``carried`` words (four standard
    deviations over the expectation at ``similarity``) and in all words (three). Bits and tables follow the number of
    fingerprints (see tables_for), so that neither the work a document nor the recall changes with the size: 16 bits in 49
    tables up to 16 million, then a bit more with every doubling. A bucket gives all of its
    candidates. One that is dense gives a forest first; then, of the components of what was verified so far, all its
    candidates between different ones. So no link depends on another that fails. A pair at ``similarity``
    meets in some table in ``recall`` of the cases, one at 0.9 practically always. Nulls, ties and empty tables as in simhash_components.
    """
    p = share_of_bits(similarity)
    far = lambda bits, sd: round(bits * p + sd * math.sqrt(bits * p * (1 - p)))
    cuts = Cuts(carried, far(64 * carried, 4), far(64 * words, 3), far(64 * words, -1))
    own = saved(_set_table(docs, width, seed, words))
    prints = saved(own.groupBy("fp", "digest").agg(F.min("doc_id").alias("rep")))
    keys = sampled_keys(*tables_for(prints.count(), similarity, recall, bucket), 64 * words)
    known = prints.where("rep is not null").select("rep", "fp")
    keyed = known.mapInArrow(_key_rows(keys, words), "key long, rep long, fp binary")
    found = saved(_cells(keyed, block, broadcast_keys).mapInArrow(_candidates_of_buckets(cuts), "src long, target long").distinct())
    edges = saved(_verified(docs, found.where("src is not null"), width, similarity, seed))
    components = connected_components(edges)
    dense = found.where("src is null").select(F.col("target").alias("key"))
    n = dense.count()
    if n:
        some = keyed.join(F.broadcast(dense) if n <= broadcast_keys else dense, "key", "left_semi")
        parted = some.join(components.withColumnsRenamed({"vertex": "rep", "component": "part"}), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
        across = _cells(parted.select("key", "rep", "fp", "part"), block, broadcast_keys).mapInArrow(_pairs_across(cuts), "src long, target long")
        across = saved(across.distinct())
        components = connected_components(edges.unionByName(_verified(docs, across, width, similarity, seed)))
    classes = prints.join(components, prints.rep == components.vertex, "left").select("fp", "digest", F.coalesce("component", "rep").alias("component_id"))
    return own.join(classes, ["fp", "digest"]).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, classes: DataFrame, broadcast_ids: int = 500_000) -> DataFrame:
    """docs without the rows that stand for another document: of each component the smallest doc_id stays, with one row.

    classes: (doc_id, component_id). Rows with a null doc_id stay unless their class has an id.
    """
    gone = saved(classes.where("component_id is not null and (doc_id is null or doc_id <> component_id)").select("doc_id").distinct())
    n = gone.count()
    ids = gone.where("doc_id is not null")
    kept = docs.join(F.broadcast(ids) if n <= broadcast_ids else ids, "doc_id", "left_anti") if n else docs
    if gone.where("doc_id is null").count():
        # null ids can't be joined: such rows go, as a class with an id holds their text
        texts = classes.where("doc_id is null and component_id is null").limit(1).count()
        kept = kept if texts else kept.where("doc_id is not null")
    again = classes.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if again:
        named = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
        kept = named.unionByName(kept.where("doc_id is null"))
    return kept.select(*docs.columns)
