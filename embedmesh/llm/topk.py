"""Exact top-k inner products by columnar branch and bound.

A partition's vectors lie in vertical layout (one row per dimension), turned so that the first dimensions hold most of the
mass: the turn is an orthogonal matrix, the eigenvectors of a bounded sample's second moments, and changes no inner product.
For a block of queries the scores are accumulated dimension block by dimension block; after each, the Cauchy-Schwarz bound
on what the remaining dimensions can add (the product of both remaining masses) is compared with the query's k-th best score so
far, and the surviving (query, candidate) pairs are compacted once they are few. Turned scores are rounded, so they only
choose; what survives is scored in the whole numbers themselves, exact in doubles up to 2**53, in integers beyond.

The stated query set meets all rows in rounds of at most ``round_queries`` numbered queries. A round first searches a
``probe``-th part of the rows; the k-th best score there is a lower bound for the whole, so that the partitions pass on some
k * ``probe`` rows a query in all, however many partitions there are, and never more than k each. A round's broadcast is
released when it is done, and its result written, so neither the driver nor the executors hold more than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embedmesh.plans.ranges import numbered
from embedmesh.plans.storage import saved

_EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def valid(vector: Column) -> Column:
    """No null vector, no null or non-finite component (Spark holds NaN equal to itself)."""
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


class Best:
    """The k best of each query so far: by score, then smaller id. floor: scores under it can't be among the best of all."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.seen = False
        self.scores = np.full((queries, k), np.iinfo(np.int64).min, np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, np.int64)
        self.floor = self.scores[:, -1].copy() if floor is None else floor

    def bound(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Pairs in any order."""
        touched = np.unique(q)
        rows = np.concatenate((q, np.repeat(touched, self.k)))
        ids = np.concatenate((ids, self.ids[touched].ravel()))
        scores = np.concatenate((scores, self.scores[touched].ravel()))
        # the complement orders descending without overflow at the least value
        order = np.lexsort((ids, ~scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        kept = place < self.k
        self.scores[rows[kept], place[kept]] = scores[kept]
        self.ids[rows[kept], place[kept]] = ids[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((self.ids != np.iinfo(np.int64).max) | (self.scores != np.iinfo(np.int64).min))


def turn_of(vectors: np.ndarray, dims: int) -> np.ndarray:
    """(dims, dims) orthogonal: the directions of most mass first."""
    x = vectors.astype(float)
    x /= max(1.0, float(np.abs(x).max(initial=0)))
    return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1]) if len(x) else np.eye(dims)


class Turned:
    """Whole-number vectors (n, dims), turned and upright, with the mass from each dimension on."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.whole = vectors
        self.columns = np.ascontiguousarray((vectors.astype(float) @ turn).T)
        self.mass = np.sqrt(np.cumsum((self.columns**2)[::-1], 0)[::-1])
        self.most = float(np.abs(vectors).max(initial=0))

    def __getitem__(self, some: slice) -> Turned:
        part = object.__new__(Turned)
        part.whole, part.columns, part.mass, part.most = self.whole[some], self.columns[:, some], self.mass[:, some], self.most
        return part


def exact(one: Turned, other: Turned, i: np.ndarray, j: np.ndarray, pairs: int = 1 << 14) -> np.ndarray:
    """Inner products of the pairs, in whole numbers."""
    dims = one.whole.shape[1]
    size = one.most * other.most * max(1, dims)
    kind = np.float64 if size < _EXACT else np.int64 if size < float(1 << 63) else object
    a, b = one.whole.astype(kind), other.whole.astype(kind)
    out = [(a[i[at : at + pairs]] * b[j[at : at + pairs]]).sum(1) for at in range(0, len(i), pairs)]
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def search_block(best: Best, at: int, queries: Turned, query_ids: np.ndarray, candidates: Turned, ids: np.ndarray, step: int = 8, few: int = 12, shares: list | None = None) -> None:
    """Adds the candidates to the queries ``at``, ... of ``best``. Pairs are compacted when fewer than 1 in ``few`` survive;
    until then whole products are cheaper. shares: gets the share of pairs that survive after each block of dimensions."""
    dims, n = candidates.columns.shape
    rows = np.arange(at, at + len(query_ids))
    bound = best.bound()[rows].astype(float)
    q, c = queries.columns, candidates.columns
    # room for rounding, upward
    room = 1 + 1e-9 * (queries.mass[0][:, None] * candidates.mass[0] if dims else 0.0)
    need = bound[:, None] - room
    scores = q[:step].T @ c[:step]
    j, pairs = step, None
    while j < dims:
        could = scores + queries.mass[j][:, None] * candidates.mass[j]
        alive = could >= need
        left = int(np.count_nonzero(alive))
        if shares is not None:
            shares.append(left / max(1, alive.size))
        if left * few < alive.size:
            pairs = np.flatnonzero(alive)
            break
        scores += q[j : j + step].T @ c[j : j + step]
        j += step
    if pairs is None:
        pairs, j = np.flatnonzero(scores >= need), dims
    qi, ci = pairs // n, pairs % n
    scores, need = scores.reshape(-1)[pairs], need.reshape(-1)[pairs]
    while j < dims and len(qi):
        for d in range(j, min(dims, j + step)):
            scores = scores + q[d][qi] * c[d][ci]
        j += step
        alive = scores + (queries.mass[j][qi] * candidates.mass[j][ci] if j < dims else 0.0) >= need
        qi, ci, scores, need = qi[alive], ci[alive], scores[alive], need[alive]
        if shares is not None:
            shares.append(len(qi) / max(1, n * len(rows)))
    other = query_ids[qi] != ids[ci]
    qi, ci = qi[other], ci[other]
    if len(qi):
        found = exact(queries, candidates, qi, ci)
        good = found >= best.bound()[rows[qi]]
        if good.any():
            best.add(rows[qi[good]], ids[ci[good]], found[good])


def _search(shared, k: int, block: int, query_block: int, step: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, turn, floor = shared.value
        best, turned = Best(len(query_ids), k, floor), None
        for ids, vectors in _blocks(batches, block, len(turn)):
            turned = turned or Turned(queries, turn)
            whole = Turned(vectors, turn)
            for part in _growing(len(ids), best):
                for at in range(0, len(query_ids), query_block):
                    some = slice(at, at + query_block)
                    search_block(best, at, turned[some], query_ids[some], whole[part], ids[part], step)
        where, place = best.found()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (where, query_ids[where], best.ids[where, place], best.scores[where, place])], ["query", "query_id", "vec_id", "score"]
        )

    return rows


def _growing(n: int, best: Best) -> Iterator[slice]:
    """The first block of candidates in growing parts, so that there is a bound to beat before most are looked at."""
    at, size = 0, n if best.seen else 4 * best.k
    while at < n:
        yield slice(at, min(n, at + size))
        at, size = at + size, size * 4
    best.seen = True


def _blocks(batches: Iterator[pa.RecordBatch], block: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
        held.append((batch.column("vec_id").to_numpy(zero_copy_only=False), values))
        n += batch.num_rows
        if n >= block:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held, n = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, block: int = 2048, query_block: int = 64, step: int = 8, round_queries: int = 16384, probe: int = 16, sample: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products among all vectors but its own id.

    vectors, queries: (vec_id long, embedding array of numbers). Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part. Vectors of different lengths only meet their own length. Ties go to
    the smaller vec_id; a repeated row counts as often as it occurs among the candidates, and once as a query; different
    vectors of one id are queries of their own. Fewer than k candidates: all. Empty table: no rows. Extra columns are left
    out. sample: rows that choose the turn, which changes no result.
    """
    spark = vectors.sparkSession
    whole = lambda d: d.where(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("v"))
    every = whole(vectors)
    asked = saved(whole(queries).dropDuplicates(["vec_id", "v"]))
    done = []
    for dims in [r[0] for r in asked.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]:  # the different lengths
        candidates = every.where(F.size("v") == dims)
        own = saved(numbered(asked.where(F.size("v") == dims), "vec_id"))
        turn = turn_of(_collected(candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample), dims)[1], dims)
        part = candidates.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(probe)) == 0)
        tasks = max(1, part.count() // (1 << 15))
        for first in range(0, own.count(), round_queries):
            ids, matrix = _collected(own.where((F.col("number") > first) & (F.col("number") <= first + round_queries)).orderBy("number"), dims)
            least = np.full(len(ids), np.iinfo(np.int64).min, np.int64)
            shared = spark.sparkContext.broadcast((ids, matrix, turn, least))
            low = _ranked(part.repartition(tasks).mapInArrow(_search(shared, k, block, query_block, step), _FOUND), k).where(F.col("rank") == k).select("query", "score").toArrow()
            shared.destroy()
            least[low.column("query").to_numpy()] = low.column("score").to_numpy()
            shared = spark.sparkContext.broadcast((ids, matrix, turn, least))
            done.append(saved(_ranked(candidates.mapInArrow(_search(shared, k, block, query_block, step), _FOUND), k).select("query_id", "rank", "vec_id", "score")))
            shared.destroy()
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    result = done[0]
    for more in done[1:]:
        result = result.unionAll(more)
    return result


_FOUND = "query long, query_id long, vec_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Of each query's rows the k best."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def _collected(some: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    got = some.toArrow()
    matrix = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if got.num_rows else np.empty((0, dims), np.int64)
    return got.column("vec_id").to_numpy(), matrix


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
