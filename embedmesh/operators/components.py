"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and a join on the vertex, so a vertex with very many neighbours is pre-aggregated before
the shuffle and its join partition is split by AQE; no group is gathered in one task. Only two numbers per round reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmesh.plans.storage import released, saved


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    return starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        starred.select("u", F.col("m").alias("v"))
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", target: str = "target", max_rounds: int = 100) -> DataFrame:
    """(vertex, component) for every vertex of an edge; component is the smallest vertex reachable.

    Edges with a null end are left out; a self-loop keeps its vertex. Repeated edges don't matter. Rounds grow with the
    logarithm of the longest path; a graph that isn't done after max_rounds is an error, never a part of the result.
    """
    # written once: what makes the edges may be long, and both the loops and the rounds start from them
    given = saved(
        edges.select(F.col(src).cast("long").alias("u"), F.col(target).cast("long").alias("v")).where("u is not null and v is not null")
    )
    loops = given.where("u = v").select(F.col("u").alias("vertex")).distinct()
    work = saved(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(work)
    rounds = 0
    while before[0]:
        if rounds == max_rounds:
            raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
        last, work, rounds = work, saved(_small_star(_large_star(work).distinct()).where("u <> v").distinct()), rounds + 1
        released(last)
        after = _state(work)
        if after == before:
            break
        before = after
    stars = work.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("component"))
    roots = work.select(F.col("v").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    every = stars.unionByName(roots).unionByName(loops.withColumn("component", F.col("vertex")))
    return every.groupBy("vertex").agg(F.min("component").alias("component"))
