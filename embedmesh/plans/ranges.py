"""Contiguous ranges of a key, and numbering across them without one big sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, key: str, n: int, accuracy: int = 10_000) -> list[int]:
    """At most n - 1 ascending cut values that split the rows about evenly by a whole-number key. One cheap scan of the
    key alone; the values become literals of the plan, so a task that runs again puts every row where it was before."""
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(F.col(key), [i / n for i in range(1, n)], accuracy).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """0 for keys (and nulls) at or below the first bound, up to len(bounds); ascending with the key. A balanced tree
    of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key > F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds)).cast("int")


def numbered(df: DataFrame, key: str, *ties: str, name: str = "number") -> DataFrame:
    """df with the row number (from 1) in the order of key, then ties. Rows are numbered range by range; the ranges' row
    counts (as many as there are shuffle partitions) give the offsets."""
    bounds = range_bounds(df, key, parts(df.sparkSession))
    placed = df.withColumn("_range", range_bucket(F.col(key), bounds))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(key, *ties))
    return placed.withColumn(name, inside).join(F.broadcast(offsets), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")
