"""Sharding: contiguous shards of near-equal bytes, by global prefix sums (DataFrame functions only).

1. The rows are cut into contiguous ranges of the key at approximate quantiles (a list of at most ``ranges`` values).
2. Each range's total bytes and rows are summed (partial sums before the shuffle); a running sum over these at most
   ``ranges`` rows gives every range its global offset. These rows are few by construction, so they are broadcast.
3. Inside each range a running sum in key order gives every row its global byte offset and row number.
4. A row goes to the shard in which its middle byte falls: equal targets, so shard sizes differ from the ideal by at most
   one row at either end. A shard's first row number (``shards`` rows) gives gapless slots.

No task holds more than one range. Rows of one key value stay in one range; the key is meant to be an identifier, and a
range that repeats make large is sorted with spilling, as (id, size, crc32) rows without texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embedmesh.llm.common import crc32_sql, parts, range_bounds, range_bucket


def shard_by_bytes(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, start): size is the text's UTF-8 bytes (null: none) plus 8.

    Nulls: a null text has size 8 and the crc32 of nothing, 0; a null key sorts first. Ties: repeated keys are ordered by
    crc32, then size; rows equal in all three are alike. Empty table: no rows. Extra columns are left out. grown_shard is
    null: this law moves rows when the number of shards changes.
    """
    n = ranges or parts(docs.sparkSession)
    bounds = range_bounds(docs, key, n)
    whole = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole) + 8).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
    ).withColumn("range", range_bucket(F.col("doc_id"), bounds))
    totals = thin.groupBy("range").agg(F.sum("size").alias("range_bytes"), F.count("*").alias("range_rows"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    # one row a range: at most n rows pass through this window, and n is a parameter
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("range_bytes").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all_bytes"),
    )
    inside = W.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        thin.withColumns({"upto": F.sum("size").over(inside), "number": F.count(F.lit(1)).over(inside)})
        .join(F.broadcast(offsets), "range")
        .withColumns({"start": F.col("bytes_before") + F.col("upto") - F.col("size"), "number": F.col("rows_before") + F.col("number") - 1})
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.expr(f"((start * 2 + size) * {shards}) div (all_bytes * 2)"))).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("number").alias("first_number"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("number") - F.col("first_number")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "start",
    )


#: (start * 2 + size) * shards stays within a long up to 190 PB of text.
SQL = f"""
WITH thin AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
         {crc32_sql("encode(coalesce(text, ''))")} AS text_crc32
  FROM documents),
placed AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start,
         CAST(sum(size) OVER () AS BIGINT) AS total
  FROM thin),
cut AS (
  SELECT *, CAST(least(23, ((start * 2 + size) * 24) // (total * 2)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, start
FROM cut
"""
