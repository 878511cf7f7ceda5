"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from embedmesh.plans.ranges import parts, range_bounds, range_bucket

__all__ = ["crc32_sql", "in_blocks", "parts", "range_bounds", "range_bucket", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_blocks(texts: Iterable, size: int = 1 << 21) -> Iterator[list[str | None]]:
    """Consecutive runs of texts (Arrow or Python strings) of about ``size`` characters, so that a worker's memory doesn't
    follow the rows of a batch."""
    held: list[str | None] = []
    n = 0
    for t in texts:
        t = t.as_py() if hasattr(t, "as_py") else t if isinstance(t, str) else None
        held.append(t)
        n += len(t or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _crc_table() -> list[int]:
    found = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        found.append(c)
    return found


def crc32_sql(blob: str) -> str:
    """A DuckDB expression: the unsigned crc32 of a blob expression, which DuckDB lacks."""
    codes = "[" + ",".join(map(str, _crc_table())) + "]::BIGINT[]"
    return f"""CAST(xor(list_reduce(list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: CAST(('0x' || x) AS BIGINT)),
      lambda c, b: xor(c >> 8, ({codes})[CAST(xor(c, b) & 255 AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS BIGINT)"""
