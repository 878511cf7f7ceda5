"""Dictionary encoding of the third-party table against an index of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmesh.plans.ranges import numbered

LAST_ID = 42_889_799


def encode_graph(lines: DataFrame, index: DataFrame, last_id: int = LAST_ID) -> tuple[DataFrame, DataFrame]:
    """lines (line, domain, trackers), index (name, id) -> (edges (src, target), additions (name, id)).

    New names get ids from last_id + 1 in the order in which they first occur: by line, the site before its third parties. A
    site without third parties gets an id too.
    """
    names = F.concat(F.array("domain"), F.transform("trackers", lambda t: t["domain"]))
    seen = lines.select("line", F.posexplode(names).alias("place", "name")).groupBy("name").agg(F.min(F.struct("line", "place")).alias("first"))
    new = seen.join(index, "name", "left_anti").select("name", F.col("first.line").alias("line"), F.col("first.place").alias("place"))
    additions = numbered(new, "line", "place", name="id").select("name", (F.col("id") + last_id).alias("id"))
    every = index.select("name", "id").unionAll(additions)
    pairs = lines.select("domain", F.explode("trackers").alias("t")).select("domain", F.col("t.domain").alias("third_party"))
    sources = pairs.join(every.select(F.col("name").alias("domain"), F.col("id").alias("src")), "domain")
    edges = sources.join(every.select(F.col("name").alias("third_party"), F.col("id").alias("target")), "third_party").select("src", "target")
    return edges, additions
