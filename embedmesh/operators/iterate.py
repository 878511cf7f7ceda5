"""Iterative analyses. Every round is written to the shared folder, so lineage stays one round long; what the driver sees
of a round is one row of totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embedmesh.functions.sketch import NAMES, estimate, joined, merged, observed
from embedmesh.operators.components import connected_components
from embedmesh.plans.ranges import parts
from embedmesh.plans.storage import released, saved


def component_sizes(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(size, components) of the undirected graph's components, over the vertices of edges."""
    sizes = connected_components(edges, max_rounds=max_rounds).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"))


def pagerank(edges: DataFrame, vertices: DataFrame, teleport: float = 0.15, max_iter: int = 100, eps: float | None = 1e-4) -> DataFrame:
    """(id, rank), with the dangling vertices' rank spread evenly. Repeated edges weigh as often as they occur.

    vertices: (id). Edges with an end that isn't a vertex are refused. eps: stop when the ranks change by less in all; None
    runs max_iter rounds.
    """
    cut = parts(edges.sparkSession)
    out = edges.groupBy("src", "target").agg(F.count("*").alias("times"))
    total = F.sum("times").over(W.partitionBy("src"))
    # one row for each two ends with its share of the source's rank; these stay where their source is, and so do the ranks, so
    # that a round shuffles nothing but what each target gains
    weighted = saved(out.repartition(cut, "src").select("src", "target", (F.col("times") / total).alias("weight")))
    ids = vertices.select("id").distinct().repartition(cut, "id")
    known = saved(ids.join(weighted.select(F.col("src").alias("id")).distinct().withColumn("sends", F.lit(True)), "id", "left"))
    ends = weighted.select(F.explode(F.array("src", "target")).alias("id")).distinct()
    if ends.join(known, "id", "left_anti").limit(1).count():
        raise ValueError("edges have ends that are not vertices")
    n = known.count()
    if not n:
        return known.select("id", F.lit(0.0).alias("rank"))
    ranks = known.select("id", "sends", F.lit(1.0 / n).alias("rank"))
    dangling = known.where("sends is null").count() / n
    for _ in range(max_iter):
        gained = weighted.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("weight")).alias("gained"))
        new = (F.coalesce("gained", F.lit(0.0)) + F.lit(dangling / n)) * (1 - teleport) + teleport / n
        last, ranks = ranks, saved(ranks.join(gained, "id", "left").select("id", "sends", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        if last.columns == ranks.columns:
            released(last)
        dangling, change = ranks.agg(F.coalesce(F.sum(F.when(F.col("sends").isNull(), F.col("rank"))), F.lit(0.0)), F.sum("change")).first()
        if eps is not None and change < eps:
            break
    return ranks.select("id", "rank")


def reachability_counters(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """(id, r0 .. r15, reachable): a sketch of the vertices that each vertex reaches along its edges, itself included.

    A vertex passes its sketch to the sources of its in-edges again only when its estimate has grown. A graph that needs more
    than max_rounds is an error.
    """
    ids = (vertices.select("id") if vertices is not None else edges.select(F.explode(F.array("src", "target")).alias("id"))).distinct()
    pairs = saved(edges.select("src", "target").distinct())
    now = saved(ids.select("id", *observed(F.col("id"))).withColumn("reachable", estimate()).withColumn("grown", F.lit(True)))
    rounds = 0
    while True:
        if rounds == max_rounds:
            raise RuntimeError(f"counters still grow after {max_rounds} rounds")
        rounds += 1
        news = pairs.join(now.where("grown").withColumnRenamed("id", "target"), "target").groupBy(F.col("src").alias("id")).agg(*merged())
        theirs = news.select("id", *[F.col(n).alias("n_" + n) for n in NAMES])
        both = now.join(theirs, "id", "left").select("id", *joined("n_"), F.col("reachable").alias("before"))
        last, now = now, saved(both.withColumn("reachable", estimate()).withColumn("grown", F.col("reachable") > F.col("before")).drop("before"))
        released(last)
        if not now.where("grown").limit(1).count():
            break
    return now.drop("grown")
