"""Degrees of the bipartite graph (src, target): distributions, assortativity, rankings, power law. Degree is the number of
edge rows; edges are not made distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmesh.functions.stats import divided

_SIDES = {"left": "src", "right": "target"}


def degrees(edges: DataFrame, side: str = "left") -> DataFrame:
    """(vertex, degree)"""
    return edges.groupBy(F.col(_SIDES[side]).alias("vertex")).agg(F.count("*").alias("degree"))


def degree_distribution(edges: DataFrame, side: str = "left") -> DataFrame:
    """(degree, vertices)"""
    return degrees(edges, side).groupBy("degree").agg(F.count("*").alias("vertices"))


def assortativity(edges: DataFrame, side: str = "left") -> DataFrame:
    """(degree, mean_degree): for each degree on one side the mean degree at the other end, over edges."""
    other = "right" if side == "left" else "left"
    own, far = degrees(edges, side), degrees(edges, other)
    # the other side's degrees are summed to one row an own vertex before its own degree is joined
    ends = edges.join(far.withColumnRenamed("vertex", _SIDES[other]), _SIDES[other])
    sums = ends.groupBy(F.col(_SIDES[side]).alias("vertex")).agg(F.sum("degree").alias("far_sum"), F.count("*").alias("far_count"))
    return sums.join(own, "vertex").groupBy("degree").agg((F.sum("far_sum") / F.sum("far_count")).alias("mean_degree"))


def degree_correlation(tp_edges: DataFrame, link_edges: DataFrame, direction: str = "out") -> DataFrame:
    """(tp_degree, link_degree) of every vertex that embeds third parties and has out- (or in-) links."""
    link = degrees(link_edges, "left" if direction == "out" else "right").withColumnRenamed("degree", "link_degree")
    return degrees(tp_edges, "left").join(link, "vertex").select(F.col("degree").alias("tp_degree"), "link_degree")


def top_left_vertices(edges: DataFrame, index: DataFrame, k: int = 10_000, min_degree: int = 10) -> DataFrame:
    """(name, degree), over min_degree, ties by name. index: (name, id)."""
    own = degrees(edges, "left").where(F.col("degree") > min_degree)
    return own.join(index, own.vertex == index.id).select("name", "degree").orderBy(F.desc("degree"), "name").limit(k)


def tld_subgraph(edges: DataFrame, index: DataFrame, tld: str) -> DataFrame:
    """The edges whose source's name ends in the top-level domain."""
    ids = index.where(F.col("name").endswith("." + tld)).select(F.col("id").alias("src"))
    return edges.join(ids, "src", "left_semi").select("src", "target")


def _coverage(edges: DataFrame, index: DataFrame, tld: str | None, min_degree: float | None, pct: float | None) -> DataFrame:
    own = tld_subgraph(edges, index, tld) if tld else edges
    total = own.agg(F.countDistinct("src").alias("sources"))
    found = degrees(own, "right").crossJoin(F.broadcast(total))  # total: one row
    limit = F.col("sources") * (pct / 100) if pct is not None else F.lit(min_degree)
    found = found.where(F.col("degree") > limit)
    return found.join(index, found.vertex == index.id).select("name", "degree", (F.col("degree") / F.col("sources")).alias("share"))


def top_right_vertices(edges: DataFrame, index: DataFrame, k: int = 100, min_degree: int = 1000, tld: str | None = None) -> DataFrame:
    """(name, degree, share): third parties in more than min_degree edges, share of the distinct sources; ties by name."""
    return _coverage(edges, index, tld, min_degree, None).orderBy(F.desc("degree"), "name").limit(k)


def right_vertices_coverage(edges: DataFrame, index: DataFrame, min_degree: int | None = 10_000, pct: float | None = None, tld: str | None = None) -> DataFrame:
    """As top_right_vertices without a limit; over min_degree edges or, if given, over pct percent of the sources."""
    return _coverage(edges, index, tld, min_degree, pct)


def power_law_exponent(edges: DataFrame, side: str = "left") -> DataFrame:
    """(gamma, sigma) by maximum likelihood over the least degree; infinite where all degrees are equal."""
    own = degrees(edges, side)
    # sum(ln(d / dmin)) = sum(ln d) - n * ln(dmin): one pass
    one = own.agg(F.count("*").alias("n"), F.sum(F.ln("degree")).alias("logs"), F.min("degree").alias("least"), F.max("degree").alias("most")).where("n > 0")
    total = F.when(F.col("least") == F.col("most"), 0.0).otherwise(F.col("logs") - F.col("n") * F.ln("least"))
    return one.select((1 + divided(F.col("n"), total)).alias("gamma"), divided(F.sqrt("n"), total).alias("sigma"))
