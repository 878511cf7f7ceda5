"""Which trackers, or companies, occur on the same sites, and how significantly.

A site's labelled trackers are one small array (at most as many as there are labels), so pairs are two explodes after one
shuffle by site, and are counted with partial aggregation. Only i <= j is counted; the rest is its mirror image.

``marginals="rowsum"`` takes Mi as the row sum of the pair matrix with its diagonal, as the original analysis did;
``"domains"`` the number of sites that have i, the textbook marginal.

Tables of every two labels are their square. The pairs that meet are few of it and come from the counts; the rest is made
label by label in as many tasks as the square needs, without a join or shuffle of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embedmesh.functions.stats import above, divided, phi, phi_t, root_log_likelihood_ratio
from embedmesh.plans.ranges import parts
from embedmesh.plans.storage import saved

FIRST_PARTIES = 41_192_060
#: Rows of a table of every two labels that one task makes.
SQUARE_ROWS = 1 << 23
#: Labels (name, number and count) that are broadcast.
BROADCAST_LABELS = 1 << 20


def pair_counts(sites: DataFrame, what: str) -> DataFrame:
    """(i, j, count), i <= j, over sites (domain, what) with more than one distinct value; (i, i) counts those that have i.
    Written once, as everything that follows reads it more than once; it has at most a row for each two labels."""
    own = sites.where(F.col(what).isNotNull()).groupBy("domain").agg(F.sort_array(F.collect_set(what)).alias("own")).where(F.size("own") > 1)
    pairs = own.select(F.posexplode("own").alias("at", "i"), "own").select("i", F.explode(F.slice("own", F.col("at") + 1, F.size("own"))).alias("j"))
    return saved(pairs.groupBy("i", "j").agg(F.count("*").alias("count")))


def mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", "count").unionAll(pairs.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "count"))


def marginals(pairs: DataFrame, kind: str = "rowsum") -> DataFrame:
    """(i, m)"""
    if kind == "domains":
        return pairs.where("i = j").select("i", F.col("count").alias("m"))
    return mirrored(pairs).groupBy("i").agg(F.sum("count").alias("m"))


def scored(pairs: DataFrame, n: int = FIRST_PARTIES, kind: str = "rowsum") -> DataFrame:
    """(i, j, count, mi, mj, phi, t, root_llr) for all i <= j."""
    m = marginals(pairs, kind)
    both = pairs.join(m.withColumnRenamed("m", "mi"), "i").join(m.select(F.col("i").alias("j"), F.col("m").alias("mj")), "j")
    own = phi(n, F.col("count"), F.col("mi"), F.col("mj"))
    root = root_log_likelihood_ratio(F.col("count"), F.col("mi") - F.col("count"), F.col("mj") - F.col("count"), F.lit(n) - F.col("mi") - F.col("mj") + F.col("count"))
    return both.select("i", "j", "count", "mi", "mj", own.alias("phi"), phi_t(own, F.col("mi"), F.col("mj")).alias("t"), root.alias("root_llr"))


def labelled_sites(tp: DataFrame, labels: DataFrame, categories: tuple[str, ...], what: str) -> DataFrame:
    """(domain, what) of the third parties in the categories. labels: (third_party, category, company)."""
    own = labels.where(F.col("category").isin(*categories)).where(F.col(what).isNotNull()).select("third_party", *{what} - {"third_party"}).distinct()
    return tp.select("domain", "third_party").join(own, "third_party").select("domain", what)


def company_cooccurrence(
    tp: DataFrame, labels: DataFrame, n: int = FIRST_PARTIES, min_count: int = 6, t: float = 2.59, categories: tuple[str, ...] = ("Advertising", "Beacon", "Analytics"), kind: str = "rowsum"
) -> DataFrame:
    """Edges (i, j, weight): companies on more than min_count common sites whose phi is significant at t, weighted by t."""
    own = scored(pair_counts(labelled_sites(tp, labels, categories, "company"), "company"), n, kind)
    return own.where((F.col("count") > min_count) & above(F.col("t"), t)).select("i", "j", F.col("t").alias("weight"))


def tracker_cooccurrence(
    tp: DataFrame, labels: DataFrame, n: int = FIRST_PARTIES, threshold: float = 15, categories: tuple[str, ...] = ("Advertising", "Beacon"), kind: str = "rowsum", score: str = "root_llr"
) -> DataFrame:
    """Undirected edges (i, j, weight), i <= j, of trackers whose score (root_llr, or t) is over the threshold."""
    own = scored(pair_counts(labelled_sites(tp, labels, categories, "third_party"), "third_party"), n, kind)
    return own.where(above(F.col(score), threshold)).select("i", "j", F.col(score).alias("weight"))


def graph_nodes(labels: DataFrame, what: str = "company", categories: tuple[str, ...] = ("Advertising", "Beacon", "Analytics")) -> DataFrame:
    """(id, label, value): the nodes of a co-occurrence graph, valued by the logarithm of their third parties' occurrences."""
    own = labels.where(F.col("category").isin(*categories) & F.col(what).isNotNull())
    return own.groupBy(F.col(what).alias("id")).agg(F.ln(F.sum("occurrences")).alias("value")).select("id", F.col("id").alias("label"), "value")


def conditional_probability(pairs: DataFrame, min_p: float = 0.15) -> DataFrame:
    """Directed edges (row, col, p): P(row | col) = c[row, col] / c[col, col], over min_p, row and col different."""
    diagonal = pairs.where("i = j").select(F.col("i").alias("col"), F.col("count").alias("own"))
    cells = mirrored(pairs).where("i <> j").select(F.col("i").alias("row"), F.col("j").alias("col"), "count")
    p = divided(F.col("count"), F.col("own"))
    return cells.join(diagonal, "col").select("row", "col", p.alias("p")).where(above(F.col("p"), min_p))


def _numbered(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, number, own): the labels (third_party) by their numbers from 0 in the order of the names, and the sites that have
    each, null where pairs has none. Written once."""
    # the list of labels is numbered in one window; what is made of it is its square
    names = labels.select(F.col("third_party").alias("name")).distinct().withColumn("number", F.row_number().over(W.orderBy("name")) - 1)
    return saved(names.join(pairs.where("i = j").select(F.col("i").alias("name"), F.col("count").alias("own")), "name", "left"))


def _square(pairs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((i, j, count) of the labels that meet; names and j of every other two), by number.

    Only what meets is joined and shuffled. The rest are the gaps between it, made where they are put out from one row a label:
    a task makes about SQUARE_ROWS of them, so there are as many tasks as the square needs.
    """
    left, right = (names.select(F.col("name").alias(x), F.col("number").alias(f"n{x}")) for x in "ij")
    cells = mirrored(pairs).join(left, "i").join(right, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "count")
    n = names.count()
    # round robin: even, and AQE neither merges nor coalesces it, as it would by the few bytes of a row
    tasks = min(max(1, n), max(parts(names.sparkSession), -(-n * n // SQUARE_ROWS)))
    met = cells.groupBy(F.col("i").alias("number")).agg(F.sort_array(F.collect_list("j")).alias("met"))
    rows = names.join(met, "number", "left").withColumn("met", F.coalesce("met", F.array().cast("array<int>"))).repartition(tasks)
    gaps = F.arrays_zip(F.concat(F.array(F.lit(-1)), "met").alias("after"), F.concat("met", F.array(F.lit(n))).alias("until"))
    between = rows.select(*names.columns, F.inline(gaps).alias("after", "until")).where("until - after > 1")
    return cells, between.select(*names.columns, F.explode(F.sequence(F.col("after") + 1, F.col("until") - 1)).alias("j"))


def probability_table(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, j, p) for every two labels (third_party) by their numbers from 0 in the order of the names: P(i | j), 1 where they
    are the same and occur, 0 for what never meets or never occurs. A row for each two labels by definition."""
    names = _numbered(pairs, labels)
    cells, rest = _square(pairs, names)
    met = cells.join(names.select(F.col("number").alias("j"), "own"), "j").select("i", "j", F.coalesce(F.col("count") / F.col("own"), F.lit(0.0)).alias("p"))
    return met.unionAll(rest.select("number", "j", F.lit(0.0).alias("p")))


def lift(pairs: DataFrame, labels: DataFrame, n: int = FIRST_PARTIES) -> DataFrame:
    """(row, col, lift) for every pair of labels (third_party), also those that never meet: (c[row, col] / c[col, col]) /
    (c[row, row] / n), with 0 / 0 as NaN. The result has a row for each two labels by definition."""
    names = _numbered(pairs, labels).withColumn("own", F.coalesce("own", F.lit(0)))
    cells, rest = _square(pairs, names)
    left, right = (names.select(F.col("number").alias(k), F.col("name").alias(name), F.col("own").alias(f"{k}_own")) for k, name in (("i", "row"), ("j", "col")))
    # beyond the bound a shuffle; the square of as many labels couldn't be put out
    right = F.broadcast(right) if names.count() <= BROADCAST_LABELS else right
    value: Column = divided(divided(F.col("count"), F.col("j_own")), divided(F.col("i_own"), F.lit(n)))
    met = cells.join(left, "i").join(right, "j").select("row", "col", value.alias("lift"))
    # what never meets: 0 / 0 if either never occurs, else 0
    none = F.when((F.col("own") == 0) | (F.col("j_own") == 0), F.lit(float("nan"))).otherwise(F.lit(0.0))
    return met.unionAll(rest.join(right, "j").select(F.col("name").alias("row"), "col", none.alias("lift")))
