"""The graph that the queries run on, derived from the star-schema tables: an order is a first party, a supplier a third
party whose id is shifted, a line item an embedded resource. Each view is given as a DataFrame and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHIFT = 100_000_000
KINDS = ("script", "iframe", "image", "link")
PAGES_A_TASK = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_name(key: Column) -> Column:
    ends = ("com", "org", "de", "fr", "ru", "cn", "ir", "gov")
    return F.concat(F.lit("order"), key.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ends)), (key % 8 + 1).cast("int")))


def _supplier_name(key: Column) -> Column:
    return F.concat(F.lit("supp"), key.cast("string"), F.lit(".net"))


def third_party_long(spark: SparkSession, d: str) -> DataFrame:
    """(src, target, script, iframe, image, link, domain, third_party)"""
    counts = [F.count(F.when(F.col("l_linenumber") % 4 == i, 1)).alias(k) for i, k in enumerate(KINDS)]
    own = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(*counts)
    return own.select(
        F.col("l_orderkey").alias("src"), (F.col("l_suppkey") + SHIFT).alias("target"), *KINDS, _order_name(F.col("l_orderkey")).alias("domain"), _supplier_name(F.col("l_suppkey")).alias("third_party")
    )


def tp_edges(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_suppkey") + SHIFT).alias("target"))
    return own.distinct()


def domain_index(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(_order_name(F.col("o_orderkey")).alias("name"), F.col("o_orderkey").alias("id"))
    return orders.unionAll(table(spark, d, "supplier").select(_supplier_name(F.col("s_suppkey")).alias("name"), (F.col("s_suppkey") + SHIFT).alias("id")))


def labels_tp(spark: SparkSession, d: str) -> DataFrame:
    """(domain, third_party, occurrences, occurrences_dynamic, occurrences_static, category, registration_org, company)"""
    seen = third_party_long(spark, d).groupBy("target").agg(
        F.count("*").alias("occurrences"), F.count(F.when(F.col("script") + F.col("iframe") > 0, 1)).alias("occurrences_dynamic"), F.count(F.when(F.col("image") + F.col("link") > 0, 1)).alias("occurrences_static")
    )
    key = F.col("s_suppkey")
    names = ("Advertising", "Analytics", "Beacon", "Widget", "ImageHoster", "ContentDelivery")
    category = F.element_at(F.array(*map(F.lit, names), F.lit(None)), (key % 7 + 1).cast("int"))
    suppliers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.join(seen, key + SHIFT == F.col("target")).select(
        _supplier_name(key).alias("domain"), _supplier_name(key).alias("third_party"), "occurrences", "occurrences_dynamic", "occurrences_static", category.alias("category"),
        F.when(key % 3 != 0, F.concat(F.lit("org"), F.col("s_nationkey").cast("string"))).alias("registration_org"), F.when(key % 5 != 0, F.col("n_name")).alias("company"),
    )


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("target"))


def whois_tp(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return own.select(_supplier_name(F.col("s_suppkey")).alias("domain"), F.when(F.col("s_suppkey") % 6 == 0, "WHOISGUARD INC.").otherwise(F.col("n_name")).alias("company"))


def _customer_edges(spark: SparkSession, d: str, other: str) -> DataFrame:
    own = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return own.select(F.col("o_custkey").alias("src"), (F.col(other) + 1_000_000).alias("target")).distinct()


def cc_edges(spark: SparkSession, d: str) -> DataFrame:
    return _customer_edges(spark, d, "l_partkey")


def pr_edges(spark: SparkSession, d: str) -> DataFrame:
    return _customer_edges(spark, d, "l_suppkey")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "target")).alias("id")).distinct()


def synthetic_pages(spark: SparkSession, d: str) -> DataFrame:
    """(url, archive_ms, html): a page for each order of a customer's site, with a tag for each line item."""
    host = F.concat(F.lit("http://cdn.supp"), F.col("l_suppkey").cast("string"), F.lit(".net/x"))
    tags = {0: ('<script src="', '"></script>'), 1: ('<iframe src="', '"></iframe>'), 2: ('<img src="', '">'), 3: ('<link href="', '">')}
    tag = F.coalesce(*[F.when(F.col("l_linenumber") % 4 == i, F.concat(F.lit(a), host, F.lit(b))) for i, (a, b) in tags.items()])
    # pages are small, but take work: a task for each core at least, and for so many pages. Both sides go there, as a join that
    # broadcasts one leaves the pages in the few splits of the other's file
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() // PAGES_A_TASK))
    lines = table(spark, d, "lineitem").select("l_orderkey", tag.alias("tag")).repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.concat_ws("\n", F.collect_list("tag")).alias("body"))
    orders = orders.repartition(n, "o_orderkey").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    url = F.concat(F.lit("http://www.cust"), F.col("o_custkey").cast("string"), F.lit(".com/"), F.col("o_orderkey").cast("string"))
    page = F.concat(F.lit("<html><head><title>order</title></head><body>"), F.coalesce("body", F.lit("")), F.lit("</body></html>"))
    return orders.select(url.alias("url"), F.lit(0).cast("long").alias("archive_ms"), page.alias("html"))


SQL = {
    "third_party_long": """SELECT l_orderkey AS src, 100000000 + l_suppkey AS target, 'order' || l_orderkey || '.' || ['com','org','de','fr','ru','cn','ir','gov'][l_orderkey % 8 + 1] AS domain,
       'supp' || l_suppkey || '.net' AS third_party, count(*) FILTER (l_linenumber % 4 = 0) AS script, count(*) FILTER (l_linenumber % 4 = 1) AS iframe,
       count(*) FILTER (l_linenumber % 4 = 2) AS image, count(*) FILTER (l_linenumber % 4 = 3) AS link FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "tp_edges": "SELECT DISTINCT l_orderkey AS src, 100000000 + l_suppkey AS target FROM lineitem",
    "domain_index": """SELECT 'order' || o_orderkey || '.' || ['com','org','de','fr','ru','cn','ir','gov'][o_orderkey % 8 + 1] AS name, o_orderkey AS id FROM orders
       UNION ALL SELECT 'supp' || s_suppkey || '.net', 100000000 + s_suppkey FROM supplier""",
    "labels_tp": """SELECT 'supp' || s_suppkey || '.net' AS domain, 'supp' || s_suppkey || '.net' AS third_party, count(*) AS occurrences,
       count(*) FILTER (script > 0 OR iframe > 0) AS occurrences_dynamic, count(*) FILTER (image > 0 OR link > 0) AS occurrences_static,
       ['Advertising','Analytics','Beacon','Widget','ImageHoster','ContentDelivery',NULL][s_suppkey % 7 + 1] AS category,
       CASE WHEN s_suppkey % 3 <> 0 THEN 'org' || s_nationkey END AS registration_org, CASE WHEN s_suppkey % 5 <> 0 THEN n_name END AS company
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN third_party_long ON target = 100000000 + s_suppkey GROUP BY s_suppkey, s_nationkey, n_name""",
    "link_edges": "SELECT l_orderkey AS src, l_partkey AS target FROM lineitem",
    "whois_tp": """SELECT 'supp' || s_suppkey || '.net' AS domain, CASE WHEN s_suppkey % 6 = 0 THEN 'WHOISGUARD INC.' ELSE n_name END AS company
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "cc_edges": "SELECT DISTINCT o_custkey AS src, 1000000 + l_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "pr_edges": "SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "pr_vertices": "SELECT src AS id FROM pr_edges UNION SELECT target FROM pr_edges",
    "synthetic_third_party": """SELECT 'cust' || o_custkey || '.com' AS domain, 'supp' || l_suppkey || '.net' AS third_party,
       count(DISTINCT l_orderkey) FILTER (l_linenumber % 4 = 0) AS script, count(DISTINCT l_orderkey) FILTER (l_linenumber % 4 = 1) AS iframe,
       count(DISTINCT l_orderkey) FILTER (l_linenumber % 4 = 2) AS image, count(DISTINCT l_orderkey) FILTER (l_linenumber % 4 = 3) AS link
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""",
}
_NEEDS = {"labels_tp": ("third_party_long",), "pr_vertices": ("pr_edges",)}


def with_views(names: str, body: str, **more: str) -> str:
    """A WITH clause of the named views, further named queries, then the body."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    own = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in order] + [f"{n} AS MATERIALIZED ({q})" for n, q in more.items()]
    return f"WITH {', '.join(own)} {body}"
