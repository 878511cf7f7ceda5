"""Text tables: typed TSV, the ragged third-party table, labelled third parties, GEXF graphs, compaction."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "src bigint, target bigint"
INDEX = "name string, id bigint"
RANKS = "id bigint, rank double"
WHOIS = "domain string, org string, country string"
COUNTRIES = "tld string, country string, iso3 string"
LABELLED = (
    "domain string, registration_org string, registration_country string, occurrences int, occurrences_dynamic int, occurrences_static int, occurrences_javascript int, occurrences_iframe int, "
    "occurrences_image int, occurrences_link int, category string, comment string, company string, found string, certain string, labeling_comment string, requires_translation string"
)
MISSING = "#"
PARSED_PAGE = "url string, archive_ms bigint, scripts array<string>, iframes array<string>, links array<string>, images array<string>"


def read_tsv(spark: SparkSession, path: str | list[str], schema: str, sep: str = "\t") -> DataFrame:
    """Positional columns; a row that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("sep", sep).option("quote", "").option("mode", "FAILFAST").csv(path)


def write_tsv(df: DataFrame, path: str, single_file: bool = True) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *df.columns).alias("value")).write.mode("overwrite").text(path)


def read_parsed_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARSED_PAGE).parquet(path)


def write_parsed_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").option("compression", "snappy").parquet(path)


def read_labelled(spark: SparkSession, path: str, categories: tuple[str, ...] | None = None) -> DataFrame:
    """Labelled third parties, most occurrences first; ``#`` is null in three columns."""
    own = read_tsv(spark, path, LABELLED)
    own = own.withColumns({c: F.nullif(F.col(c), F.lit(MISSING)) for c in ("registration_org", "category", "company")})
    own = own.where(F.col("category").isin(*categories)) if categories else own
    return own.orderBy(F.desc("occurrences"), "domain")


def parse_third_party_lines(lines: DataFrame) -> DataFrame:
    """value -> (domain, num_pages, trackers array<struct<domain, script, iframe, image, link>>)."""
    parts = F.split("value", "\t")
    rest = F.filter(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != "")

    # split in a step of its own: every mention of it inside one function is worked out again
    fields = F.transform(rest, lambda x: F.split(F.translate(x, "[]", ""), ","))

    def one(own):
        return F.struct(own[0].alias("domain"), *[own[i + 1].cast("int").alias(n) for i, n in enumerate(("script", "iframe", "image", "link"))])

    return lines.select(parts[0].alias("domain"), F.try_element_at(parts, F.lit(2)).cast("int").alias("num_pages"), F.transform(fields, one).alias("trackers"))


def long_third_parties(table: DataFrame) -> DataFrame:
    """One row for each (domain, third_party)."""
    each = table.select("domain", "num_pages", F.explode("trackers").alias("t"))
    return each.select("domain", "num_pages", F.col("t.domain").alias("third_party"), "t.script", "t.iframe", "t.image", "t.link")


def long_third_party_lines(lines: DataFrame) -> DataFrame:
    """long_third_parties of parse_third_party_lines, without the arrays between: fields are split row by row, in compiled code."""
    parts = F.split("value", "\t")
    each = lines.select(parts[0].alias("domain"), F.try_element_at(parts, F.lit(2)).cast("int").alias("num_pages"), F.explode(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))).alias("x"))
    own = each.where("x <> ''").select("domain", "num_pages", F.split(F.translate("x", "[]", ""), ",").alias("own"))
    return own.select("domain", "num_pages", F.col("own")[0].alias("third_party"), *[F.col("own")[i + 1].cast("int").alias(n) for i, n in enumerate(("script", "iframe", "image", "link"))])


def format_third_party_lines(table: DataFrame) -> DataFrame:
    """(domain, num_pages, trackers) -> value; trackers in the order of their names."""
    each = F.transform(F.array_sort("trackers"), lambda t: F.concat(F.lit("["), F.concat_ws(",", t["domain"], t["script"], t["iframe"], t["image"], t["link"]), F.lit("]")))
    return table.select(F.concat_ws("\t", F.col("domain"), F.col("num_pages").cast("string"), each).alias("value"))


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """All Parquet files of a folder as one, replacing the target."""
    spark.read.parquet(folder).coalesce(1).write.mode("overwrite").option("compression", "snappy").parquet(target)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = False, attribute: str = "logNumDomains") -> None:
    """nodes (id, label, value), edges (i, j, weight): a report for a graph viewer, so both are meant to be small; rows stream
    through the driver partition by partition."""
    root = ElementTree.Element("gexf", xmlns="http://www.gexf.net/1.2draft", version="1.2")
    graph = ElementTree.SubElement(root, "graph", defaultedgetype="directed" if directed else "undirected", mode="static")
    own = ElementTree.SubElement(graph, "attributes", {"class": "node"})
    ElementTree.SubElement(own, "attribute", id="0", title=attribute, type="double")
    listed = ElementTree.SubElement(graph, "nodes")
    for r in nodes.select("id", "label", "value").orderBy("id").toLocalIterator():
        node = ElementTree.SubElement(listed, "node", id=str(r.id), label=str(r.label))
        ElementTree.SubElement(ElementTree.SubElement(node, "attvalues"), "attvalue", {"for": "0", "value": repr(float(r.value))})
    listed = ElementTree.SubElement(graph, "edges")
    for k, r in enumerate(edges.select("i", "j", "weight").orderBy("i", "j").toLocalIterator()):
        ElementTree.SubElement(listed, "edge", id=str(k), source=str(r.i), target=str(r.j), weight=repr(float(r.weight)))
    ElementTree.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)
