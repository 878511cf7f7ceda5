"""Rankings of third parties and companies. ``tp`` is the long third-party table (domain or src, third_party or target,
script, iframe, image, link)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TLDS = ("com", "org", "de", "fr", "ru", "cn", "ir")
PRIVACY_PROXIES = (
    "DOMAINS BY PROXY, LLC", "WHOISGUARD INC.", "WHOISGUARD, INC.", "CONTACT PRIVACY INC.", "PERFECT PRIVACY, LLC", "WHOIS PRIVACY PROTECTION SERVICE, INC.",
)


def flag(*counts: str) -> Column:
    """1 if any count is positive."""
    return F.when(F.greatest(*[F.col(c) for c in counts], F.lit(0)) > 0, 1).otherwise(0)


def third_party_stats(tp: DataFrame, min_domains: int = 2500) -> DataFrame:
    """(third_party, domains, scripts, iframes, images, links): domains that embed it at all and by each type."""
    kinds = {"scripts": "script", "iframes": "iframe", "images": "image", "links": "link"}
    own = tp.groupBy("third_party").agg(F.count("*").alias("domains"), *[F.sum(flag(c)).alias(n) for n, c in kinds.items()])
    return own.where(F.col("domains") >= min_domains).orderBy(F.desc("domains"), "third_party")


def embedding_type_stats(tp: DataFrame, min_domains: int = 2500) -> DataFrame:
    """(third_party, domains, dynamic, static): by script or iframe, by image or link."""
    own = tp.groupBy("third_party").agg(F.count("*").alias("domains"), F.sum(flag("script", "iframe")).alias("dynamic"), F.sum(flag("image", "link")).alias("static"))
    return own.where(F.col("domains") >= min_domains).orderBy(F.desc("domains"), "third_party")


def tld(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def tld_distribution(domains: DataFrame, column: str = "domain") -> DataFrame:
    """(tld, domains) of first-party names, most first."""
    return domains.groupBy(tld(F.col(column)).alias("tld")).agg(F.count("*").alias("domains")).orderBy(F.desc("domains"), "tld")


def _top_per_tld(all_pairs: DataFrame, pairs: DataFrame, what: str, tlds: tuple[str, ...], k: int) -> DataFrame:
    """pairs (domain, what), distinct; all_pairs: every first party with a third party of any kind. One pass serves all groups:
    a row counts for ``overall`` and, if listed, for its top-level domain."""
    group = F.explode(F.when(tld(F.col("domain")).isin(*tlds), F.array(F.lit("overall"), tld(F.col("domain")))).otherwise(F.array(F.lit("overall")))).alias("tld")
    sizes = all_pairs.select("domain").distinct().select(group).groupBy("tld").agg(F.count("*").alias("sites"))
    counts = pairs.select(group, what).groupBy("tld", what).agg(F.count("*").alias("domains"))
    place = F.row_number().over(W.partitionBy("tld").orderBy(F.desc("domains"), what))
    best = counts.withColumn("place", place).where(F.col("place") <= k)
    return best.join(F.broadcast(sizes), "tld").select("tld", "place", what, "domains", (F.col("domains") / F.col("sites")).alias("share"))


def top_third_parties_per_tld(tp: DataFrame, trackers: DataFrame, tlds: tuple[str, ...] = TLDS, k: int = 20) -> DataFrame:
    """(tld, place, third_party, domains, share): labelled trackers (third_party) by the share of the group's sites with any
    third party. A group without sites has no rows."""
    own = tp.select("domain", "third_party")
    return _top_per_tld(own, own.join(trackers.select("third_party").distinct(), "third_party", "left_semi"), "third_party", tlds, k)


def top_companies_per_tld(tp: DataFrame, companies: DataFrame, tlds: tuple[str, ...] = TLDS, k: int = 10) -> DataFrame:
    """As above for companies (third_party, company); a site counts once for a company, null and empty names don't."""
    own = companies.where("company is not null and company <> ''").select("third_party", "company").distinct()
    pairs = tp.select("domain", "third_party").join(own, "third_party").select("domain", "company").distinct()
    return _top_per_tld(tp.select("domain"), pairs, "company", tlds, k)


def top_companies(edges: DataFrame, index: DataFrame, whois: DataFrame, invalid: tuple[str, ...] = PRIVACY_PROXIES) -> DataFrame:
    """(company, domains): sources that embed a third party of the company. whois: (domain, company)."""
    known = whois.where(~F.col("company").isin(*invalid)).join(index, whois.domain == index.name).select(F.col("id").alias("target"), "company")
    pairs = edges.join(known, "target").select("src", "company").distinct()
    return pairs.groupBy("company").agg(F.count("*").alias("domains")).orderBy(F.desc("domains"), "company")


def third_parties_by_pagerank(edges: DataFrame, ranks: DataFrame, index: DataFrame, k: int | None = 1000) -> DataFrame:
    """(name, rank_sum): the ranks of the sites that embed each third party, of the k best or, for None, of all. ranks: (id, rank)."""
    sums = edges.join(ranks, edges.src == ranks.id).groupBy("target").agg(F.sum("rank").alias("rank_sum"))
    named = sums.join(index, sums.target == index.id).select("name", "rank_sum").orderBy(F.desc("rank_sum"), "name")
    return named if k is None else named.limit(k)
