"""Questions to the labelled third parties (domain, occurrences, occurrences_dynamic, occurrences_static, category,
registration_org, company)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmesh.functions.stats import divided, mean, sample_std

TRACKING = ("Advertising", "Analytics", "Widget", "Beacon")
CATEGORIES = ("Advertising", "Analytics", "Beacon", "Widget", "ImageHoster", "ContentDelivery")


def trackers_without_company(labels: DataFrame, categories: tuple[str, ...] = TRACKING) -> DataFrame:
    return labels.where(F.col("category").isin(*categories) & F.col("company").isNull())


def registrant_without_company(labels: DataFrame, categories: tuple[str, ...] = TRACKING) -> DataFrame:
    return trackers_without_company(labels, categories).where("registration_org is not null")


def embedding_ratios(labels: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(category, third_parties, dynamic_mean, dynamic_std, static_mean, static_std), unweighted over third parties, for each
    category and ``Overall``; the deviation of one value is NaN."""
    own = labels.select("category", divided("occurrences_dynamic", "occurrences").alias("dynamic"), divided("occurrences_static", "occurrences").alias("static"))
    grouped = own.groupingSets([["category"], []], "category").agg(
        F.grouping("category").alias("all"), F.count("*").alias("third_parties"),
        mean("dynamic").alias("dynamic_mean"), sample_std("dynamic").alias("dynamic_std"), mean("static").alias("static_mean"), sample_std("static").alias("static_std"),
    )
    named = grouped.withColumn("category", F.when(F.col("all") == 1, "Overall").otherwise(F.col("category")))
    return named.where((F.col("all") == 1) | F.col("category").isin(*categories)).drop("all")
