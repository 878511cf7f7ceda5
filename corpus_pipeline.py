"""Documents -> language -> near-duplicates -> decontamination -> piece ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes every stage's rows as
Parquet into the shared folder and reads them again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmesh.llm import langid, mergedrop, simhash, templates
from embedmesh.llm.common import table
from embedmesh.plans.storage import shared_dir

#: A language must hold at least half of a document. ``und`` is a class of its own, so any number of languages leaves room below.
MIN_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (or text), those that look like no learned language, and those for which every
    language scores under MIN_SCORE. Where no document has a label there is nothing to learn, and all with a letter stay."""
    model = langid.fit(docs.where(~langid.held_out()), reject=True)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c in ("lang_pred", "score")}), model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.drop("lang_pred", "score").withColumnsRenamed({f"own_{c}": c for c in docs.columns if c in ("lang_pred", "score")}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents whose five-word shingles are alike to 0.8 or more."""
    return simhash.one_of_each(docs, simhash.near_duplicates(docs, width=5, similarity=0.8))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, also with other numbers, names or units."""
    return templates.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with seeded merge dropout, and whether they decode to the very text."""
    found = mergedrop.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), seed=1, rate=0.1, keep=["doc_id"])
    return found.select("doc_id", "n_pieces", "ids_crc32", "lossless", "piece_ids")


STAGES = [("language", known_language), ("near_duplicates", near_dedup), ("decontamination", decontaminate), ("encoding", encode)]

#: A trained network and a merge agenda aren't SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the rows of the last one."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
