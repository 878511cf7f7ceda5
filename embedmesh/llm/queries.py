"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmesh.llm import attribution, langid, mergedrop, roles, sharding, simhash, sitetree, templates, tokenids, topk
from embedmesh.llm.common import table
from embedmesh.plans.storage import shared_dir


def op1_tokenids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    files = tokenids.write(table(spark, sf_dir, "documents"), folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokenids.read(spark, folder, files)


def op8_sitetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op3_mergedrop(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mergedrop.encode(docs, model or public_tokenizers.path("piece_bpe_32k.model"), seed=1, rate=0.1, with_ids=False, keep=["doc_id"])
    return found.select("doc_id", "n_pieces", "ids_crc32", "lossless")


def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), width=4, radius=4, seed=42)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op6_attribution(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return attribution.count_sections(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, rule="first")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op10_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.format_chats(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokenids": op1_tokenids,
    "op2_topk": op2_topk,
    "op3_mergedrop": op3_mergedrop,
    "op4_templates": op4_templates,
    "op5_simhash": op5_simhash,
    "op6_attribution": op6_attribution,
    "op7_langid": op7_langid,
    "op8_sitetree": op8_sitetree,
    "op9_sharding": op9_sharding,
    "op10_roles": op10_roles,
}

SQL: dict[str, str] = {
    "op2_topk": topk.SQL,
    "op4_templates": templates.SQL,
    "op8_sitetree": sitetree.SQL,
    "op9_sharding": sharding.SQL,
}
