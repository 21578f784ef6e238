"""Registered queries of the numbered operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from featureforge.llm import (
    bpe, chosen_path, filter_audit, fingerprints, html_text, language, mixing, perplexity, secrets, sharding, spelling, sql, streaming_dedup, toxicity,
)
from featureforge.llm.common import documents, sha256_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def with_sql(text: str):
    def register(f):
        ORACLES[f.__name__] = text
        return query(f)

    return register


@query
def op1_bloom_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, folder))


@query
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op3_kneser_ney_quality(spark: SparkSession, folder: str) -> DataFrame:
    trusted = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return perplexity.score_perplexity(documents(spark, folder), trusted)


@with_sql(sql.DEDUP)
def op4_dedup_stream(spark: SparkSession, folder: str) -> DataFrame:
    found = streaming_dedup.dedup_stream(spark, f"{folder}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@with_sql(sql.SECRETS)
def op5_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, folder))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        sha256_text(secrets.span_text(F.filter("spans", lambda s: s["base"]))).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


@query
def op6_consensus_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract_pages(spark.read.parquet(f"{folder}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Where the vocabulary is; a parameter of the operator.
def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, vocabulary(), keep=["doc_id"]), vocabulary())
    return coded.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"), sha256_text(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_kneser_ney_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.score_toxicity(documents(spark, folder), labels).select("doc_id", "held_out", "score", "predicted", "statistic")


@query
def op9_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    found = chosen_path.near_duplicates(documents(spark, folder))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query
def op10_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    tree = sharding.even_tree(regions=4, racks=2, shards=5)
    return sharding.shard_documents(documents(spark, folder), tree, sharding.with_region(tree, shards=1, first=40))


@query
def op11_string_kernel_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(documents(spark, folder))


@with_sql(sql.VARIANTS)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(documents(spark, folder))


@with_sql(sql.AUDIT)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(spark, f"{folder}/documents.parquet", spark.read.parquet(f"{folder}/labels.parquet"))
