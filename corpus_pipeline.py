"""Clean, deduplicate, mix and encode a document table.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before it kept. All but the last return the columns they were given. A stage
keeps a document unless its operator decides against it: toxic documents, exact
copies, all but one document of each near-duplicate group, and what the mix
leaves out go; documents that the mix takes more than once are repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featureforge.llm import bpe, chosen_path, mixing, queries, streaming_dedup, toxicity
from featureforge.llm.common import sha256_text, whole_text
from featureforge.staging import new_folder, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs, labels, carry=True).where(F.col("predicted") == 0).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier; the stream reads a copy of ``docs`` in the shared folder."""
    folder = new_folder(spark, "dedup-input")
    docs.write.parquet(folder)
    return streaming_dedup.dedup_stream(spark, folder, carry=True).where("kept").select("whole.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The leader of each group of documents linked on five-word shingles; rows equal in identifier and text count as one."""
    leaders = chosen_path.near_duplicates(docs, size=5).where("leader").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(whole_text(F.col("text"))).alias("key"))
    kept = keyed.join(leaders, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows equal in identifier, source and text share their copies."""
    keys = ["doc_id", "source", "digest"]
    copies = mixing.mix_sources(docs).groupBy(*keys).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    copies = copies.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("digest").alias("_key"), "_copies")
    keyed = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"),
        F.md5(whole_text(F.col("text")).cast("binary")).alias("key")).dropDuplicates(["id", "source", "key"])
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key"))
    taken = keyed.join(copies, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return taken.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the bytes they decode to."""
    coded = bpe.encode(docs, queries.vocabulary(), keep=["doc_id", "source"])
    coded = bpe.decode(coded, queries.vocabulary())
    return coded.select(
        "doc_id", "source", bpe.token_count(F.col("ids")).alias("n_tokens"), sha256_text(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("byte_bpe", encode),
]

#: SQL has neither the models nor the hashes of the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each staged before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
