"""Exact deduplication with disk-backed keyed state.

The documents run through a streaming aggregation in RocksDB. Per digest of the
normalised text the state keeps, without expiry, the smallest identifier, the
locator of that row's content (file and row), and the number of rows. A digest
that was met more than once is a hit: the full bytes of its rows are compared,
so that texts which only share a digest stay apart.

The state outlives the call in its folder; a later call with the same folder
reads only files that are new (``state`` argument).

Defined results: null text is empty; rows with a null identifier come after
all others; repeated rows are copies of each other, and each is returned;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from featureforge.llm.common import BLANKS, FILTER_SETTINGS, settings, sha256_text, stream_parquet, whole_text
from featureforge.staging import new_folder, stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the state store while the stream runs; memory is shared by all stores of an executor.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else each store of a partition reserves 4 MB on disk, whatever it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Text with every run of ASCII white space replaced by one space."""
    return F.regexp_replace(whole_text(text), BLANKS, " ")


def run_state(
    spark: SparkSession, path: str, state: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_text, files_per_trigger: int | None = None,
) -> DataFrame:
    """Bring the state up to date with the files under ``path``; ``(digest, keep_id, file, row, group_size)``."""
    kind = spark.read.parquet(path).schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(text_col, T.StringType())])
    rows = stream_parquet(spark, path, schema, files_per_trigger).select(
        digest(normalised(F.col(text_col))).alias("digest"),
        F.struct(
            F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        ).alias("first"),
    )
    kept = rows.groupBy("digest").agg(F.min("first").alias("first"), F.count("*").alias("group_size"))
    with settings(spark, STATE_SETTINGS):
        query = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    store = spark.read.format("statestore").load(state)
    first, count = store.schema["value"].dataType.names[-2:]
    return store.select(
        F.col("key.digest").alias("digest"), F.col("value")[first]["id"].alias("keep_id"),
        F.col("value")[first]["file"].alias("file"), F.col("value")[first]["row"].alias("row"),
        F.col("value")[count].alias("group_size"),
    )


def dedup_stream(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_text, state: str | None = None, files_per_trigger: int | None = None, carry: bool = False,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, file, row)``, one row per document under ``path``; with ``carry`` also all columns as ``whole``.

    ``kept`` is the row at the locator in the state. Rows of a hit digest whose
    bytes differ from its first row's are grouped by their full text instead.
    """
    if spark.read.parquet(path).limit(1).count() == 0:
        state_rows = spark.createDataFrame([], T.StructType([
            T.StructField("digest", T.StringType()), T.StructField("keep_id", spark.read.parquet(path).schema[id_col].dataType),
            T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("group_size", T.LongType())]))
    else:
        state_rows = stage(run_state(spark, path, state or new_folder(spark, "dedup-state"), id_col, text_col, digest, files_per_trigger), "state")
    docs = spark.read.parquet(path)
    text = normalised(docs[text_col])
    rows = docs.select(
        docs[id_col].alias("doc_id"), text.alias("text"), digest(text).alias("digest"), sha256_text(text).alias("text_sha256"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("whole")] if carry else []),
    )
    # full bytes of the hits: equal texts meet as one row per task and text
    hits = state_rows.where(F.col("group_size") > 1).select("digest")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("file"), F.col("row"))
    texts = rows.join(hits, "digest", "left_semi").groupBy("digest", "text").agg(
        F.min(order).alias("first"), F.count("*").alias("n"), F.first("text_sha256").alias("text_sha256"))
    with settings(spark, FILTER_SETTINGS):
        texts = stage(texts.select("digest", "text_sha256", "n", F.col("first.id").alias("id"), F.col("first.file").alias("file"), F.col("first.row").alias("row")), "texts")
    shared = texts.groupBy("digest").agg(F.count("*").alias("texts")).where(F.col("texts") > 1)
    apart = stage(texts.join(shared.select("digest"), "digest", "left_semi"), "collisions").select(
        F.col("digest").alias("_digest"), F.col("text_sha256").alias("_sha"), F.col("id").alias("_id"),
        F.col("file").alias("_file"), F.col("row").alias("_row"), "n")
    found = rows.drop("text").join(
        state_rows.select("digest", "keep_id", "group_size", F.col("file").alias("keep_file"), F.col("row").alias("keep_row")), "digest")
    own = F.col("n").isNotNull()
    return (
        found.join(apart, (F.col("digest") == F.col("_digest")) & (F.col("text_sha256") == F.col("_sha")), "left")
        .select(
            "doc_id", F.when(own, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(own, F.col("n")).otherwise(F.col("group_size")).cast("long").alias("group_size"),
            F.when(own, (F.col("file") == F.col("_file")) & (F.col("row") == F.col("_row")))
            .otherwise((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
            "text_sha256", "file", "row", *(["whole"] if carry else []),
        )
    )
