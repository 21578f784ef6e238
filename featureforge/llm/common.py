"""Column expressions shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def whole_text(text: Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_text(key: Column) -> Column:
    """A key as text for hashing; a null key is one more value, unlike any text of a number."""
    return F.coalesce(key.cast("string"), F.lit("null"))


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that the parts decide, from 52 bits of their MD5."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def sha256_text(text: Column) -> Column:
    """Lowercase hex of the SHA-256 of the text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The files at ``path``, a folder or one file, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(place) and store.getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


#: Let Spark filter a large side by a Bloom filter of the smaller one before their join, whatever the sizes (default: from 10 GB).
FILTER_SETTINGS = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings that hold while a step runs."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
