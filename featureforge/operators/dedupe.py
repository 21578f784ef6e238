"""Duplicate handling that stays balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from featureforge.functions.columns import canonical
from featureforge.staging import stage


def dedupe(df: DataFrame) -> DataFrame:
    """Drop fully equal rows; null equals null."""
    return df.dropDuplicates()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key by ``order``.

    The filter on ``row_number() = 1`` lets Spark cut every map task down to
    one row per key before the shuffle, so a hot key costs one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """Digest of several columns; null differs from every text, signed zeros are equal, and NaN is null."""
    texts = F.struct(*[canonical(df, c).cast("string").alias(c) for c in columns])
    return F.sha2(F.to_json(texts, {"ignoreNullFields": "false"}), 256)


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All members of groups of equal ``columns``.

    Groups are counted with map-side aggregation and joined back on a digest of
    the columns; rows of one group may be spread over many tasks.
    """
    marked = df.withColumn("_fp", fingerprint(df, columns))
    repeated = marked.groupBy("_fp").count().filter("count > 1").select("_fp")
    return marked.join(stage(repeated, "duplicates"), "_fp", "left_semi").drop("_fp")


def duplicate_report(
    df: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] = ()
) -> DataFrame:
    """Rows, columns, surplus full rows, surplus keys and surplus metric vectors.

    Every count is a two-step aggregation: distinct vectors with map-side
    combine, then their number.
    """
    out = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    parts = {
        "full_duplicate_rows": df.columns,
        "duplicate_configurations": [c for c in keys if c in df.columns],
        "duplicate_metric_vectors": [c for c in metrics if c in df.columns],
    }
    for name, columns in parts.items():
        if not columns:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
            continue
        distinct = df.select(*columns).distinct().agg(F.count(F.lit(1)).alias("n"))
        out = out.withColumn(name, F.col("rows") - distinct.scalar())
    return out
