"""Counters nested in JSON maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featureforge.functions.fixed_values import MODULE_COUNTERS

MODULE_TYPE = T.StructType(
    [T.StructField(c, T.LongType()) for c in MODULE_COUNTERS]
    + [T.StructField("num_cells_by_type", T.MapType(T.StringType(), T.LongType()))]
)
REPORT_SCHEMA = T.StructType(
    [T.StructField("modules", T.MapType(T.StringType(), MODULE_TYPE))]
)


def map_rollup(
    entries: Column | str,
    fields: Sequence[str],
    prefix: str = "total_",
    count_name: str = "entries",
) -> list[Column]:
    """Σ of every field over the values of a map (null counts as 0) and the number of entries.

    The fold stays inside the row, so there is no explode and no shuffle.
    """
    entries = F.col(entries) if isinstance(entries, str) else entries
    values = F.coalesce(F.map_values(entries), F.array())

    def total(field: str) -> Column:
        return F.aggregate(
            values, F.lit(0).cast("bigint"),
            lambda acc, entry: acc + F.coalesce(entry[field].cast("bigint"), F.lit(0)),
        )

    sums = [total(f).alias(prefix + f.removeprefix("num_")) for f in fields]
    return [F.size(values).cast("bigint").alias(count_name)] + sums


def map_counts(
    df: DataFrame, entries: Column | str, inner: str, by: Sequence[str], name: str = "cell_type"
) -> DataFrame:
    """Σ of an inner count map over all entries: one row per ``by`` and inner key."""
    entries = F.col(entries) if isinstance(entries, str) else entries
    outer = df.select(*by, F.explode(F.map_values(entries)).alias("_entry"))
    pairs = outer.select(*by, F.explode(F.col("_entry")[inner]).alias(name, "_n"))
    return pairs.groupBy(*by, name).agg(F.sum("_n").alias("n"))


def pick_entry(entries: Column | str, candidates: Sequence[Column | str], by: str) -> Column:
    """Struct ``(key, value)``: the first candidate present, else the entry with the largest ``by``.

    The first of several largest entries wins; a null ``by`` counts as 0.
    """
    entries = F.col(entries) if isinstance(entries, str) else entries
    wanted = [F.lit(c) if isinstance(c, str) else c for c in candidates]

    def size_of(entry: Column) -> Column:
        return F.coalesce(entry["value"][by].cast("bigint"), F.lit(0).cast("bigint"))

    pairs = F.map_entries(entries)
    largest = F.array_max(F.transform(pairs, size_of))
    fallback = F.try_element_at(F.filter(pairs, lambda e: size_of(e) == largest), F.lit(1))

    def named(key: Column) -> Column:
        return F.try_element_at(F.filter(pairs, lambda e: e["key"] == key), F.lit(1))

    return F.coalesce(*[named(c) for c in wanted], fallback)
