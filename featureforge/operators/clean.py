"""Projections, filters and typed cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featureforge.functions.columns import number, stripped, whole


def normalize_keys(
    df: DataFrame, text: Sequence[str] = (), ints: Sequence[str] = (), floats: Sequence[str] = ()
) -> DataFrame:
    """Trim text keys and cast numeric keys; a value that does not cast, or an integer key that is not whole, becomes null."""
    present = set(df.columns)
    kinds = {f.name: f.dataType for f in df.schema}
    out: dict[str, Column] = {c: stripped(F.col(c).cast("string")) for c in text if c in present}
    out |= {c: whole(stripped(F.col(c)) if isinstance(kinds[c], T.StringType) else F.col(c), kinds[c], "bigint") for c in ints if c in present}
    out |= {c: number(F.col(c).try_cast("double")) for c in floats if c in present}
    return df.withColumns(out) if out else df


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projection that ignores names the table does not have."""
    present = set(df.columns)
    return df.select(*[c for c in columns if c in present])


def drop_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def drop_null(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows with a null in any, or in all, of the columns."""
    return df.na.drop(how=how, subset=list(columns))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def fill(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(columns) if columns else None)


def with_parse_status(
    df: DataFrame, rules: Sequence[tuple[Column, str]], status: str = "parse_status"
) -> DataFrame:
    """First rule that holds names the status; ``ok`` where none holds."""
    chain = None
    for condition, text in rules:
        chain = F.when(condition, F.lit(text)) if chain is None else chain.when(condition, F.lit(text))
    value = F.lit("ok") if chain is None else chain.otherwise(F.lit("ok"))
    return df.withColumn(status, value)


def classify_reports(
    files: DataFrame, runs: DataFrame, run: str, text: str, finding=None
) -> DataFrame:
    """Per run: number of reports, non-blank lines, findings and a status.

    ``files`` is folded with map-side aggregation; ``runs`` lists every run, so
    that runs without a report show up as ``missing``.
    """
    from featureforge.functions.text import count_lines, count_lines_where, violation_line

    low = F.lower(F.col(text))
    per_run = files.select(
        run,
        count_lines(text).alias("_lines"),
        count_lines_where(text, finding or violation_line).alias("_hits"),
        (low.contains("no drc violations") | low.contains("number of violations: 0")).alias("_clean"),
    ).groupBy(run).agg(
        F.count(F.lit(1)).alias("report_count"),
        F.sum("_lines").alias("nonempty_lines"),
        F.sum("_hits").alias("violation_keyword_count"),
        F.max("_clean").alias("_clean"),
    )
    joined = runs.join(per_run, run, "left").fillna(
        0, ["report_count", "nonempty_lines", "violation_keyword_count"]
    )
    status = (
        F.when(F.col("report_count") == 0, "missing")
        .when(F.col("nonempty_lines") == 0, "empty_or_clean")
        .when(F.col("_clean"), "clean")
        .when(F.col("violation_keyword_count") == 0, "no_violation_keywords")
        .otherwise("possible_violations")
    )
    return joined.withColumn("has_report", (F.col("report_count") > 0).cast("int")).withColumn(
        "status", status
    ).drop("_clean")


def map_table(df: DataFrame, mapping: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Replace codes by labels in several columns."""
    from featureforge.functions.text import map_values

    return df.withColumns({c: map_values(c, m) for c, m in mapping.items()})
