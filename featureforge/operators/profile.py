"""Quality reports, distributions and correlations of a table.

Reports are long tables (one row per column, group or pair). Every statistic is
an aggregation with map-side combine; quantiles are exact and come from
:mod:`featureforge.operators.quantiles`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featureforge.functions.columns import canonical, number
from featureforge.operators.clean import numeric_columns
from featureforge.operators.dedupe import duplicate_report
from featureforge.operators.quantiles import exact_quantiles
from featureforge.staging import stage


def _missing(df: DataFrame, c: str) -> Column:
    """True for null and, in a floating column, for NaN."""
    kind = df.schema[c].dataType
    gone = F.col(c).isNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        gone = gone | F.isnan(F.col(c))
    return gone


def _one_row_per_column(df: DataFrame, columns: Sequence[str], stats) -> DataFrame:
    """Aggregate ``stats(column) -> {name: aggregate}`` for every column in one pass, then go long."""
    per_column = {c: stats(c) for c in columns}
    names = list(next(iter(per_column.values())))
    wide = df.agg(*[
        agg.alias(f"{name}{i}")
        for i, c in enumerate(columns) for name, agg in per_column[c].items()
    ])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}{i}").alias(name) for name in names])
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percent per column, largest first."""
    report = _one_row_per_column(df, df.columns, lambda c: {
        "missing_count": F.count_if(_missing(df, c)), "_rows": F.count(F.lit(1)),
    })
    percent = F.col("missing_count") * 100.0 / F.nullif(F.col("_rows"), F.lit(0))
    return report.select("column", "missing_count", percent.alias("missing_percent")).orderBy(
        F.desc("missing_count"), "column"
    )


def _identity(df: DataFrame, c: str) -> Column:
    """Text that is equal exactly for equal values; long texts shuffle as a digest."""
    text = canonical(df, c).cast("string")
    if not isinstance(df.schema[c].dataType, T.StringType):
        return text
    return F.when(F.length(text) < 64, text).otherwise(F.sha2(text, 256))


def constant_report(df: DataFrame, approximate: bool = False, rsd: float = 0.02) -> DataFrame:
    """Distinct values per column, null counted as a value; constant where there is at most one.

    The exact count aggregates distinct (column, value) pairs first, so that
    neither a frequent value nor a wide column ends up in one task.
    ``approximate`` uses one sketch per column and no shuffle of values.
    """
    if approximate:
        counted = _one_row_per_column(df, df.columns, lambda c: {
            "unique_values": F.approx_count_distinct(c, rsd) + F.max(F.col(c).isNull().cast("int")),
        })
    else:
        cells = [
            F.struct(F.lit(c).alias("column"), _identity(df, c).alias("value")) for c in df.columns
        ]
        counted = (
            df.select(F.inline(F.array(*cells))).distinct()
            .groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
        )
    return counted.withColumn("is_constant", F.col("unique_values") <= 1).orderBy(
        F.desc("is_constant"), "unique_values", "column"
    )


def _bounds(k: float) -> dict[str, Column]:
    iqr = F.col("q3") - F.col("q1")
    return {
        "iqr": iqr,
        "lower_bound": F.col("q1") - k * iqr,
        "upper_bound": F.col("q3") + k * iqr,
    }


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, fences and the values outside them per numeric column.

    The percentage is of all rows, nulls included; columns with at most one
    value are left out.
    """
    columns = list(columns or numeric_columns(df))
    fences = stage(
        exact_quantiles(df, columns, [0.25, 0.75], names=["q1", "q3"]).withColumns(_bounds(k)), "fences"
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns])
    values = df.select(F.inline(cells)).join(fences.select("column", "lower_bound", "upper_bound"), "column")
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    counts = values.groupBy("column").agg(
        F.count_if(outside).alias("outlier_count"),
        F.count(F.lit(1)).alias("_rows"),
        (F.min("value") < F.max("value")).alias("_varies"),
    )
    return fences.drop("n").join(counts, "column").filter("_varies").select(
        "column", "q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count",
        (F.col("outlier_count") * 100.0 / F.col("_rows")).alias("outlier_percent"),
    ).orderBy(F.desc("outlier_count"), "column")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (ddof 1), min, quartiles and max, one row per column."""
    columns = list(columns or numeric_columns(df))
    moments = _one_row_per_column(df, columns, lambda c: {
        "count": F.count(number(c)), "mean": F.avg(number(c)), "std": F.stddev_samp(number(c)),
        "min": F.min(number(c)), "max": F.max(number(c)),
    })
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], names=["q25", "q50", "q75"]).drop("n")
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def target_summary(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Distribution of every target with its label."""
    labels = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    present = [t for t in targets if t in df.columns]
    return describe(df, present).select(
        F.col("column").alias("target"), labels[F.col("column")].alias("label"), "count", "mean",
        F.col("q50").alias("median"), "std", "min", "q25", "q75", "max",
    )


def group_summary(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """mean, std, min and max of every metric for every value of every grouping column.

    One pass: every row goes to one partial group per grouping column, rows
    with a null key are left out of that column only.
    """
    keys = [
        F.struct(F.lit(g).alias("group_column"), F.col(g).cast("string").alias("group_value"))
        for g in groups if g in df.columns
    ]
    metrics = [m for m in metrics if m in df.columns]
    long = df.select(F.inline(F.array(*keys)), *[number(m).alias(m) for m in metrics])
    aggs = []
    for m in metrics:
        aggs += [
            F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
        ]
    return long.filter(F.col("group_value").isNotNull()).groupBy("group_column", "group_value").agg(*aggs)


def group_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean per group, smallest first; null groups are left out."""
    means = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(number(value)).alias("mean"))
    return means.orderBy("mean", group)


def _pair_grid(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``(a, b, n, varies, r)`` over the complete pairs of two columns, in one pass.

    Every task unrolls its rows by pair and hands on one row of moments per
    pair, so that the shuffle depends on the number of pairs only.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(names)}
    side = lambda k: F.array(*[F.lit(at[pair[k]]) for pair in pairs])
    values = df.select(F.array(*[number(c) for c in names]).alias("_v")).select(
        "_v", F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("_pair"))
    both = values.select(
        "_pair", F.get("_v", F.get(side(0), F.col("_pair"))).alias("x"), F.get("_v", F.get(side(1), F.col("_pair"))).alias("y"),
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    r = F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))
    found = both.groupBy("_pair").agg(
        F.count(F.lit(1)).alias("n"), ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("varies"), r.alias("r"))
    labels = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "_pair int, a string, b string")
    varies = F.coalesce("varies", F.lit(False))
    return labels.join(found, "_pair", "left").select(
        "a", "b", F.coalesce("n", F.lit(0)).alias("n"), varies.alias("varies"),
        F.when(varies, F.greatest(F.least("r", F.lit(1.0)), F.lit(-1.0))).alias("r"))


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of complete pairs, long: ``(column_a, column_b, correlation)``.

    A constant side gives null.
    """
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations_with_replacement(columns, 2))
    half = _pair_grid(df, pairs)
    both = F.when(
        F.col("a") == F.col("b"), F.array(F.struct("a", "b"))
    ).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    r = F.when((F.col("a") == F.col("b")) & F.col("varies"), F.lit(1.0)).otherwise(F.col("r"))
    return half.select(r.alias("correlation"), F.inline(both).alias("column_a", "column_b")).select(
        "column_a", "column_b", "correlation"
    )


def corr_with(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every column with the target, nulls left out, largest first."""
    columns = list(columns or numeric_columns(df))
    grid = _pair_grid(df, [(c, target) for c in columns])
    r = F.when(F.col("a") == F.col("b"), F.when(F.col("varies"), F.lit(1.0))).otherwise(F.col("r"))
    return grid.select(F.col("a").alias("feature"), r.alias("correlation")).filter(
        F.col("correlation").isNotNull()
    ).orderBy(F.desc("correlation"), "feature")


def corr_grid(df: DataFrame, left: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Correlations of ``left`` columns with the columns of named groups, strongest first.

    Null where there are fewer than three complete pairs or a side is constant.
    """
    present = set(numeric_columns(df))
    name_of = {c: g for g, cs in groups.items() for c in reversed(cs)}
    others = [c for cs in groups.values() for c in cs if c in present]
    pairs = [(a, b) for a in left if a in present for b in others if a != b]
    labels = F.create_map(*[F.lit(x) for pair in name_of.items() for x in pair])
    r = F.when(F.col("n") >= 3, F.col("r"))
    return _pair_grid(df, pairs).select(
        F.col("a").alias("physical_metric"), F.col("b").alias("compared_metric"),
        labels[F.col("b")].alias("metric_group"),
        r.alias("pearson_corr"), F.abs(r).alias("abs_pearson_corr"), "n",
    ).orderBy(F.desc_nulls_last("abs_pearson_corr"), "physical_metric", "compared_metric")


def value_counts(df: DataFrame, column: str, dropna: bool = True, by: str = "count") -> DataFrame:
    """Rows per value, by count (largest first) or by value."""
    kept = df.filter(F.col(column).isNotNull()) if dropna else df
    counts = kept.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column) if by == "count" else counts.orderBy(column)


def counter_totals(
    df: DataFrame, columns: Sequence[str], status: str | None = None, ok: str = "ok"
) -> DataFrame:
    """Total and maximum of counters (null counts as 0), rows and rows with status ``ok``."""
    columns = [c for c in columns if c in df.columns]
    value = lambda c: F.coalesce(number(c), F.lit(0.0))
    hits = F.count_if(F.col(status) == ok) if status and status in df.columns else F.lit(None).cast("bigint")
    return _one_row_per_column(df, columns, lambda c: {
        "total": F.sum(value(c)), "maximum": F.max(value(c)),
        "rows": F.count(F.lit(1)), "ok_rows": hits,
    })


def histogram(df: DataFrame, column: str, bins: int | str = 30) -> DataFrame:
    """Equal-width bins ``(bin, lower, upper, count)``; the last bin is closed.

    ``bins`` may be ``"half"`` or ``"all"``: between 3 and 10 by the number of
    values. Equal values spread over a unit-wide range around them.
    """
    values = df.select(number(column).alias("value")).filter("value is not null")
    n = F.count(F.lit(1))
    rule = {"half": F.floor(n / 2), "all": n}
    size = F.lit(bins) if isinstance(bins, int) else F.least(F.lit(10), F.greatest(F.lit(3), rule[bins]))
    flat = F.min("value") == F.max("value")
    edges = values.agg(
        F.when(flat, F.min("value") - 0.5).otherwise(F.min("value")).alias("lo"),
        F.when(flat, F.max("value") + 0.5).otherwise(F.max("value")).alias("hi"),
        size.cast("int").alias("bins"),
    )
    lo, hi, k = (edges.select(c).scalar() for c in ("lo", "hi", "bins"))
    bucket = F.least(F.width_bucket("value", lo, hi, k), k.cast("bigint")).alias("bin")
    counts = values.groupBy(bucket).agg(F.count(F.lit(1)).alias("count"))
    frame = edges.filter("lo is not null").select(
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("bins").cast("bigint"))).alias("bin"),
        "lo", ((F.col("hi") - F.col("lo")) / F.col("bins")).alias("width"),
    )
    return frame.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("lower"),
        (F.col("lo") + F.col("bin") * F.col("width")).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    ).orderBy("bin")


def box_stats(df: DataFrame, value: str, group: str, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (most extreme values inside the fences) and fliers per category."""
    kept = df.filter(F.col(group).isNotNull()).select(group, number(value).alias("value"))
    boxes = stage(
        exact_quantiles(kept, ["value"], [0.25, 0.5, 0.75], by=[group], names=["q1", "median", "q3"])
        .withColumns(_bounds(k)).drop("column", "iqr"), "boxes"
    )
    v = F.col("value")
    inside = v.between(F.col("lower_bound"), F.col("upper_bound"))
    extremes = kept.join(boxes, group).groupBy(group).agg(
        F.min(F.when(inside & (v <= F.col("q1")), v)).alias("_low"),
        F.max(F.when(inside & (v >= F.col("q3")), v)).alias("_high"),
        F.count_if(~inside).alias("fliers"),
    )
    return boxes.join(extremes, group).select(
        group, "n", "q1", "median", "q3",
        F.coalesce("_low", "q1").alias("whisker_low"), F.coalesce("_high", "q3").alias("whisker_high"),
        "fliers",
    )


def xy_sample(df: DataFrame, x: str, y: str) -> DataFrame:
    """All complete pairs of two columns."""
    return df.select(number(x).alias("x"), number(y).alias("y")).na.drop()


def pivot(
    df: DataFrame, index: str, column: str, value: str, values: Sequence, how: str = "mean",
    order: str | None = None,
) -> DataFrame:
    """Pivot table over the listed column values; ``first`` follows ``order``."""
    agg = F.avg(value) if how == "mean" else F.min_by(value, order)
    return df.groupBy(index).pivot(column, list(values)).agg(agg)


def quality_summary(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], targets: Sequence[str],
    counted: str | None = None,
) -> DataFrame:
    """Dataset card as ``(section, key, value)``."""
    def rows(section: str, frame: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
        cells = F.array(*[
            F.struct(F.concat(F.col(key), F.lit(f".{n}")).alias("key"), F.col(n).cast("double").alias("value"))
            for n in names
        ])
        return frame.select(F.lit(section).alias("section"), F.inline(cells))

    total = missing_report(df).agg(F.sum("missing_count").cast("double").alias("value"))
    dup = duplicate_report(df, keys, metrics)
    names = dup.columns
    parts = [
        total.select(F.lit("missing").alias("section"), F.lit("total").alias("key"), "value"),
        dup.select(F.lit("duplicates").alias("section"), F.inline(F.array(*[
            F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names
        ]))),
        constant_report(df).filter("is_constant").select(
            F.lit("constant").alias("section"), F.col("column").alias("key"),
            F.col("unique_values").cast("double").alias("value"),
        ),
        rows("targets", describe(df, targets), "column",
             ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]),
    ]
    if counted:
        parts.append(value_counts(df, counted).select(
            F.lit("counts").alias("section"), F.col(counted).cast("string").alias("key"),
            F.col("count").cast("double").alias("value"),
        ))
    return reduce(DataFrame.unionByName, parts)
