"""Preparation fitted on the training rows of every fold.

``eval_fold`` names the held-out fold; its statistics come from all other rows.
Means and variances of the training rows follow from one aggregation per fold
by taking the held-out part off the total, so rows are not repeated per fold.
Medians and quartiles come from ranks outside the fold in counts by fold
(``quantiles.py``), so that they repeat no row either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featureforge.functions.columns import number
from featureforge.operators.quantiles import training_quantiles
from featureforge.staging import stage

TRAIN_ONLY = "__train__"
MAX_LISTED_FOLDS = 10_000


def fold_names(df: DataFrame, fold: str = "fold") -> list[str]:
    """Folds that are held out once; rows of the fold ``__train__`` never are."""
    rows = df.select(F.col(fold).cast("string").alias("f")).distinct().limit(MAX_LISTED_FOLDS + 1).collect()
    if len(rows) > MAX_LISTED_FOLDS:
        raise ValueError(f"more than {MAX_LISTED_FOLDS} folds; use fewer or coarser groups")
    return sorted(r.f for r in rows if r.f is not None and r.f != TRAIN_ONLY)


def held_out(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a table that ``expand_folds`` gave: every row once, in the fold that holds it out, and all folds."""
    fold = F.col("eval_fold").cast("string")
    return df.filter(~F.col("is_train")).withColumn("fold", fold), df.select(fold.alias("fold")).distinct()


def _training(df: DataFrame, columns: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    rows, folds = held_out(df)
    stats = training_quantiles(rows, columns, probs, names, folds)
    return stats.withColumn("eval_fold", F.col("eval_fold").cast(df.schema["eval_fold"].dataType))


def fold_moment_stats(df: DataFrame, columns: Sequence[str], fold: str = "fold") -> DataFrame:
    """Training-row ``n``, ``mean``, ``std`` (ddof 0) and ``min`` per ``eval_fold`` and column.

    One scan. Deviations are taken from the overall mean, so the difference of
    total and held-out part keeps its precision.
    """
    aggs = []
    for i, c in enumerate(columns):
        v = number(c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"), F.min(v).alias(f"a{i}")]
    wide = df.groupBy(F.col(fold).cast("string").alias("fold")).agg(*aggs)
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.coalesce(f"m{i}", F.lit(0.0)).alias("m"),
            F.coalesce(f"v{i}", F.lit(0.0)).alias("v"), F.col(f"a{i}").alias("a"),
        ) for i, c in enumerate(columns)
    ])
    parts = stage(wide.select("fold", F.inline(cells)), "fold-moments")
    overall = parts.groupBy("column").agg(
        F.sum("n").alias("tn"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("tm"),
    )
    shifted = stage(parts.join(overall, "column").withColumns({
        "s1": F.col("n") * (F.col("m") - F.col("tm")),
        "s2": F.col("n") * (F.col("v") + (F.col("m") - F.col("tm")) ** 2),
    }), "fold-sums")
    low = F.struct("a", "fold")
    sums = shifted.groupBy("column").agg(
        F.sum("s1").alias("t1"), F.sum("s2").alias("t2"),
        F.min(F.when(F.col("a").isNotNull(), low)).alias("lowest"),
    )
    second = shifted.join(sums.select("column", F.col("lowest.fold").alias("lf")), "column").filter(
        ~F.col("fold").eqNullSafe(F.col("lf"))
    ).groupBy("column").agg(F.min("a").alias("a2"))
    joined = shifted.join(sums, "column").join(second, "column", "left")
    n = F.col("tn") - F.col("n")
    d1 = F.try_divide(F.col("t1") - F.col("s1"), n)
    var = F.try_divide(F.col("t2") - F.col("s2"), n) - d1 * d1
    return joined.filter(F.col("fold") != TRAIN_ONLY).select(
        F.col("fold").alias("eval_fold"), "column", n.alias("n"), (F.col("tm") + d1).alias("mean"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"),
        F.when(F.col("fold") == F.col("lowest.fold"), F.col("a2")).otherwise(F.col("lowest.a")).alias("min"),
    )


def _attach(df: DataFrame, stats: DataFrame, columns: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Statistics of the row's ``eval_fold`` as columns ``_<value>_<i>``."""
    aggs = [
        F.max(F.when(F.col("column") == c, F.col(v))).alias(f"_{v}_{i}")
        for i, c in enumerate(columns) for v in values
    ]
    return df.join(stage(stats.groupBy("eval_fold").agg(*aggs), "fold-stats"), "eval_fold")


def _apply(df: DataFrame, columns: Sequence[str], values: Sequence[str], rule) -> DataFrame:
    out = df.withColumns({
        c: rule(number(c), *[F.col(f"_{v}_{i}") for v in values]) for i, c in enumerate(columns)
    })
    return out.drop(*[f"_{v}_{i}" for i in range(len(columns)) for v in values])


def fold_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` comes from ``expand_folds``: nulls become the training median."""
    joined = _attach(df, _training(df, columns, [0.5], ["median"]), columns, ["median"])
    return _apply(joined, columns, ["median"], lambda x, m: F.coalesce(x, m))


def fold_standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Training mean 0 and population std 1; a constant column is only centred."""
    train = df.filter("is_train")
    aggs = [a for i, c in enumerate(columns) for a in (
        F.avg(number(c)).alias(f"_mean_{i}"), F.stddev_pop(number(c)).alias(f"_std_{i}"))]
    joined = df.join(stage(train.groupBy("eval_fold").agg(*aggs), "fold-scale"), "eval_fold")
    return _apply(joined, columns, ["mean", "std"], lambda x, m, s: (x - m) / unit_if_zero(s))


def fold_robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x − training median) / training IQR; a zero IQR counts as 1. ``df`` comes from ``expand_folds``."""
    stats = _training(df, columns, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    joined = _attach(df, stats, columns, ["q1", "median", "q3"])
    return _apply(
        joined, columns, ["q1", "median", "q3"], lambda x, a, m, b: (x - m) / unit_if_zero(b - a)
    )


def unit_if_zero(scale: Column) -> Column:
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def log1p_shift(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log1p after moving negative training minima to zero; missing values count as 0.

    Rows of the held-out fold use the shift of the training rows and are
    clipped at zero. Without ``eval_fold`` the whole table is the training set.
    """
    filled = df.withColumns({c: F.coalesce(number(c), F.lit(0.0)) for c in columns})
    filled = filled.withColumns({c: F.when(F.abs(c) == float("inf"), 0.0).otherwise(F.col(c)) for c in columns})
    if "eval_fold" not in df.columns:
        low = filled.agg(*[F.min(c).alias(c) for c in columns])
        return filled.withColumns({
            c: F.log1p(F.col(c) + F.greatest(-low.select(c).scalar(), F.lit(0.0))) for c in columns
        })
    mins = filled.filter("is_train").groupBy("eval_fold").agg(*[
        F.min(c).alias(f"_min_{i}") for i, c in enumerate(columns)
    ])
    joined = filled.join(stage(mins, "fold-min"), "eval_fold")
    return _apply(
        joined, columns, ["min"],
        lambda x, a: F.log1p(F.greatest(x + F.greatest(-a, F.lit(0.0)), F.lit(0.0))),
    )
