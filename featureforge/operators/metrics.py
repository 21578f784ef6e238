"""Regression metrics over an out-of-fold table ``(config…, fold, y, yhat)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from featureforge.staging import stage

METRICS = ("mae", "rmse", "r2", "relative_mae")


def _target_stats(y: str) -> list:
    return [
        F.count(F.lit(1)).alias("test_rows"), F.var_pop(y).alias("_var"),
        (F.min(y) < F.max(y)).alias("_varies"), F.avg(F.abs(F.col(y))).alias("_scale"),
    ]


def _finish(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics from ``mae``, ``_mse`` and the target statistics."""
    r2 = (
        F.when(F.col("test_rows") < 2, None)
        .when(F.col("_varies"), 1 - F.try_divide(F.col("_mse"), F.col("_var")))
        .when(F.col("_mse") == 0, 1.0)
        .otherwise(0.0)
    )
    return sums.select(
        *by, "test_rows", "mae", F.sqrt("_mse").alias("rmse"), r2.alias("r2"),
        F.try_divide(F.col("mae"), F.col("_scale")).alias("relative_mae"),
    )


def regression_metrics(
    oof: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """MAE, RMSE, R² and relative MAE per group, one aggregation.

    R² is null for a single row; for a constant target it is 1 when every
    prediction is exact, else 0. Relative MAE is null where the mean of |y| is 0.
    """
    error = F.col(y) - F.col(yhat)
    sums = oof.groupBy(*by).agg(
        *_target_stats(y), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("_mse")
    )
    return _finish(sums, by)


def metrics_from_sums(sums: DataFrame, rows: DataFrame, y: str = "y") -> DataFrame:
    """Metrics from error sums ``(config_id, fold, abs_sum, sq_sum)`` and the held-out rows of every fold."""
    target = rows.groupBy("fold").agg(*_target_stats(y))
    joined = sums.join(target, "fold").withColumns({
        "mae": F.col("abs_sum") / F.col("test_rows"), "_mse": F.col("sq_sum") / F.col("test_rows"),
    })
    return _finish(joined, ["config_id", "fold"])


def fold_summary(metrics: DataFrame, by: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """Mean and std (ddof 1) over folds per metric; folds with a null metric are skipped."""
    aggs = [F.count(F.lit(1)).alias("folds"), F.sum("test_rows").alias("rows")]
    for m in names:
        aggs += [
            F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_folds"),
        ]
    return metrics.groupBy(*by).agg(*aggs)


def group_detail(oof: DataFrame, config: Sequence[str] = (), group: str = "fold") -> DataFrame:
    """Metrics of every held-out group."""
    return regression_metrics(oof, [*config, group]).withColumnRenamed(group, "heldout_group")


def mean_of_other_groups(df: DataFrame, group: str, y: str) -> DataFrame:
    """Out-of-fold table of the predictor that knows the mean of all other groups.

    Group sums are aggregated first; no row is repeated per fold.
    """
    kept = df.filter(F.col(group).isNotNull() & F.col(y).isNotNull())
    sums = kept.groupBy(group).agg(F.sum(y).alias("_s"), F.count(F.lit(1)).alias("_n"))
    total = kept.agg(F.sum(y).alias("_s"), F.count(F.lit(1)).alias("_n"))
    others = sums.select(
        group,
        F.try_divide(total.select("_s").scalar() - F.col("_s"), total.select("_n").scalar() - F.col("_n")).alias("yhat"),
    )
    return kept.join(stage(others, "others"), group).select(
        F.col(group).cast("string").alias("fold"), F.col(y).cast("double").alias("y"), "yhat"
    )
