"""One table from the results of all experiments, and the picks that are reported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from featureforge.operators.results import best_preferred, best_rows, standardize, union_all

COLUMNS = [
    "evaluation", "target", "model", "feature_set", "reduction", "scaler", "benchmark_onehot",
    "mae", "rmse", "r2", "relative_mae", "rows", "features",
]
# Where each experiment keeps the common columns, and its constant texts.
EXPERIMENTS: dict[str, tuple[Mapping[str, str], Mapping[str, str]]] = {
    "baseline": ({"mae": "mae", "rmse": "rmse", "r2": "r2"},
                 {"feature_set": "all_direct_features", "reduction": "none", "scaler": "default"}),
    "feature_engineering": ({"feature_set": "reduction", "features": "features_before"}, {"scaler": "standard"}),
    "rigorous_direct_target": ({"feature_set": "feature_mode", "benchmark_onehot": "include_benchmark_onehot"},
                               {"scaler": "standard_or_log"}),
    "eda_aware_normalized_target": (
        {"target": "original_target", "normalized_target": "normalized_target", "mae": "mae_original",
         "rmse": "rmse_original", "r2": "r2_original", "relative_mae": "relative_mae_original",
         "benchmark_onehot": "include_benchmark_onehot"},
        {"feature_set": "semantic_ratios_normalized_target"}),
    "ablation_direct_target": ({"benchmark_onehot": "include_benchmark_onehot"}, {}),
}
TYPES = {"mae": "double", "rmse": "double", "r2": "double", "relative_mae": "double",
         "rows": "bigint", "features": "bigint", "benchmark_onehot": "boolean"}
GROUP_EVALUATION = "groupkfold_by_benchmark"
# Other names of the leave-one-group-out scheme.
GROUP_ALIASES = {"leave_one_benchmark_out": GROUP_EVALUATION, "groupkfold": GROUP_EVALUATION}
# The experiment that is reported per target.
PREFERRED = [
    ("synth_chip_area", "rigorous_direct_target", GROUP_EVALUATION),
    ("critical_path_delay", "rigorous_direct_target", GROUP_EVALUATION),
    ("total_power", "ablation_direct_target", GROUP_EVALUATION),
]


def standardize_experiment(df: DataFrame, experiment: str) -> DataFrame:
    """One experiment in the common shape; fold means stand in where a plain metric is absent."""
    renames, texts = EXPERIMENTS[experiment]
    present = set(df.columns)
    for metric in ("mae", "rmse", "r2"):
        mean = f"{metric}_mean"
        if mean in present:
            df = df.withColumn(metric, F.coalesce(metric, mean) if metric in present else F.col(mean))
    columns = {c: renames.get(c, c) for c in COLUMNS if c not in texts}
    columns |= {c: s for c, s in renames.items() if c not in COLUMNS}
    out = standardize(df, columns, {"experiment": experiment, **texts})
    out = out.withColumns({c: F.col(c).try_cast(t) for c, t in TYPES.items()})
    alias = F.create_map(*[F.lit(x) for pair in GROUP_ALIASES.items() for x in pair])
    return out.withColumn("evaluation", F.coalesce(F.try_element_at(alias, F.col("evaluation")), F.col("evaluation")))


def combine(results: Mapping[str, DataFrame]) -> DataFrame:
    """All experiments that are present, in one table."""
    return union_all([standardize_experiment(df, name) for name, df in results.items() if df.columns])


def best_by_relative_mae(table: DataFrame, tie: Sequence[str] = ("experiment", "model", "feature_set")) -> DataFrame:
    return best_rows(table, ["target", "evaluation"], "relative_mae", True, tie)


def best_by_r2(table: DataFrame, tie: Sequence[str] = ("experiment", "model", "feature_set")) -> DataFrame:
    return best_rows(table, ["target", "evaluation"], "r2", False, tie)


def preferred_results(
    table: DataFrame, preferred: Sequence[tuple[str, str, str]] = tuple(PREFERRED),
    tie: Sequence[str] = ("model", "feature_set"),
) -> DataFrame:
    """Best row per target within its preferred experiment and validation scheme."""
    prefs = table.sparkSession.createDataFrame(list(preferred), "target string, experiment string, evaluation string")
    return best_preferred(table, prefs, ["target", "experiment", "evaluation"], ["target"], "relative_mae", True, tie)
