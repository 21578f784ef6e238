"""Grids of feature set × preparation × model × validation scheme, and their result table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from featureforge.functions.columns import safe_div
from featureforge.operators.features import reconstruct
from featureforge.operators.folds import assign_group_folds, assign_kfold, split_holdout
from featureforge.operators.kernel import fit_rff
from featureforge.operators.linear import Config, FittedGrid, fit_grid
from featureforge.operators.metrics import fold_summary, regression_metrics
from featureforge.operators.results import union_all
from featureforge.operators.scaling import TRAIN_ONLY
from featureforge.operators.trees import boosting, fit_trees, forest
from featureforge.staging import stage


@dataclass(frozen=True)
class Model:
    """A named model: ``kind`` is a linear solver, ``rff``, ``forest`` or ``boosting``."""

    name: str
    kind: str
    params: Mapping[str, object] = field(default_factory=dict)


# The models of the published grids.
RIDGES = [Model(f"ridge_a{a}", "ridge", {"alpha": float(a)}) for a in ("0.1", "1", "10")]
ELASTIC_NETS = [
    Model(f"elasticnet_a{a}_l1{l}", "elastic_net", {"alpha": a, "l1_ratio": l})
    for a in (0.001, 0.01, 0.1, 1.0) for l in (0.2, 0.5, 0.8)
]
PLS_MODELS = [Model(f"pls_{m}", "pls", {"components": m}) for m in (2, 3, 5)]
KERNELS = [Model(f"gpr_{k}", "rff", {"kernel": k}) for k in ("matern", "rbf", "rq")]
BASELINES = [
    Model("linear_regression", "ols"), Model("random_forest", "forest"), Model("gradient_boosting", "boosting"),
]
ENGINEERED = [
    Model("ridge", "ridge", {"alpha": 1.0}), Model("random_forest", "forest", {"min_leaf": 2}),
    Model("gradient_boosting", "boosting", {"max_depth": 2}), Model("gaussian_process", "rff", {"kernel": "rbf"}),
]
LINEAR_GRID = RIDGES + ELASTIC_NETS + PLS_MODELS
EVALUATIONS = ("random_split", "kfold", "groupkfold")
LINEAR_KINDS = ("ols", "ridge", "elastic_net", "pls")


@dataclass(frozen=True)
class Target:
    """A target column, or the ratio ``column / denominator`` scored in original units."""

    column: str
    denominator: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class Grid:
    """What to run. ``feature_sets`` maps a name to feature names, or to a function of the target."""

    targets: Sequence[Target]
    feature_sets: Mapping[str, Sequence[str] | Callable[[str], Sequence[str]]]
    models: Sequence[Model]
    id_col: str
    group_col: str | None = None
    scalers: Sequence[str] = ("standard",)
    reductions: Sequence[str] = ("none",)
    logs: Sequence[bool] = (False,)
    evaluations: Sequence[str] = EVALUATIONS
    folds: int = 5
    seed: int = 42
    min_rows: int = 6


def with_folds(df: DataFrame, grid: Grid, evaluation: str) -> DataFrame:
    """Rows with the column ``_fold`` of a validation scheme."""
    if evaluation == "random_split":
        split = split_holdout(df, grid.id_col, 0.25, grid.seed, grid.min_rows)
        return split.withColumn("_fold", F.when(F.col("is_test"), "test").otherwise(TRAIN_ONLY)).drop("is_test")
    if evaluation == "kfold":
        split = assign_kfold(df, grid.id_col, grid.folds, grid.seed, grid.min_rows)
        return split.withColumn("_fold", F.col("fold").cast("string")).drop("fold")
    if evaluation == "groupkfold":
        return assign_group_folds(df, grid.group_col).withColumnRenamed("fold", "_fold")
    raise ValueError(f"Unknown evaluation: {evaluation}")


TREES = ("forest", "boosting")


def _configs(grid: Grid, sets: Mapping[str, Sequence[str]], log: bool):
    """``(attributes, model, features)`` of every combination; PLS is not stacked on a reduction.

    Scaling and logarithms keep the order of a feature, and so the splits of a tree: trees are
    listed once, as unscaled, or standardised before principal axes, with the first log flag.
    """
    for set_name, features in sets.items():
        for scaler in grid.scalers:
            for reduction in grid.reductions:
                for model in grid.models:
                    if model.kind == "pls" and reduction not in ("none", "all_features"):
                        continue
                    if not features:
                        continue
                    label = scaler
                    if model.kind in TREES:
                        if scaler != grid.scalers[0] or log != grid.logs[0]:
                            continue
                        label = "standard" if reduction.startswith("pca_") else "none"
                    yield (set_name, label, reduction, model.name, len(features)), model, features


ATTRIBUTES = "config_id string, feature_set string, scaler string, reduction string, model string, features int"


def _tree(model: Model):
    return (forest if model.kind == "forest" else boosting)(**model.params)


@dataclass(frozen=True)
class Run:
    """Parts of one target, evaluation and log flag."""

    linear: FittedGrid | None
    tables: Sequence[DataFrame]
    errors: Sequence[DataFrame]
    attributes: DataFrame
    rows: DataFrame
    ratio: bool

    def out_of_fold(self) -> DataFrame:
        """``(config_id, fold, y, yhat)`` of every configuration, in units of the target column."""
        parts = list(self.tables) + ([self.linear.out_of_fold()] if self.linear else [])
        return reduce(DataFrame.unionByName, [self._in_units(p) for p in parts])

    def fold_metrics(self) -> DataFrame:
        parts = [regression_metrics(self._in_units(p), ["config_id", "fold"]) for p in self.tables]
        if self.linear:
            y, unit = ("y_original", "denominator") if self.ratio else ("y", None)
            parts.append(self.linear.fold_metrics(y, unit))
        return reduce(DataFrame.unionByName, parts)

    def _in_units(self, oof: DataFrame) -> DataFrame:
        if not self.ratio:
            return oof.select("config_id", "fold", "y", "yhat")
        yhat = reconstruct("yhat", "denominator")
        return oof.select("config_id", "fold", F.col("y_original").alias("y"), yhat.alias("yhat"))


def fit(df: DataFrame, grid: Grid, target: Target, evaluation: str, log: bool) -> Run:
    """Fit every configuration of one target and validation scheme."""
    spark = df.sparkSession
    sets = _feature_sets(grid, target)
    union = list(dict.fromkeys(f for s in sets.values() for f in s))
    position = {f: i for i, f in enumerate(union)}
    rows = df.filter(F.col(target.column).isNotNull())
    extra: list[str] = []
    y = target.column
    if target.denominator:
        y, extra = "_ratio", ["y_original", "denominator"]
        rows = rows.withColumns({
            "_ratio": safe_div(target.column, target.denominator),
            "y_original": F.col(target.column).cast("double"),
            "denominator": F.col(target.denominator).cast("double"),
        }).filter(F.col("_ratio").isNotNull())
    rows = with_folds(rows, grid, evaluation).select(
        *[F.col(f"`{f}`") for f in union if f != y], y, "_fold", *extra,
    )

    attributes, linear, others = [], [], []
    for (set_name, scaler, reduction, name, p), model, features in _configs(grid, sets, log):
        config_id = f"{set_name}|{scaler}|{reduction}|{name}"
        attributes.append((config_id, set_name, scaler, reduction, name, p))
        if model.kind in LINEAR_KINDS:
            linear.append(Config(
                config_id, tuple(position[f] for f in features), model.kind, dict(model.params), scaler, reduction
            ))
        else:
            others.append((config_id, scaler, reduction, model, features))

    fitted, tables, errors = None, [], []
    if linear:
        fitted = fit_grid(rows, union, y, "_fold", linear, log, extra)
        failed = fitted.solutions.filter("error is not null")
        errors.append(failed.groupBy("config_id").agg(F.min("error").alias("error")))
    for config_id, scaler, reduction, model, features in others:
        try:
            if model.kind == "rff":
                oof = fit_rff(rows, features, y, "_fold", scaler=scaler, reduction=reduction, log=log, seed=grid.seed,
                              extra=extra, **model.params)
            else:
                oof, _ = fit_trees(rows, features, y, "_fold", _tree(model), reduction, extra)
            tables.append(oof.withColumn("config_id", F.lit(config_id)))
        except Exception as error:  # a failed configuration is a result row, as every other
            errors.append(spark.createDataFrame([(config_id, str(error))], "config_id string, error string"))
    table = spark.createDataFrame(attributes, ATTRIBUTES)
    return Run(fitted, tables, errors, table, rows, bool(target.denominator))


def _feature_sets(grid: Grid, target: Target) -> dict[str, list[str]]:
    return {n: list(s(target.column) if callable(s) else s) for n, s in grid.feature_sets.items()}


def _needed(grid: Grid) -> list[str]:
    """Columns the grid reads, each once."""
    names = [grid.id_col] + ([grid.group_col] if grid.group_col else [])
    for target in grid.targets:
        names += [target.column] + ([target.denominator] if target.denominator else [])
        names += [f for s in _feature_sets(grid, target).values() for f in s]
    return list(dict.fromkeys(names))


def run_grid(df: DataFrame, grid: Grid, detail: bool = False) -> DataFrame:
    """Result table: one row per target, evaluation, log flag and configuration; failures carry ``error``.

    ``detail`` gives one row per held-out fold instead, and one per configuration that failed in any.
    """
    # Every target and scheme reads the table several times; it is computed and written once.
    df = stage(df.select(*[F.col(f"`{c}`") for c in _needed(grid)]), "grid-input")
    results = []
    for target in grid.targets:
        for evaluation in grid.evaluations:
            for log in grid.logs:
                run = fit(df, grid, target, evaluation, log)
                tags = {
                    "evaluation": F.lit(evaluation), "target": F.lit(target.column),
                    "normalized_target": F.lit(target.name).cast("string"), "use_log_transform": F.lit(log),
                }
                # a configuration that failed in one fold has no score, whatever its other folds gave
                failed = union_all(run.errors).groupBy("config_id").agg(F.min("error").alias("error")) if run.errors else None
                per_fold = run.fold_metrics()
                if failed is not None:
                    failed = stage(failed, "failed")
                    per_fold = per_fold.join(failed.select("config_id"), "config_id", "left_anti")
                if detail:
                    held_out = per_fold.withColumnRenamed("fold", "heldout_group")
                    parts = [held_out.join(run.attributes, "config_id")]
                    parts += [run.attributes.join(failed, "config_id")] if failed is not None else []
                    results.append(stage(union_all(parts).withColumns(tags), "result"))
                    continue
                summary = fold_summary(per_fold, ["config_id"]).withColumnRenamed("rows", "test_rows")
                summary = summary.withColumn("rows", run.rows.agg(F.count(F.lit(1))).scalar())
                parts = [run.attributes.join(summary, "config_id")]
                parts += [run.attributes.join(failed, "config_id")] if failed is not None else []
                results.append(stage(union_all(parts).withColumns(tags), "result"))
    out = union_all(results)
    if not detail and "error" not in out.columns:
        out = out.withColumn("error", F.lit(None).cast("string"))
    return out


__all__ = ["Grid", "Model", "Target", "run_grid", "fit", "with_folds"]
