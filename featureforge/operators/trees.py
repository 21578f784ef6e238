"""Forests and boosted trees per fold, fitted by MLlib on the training rows of the fold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from featureforge.operators.moments import fold_centres, make_design, prepare
from featureforge.operators.scaling import fold_names
from featureforge.operators.solvers import capped
from featureforge.staging import spread, stage


def forest(trees: int = 200, min_leaf: int = 1, max_depth: int = 30, max_bins: int = 64, seed: int = 42):
    """Random forest with every feature at every split."""
    return RandomForestRegressor(
        featuresCol="inputs", labelCol="y", predictionCol="yhat", numTrees=trees, minInstancesPerNode=min_leaf,
        featureSubsetStrategy="all", maxDepth=max_depth, maxBins=max_bins, seed=seed,
    )


def boosting(stages: int = 100, rate: float = 0.1, max_depth: int = 3, max_bins: int = 64, seed: int = 42):
    return GBTRegressor(
        featuresCol="inputs", labelCol="y", predictionCol="yhat", maxIter=stages, stepSize=rate,
        maxDepth=max_depth, maxBins=max_bins, seed=seed,
    )


def _reducer(reduction: str, p: int, n: int) -> list:
    """Stages from the assembled vector to ``inputs``."""
    if reduction in ("none", "all_features"):
        return []
    if reduction.startswith("select_k_"):
        k = capped(int(reduction.removeprefix("select_k_")), p, n)
        return [UnivariateFeatureSelector(
            featuresCol="vector", labelCol="y", outputCol="inputs", selectionMode="numTopFeatures"
        ).setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(k)]
    if reduction.startswith("pca_"):
        m = capped(int(reduction.removeprefix("pca_")), p, n)
        # sample deviations here, population ones elsewhere: a common factor, which moves no axis and no split
        return [
            StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True),
            PCA(inputCol="scaled", outputCol="inputs", k=m),
        ]
    raise ValueError(f"Unknown reduction: {reduction}")


def _pipeline(estimator, names: Sequence[str], reduction: str, n: int) -> Pipeline:
    stages = _reducer(reduction, len(names), n)
    output = "vector" if stages else "inputs"
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol=output), *stages, estimator])


def fit_trees(
    df: DataFrame, features: Sequence[str], y: str, fold: str, estimator, reduction: str = "none",
    extra: Sequence[str] = (), parallelism: int = 2,
) -> tuple[DataFrame, dict]:
    """Out-of-fold table and the fitted pipeline of every fold.

    Missing values take the training median of the fold. Folds are fitted side
    by side, ``parallelism`` at a time; each fit is itself distributed.
    """
    prepared = spread(stage(prepare(df, features, y, fold, extra), "prepared"))
    folds = fold_names(prepared)
    design = make_design(prepared, features)
    names = [f"x{i}" for i in range(len(features))]
    medians = {r.fold: r.medians or {} for r in fold_centres(prepared, design).collect()}
    sizes = {r.fold: r["count"] for r in prepared.groupBy("fold").count().collect()}
    total = sum(sizes.values())

    def filled(rows: DataFrame, name: str) -> DataFrame:
        return rows.fillna({f"x{i}": medians[name].get(i, 0.0) for i in design.masked}) if design.masked else rows

    def fit(name: str):
        train = filled(prepared.filter(F.col("fold") != name), name)
        model = _pipeline(estimator, names, reduction, total - sizes[name]).fit(train)
        held = filled(prepared.filter(F.col("fold") == name), name)
        keep = [c for c in prepared.columns if c not in names]
        return name, model, model.transform(held).select(*keep, "yhat")

    pool = ThreadPool(max(1, min(parallelism, len(folds))))
    try:
        fitted = pool.map(inheritable_thread_target(df.sparkSession)(fit), folds)
    finally:
        pool.close()
    oof = reduce(DataFrame.unionByName, [part for _, _, part in fitted])
    return oof, {name: model for name, model, _ in fitted}


def importance_table(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """``(feature, importance)``, largest first, of a fitted tree pipeline without projection."""
    tree = model.stages[-1]
    used = list(features)
    for part in model.stages:
        if hasattr(part, "selectedFeatures"):
            used = [features[i] for i in part.selectedFeatures]
    rows = [(f, float(v)) for f, v in zip(used, tree.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
