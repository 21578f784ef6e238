"""Linear models for many configurations and folds from one set of fold moments."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from featureforge.operators.metrics import metrics_from_sums
from featureforge.operators.moments import (
    Design, design_columns, fold_centres, fold_moments, gram_partials, make_design, prepare, sum_vectors,
)
from featureforge.operators.quantiles import exact_quantiles
from featureforge.operators.scaling import TRAIN_ONLY
from featureforge.operators.solvers import LINEAR, reduction_basis, f_scores, best_k, capped, principal_axes
from featureforge.staging import spread, stage


@dataclass(frozen=True)
class Config:
    """One model configuration over a subset of the features (positions)."""

    config_id: str
    features: tuple[int, ...]
    model: str
    params: Mapping[str, float] = field(default_factory=dict)
    scaler: str = "standard"
    reduction: str = "none"


@dataclass(frozen=True)
class TrainView:
    """Training moments of one fold, for a subset of the features, in scaled units."""

    n: float
    cov: np.ndarray
    cov_y: np.ndarray
    var_y: float
    mean_y: float
    divisor: np.ndarray
    raw_center: np.ndarray
    lift: np.ndarray
    center: np.ndarray
    scale: np.ndarray


def train_view(design: Design, row, features: Sequence[int], scaler: str) -> TrainView:
    """Impute, centre and scale by algebra on the moment matrix of one fold."""
    if scaler == "robust" and design.log:
        raise ValueError("robust scaling is not defined for log features")
    d = design.width
    train = (np.asarray(row["total"]) - np.asarray(row["held"])).reshape(d, d)
    n = train[0, 0]
    if n < 2:
        raise ValueError("fewer than two training rows")
    medians = dict(row["medians"] or {})
    entries = [design.entry(f, row["fold"]) for f in features]
    lift = np.zeros((d, len(features) + 2))
    lift[0, 0] = lift[d - 1, -1] = 1.0
    for j, (f, e) in enumerate(zip(features, entries)):
        lift[e, 1 + j] = 1.0
        mask = design.mask_entry(f)
        if mask is not None:
            value = medians.get(f, 0.0)
            shift = design.values[e - 1][1]
            if shift is not None:
                value = np.log1p(max(value + shift, 0.0))
            lift[mask, 1 + j] = (value - design.center[e - 1]) / design.scale[e - 1]
    m = lift.T @ train @ lift
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    center = np.array([design.center[e - 1] for e in entries])
    scale = np.array([design.scale[e - 1] for e in entries])
    if scaler == "robust":
        q1, q3 = dict(row["q1"] or {}), dict(row["q3"] or {})
        spread = np.array([q3.get(f, 0.0) - q1.get(f, 0.0) for f in features])
        divisor = np.where(spread > 0, spread, 1.0) / scale
    elif scaler == "standard":
        var = np.diag(cov)[:-1]
        divisor = np.sqrt(np.where(var > 1e-14, var, 0.0))
    else:
        raise ValueError(f"Unknown scaler: {scaler}")
    divisor = np.where(divisor > 0, divisor, 1.0)
    xx, xy = cov[:-1, :-1] / np.outer(divisor, divisor), cov[:-1, -1] / divisor
    raw_center = center + scale * mean[:-1]
    return TrainView(n, xx, xy, cov[-1, -1], design.y_center + mean[-1], divisor * scale, raw_center, lift, center, scale)


def held_out_error(design: Design, row, view: TrainView, beta: np.ndarray, intercept: float) -> float:
    """Sum of squared errors on the held-out rows, a quadratic form of their moments."""
    d = design.width
    held = view.lift.T @ np.asarray(row["held"]).reshape(d, d) @ view.lift
    w = np.concatenate([[design.y_center - intercept - beta @ view.center], -beta * view.scale, [1.0]])
    return max(float(w @ held @ w), 0.0)


def _solve(design: Design, row, config: Config) -> dict:
    out = {
        "config_id": config.config_id, "fold": row["fold"], "train_rows": None, "intercept": None,
        "coef": None, "sq_sum": None, "error": None,
    }
    try:
        view = train_view(design, row, config.features, config.scaler)
        basis = reduction_basis(config.reduction, view.cov, view.cov_y, view.var_y, view.n)
        small = LINEAR[config.model](basis.T @ view.cov @ basis, basis.T @ view.cov_y, view.n, **config.params)
        beta = (basis @ small) / view.divisor
        coef = np.zeros(len(design.features))
        coef[list(config.features)] = beta
        intercept = float(view.mean_y - beta @ view.raw_center)
        out |= {
            "train_rows": int(round(view.n)), "coef": coef.tolist(), "intercept": intercept,
            "sq_sum": held_out_error(design, row, view, beta, intercept),
        }
    except Exception as error:  # a failed configuration is a result row, as every other
        out["error"] = f"{type(error).__name__}: {error}"
    return out


SOLUTION = "config_id string, fold string, train_rows bigint, intercept double, coef array<double>, sq_sum double, error string"


def solve_grid(
    moments: DataFrame, centres: DataFrame, design: Design, configs: Sequence[Config], per_task: int = 64
) -> DataFrame:
    """Coefficients of every configuration and fold; each (fold, chunk of configurations) is one unit of work."""
    chunks = [list(configs[i:i + per_task]) for i in range(0, len(configs), per_task)]
    units = moments.join(centres, "fold").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))
    )

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                yield pd.DataFrame([_solve(design, row, c) for c in chunks[row["_chunk"]]])

    return units.repartition("fold", "_chunk").mapInPandas(work, SOLUTION)


def model_inputs(prepared: DataFrame, centres: DataFrame, design: Design) -> DataFrame:
    """Rows with the imputed (and logged) feature array ``x`` of their held-out fold."""
    medians = centres.select("fold", "medians")
    joined = prepared.join(medians, "fold") if design.masked else prepared
    items = []
    for i in range(len(design.features)):
        x = F.col(f"x{i}")
        if i in design.masked:
            x = F.coalesce(x, F.try_element_at("medians", F.lit(i)), F.lit(0.0))
        shift = design.values[i][1]
        if shift is not None:
            moved: Column = F.log1p(F.greatest(x + F.lit(float(shift)), F.lit(0.0)))
            if i in design.second:
                k, fold = design.second[i]
                other = F.log1p(F.greatest(x + F.lit(float(design.values[k][1])), F.lit(0.0)))
                moved = F.when(F.col("fold") == fold, other).otherwise(moved)
            x = moved
        items.append(x)
    keep = [c for c in prepared.columns if not (c.startswith("x") and c[1:].isdigit())]
    return joined.select(*keep, F.array(*items).alias("x"))


def predict(inputs: DataFrame, solutions: DataFrame) -> DataFrame:
    """Out-of-fold table: one row per held-out row and configuration, with ``yhat``."""
    fitted = stage(solutions.filter("error is null").select("config_id", "fold", "intercept", "coef"), "coefs")
    dot = F.aggregate(
        F.zip_with("x", "coef", lambda a, b: a * b), F.col("intercept"), lambda acc, v: acc + v
    )
    return inputs.join(fitted, "fold").withColumn("yhat", dot).drop("x", "coef", "intercept")


#: Configurations whose coefficients travel together, and rows that meet them at once.
CHUNK, BLOCK = 1024, 4096
#: Sums that a task holds before it hands them on.
MAX_OPEN_SUMS = 64


def row_blocks(inputs: DataFrame, y: str, unit: str | None) -> DataFrame:
    """``(fold, x, y, unit)``: up to ``BLOCK`` rows of one fold as arrays of doubles, row after row."""
    numbers = "array<double>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for fold in batch.column(0).unique():
                own = table.filter(pc.equal(table.column(0), fold)).combine_chunks()
                for start in range(0, own.num_rows, BLOCK):
                    part = own.slice(start, BLOCK)
                    lists = [pc.list_flatten(part.column(1)).to_numpy()] + [c.to_numpy() for c in part.columns[2:]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([fold.as_py()]), *[pa.array([v], pa.list_(pa.float64())) for v in lists]], batch.schema.names)

    columns = [F.col("fold"), F.col("x"), F.col(y).alias("y")] + ([F.col(unit).alias("unit")] if unit else [])
    return inputs.select(*columns).mapInArrow(pack, f"fold string, x {numbers}, y {numbers}" + (f", unit {numbers}" if unit else ""))


def error_sums(pairs: DataFrame, squares: bool) -> DataFrame:
    """``(fold, chunk, v)``: absolute errors of every configuration of a chunk (then squared ones), summed per task.

    Rows are ``(fold, chunk, x, y, coef, intercept[, unit])``, a block of rows with a chunk of configurations.
    """
    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}

        def flushed() -> pa.RecordBatch:
            folds, chunks = zip(*sums)
            out = pa.RecordBatch.from_arrays(
                [pa.array(folds, pa.string()), pa.array(chunks, pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["fold", "chunk", "v"])
            sums.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                fold, chunk = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                x, y, coef, intercept, *unit = (c[i].values.to_numpy() for c in batch.columns[2:])
                yhat = x.reshape(len(y), -1) @ coef.reshape(len(intercept), -1).T + intercept
                gap = y[:, None] - (yhat * unit[0][:, None] if unit else yhat)
                found = np.abs(gap).sum(axis=0)
                if squares:
                    found = np.concatenate([found, (gap * gap).sum(axis=0)])
                sums[fold, chunk] = sums[fold, chunk] + found if (fold, chunk) in sums else found
            if len(sums) > MAX_OPEN_SUMS:
                yield flushed()
        if sums:
            yield flushed()

    return sum_vectors(pairs.mapInArrow(errors, "fold string, chunk long, v array<double>"), ["fold", "chunk"])


@dataclass(frozen=True)
class FittedGrid:
    """Held-out inputs and the solutions of all configurations."""

    inputs: DataFrame
    solutions: DataFrame
    configs: int

    def out_of_fold(self) -> DataFrame:
        return predict(self.inputs, self.solutions)

    def coefficients(self) -> DataFrame:
        """``(fold, chunk, fitted)``: the solutions of some ``CHUNK`` configurations of a fold, by their ids; staged."""
        chunk = F.pmod(F.xxhash64("config_id"), F.lit(-(-self.configs // CHUNK)).cast("long"))
        own = F.array_sort(F.collect_list(F.struct("config_id", "intercept", "coef", "sq_sum")))
        return stage(self.solutions.filter("error is null").groupBy("fold", chunk.alias("chunk")).agg(own.alias("fitted")), "coefs")

    def fold_metrics(self, y: str = "y", denominator: str | None = None) -> DataFrame:
        """Metrics per configuration and fold, without a row per held-out row and configuration.

        Squared errors are known from the moments. Absolute errors take one pass:
        blocks of rows meet the chunks of coefficients of their fold, and tasks hand
        on sums only. ``denominator`` turns predictions of a ratio into units of
        ``y``; then squared errors take the same pass.
        """
        table = self.coefficients()
        pairs = row_blocks(self.inputs, y, denominator).join(
            table.select("fold", "chunk", F.flatten("fitted.coef").alias("coef"), F.col("fitted.intercept").alias("intercept")), "fold")
        sums = error_sums(pairs.select("fold", "chunk", "x", "y", "coef", "intercept", *(["unit"] if denominator else [])), bool(denominator))
        long = table.join(sums, ["fold", "chunk"]).select("fold", F.posexplode("fitted").alias("k", "own"), F.size("fitted").alias("c"), "v")
        squared = F.get("v", F.col("k") + F.col("c")) if denominator else F.col("own.sq_sum")
        summed = long.select(F.col("own.config_id").alias("config_id"), "fold", F.get("v", F.col("k")).alias("abs_sum"), squared.alias("sq_sum"))
        return metrics_from_sums(summed, self.inputs, y)


def fit_grid(
    df: DataFrame, features: Sequence[str], y: str, fold: str, configs: Sequence[Config],
    log: bool = False, extra: Sequence[str] = (),
) -> FittedGrid:
    """Fit all configurations for all folds."""
    prepared = spread(stage(prepare(df, features, y, fold, extra), "prepared"))
    design = make_design(prepared, features, log)
    robust = any(c.scaler == "robust" for c in configs) and not log
    centres = fold_centres(prepared, design, robust)
    solutions = stage(solve_grid(fold_moments(prepared, design), centres, design, configs), "solutions")
    return FittedGrid(model_inputs(prepared, centres, design), solutions, len(configs))


def fit_predict(
    df: DataFrame, features: Sequence[str], y: str, fold: str, configs: Sequence[Config],
    log: bool = False, extra: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold table and solutions of all configurations."""
    fitted = fit_grid(df, features, y, fold, configs, log, extra)
    return fitted.out_of_fold(), fitted.solutions


def _single(model: str, **params):
    def fit(df, features, y, fold, scaler="standard", reduction="none", log=False, extra=()):
        config = Config(model, tuple(range(len(features))), model, params, scaler, reduction)
        return fit_predict(df, features, y, fold, [config], log, extra)

    return fit


def fit_ols(df, features, y, fold, **how):
    """Ordinary least squares per fold; least-norm where features are dependent."""
    return _single("ols")(df, features, y, fold, **how)


def fit_ridge(df, features, y, fold, alpha: float = 1.0, **how):
    return _single("ridge", alpha=alpha)(df, features, y, fold, **how)


def fit_elastic_net(df, features, y, fold, alpha: float, l1_ratio: float, **how):
    return _single("elastic_net", alpha=alpha, l1_ratio=l1_ratio)(df, features, y, fold, **how)


def fit_pls(df, features, y, fold, components: int, **how):
    return _single("pls", components=components)(df, features, y, fold, **how)


def _whole_table_moments(df: DataFrame, features: Sequence[str], y: str | None):
    """Design and moments of all rows: the held-out part is an empty fold."""
    source = df if y is not None else df.withColumn("_zero", F.lit(0.0))
    marked = source.withColumn("_fold", F.lit(TRAIN_ONLY))
    prepared = spread(stage(prepare(marked, features, y or "_zero", "_fold"), "prepared"))
    design = make_design(prepared, features)
    rows = prepared.select("fold", *design_columns(design))
    total = sum_vectors(gram_partials(rows, "fold", [c for c in rows.columns if c != "fold"]), ["fold"]).first()
    medians = {}
    if design.masked:
        names = [f"x{i}" for i in design.masked]
        medians = {int(r["column"][1:]): r["median"] for r in
                   exact_quantiles(prepared, names, [0.5], names=["median"]).collect()}
    size = design.width ** 2
    vector = total["v"] if total else [0.0] * size
    return design, {"fold": "none", "total": vector, "held": [0.0] * size, "medians": medians, "q1": {}, "q3": {}}


def select_k_best(df: DataFrame, features: Sequence[str], y: str, k: int) -> DataFrame:
    """Table ``(feature, score, selected)`` by univariate F score, from one pass over the rows."""
    design, row = _whole_table_moments(df, features, y)
    view = train_view(design, row, range(len(features)), "standard")
    scores = f_scores(view.cov, view.cov_y, view.var_y, view.n)
    chosen = set(best_k(scores, capped(k, len(features), view.n)).tolist())
    rows = [(f, float(s), i in chosen) for i, (f, s) in enumerate(zip(features, scores))]
    out = df.sparkSession.createDataFrame(rows, "feature string, score double, selected boolean")
    return out.orderBy(F.desc("score"), "feature")


def principal_components(
    df: DataFrame, features: Sequence[str], m: int, standardize: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Axes ``(component, explained_variance, explained_ratio, loadings)`` and the projected rows.

    Only the features × features matrix reaches the driver.
    """
    design, row = _whole_table_moments(df, features, None)
    view = train_view(design, row, range(len(features)), "standard")
    cov = view.cov if standardize else view.cov * np.outer(view.divisor, view.divisor)
    m = capped(m, len(features), view.n)
    lam, axes = principal_axes(cov, m)
    ddof = view.n / (view.n - 1)
    total = float(np.trace(cov))
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(i, float(l * ddof), float(l / total), axes[:, i].tolist()) for i, l in enumerate(lam)],
        "component int, explained_variance double, explained_ratio double, loadings array<double>",
    )
    unit = view.divisor if standardize else np.ones(len(features))
    scaled = []
    for i, f in enumerate(features):
        x = F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float(row["medians"].get(i, 0.0))))
        scaled.append((x - F.lit(float(view.raw_center[i]))) / F.lit(float(unit[i])))
    projected = df
    vector = F.array(*scaled)
    for c in range(m):
        weights = F.array(*[F.lit(float(w)) for w in axes[:, c]])
        dot = F.aggregate(F.zip_with(vector, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        projected = projected.withColumn(f"pc{c + 1}", dot)
    return table, projected
