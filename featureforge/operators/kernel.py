"""Kernel regression with random Fourier features.

The kernel is replaced by the inner product of D random cosines (Rahimi and
Recht 2007), so that the fit is a ridge problem of size D for any number of
rows. One pass over the rows builds the D × D moments of every fold; rows are
scaled with the training statistics of each fold that trains on them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from featureforge.operators.linear import train_view
from featureforge.operators.moments import (
    Design, fold_centres, fold_moments, make_design, prepare, sum_vectors,
)
from featureforge.operators.scaling import fold_names
from featureforge.operators.solvers import reduction_basis
from featureforge.staging import spread, stage

NOISE = 1e-3 + 1e-6
# Doubles of moment accumulators that a task may hold; more folds take more passes.
MAX_ACCUMULATORS = 20_000_000


def frequencies(kernel: str, p: int, size: int, seed: int, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Random frequencies (p × size) and phases of a kernel with length scale 1."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((p, size))
    if kernel == "matern":
        w = w / np.sqrt(rng.chisquare(3, size) / 3)
    elif kernel == "rq":
        w = w * np.sqrt(rng.gamma(alpha, 1 / alpha, size))
    elif kernel != "rbf":
        raise ValueError(f"Unknown kernel: {kernel}")
    return w, rng.uniform(0, 2 * np.pi, size)


def cosines(z: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / w.shape[1]) * np.cos(z @ w + b)


def _fold_scalers(moments: DataFrame, centres: DataFrame, design: Design, scaler: str, reduction: str):
    """Per fold: imputation, shift, centre and projection; small, so it may travel with the tasks."""
    p = len(design.features)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                view = train_view(design, row, range(p), scaler)
                basis = reduction_basis(reduction, view.cov, view.cov_y, view.var_y, view.n)
                medians = dict(row["medians"] or {})
                yield pd.DataFrame([{
                    "fold": row["fold"], "fill": [float(medians.get(i, 0.0)) for i in range(p)],
                    "centre": view.raw_center.tolist(), "axes": (basis / view.divisor[:, None]).ravel().tolist(),
                    "mean_y": float(view.mean_y),
                }])

    schema = "fold string, fill array<double>, centre array<double>, axes array<double>, mean_y double"
    rows = moments.join(centres, "fold").mapInPandas(work, schema).collect()
    out = {}
    for r in rows:
        shifts = np.array([
            design.values[design.entry(i, r.fold) - 1][1] or 0.0 for i in range(p)
        ])
        out[r.fold] = {
            "fill": np.array(r.fill), "shift": shifts, "centre": np.array(r.centre),
            "axes": np.array(r.axes).reshape(p, -1), "mean_y": r.mean_y,
        }
    return out


def _inputs(x: np.ndarray, s: dict, log: bool) -> np.ndarray:
    filled = np.where(np.isnan(x), s["fill"], x)
    if log:
        filled = np.log1p(np.maximum(filled + s["shift"], 0.0))
    return (filled - s["centre"]) @ s["axes"]


def fit_rff(
    df: DataFrame, features: Sequence[str], y: str, fold: str, kernel: str = "rbf", size: int = 256,
    seed: int = 42, scaler: str = "standard", reduction: str = "none", log: bool = False,
    noise: float = NOISE, extra: Sequence[str] = (),
) -> DataFrame:
    """Out-of-fold table of the kernel regression."""
    frequencies(kernel, 1, 1, seed)  # an unknown kernel fails here, not in a task
    prepared = spread(stage(prepare(df, features, y, fold, extra), "prepared"))
    folds = fold_names(prepared)
    design = make_design(prepared, features, log)
    moments = stage(fold_moments(prepared, design), "moments")
    centres = fold_centres(prepared, design, scaler == "robust")
    scalers = _fold_scalers(moments, centres, design, scaler, reduction)
    p = len(features)
    xs = [f"x{i}" for i in range(p)]

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([
            batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in xs
        ])

    def basis_for(s: dict):
        return frequencies(kernel, s["axes"].shape[1], size, seed)

    def partials(part: list[str]):
        def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {f: np.zeros((size + 2, size + 2)) for f in part}
            for batch in batches:
                x = matrix(batch)
                target = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
                own = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
                for f in part:
                    train = own != f
                    s = scalers[f]
                    phi = cosines(_inputs(x[train], s, log), *basis_for(s))
                    v = np.column_stack([phi, np.ones(len(phi)), target[train] - s["mean_y"]])
                    sums[f] += v.T @ v
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([sums[f].ravel() for f in part], pa.list_(pa.float64()))],
                ["fold", "v"],
            )

        return accumulate

    step = max(1, MAX_ACCUMULATORS // (size + 2) ** 2)
    passes = [
        sum_vectors(prepared.mapInArrow(partials(folds[i:i + step]), "fold string, v array<double>"), ["fold"])
        for i in range(0, len(folds), step)
    ]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, flat in zip(frame["fold"], frame["v"]):
                g = np.asarray(flat).reshape(size + 2, size + 2)
                w = np.linalg.solve(g[:size, :size] + noise * np.eye(size), g[:size, -1])
                yield pd.DataFrame({"fold": [name], "w": [w.tolist()]})

    solved = reduce(DataFrame.unionByName, passes).mapInPandas(solve, "fold string, w array<double>")
    weights = {r.fold: np.array(r.w) for r in solved.collect()}
    keep = [c for c in prepared.columns if c not in xs]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch)
            own = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            yhat = np.full(len(x), np.nan)
            for f in set(own) & set(weights):
                rows = own == f
                s = scalers[f]
                yhat[rows] = s["mean_y"] + cosines(_inputs(x[rows], s, log), *basis_for(s)) @ weights[f]
            held = pa.array(np.isfinite(yhat))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(yhat)]
            yield pa.RecordBatch.from_arrays(columns, keep + ["yhat"]).filter(held)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.schema if f.name in keep)
    return prepared.mapInArrow(score, f"{schema}, yhat double")
