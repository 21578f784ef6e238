"""Second moments per fold: the one data pass behind all linear models.

A row enters the moments of its own fold only. The training moments of a fold
are the total less that fold, so K folds cost one pass and no repeated rows.
Median imputation is kept exact without a second pass: each column with missing
values contributes its zero-filled value and its missing mark, and the moments
of the imputed column are a linear map of these two.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from featureforge.functions.columns import number
from featureforge.operators.quantiles import training_quantiles
from featureforge.operators.scaling import TRAIN_ONLY, fold_moment_stats
from featureforge.staging import stage

SALTS = 64
# Accumulators a task holds before it hands them on.
MAX_OPEN_FOLDS = 64


@dataclass(frozen=True)
class Design:
    """How raw features become moment columns.

    ``values`` lists ``(feature, shift)``; ``shift`` is None without log.
    A log feature whose training minimum differs in one fold has a second
    entry, used for that fold (``second``: feature -> (entry, fold)).
    ``masked`` lists features with missing values.
    """

    features: tuple[str, ...]
    log: bool
    values: tuple[tuple[int, float | None], ...]
    center: np.ndarray
    scale: np.ndarray
    y_center: float
    masked: tuple[int, ...]
    second: dict[int, tuple[int, str]]

    @property
    def width(self) -> int:
        return 2 + len(self.values) + len(self.masked)

    def entry(self, feature: int, fold: str) -> int:
        """Position of the feature in the moment matrix for one fold."""
        if feature in self.second and self.second[feature][1] == fold:
            return 1 + self.second[feature][0]
        return 1 + next(i for i, (f, _) in enumerate(self.values) if f == feature)

    def mask_entry(self, feature: int) -> int | None:
        if feature not in self.masked:
            return None
        return 1 + len(self.values) + self.masked.index(feature)


def prepare(df: DataFrame, features: Sequence[str], y: str, fold: str, extra: Sequence[str] = ()) -> DataFrame:
    """Labelled rows with features ``x0…``, ``y`` and ``fold``, written once for all passes."""
    cols = [number(f"`{c}`").alias(f"x{i}") for i, c in enumerate(features)]
    return df.select(F.col(fold).cast("string").alias("fold"), number(y).alias("y"), *cols, *extra).filter(
        F.col("y").isNotNull() & F.col("fold").isNotNull()
    )


def _transformed(feature: int, shift: float | None) -> Column:
    x = F.col(f"x{feature}")
    if shift is None:
        return x
    return F.when(x.isNotNull(), F.log1p(F.greatest(x + F.lit(float(shift)), F.lit(0.0))))


def make_design(prepared: DataFrame, features: Sequence[str], log: bool = False) -> Design:
    """Measure the overall centre and spread that keep the moments well conditioned."""
    p = len(features)
    values: list[tuple[int, float | None]] = [(i, None) for i in range(p)]
    second: dict[int, tuple[int, str]] = {}
    if log:
        values, second = _log_entries(prepared, p)
    aggs = [F.avg("y").alias("y")]
    for k, (i, shift) in enumerate(values):
        aggs += [F.avg(_transformed(i, shift)).alias(f"m{k}"), F.stddev_pop(_transformed(i, shift)).alias(f"s{k}")]
    aggs += [F.max(F.col(f"x{i}").isNull()).alias(f"n{i}") for i in range(p)]
    row = prepared.agg(*aggs).first().asDict()
    center = np.array([row[f"m{k}"] or 0.0 for k in range(len(values))])
    scale = np.array([row[f"s{k}"] or 1.0 for k in range(len(values))])
    masked = tuple(i for i in range(p) if row[f"n{i}"])
    return Design(tuple(features), log, tuple(values), center, scale, row["y"] or 0.0, masked, second)


def _log_entries(prepared: DataFrame, p: int):
    """Shift per feature from the training minima; at most two values per feature."""
    names = [f"x{i}" for i in range(p)]
    mins = fold_moment_stats(prepared, names).groupBy("column").agg(
        F.min(F.struct("min", "eval_fold")).alias("lo"), F.max(F.struct("min", "eval_fold")).alias("hi")
    )
    rows = {r["column"]: r for r in mins.collect()}
    shift = lambda low: max(-(low or 0.0), 0.0)
    values: list[tuple[int, float | None]] = []
    second: dict[int, tuple[int, str]] = {}
    for i, name in enumerate(names):
        r = rows.get(name)
        values.append((i, shift(r.lo["min"]) if r else 0.0))
    for i, name in enumerate(names):
        r = rows.get(name)
        if r and shift(r.lo["min"]) != shift(r.hi["min"]):
            second[i] = (len(values), r.hi["eval_fold"])
            values.append((i, shift(r.hi["min"])))
    return values, second


def sum_vectors(partials: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Element-wise sum of array columns per key, in two streaming steps."""
    salted = partials.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = salted.groupBy(*keys, "_salt").agg(Summarizer.sum(array_to_vector(value)).alias(value))
    both = first.groupBy(*keys).agg(Summarizer.sum(F.col(value)).alias(value))
    return both.withColumn(value, vector_to_array(value))


def gram_partials(
    rows: DataFrame, group: str, columns: Sequence[str], partition_key: str = "fold"
) -> DataFrame:
    """Per task and group the flattened matrix ``Vᵀ V`` of the listed columns."""
    selected = rows.select(F.col(group).alias(partition_key), *columns)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_sums: dict[str, np.ndarray] = {}

        def flush():
            names = list(open_sums)
            sums = [open_sums[n].ravel() for n in names]
            open_sums.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(sums, pa.list_(pa.float64()))], [partition_key, "v"]
            )

        for batch in batches:
            data = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            codes = batch.column(0).dictionary_encode()
            index = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(index, kind="stable")
            parts = np.split(data[order], np.flatnonzero(np.diff(index[order])) + 1)
            for name, part in zip(codes.dictionary.to_pylist(), parts):
                gram = part.T @ part
                open_sums[name] = open_sums[name] + gram if name in open_sums else gram
            if len(open_sums) > MAX_OPEN_FOLDS:
                yield flush()
        if open_sums:
            yield flush()

    return selected.mapInArrow(accumulate, f"{partition_key} string, v array<double>")


def design_columns(design: Design) -> list[Column]:
    """``1``, standardised values (0 where missing), missing marks, centred target."""
    out = [F.lit(1.0).alias("one")]
    for k, (i, shift) in enumerate(design.values):
        z = (_transformed(i, shift) - F.lit(float(design.center[k]))) / F.lit(float(design.scale[k]))
        out.append(F.coalesce(z, F.lit(0.0)).alias(f"z{k}"))
    out += [F.col(f"x{i}").isNull().cast("double").alias(f"m{i}") for i in design.masked]
    return out + [(F.col("y") - F.lit(float(design.y_center))).alias("yc")]


def fold_moments(prepared: DataFrame, design: Design) -> DataFrame:
    """One row per held-out fold: ``fold``, moments ``held`` of it and ``total`` of all rows."""
    rows = prepared.select("fold", *design_columns(design))
    names = [c for c in rows.columns if c != "fold"]
    per_fold = stage(sum_vectors(gram_partials(rows, "fold", names), ["fold"]), "moments")
    one = per_fold.withColumn("_all", F.lit("all"))
    total = sum_vectors(one, ["_all"]).withColumnRenamed("v", "total")
    return one.filter(F.col("fold") != TRAIN_ONLY).join(total, "_all").select(
        "fold", F.col("v").alias("held"), "total"
    )


def fold_centres(prepared: DataFrame, design: Design, robust: bool = False) -> DataFrame:
    """Per fold the imputation value of every masked feature, and quartiles of the imputed train rows.

    Columns ``medians``, ``q1``, ``q3`` are maps from feature number to value.
    No row is repeated, and the number of folds is not limited.
    """
    base = prepared.select("fold").distinct().filter(F.col("fold") != TRAIN_ONLY)
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>"))

    def as_map(stats: DataFrame, value: str, name: str) -> DataFrame:
        key = F.substring("column", 2, 10).cast("int")
        pairs = F.map_from_entries(F.collect_list(F.struct(key, F.col(value))))
        return stats.groupBy(F.col("eval_fold").alias("fold")).agg(pairs.alias(name))

    out = base
    if design.masked:
        names = [f"x{i}" for i in design.masked]
        base = stage(base, "folds")
        medians = stage(training_quantiles(prepared, names, [0.5], ["median"], base), "medians")
        out = out.join(as_map(medians, "median", "medians"), "fold", "left")
    else:
        out = out.withColumn("medians", empty)
    if robust:
        all_names = [f"x{i}" for i in range(len(design.features))]
        fill = medians.withColumnRenamed("median", "fill") if design.masked else None
        spread = stage(training_quantiles(prepared, all_names, [0.25, 0.75], ["q1", "q3"], base, fill), "spread")
        out = out.join(as_map(spread, "q1", "q1"), "fold", "left").join(as_map(spread, "q3", "q3"), "fold", "left")
    else:
        out = out.withColumn("q1", empty).withColumn("q3", empty)
    return stage(out, "centres")
