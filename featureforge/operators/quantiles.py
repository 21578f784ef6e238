"""Exact order statistics by repeated histograms, without a global sort or a large group in one task.

Level 1 counts values, with map-side combine, in buckets that depend on the
value alone: sign and 64ths of a power of two for doubles, the leading 16
bits for integers. A wanted rank falls into one bucket. Every further level
divides the range between the least and the greatest value of such a bucket
into 2^16 more, until a bucket holds one value. Bucket numbers never decrease
with the value, so that ranks stay exact; the ends of a range always part, and
levels 2 to 4 are the deepest that values of 64 bits can need.

A table of folds is counted once, by fold. The rank ``r`` among the rows outside
a fold is the rank ``r + h`` among all rows, where ``h`` counts the fold's own rows in
buckets up to which no more than ``r`` others lie. Rows are never repeated per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from featureforge.functions.columns import number
from featureforge.staging import stage

SPLITS = 1 << 16


def _cells(df: DataFrame, columns: Sequence[str], keep: Sequence[Column], dtype: str) -> DataFrame:
    """``(keep, column, raw, coarse)``, one row per value; nulls and NaN are left out."""
    value = number if dtype == "double" else (lambda c: F.col(c).cast(dtype))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("raw")) for c in columns])
    return df.select(*keep, F.inline(cells)).filter(F.col("raw").isNotNull()).withColumn("coarse", _coarse(F.col("raw"), dtype))


def _coarse(value: Column, dtype: str) -> Column:
    if dtype != "double":
        return F.shiftright(value, 48)
    size = F.abs(value)
    step = F.when(size == float("inf"), F.lit(160_000)).when(size == 0, F.lit(0)).otherwise(F.floor(F.log2(size) * 64) + 80_000)
    return F.signum(value).cast("int") * step


def _fine(dtype: str) -> Column:
    """Part of the range ``lo`` to ``hi`` that ``raw`` is in."""
    above, wide = F.col("raw") - F.col("lo"), F.col("hi") - F.col("lo")
    if dtype == "double":
        return F.floor(above / wide * float(SPLITS - 1))
    return F.call_function("div", above, F.shiftright(wide, 16) + 1)


def _histogram(cells: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    return cells.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("raw").alias("a"), F.max("raw").alias("z"))


def _without_own(histogram: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranks among the rows outside a fold become ranks among all rows."""
    through = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(*keys, "fold").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = histogram.select(*keys, "fold", F.sum("n").over(own).alias("_held"), F.sum("n").over(through).alias("_through"))
    same = [F.col(f"t.{k}") == F.col(f"h.{k}") for k in [*keys, "fold"]]
    joined = targets.alias("t").join(held.alias("h"), [*same, F.col("_through") - F.col("_held") <= F.col("t.r")], "left")
    shift = joined.groupBy(*[F.col(f"t.{c}") for c in targets.columns]).agg(F.coalesce(F.max("_held"), F.lit(0)).alias("_held"))
    return shift.withColumn("r", F.col("r") + F.col("_held")).drop("_held")


def _located(histogram: DataFrame, targets: DataFrame, keys: Sequence[str], first: bool, folded: bool) -> DataFrame:
    """Targets in the bucket that holds their rank: its ``lo``, ``hi`` and the rank ``r`` inside it."""
    if folded:
        targets = _without_own(histogram, targets, keys)
    total = histogram.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("r", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rest = [c for c in targets.columns if c not in keys and c != "r"]
    marks = total.select(*keys, "r", F.struct("bucket", "a", "z", "r").alias("_place"))
    asks = targets.select(*keys, "r", F.struct(*rest).alias("_ask"))
    in_order = Window.partitionBy(*keys).orderBy(F.col("r"), F.col("_ask").isNotNull())
    found = marks.unionByName(asks, allowMissingColumns=True).withColumn("_place", F.last("_place", ignorenulls=True).over(in_order))
    kept = [k for k in keys if k not in ("coarse", "lo", "hi")]
    return found.filter(F.col("_ask").isNotNull()).select(
        *kept, "_ask.*", (F.col("r") - F.col("_place.r")).alias("r"),
        (F.col("_place.bucket") if first else F.col("coarse")).alias("coarse"), F.col("_place.a").alias("lo"), F.col("_place.z").alias("hi"))


def _located_all(histogram: DataFrame, keys: Sequence[str], ranks: Column) -> DataFrame:
    """As ``_located``, for ``ranks``, an array of ``(tag, r)`` that ``size``, the values of a group, decides."""
    group = Window.partitionBy(*keys)
    before = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    total = histogram.withColumns({"before": F.coalesce(before, F.lit(0)), "size": F.sum("n").over(group)})
    here = F.filter(ranks, lambda t: (t["r"] >= F.col("before")) & (t["r"] < F.col("before") + F.col("n")))
    return total.select(*keys, "size", "bucket", "a", "z", "before", F.inline(here)).select(
        *keys, "size", "tag", (F.col("r") - F.col("before")).alias("r"), F.col("bucket").alias("coarse"), F.col("a").alias("lo"), F.col("z").alias("hi"))


def _values_at(cells: DataFrame, located: DataFrame, by: Sequence[str], dtype: str, folded: bool = False) -> DataFrame:
    """The targets ``(by, column, [fold], r, …)`` in buckets of level 1, with the ``value`` at their rank."""
    groups, done = [*by, "column"], None
    keys = [*groups, "coarse", "lo", "hi"]
    while True:
        unsettled = F.col("lo") < F.col("hi")
        located = stage(located, "ranks")
        settled = located.filter(~unsettled).withColumn("value", F.col("lo")).drop("r", "coarse", "lo", "hi")
        done = settled if done is None else done.unionByName(settled)
        targets = located.filter(unsettled)
        if targets.isEmpty():
            return done
        ranges = targets.select(*[F.col(k).alias(f"_r_{k}") for k in [*groups, "coarse"]], "lo", "hi").distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in [*groups, "coarse"]]
        inside = cells.join(ranges, [*same, F.col("raw").between(F.col("lo"), F.col("hi"))])
        histogram = _histogram(inside, [*keys, *(["fold"] if folded else [])], _fine(dtype))
        located = _located(stage(histogram, "histogram") if folded else histogram, targets, keys, False, folded)


def _ranks(size: Column, probs: Sequence[float]) -> Column:
    """``(tag, rank)`` of the two neighbours of every probability, as an array."""
    ends = [(2 * j + k, end(F.lit(float(p)) * (size - 1))) for j, p in enumerate(probs) for k, end in enumerate((F.floor, F.ceil))]
    return F.array(*[F.struct(F.lit(t).alias("tag"), r.alias("r")) for t, r in ends])


def _interpolated(size: Column, probs: Sequence[float], names: Sequence[str]) -> list[Column]:
    out = []
    for j, (p, name) in enumerate(zip(probs, names)):
        position = F.lit(float(p)) * (size - 1)
        lo, hi = F.col(f"_v{2 * j}"), F.col(f"_v{2 * j + 1}")
        same = (lo == hi) | (position == F.floor(position))  # also keeps infinite values
        out.append(F.when(same, lo).otherwise(lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return out


def _by_tag(values: DataFrame, keys: Sequence[str], tags: int, value: str = "value") -> DataFrame:
    return values.groupBy(*keys).agg(*[F.max(F.when(F.col("tag") == t, F.col(value))).alias(f"_v{t}") for t in range(tags)])


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles: one row per group and column with ``n`` and one column per prob.

    Nulls and NaN are left out. A group without a value has no row.
    """
    names = list(names or [f"q{round(p * 100):02d}" for p in probs])
    groups = {f"_g{i}": c for i, c in enumerate(by)}
    cells, keys = _cells(df, columns, [F.col(c).alias(g) for g, c in groups.items()], "double"), [*groups, "column"]
    located = _located_all(_histogram(cells, keys, F.col("coarse")), keys, _ranks(F.col("size"), probs))
    values = _values_at(cells, located, list(groups), "double")
    wide = _by_tag(values, [*keys, "size"], 2 * len(probs))
    return wide.select(*[F.col(g).alias(c) for g, c in groups.items()], "column", F.col("size").alias("n"), *_interpolated(F.col("size"), probs, names))


def training_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], names: Sequence[str], folds: DataFrame, fill: DataFrame | None = None,
) -> DataFrame:
    """Quantiles of the rows outside each of ``folds`` (column ``fold``): one row per ``eval_fold`` and column.

    ``df`` holds every row once, with its ``fold`` as text. With ``fill``, a table
    ``(eval_fold, column, fill)``, the missing values of the training rows count as
    that value: with ``k`` of them the value at rank ``r`` is the middle one of the
    fill value and the present values at ranks ``r`` and ``r - k``. Columns without
    a fill value, and folds without a present training value, have no missing ones
    or no row.
    """
    df = df.select("fold", *columns)
    cells = _cells(df, columns, [F.col("fold")], "double")
    histogram = stage(_histogram(cells, ["column", "fold"], F.col("coarse")), "histogram")
    per_fold = histogram.groupBy("column", "fold").agg(F.sum("n").alias("n"))
    totals = per_fold.groupBy("column").agg(F.sum("n").alias("total"))
    named = folds.select("fold", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    sizes = named.join(totals, "column").join(per_fold, ["column", "fold"], "left").select(
        "column", "fold", (F.col("total") - F.coalesce("n", F.lit(0))).alias("present"))
    if fill is None:
        sizes = sizes.withColumns({"size": F.col("present"), "fill": F.lit(None).cast("double")})
    else:
        rows = stage(df.groupBy("fold").agg(F.count("*").alias("n")), "fold-rows")
        all_rows = rows.agg(F.sum("n")).scalar()
        sizes = sizes.join(rows, "fold", "left").join(
            fill.select(F.col("eval_fold").alias("fold"), "column", "fill"), ["fold", "column"], "left"
        ).withColumn("size", F.when(F.col("fill").isNull(), F.col("present")).otherwise(all_rows - F.coalesce("n", F.lit(0))))
    sizes = stage(sizes.filter("present > 0").select("column", "fold", "present", "size", "fill"), "sizes")
    both = sizes.select("*", F.inline(_ranks(F.col("size"), probs))).withColumnRenamed("r", "rank")
    late = F.col("rank") - (F.col("size") - F.col("present"))
    targets = both.select("*", F.explode(F.array_distinct(F.array(F.col("rank"), late))).alias("r")).filter("r between 0 and present - 1")
    targets = targets.withColumn("at_rank", F.col("r") == F.col("rank"))
    found = _values_at(cells, _located(histogram, targets, ["column"], True, True), (), "double", folded=True)
    keys = ["column", "fold", "size", "present", "fill"]
    middle = found.groupBy(*keys, "tag").agg(
        F.max(F.when(F.col("at_rank"), F.col("value"))).alias("high"), F.max(F.when(~F.col("at_rank"), F.col("value"))).alias("low"))
    # without missing values both ranks are one
    low = F.when(F.col("size") == F.col("present"), F.col("high")).otherwise(F.col("low"))
    middle = middle.withColumn("value", F.greatest(F.least("high", "fill"), low))
    # where the fill values cover a rank on both sides, no present value is asked for
    covered = both.filter(F.col("fill").isNotNull() & (F.col("rank") >= F.col("present")) & (late < 0))
    middle = middle.select(*keys, "tag", "value").unionByName(covered.select(*keys, "tag", F.col("fill").alias("value")))
    wide = _by_tag(middle, keys, 2 * len(probs))
    return wide.select(F.col("fold").alias("eval_fold"), "column", *_interpolated(F.col("size"), probs, names))


def rank_thresholds(df: DataFrame, key: str, cuts: Sequence[tuple[str, Column]]) -> DataFrame:
    """``n`` and the values of the bigint ``key`` at given 0-based ranks, as one row; none for an empty table.

    ``cuts`` holds ``(name, rank as an expression of size)``; a rank that is null or outside the table gives null.
    """
    cells = _cells(df, [key], (), "bigint")
    # rank 0 is asked for as well, so that every table with a value gives a row
    asked = F.array(*[F.struct(F.lit(t).alias("tag"), r.cast("bigint").alias("r")) for t, r in enumerate([*[r for _, r in cuts], F.lit(0)])])
    located = _located_all(_histogram(cells, ["column"], F.col("coarse")), ["column"], asked)
    wide = _by_tag(_values_at(cells, located, (), "bigint"), ["size"], len(cuts))
    return wide.select(F.col("size").alias("n"), *[F.col(f"_v{t}").alias(name) for t, (name, _) in enumerate(cuts)])
