"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document is taken whole as often as its
source's rate allows for certain; what is left of the target is a sample
without replacement. Shorter documents are likelier to be in it: with f the
share of its words that a source still needs, a document's inclusion
probability is ``f * (1 + (1 - f) * (a - m))``, where a falls from 1 to 0 with
the size and m is the mean of a over the words of the source. That lies between
f squared and 1 - (1 - f) squared, and the expected words are those needed.
Documents are ranked by their random odds divided by their inclusion odds, and
taken in that order up to the words that are left: a sample of fixed size in
words, with unequal probabilities.

The cut of each source is found from word sums per slice of the rank; only the
rows of the one slice that holds the cut are ordered.

Defined results: a null source is a source of its own, ordered last; a null or
empty text has no words and is taken with none; repeated rows count each;
equal ranks (repeated rows only) are cut in any order, which gives equal rows;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from featureforge.llm.common import id_text, uniform, whole_text, word_count
from featureforge.staging import stage

#: Slices of the rank, brought to 0 to 1, in each of two steps.
SLICES = 256


def source_targets(sizes: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    The whole size is shared by weight (repeating, sources by code point, null
    last); no target exceeds ``most`` times its source's size. The level that
    shares what capped sources leave is the first at which the next source by
    size per weight is not capped. One row per source, ordered in one task.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_cap.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    table = table.withColumn("_level", (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("_level")))
    level = F.min(fits).over(whole)["_level"]
    return table.select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def shortness() -> Column:
    """1 for an empty document, 1/2 for one of mean size, towards 0 for long ones."""
    return F.when(F.col("mean") > 0, F.col("mean") / (F.col("mean") + F.col("size"))).otherwise(F.lit(1.0))


def rank() -> Column:
    """Random odds over inclusion odds, brought from 0 to infinity to 0 to 1; null where a source needs nothing more."""
    share = F.try_divide(F.col("left"), F.col("source_size"))
    inclusion = share * (1 + (1 - share) * (shortness() - F.col("mean_shortness")))
    odds = F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(inclusion, 1 - inclusion))
    return odds / (1 + odds)


def narrowed(rows: DataFrame, plan: DataFrame, slices: int) -> DataFrame:
    """``plan`` with the slice of the rank, of ``slices`` ones, in which the words left to a source run out.

    A slice that the plan already has is cut further, so that a source never has more than ``SLICES`` sums.
    """
    known = plan.withColumnRenamed("source", "_source")
    piece = F.floor(rank() * slices)
    inside = F.col("slice").isNull() | (F.floor(rank() * (slices // SLICES)) == F.col("slice"))
    sums = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).where(inside & (F.col("left") > 0)).groupBy("source", piece.alias("piece")).agg(
        F.sum("size").alias("words"), F.first("left").alias("left"), F.first("taken_before").alias("before"))
    upto = W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = F.col("before") + F.sum("words").over(upto)
    cuts = sums.withColumn("reached", reached).where(F.col("reached") >= F.col("left")).groupBy("source").agg(
        F.min(F.struct("piece", (F.col("reached") - F.col("words")).alias("taken_before"))).alias("cut"))
    return known.drop("slice", "taken_before").join(cuts, F.col("_source").eqNullSafe(F.col("source")), "left").select(
        F.col("_source").alias("source"), "source_size", "target", "sure", "left", "mean", "mean_shortness", F.col("cut.piece").alias("slice"), F.col("cut.taken_before").alias("taken_before"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, source, digest)``, one row per document."""
    text = whole_text(F.col(text_col))
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"), F.md5(text.cast("binary")).alias("digest"),
    ).withColumn("u", uniform(F.lit(seed), id_text(F.col("doc_id")), F.col("digest"))), "mix")
    sizes = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean")), "sizes")
    means = sizes.withColumnRenamed("source", "_source").select("_source", "mean")
    short = rows.join(means, F.col("source").eqNullSafe(F.col("_source"))).groupBy(F.col("source").alias("_source")).agg(
        F.first("mean").alias("mean"), F.try_divide(F.sum(F.col("size") * shortness()), F.sum("size")).alias("mean_shortness"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(sizes, weights, most).withColumn("sure", F.least(F.floor(rate + 1e-12), F.lit(most)))
    targets = targets.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("sure") * F.col("source_size")))
    targets = stage(targets.join(short, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "targets")

    plan = targets.withColumn("slice", F.lit(None).cast("long")).withColumn("taken_before", F.lit(0).cast("long"))
    for slices in (SLICES, SLICES**2):
        plan = stage(narrowed(rows, plan, slices), "plan")
    plan = plan.withColumnRenamed("source", "_source")

    ranked = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_rank", rank()).withColumn(
        "_slice", F.floor(F.col("_rank") * SLICES**2))
    at_cut = F.col("_slice") == F.col("slice")
    sure = ranked.where(F.col("slice").isNull() | (F.col("_slice") != F.col("slice"))).withColumn("extra", F.when(F.col("_slice") < F.col("slice"), 1).otherwise(0))
    # a document at the cut is taken if at least half of its words are below the cut
    before = W.partitionBy("source").orderBy("_rank", "doc_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    cut = ranked.where(at_cut).withColumn(
        "_mid", F.col("taken_before") + F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("size") / 2
    ).withColumn("extra", F.when(F.col("_mid") <= F.col("left"), 1).otherwise(0))
    both = sure.select(*ranked.columns, "extra").unionByName(cut.select(*ranked.columns, "extra"))
    copies = (F.col("sure") + F.col("extra")).cast("long")
    return both.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.least(copies, F.lit(most))).alias("taken"),
        F.least(copies, F.lit(most)).cast("long").alias("copies"), "source", "digest",
    )
