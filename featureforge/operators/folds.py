"""Train/test splits that depend only on row ids, never on partitioning.

Rows are ranked by a seeded digest of their id. The split points are exact
order statistics of that digest, so fold sizes are those of a shuffled split,
without a global sort and without a collected permutation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featureforge.functions.columns import seeded_hash
from featureforge.operators.quantiles import rank_thresholds
from featureforge.staging import stage


def _thresholds(df: DataFrame, id_col: str, seed: int, cuts) -> DataFrame:
    keyed = df.select(seeded_hash(id_col, seed).alias("_key"))
    return stage(rank_thresholds(keyed, "_key", cuts), "cuts")


def split_holdout(
    df: DataFrame, id_col: str, frac: float = 0.25, seed: int = 42, min_rows: int = 6
) -> DataFrame:
    """Add ``is_test``: the ``ceil(frac · n)`` rows with the smallest digest.

    A table with fewer than ``min_rows`` rows gives no rows.
    """
    size = F.ceil(F.lit(frac) * F.col("size"))
    cuts = _thresholds(df, id_col, seed, [("cut", size - 1)])
    enough = cuts.select("n").scalar() >= min_rows
    is_test = seeded_hash(id_col, seed) <= cuts.select("cut").scalar()
    return df.withColumn("is_test", is_test).filter(F.coalesce(enough, F.lit(False)))


def fold_count(n, k: int = 5, small: int = 10, small_k: int = 3):
    """Number of folds for ``n`` rows: ``min(k, n)``, but 3 below 10 rows."""
    return F.when(n < small, F.least(F.lit(small_k), n)).otherwise(F.least(F.lit(k), n))


def assign_kfold(
    df: DataFrame, id_col: str, k: int = 5, seed: int = 42, min_rows: int = 6
) -> DataFrame:
    """Add ``fold`` in ``0..k-1``; sizes differ by at most one, larger folds first.

    A table with fewer than ``min_rows`` rows gives no rows.
    """
    folds = fold_count(F.col("size"), k)
    first = lambda j: (F.lit(j) * F.floor(F.col("size") / folds) + F.least(F.lit(j), F.col("size") % folds)).cast("bigint")
    # Small tables have fewer folds: cuts past the last fold are null there.
    cut_list = [(f"cut{j}", F.when(F.lit(j) < folds, first(j))) for j in range(1, k)]
    cuts = _thresholds(df, id_col, seed, cut_list)
    enough = cuts.select("n").scalar() >= min_rows
    key = seeded_hash(id_col, seed)
    fold = F.lit(0)
    for j in range(1, k):
        fold = fold + F.coalesce((key >= cuts.select(f"cut{j}").scalar()).cast("int"), F.lit(0))
    return df.withColumn("fold", fold).filter(F.coalesce(enough, F.lit(False)))


def assign_group_folds(df: DataFrame, group: str) -> DataFrame:
    """Leave-one-group-out: the fold is the group itself. Fewer than two groups give no rows."""
    groups = df.agg((F.min(group) < F.max(group)).alias("several"))
    several = F.coalesce(groups.scalar(), F.lit(False))
    return df.filter(F.col(group).isNotNull()).withColumn("fold", F.col(group).cast("string")).filter(several)


def expand_folds(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Every row once per fold ``eval_fold``, with ``is_train`` where it is not held out."""
    out = df.withColumn("eval_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return out.withColumn("is_train", F.col(fold) != F.col("eval_fold"))
