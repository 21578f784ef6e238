"""Left outer joins that enrich a fact table.

No side carries a broadcast hint by default: the optimizer broadcasts a side
whose known size is below its threshold and otherwise sort-merges, where
adaptive execution splits skewed partitions of the left side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from featureforge.operators.dedupe import first_per_key


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    """Equi-join that keeps the key columns of ``left`` only."""
    if not null_safe:
        return left.join(right, list(on), how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in on])


def enrich(
    df: DataFrame, dim: DataFrame, on: Sequence[str] | str, null_safe: bool = False
) -> DataFrame:
    """Left join on equal keys; rows of ``dim`` that repeat a key fan out.

    ``null_safe`` lets null keys match each other.
    """
    return _join(df, dim, [on] if isinstance(on, str) else on, "left", null_safe)


def enrich_unique(
    df: DataFrame, features: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
    null_safe: bool = False,
) -> DataFrame:
    """Left join against the first row per key, so the row count does not change."""
    return enrich(df, first_per_key(features, keys, order), keys, null_safe)


def attach_labels(
    df: DataFrame, labels: DataFrame, keys: Sequence[str], status: str | None = None, ok: str = "ok",
    null_safe: bool = False,
) -> DataFrame:
    """Left join against every label row of a key; the fan-out is kept.

    One key may hold a large part of the labels. The matching rows therefore
    come from an inner join, whose skewed partitions adaptive execution splits
    on either side; a left join could only split the left one. Rows without a
    label are added by an anti join against the distinct keys.

    With ``status``, only labels of that status take part and the filter runs
    before the join.
    """
    if status is not None and status in labels.columns:
        labels = labels.filter(F.col(status) == ok)
    matched = _join(df, labels, keys, "inner", null_safe)
    unmatched = _join(df, labels.select(*keys).distinct(), keys, "left_anti", null_safe)
    return matched.unionByName(unmatched, allowMissingColumns=True)


def join_via(df: DataFrame, bridge: DataFrame | None, other: DataFrame, key: str,
             bridge_on: Sequence[str] | str | None = None) -> DataFrame:
    """Join ``other`` on ``key``; a table without the key goes through ``bridge`` first."""
    if key not in df.columns:
        if bridge is None:
            return other
        df = df.join(bridge, bridge_on if bridge_on is not None else
                     [c for c in df.columns if c in bridge.columns], "left")
    return df.join(other, key, "left")


def lookup(
    df: DataFrame, dim: DataFrame, on: Sequence[str] | str, columns: Sequence[str], default=0
) -> DataFrame:
    """Add ``columns`` of ``dim``; keys that are not listed get ``default``."""
    on = [on] if isinstance(on, str) else list(on)
    joined = df.join(dim.select(*on, *columns), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})
