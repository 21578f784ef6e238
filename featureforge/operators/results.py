"""Unions, rankings and best-row picks over result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from featureforge.operators.dedupe import first_per_key


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def standardize(
    df: DataFrame, columns: Mapping[str, str | Column | None], literals: Mapping[str, str] = {}
) -> DataFrame:
    """Bring one result table to the common shape.

    ``columns`` maps a common name to a source name (or expression); an absent
    source gives null. ``literals`` are constant texts such as the experiment.
    """
    out = [F.lit(text).alias(name) for name, text in literals.items()]
    for name, source in columns.items():
        if isinstance(source, Column):
            out.append(source.alias(name))
        elif source in df.columns:
            out.append(F.col(source).alias(name))
        else:
            out.append(F.lit(None).alias(name))
    return df.select(*out)


def best_rows(
    df: DataFrame, by: Sequence[str], metric: str, ascending: bool = True,
    tie: Sequence[str] = (), fallback: str | None = None,
) -> DataFrame:
    """Best row per group.

    Rows without the metric are left out. With ``fallback``, a group whose
    metric is null everywhere is decided by the smallest ``fallback`` instead.
    """
    first = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    order: list = [first]
    if fallback:
        order.append(F.col(fallback).asc_nulls_last())
    else:
        df = df.filter(F.col(metric).isNotNull())
    return first_per_key(df, by, [*order, *tie])


def best_preferred(
    df: DataFrame, preferred: DataFrame, on: Sequence[str], by: Sequence[str], metric: str,
    ascending: bool = True, tie: Sequence[str] = (),
) -> DataFrame:
    """Best row per group among the rows that match the preferred configuration."""
    return best_rows(df.join(preferred, list(on), "left_semi"), by, metric, ascending, tie)


def top_n(df: DataFrame, column: str, n: int, ascending: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows after a sort; every task keeps at most ``n`` rows."""
    order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return df.orderBy(order, *tie).limit(n)
