"""Derived features, feature sets and ratio targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featureforge.functions import fixed_values as fixed
from featureforge.functions.columns import safe_div
from featureforge.functions.fixed_values import RATIO_FEATURES, RATIO_TARGETS
from featureforge.operators.clean import numeric_columns
from featureforge.operators.joins import lookup

# A category list becomes columns, so it has to fit a table schema.
MAX_CATEGORIES = 10_000


def categories(df: DataFrame, column: str) -> list:
    """Sorted distinct values; refuses a column with too many for a schema."""
    rows = (
        df.select(column).filter(F.col(column).isNotNull()).distinct()
        .orderBy(column).limit(MAX_CATEGORIES + 1).collect()
    )
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories; it cannot become columns")
    return [r[0] for r in rows]


def one_hot(
    df: DataFrame, columns: Sequence[str], cats: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """Replace every column by 0/1 columns ``column_value``, one per category."""
    cats = cats or {}
    dummies = {}
    for c in columns:
        for v in cats.get(c) or categories(df, c):
            dummies[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
    return df.select(*[f"`{c}`" for c in df.columns if c not in columns],
                     *[expr.alias(name) for name, expr in dummies.items()])


def from_one_hot(df: DataFrame, prefix: str) -> Column:
    """Name of the largest 0/1 column of a prefix, the first one on ties; ``unknown`` without any."""
    names = [c for c in df.columns if c.startswith(prefix)]
    if not names:
        return F.lit("unknown")
    values = F.array(*[F.col(f"`{c}`") for c in names])
    labels = F.array(*[F.lit(c[len(prefix):]) for c in names])
    return F.get(labels, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def add_ratios(
    df: DataFrame, spec: Sequence[tuple[str, str, str]] = tuple(RATIO_FEATURES)
) -> DataFrame:
    """Add ``name = numerator / denominator`` wherever both columns exist."""
    present = set(df.columns)
    ratios = {n: safe_div(a, b) for n, a, b in spec if a in present and b in present}
    return df.withColumns(ratios) if ratios else df


def normalize_target(
    df: DataFrame, spec: Mapping[str, tuple[str, str]] = RATIO_TARGETS
) -> DataFrame:
    """Add ratio targets ``target / denominator``."""
    return add_ratios(df, [(n, a, b) for n, (a, b) in spec.items()])


def reconstruct(prediction: Column | str, denominator: Column | str) -> Column:
    """Prediction of a ratio target in original units."""
    prediction = F.col(prediction) if isinstance(prediction, str) else prediction
    denominator = F.col(denominator) if isinstance(denominator, str) else denominator
    return prediction * denominator


def feature_set(
    df: DataFrame, target: str, leakage: Sequence[str] = (),
    names: Sequence[str] | None = None, prefixes: Sequence[str] = (),
    group_prefix: str | None = None, with_group: bool = False,
    target_leakage: Mapping[str, Sequence[str]] | None = None,
) -> list[str]:
    """Feature names of a set, in table order of first mention, without repeats.

    ``names=None`` takes every numeric column; otherwise the named columns,
    those with one of the ``prefixes`` and, on request, the 0/1 group columns.
    ``target_leakage`` drops further columns for a given target.
    """
    numeric = numeric_columns(df)
    is_group = lambda c: group_prefix is not None and c.startswith(group_prefix)
    if names is None:
        chosen = [c for c in numeric if with_group or not is_group(c)]
    else:
        chosen = [c for c in names if c in numeric]
        chosen += [c for c in numeric if any(c.startswith(p) for p in prefixes)]
        if with_group:
            chosen += [c for c in numeric if is_group(c)]
    dropped = set(leakage) | {target} | set((target_leakage or {}).get(target, ()))
    return [c for c in dict.fromkeys(chosen) if c not in dropped]


def named_feature_set(
    df: DataFrame, name: str, target: str, leakage: Sequence[str] = tuple(fixed.FINAL_OUTPUTS), with_group: bool = False,
) -> list[str]:
    """Features of one of the six named sets: its columns, the configuration columns and, on request, the group columns.

    Results of the final flow and the target itself are never features.
    """
    if name not in fixed.FEATURE_SETS:
        raise ValueError(f"Unknown feature set: {name}")
    names = fixed.FEATURE_SETS[name]
    if names is None:
        return feature_set(df, target, leakage, group_prefix=fixed.GROUP_PREFIX, with_group=with_group)
    if name == "ratios_only":
        names = [c for c in numeric_columns(df) if c.startswith(fixed.RATIO_PREFIX)]
    return feature_set(df, target, leakage, names, fixed.CONFIG_PREFIXES, fixed.GROUP_PREFIX, with_group)


def add_descriptors(df: DataFrame, group: str = "benchmark") -> DataFrame:
    """Add the coarse descriptors of each row's group; 0 for groups without any."""
    rows = [(name, *values) for name, values in fixed.DESCRIPTORS.items()]
    kinds = ", ".join(f"{c} int" for c in fixed.DESCRIPTOR_COLUMNS)
    table = df.sparkSession.createDataFrame(rows, f"_group string, {kinds}").withColumnRenamed("_group", group)
    return lookup(df, table, group, fixed.DESCRIPTOR_COLUMNS)
