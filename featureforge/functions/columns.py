"""Small scalar helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Text without blanks, tabs and line ends at both sides."""
    return F.btrim(as_column(c), F.lit(" \t\n\r\x0b\x0c"))


def number(c: Column | str) -> Column:
    """Double where NULL is the only missing marker (NaN becomes NULL)."""
    c = as_column(c).cast("double")
    return F.when(~F.isnan(c), c)


def canonical(df: DataFrame, c: str) -> Column:
    """The column with one form of each value: no signed zero, and NaN as NULL."""
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, T.FractionalType) and not isinstance(df.schema[c].dataType, T.DecimalType):
        return F.when(~F.isnan(col), col + F.lit(0.0).cast(df.schema[c].dataType))
    return col


def whole(c: Column, given: T.DataType, kind: str) -> Column:
    """An integer of type ``kind``, without a way through double; null where the value is not whole or does not fit."""
    if isinstance(given, T.IntegralType):
        return c.try_cast(kind)
    if isinstance(given, (T.FloatType, T.DoubleType)):
        return F.when(c == F.floor(c), c.try_cast(kind))
    exact = c.try_cast("decimal(38,9)")
    return F.when(exact == F.floor(exact), exact.try_cast(kind))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """``a / b``; null where ``b`` is zero."""
    b = as_column(b).cast("double")
    return as_column(a).cast("double") / F.nullif(b, F.lit(0.0))


def seeded_hash(key: Column | str, seed: int = 42) -> Column:
    """60-bit number from md5: the same on every engine, partitioning and run."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), as_column(key).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
