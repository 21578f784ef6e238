"""Routed path length from coordinate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from featureforge.functions.fixed_values import UNITS_PATTERN
from featureforge.functions.text import extract_first

POINT = r"\(\s*([\-0-9*]+)\s+([\-0-9*]+)\s*\)"
RECORD_START = r"\n\s*-\s+"


def path_points(record: Column | str) -> Column:
    """Raw ``(x, y)`` pairs of one record, ``*`` where a coordinate repeats."""
    record = F.col(record) if isinstance(record, str) else record
    xs = F.regexp_extract_all(record, F.lit(POINT), F.lit(1))
    ys = F.regexp_extract_all(record, F.lit(POINT), F.lit(2))
    return F.arrays_zip(xs.alias("x"), ys.alias("y"))


def fold_path(points: Column) -> Column:
    """Struct ``(points, length)`` of one path.

    ``*`` takes the coordinate of the last accepted point. A point that cannot
    be resolved is skipped and changes nothing.
    """
    def number(raw: Column, last: Column) -> Column:
        return F.when(raw == "*", last).otherwise(raw.try_cast("bigint"))

    zero = F.struct(
        F.lit(None).cast("bigint").alias("x"),
        F.lit(None).cast("bigint").alias("y"),
        F.lit(0).cast("bigint").alias("points"),
        F.lit(0).cast("bigint").alias("length"),
    )

    def step(acc: Column, point: Column) -> Column:
        x, y = number(point["x"], acc["x"]), number(point["y"], acc["y"])
        move = F.coalesce(F.abs(x - acc["x"]) + F.abs(y - acc["y"]), F.lit(0).cast("bigint"))
        moved = F.struct(
            x.alias("x"), y.alias("y"),
            (acc["points"] + 1).alias("points"),
            (acc["length"] + move).alias("length"),
        )
        return F.when(x.isNotNull() & y.isNotNull(), moved).otherwise(acc)

    return F.aggregate(
        points, zero, step,
        lambda acc: F.struct(acc["points"].alias("points"), acc["length"].alias("length")),
    )


def sections(text: Column | str, names=("SPECIALNETS", "NETS"), whole_word: bool = True) -> Column:
    """Bodies of the named sections; the whole text where none is found.

    ``whole_word=False`` lets ``NETS`` also match inside ``SPECIALNETS``.
    """
    text = F.col(text) if isinstance(text, str) else text
    edge = r"(?<!\w)" if whole_word else ""
    # a search only where the name occurs, and each list made once: conditions repeat what they are given
    found = F.array(*[
        F.when(F.contains(text, F.lit(n)), F.regexp_extract(text, rf"(?s){edge}{n}\s+\d+\s*;(.*?END\s+{n})", 1)) for n in names
    ])
    bodies = F.filter(found, lambda body: body != "")
    return F.transform(F.array(bodies), lambda some: F.when(F.size(some) > 0, some).otherwise(F.array(text)))[0]


def path_sums(text: Column | str, whole_word: bool = True) -> Column:
    """Struct ``(length, points, records)`` over all routed records of one text."""
    records = F.flatten(F.transform(sections(text, whole_word=whole_word), lambda part: F.split(part, RECORD_START)))
    routed = F.filter(records, lambda r: r.rlike("ROUTED|FIXED|COVER"))
    paths = F.transform(routed, lambda r: fold_path(path_points(r)))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        paths, F.struct(zero.alias("length"), zero.alias("points"), zero.alias("records")),
        lambda acc, p: F.struct(
            (acc["length"] + p["length"]).alias("length"), (acc["points"] + p["points"]).alias("points"),
            (acc["records"] + 1).alias("records"),
        ),
    )


def path_length(df: DataFrame, text: str, by: list[str], whole_word: bool = True) -> DataFrame:
    """Σ length, points and routed records per ``by``; length also in microns.

    Every text is folded where it lies, so only its sums are shuffled. A run
    without a routed record keeps a row with zeros.
    """
    per_text = df.select(
        *by, extract_first(text, UNITS_PATTERN, "bigint").alias("_units"), path_sums(text, whole_word).alias("_sums")
    )
    sums = per_text.groupBy(*by).agg(
        F.max("_units").alias("units_per_micron"),
        *[F.sum(f"_sums.{c}").alias(c) for c in ("length", "points", "records")],
    )
    return sums.withColumn(
        "length_microns", F.col("length") / F.nullif(F.col("units_per_micron"), F.lit(0))
    )
