"""Column expressions that turn report text into typed metrics and counts.

Everything here is a built-in Spark expression: extraction of any number of
metrics is one projection in one stage, without a shuffle or a Python worker.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Line ends as text tools see them, and blanks that do not make a line count.
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
VISIBLE = r"[^\s\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_last(text: Column | str, pattern: str, dtype: str = "string", group: int = 1) -> Column:
    """Typed capture of the last match; null where nothing matches or the cast fails."""
    hits = F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(group))
    return F.try_element_at(hits, F.lit(-1)).try_cast(dtype)


def extract_first(text: Column | str, pattern: str, dtype: str = "string", group: int = 1) -> Column:
    """Typed capture of the first match; null where nothing matches or the cast fails."""
    return F.nullif(F.regexp_extract(_col(text), pattern, group), F.lit("")).try_cast(dtype)


def extract_metrics(
    df: DataFrame,
    text: Column | str,
    specs: Mapping[str, tuple[str, str]],
    which: str = "last",
) -> DataFrame:
    """Add one column per ``name -> (pattern, type)``."""
    pick = {"last": extract_last, "first": extract_first}[which]
    return df.withColumns({name: pick(text, p, t) for name, (p, t) in specs.items()})


def strip_comments(
    text: Column | str,
    patterns: Sequence[str] = (r"(?s)/\*.*?\*/", r"(?d)//.*"),
) -> Column:
    """Remove block comments, then line comments."""
    out = _col(text)
    for pattern in patterns:
        out = F.regexp_replace(out, pattern, "")
    return out


def count_pattern(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(_col(text), F.lit(pattern)).cast("bigint")


def count_names(text: Column | str, pattern: str, excluded: Sequence[str]) -> Column:
    """Matches whose first group is not one of ``excluded``."""
    names = F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1))
    return F.size(F.filter(names, lambda n: ~n.isin(*excluded))).cast("bigint")


def count_patterns(df: DataFrame, text: Column | str, patterns: Mapping[str, str]) -> DataFrame:
    """Add one match count per ``name -> pattern``."""
    return df.withColumns({name: count_pattern(text, p) for name, p in patterns.items()})


def add_totals(df: DataFrame, totals: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add row-wise sums, e.g. all loops or all arithmetic operators."""
    out = {}
    for name, parts in totals.items():
        total = F.col(parts[0])
        for part in parts[1:]:
            total = total + F.col(part)
        out[name] = total
    return df.withColumns(out)


def nesting_depth(
    text: Column | str,
    opener: str = r"\b(?:for|while)\s*\(",
    enter: str = r"\{",
    leave: str = r"\}",
) -> Column:
    """Deepest nesting of ``enter`` tokens that follow an ``opener``.

    An ``enter`` counts once after an opener; every ``leave`` closes a level
    while one is open, also where it belongs to an uncounted ``enter``.
    """
    tokens = F.regexp_extract_all(_col(text), F.lit(f"{opener}|{enter}|{leave}"), F.lit(0))
    zero = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("deepest"), F.lit(False).alias("pending")
    )

    def step(acc: Column, token: Column) -> Column:
        entering = token.rlike(f"^(?:{enter})$")
        leaving = token.rlike(f"^(?:{leave})$")
        counted = entering & acc["pending"]
        depth = (
            F.when(counted, acc["depth"] + 1)
            .when(leaving, F.greatest(acc["depth"] - 1, F.lit(0)))
            .otherwise(acc["depth"])
        )
        pending = F.when(counted, F.lit(False)).when(
            ~entering & ~leaving, F.lit(True)
        ).otherwise(acc["pending"])
        return F.struct(
            depth.alias("depth"),
            F.greatest(acc["deepest"], depth).alias("deepest"),
            pending.alias("pending"),
        )

    return F.aggregate(tokens, zero, step, lambda acc: acc["deepest"]).cast("bigint")


def visible_lines(text: Column | str) -> Column:
    """Non-blank lines as an array."""
    return F.filter(F.split(_col(text), LINE_END), lambda line: line.rlike(VISIBLE))


def count_lines(text: Column | str, skip_prefix: str | None = None) -> Column:
    """Non-blank lines, without those whose first visible characters are ``skip_prefix``."""
    lines = visible_lines(text)
    if skip_prefix is not None:
        lines = F.filter(lines, lambda line: ~F.ltrim(F.translate(line, "\t", " ")).startswith(skip_prefix))
    return F.size(lines).cast("bigint")


def count_lines_where(text: Column | str, predicate) -> Column:
    """Non-blank lines for which ``predicate(line)`` holds."""
    return F.size(F.filter(visible_lines(text), predicate)).cast("bigint")


def violation_line(line: Column) -> Column:
    """Line that looks like a rule-check finding."""
    low = F.lower(line)
    return (
        low.contains("violation")
        | (low.contains("drc") & (low.contains("error") | low.contains("viol")))
        | low.rlike(r"\bmet[0-9]+\b")
    )


def guide_line(line: Column) -> Column:
    """Line with a routing layer or with at least four integers."""
    return F.lower(line).rlike(r"\bmet[0-9]+\b") | (F.regexp_count(line, F.lit(r"\d+")) >= 4)


def safe_name(text: Column | str) -> Column:
    """Make a cell type usable as a column name."""
    out = F.replace(_col(text), F.lit("$"), F.lit("cell_"))
    out = F.replace(out, F.lit("\\"), F.lit(""))
    return F.translate(out, "/.: -", "_____")


def fmt_mean_std(mean: Column | str, std: Column | str, digits: int = 4) -> Column:
    """``mean ± std`` as text; a missing number reads ``nan``."""
    def cell(c: Column) -> Column:
        missing = c.isNull() | F.isnan(c.cast("double"))
        return F.when(missing, F.lit("nan")).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))

    return F.concat(cell(_col(mean)), F.lit(" ± "), cell(_col(std)))


def map_values(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace codes by labels; a code without a label stays as it is."""
    value = _col(value)
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)
