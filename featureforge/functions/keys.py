"""Configuration names such as ``gemm_SMALL_clk10_memALL_BRAM_dsp1.0_optO0`` as typed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from featureforge.functions.fixed_values import CONFIG_FULL, CONFIG_HEAD, DATASET_SIZES


@dataclass(frozen=True)
class KeySpec:
    """Named parts of a key, in order; each part is ``(name, pattern with one group)``.

    ``optional`` parts may be absent, ``types`` cast the captured text, and
    ``defaults`` fill parts that were not captured. ``prefixes`` drive the
    token fallback of the lenient mode.
    """

    parts: Sequence[tuple[str, str]]
    types: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, str] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()
    prefixes: Mapping[str, str] = field(default_factory=dict)
    second_token: tuple[str, Sequence[str]] | None = None

    @property
    def pattern(self) -> str:
        body = "".join(f"(?:{p})?" if n in self.optional else p for n, p in self.parts)
        return "(?d)^" + body


LOG_KEY = KeySpec(
    parts=CONFIG_HEAD + CONFIG_FULL + [("opt_level", r"opt(O\d+)_"), ("experimental_setup", r"setup([^_]+)")],
    defaults={
        "benchmark": "UNKNOWN", "dataset_size": "DEFAULT", "clock_period": "default",
        "mem_policy": "default", "dsp_coeff": "default", "opt_level": "default",
        "experimental_setup": "none",
    },
    optional=frozenset(["mem_policy", "dsp_coeff", "opt_level", "experimental_setup"]),
    prefixes={
        "clock_period": "clk", "mem_policy": "mem", "dsp_coeff": "dsp",
        "opt_level": "opt", "experimental_setup": "setup",
    },
    second_token=("dataset_size", DATASET_SIZES),
)
REPORT_KEY = KeySpec(
    parts=CONFIG_HEAD + CONFIG_FULL + [("opt_level", r"opt(O\d+)")],
    types={"clock_period": "bigint", "dsp_coeff": "double"},
)
LABEL_KEY = KeySpec(
    parts=CONFIG_HEAD + CONFIG_FULL + [("opt_level", r"opt(O\d+)_"), ("clock_constraint", r"orclk([\d.]+)")],
    types={"clock_period": "bigint", "dsp_coeff": "double", "clock_constraint": "double"},
)


def _captured(key: Column, spec: KeySpec) -> dict[str, Column]:
    return {
        name: F.nullif(F.regexp_extract(key, spec.pattern, i), F.lit(""))
        for i, (name, _) in enumerate(spec.parts, start=1)
    }


def _typed(columns: Mapping[str, Column], spec: KeySpec) -> dict[str, Column]:
    return {n: c.try_cast(spec.types[n]) if n in spec.types else c for n, c in columns.items()}


def _last_with_prefix(tokens: Column, prefix: str) -> Column:
    found = F.filter(tokens, lambda token: token.startswith(prefix))
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(prefix), F.lit(""))


def _token_fallback(key: Column, spec: KeySpec) -> dict[str, Column]:
    """Split on ``_``: first token, known second token, then the last token per prefix."""
    tokens = F.split(key, "_")
    out = {}
    first = spec.parts[0][0]
    out[first] = F.try_element_at(tokens, F.lit(1))
    if spec.second_token:
        name, allowed = spec.second_token
        second = F.try_element_at(tokens, F.lit(2))
        out[name] = F.when(second.isin(*allowed), second)
    for name, prefix in spec.prefixes.items():
        out[name] = _last_with_prefix(tokens, prefix)
    return out


def parse_key(
    df: DataFrame, key: Column | str, spec: KeySpec, mode: str = "lenient", rejects: Observation | None = None,
) -> DataFrame:
    """Add one column per part of the key.

    ``lenient`` falls back to tokens and defaults; ``null`` gives nulls and a
    ``config_parse_status``; ``drop`` keeps only rows whose key parses and, with
    ``rejects``, observes the number of others as ``rejected``.
    """
    key = F.col(key) if isinstance(key, str) else key
    matched = key.rlike(spec.pattern)
    captured = _captured(key, spec)
    if mode == "drop":
        if rejects is not None:
            df = df.observe(rejects, F.count_if(~F.coalesce(matched, F.lit(False))).alias("rejected"))
        return df.filter(matched).withColumns(_typed(captured, spec))
    if mode == "null":
        status = F.when(matched, F.lit("ok")).otherwise(F.lit("failed"))
        return df.withColumns({**_typed(captured, spec), "config_parse_status": status})
    if mode != "lenient":
        raise ValueError(f"unknown mode: {mode}")
    fallback = _token_fallback(key, spec)
    out = {}
    for name, value in captured.items():
        other = fallback.get(name, F.lit(None).cast("string"))
        value = F.when(matched, value).otherwise(other)
        if name in spec.defaults:
            value = F.coalesce(value, F.lit(spec.defaults[name]))
        out[name] = value
    return df.withColumns(_typed(out, spec))
