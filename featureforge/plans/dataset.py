"""Integration of four metric tables, and the clean and modelling tables made from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from featureforge.functions import fixed_values as fixed
from featureforge.operators import profile
from featureforge.operators.clean import drop_existing, drop_null, normalize_keys, select_existing
from featureforge.operators.dedupe import dedupe, duplicate_report
from featureforge.operators.features import one_hot
from featureforge.operators.joins import attach_labels, enrich, enrich_unique


def _keys(df: DataFrame) -> DataFrame:
    return normalize_keys(df, fixed.TEXT_KEYS, ["clock_period"], ["dsp_coeff"])


def integrate(
    metrics: DataFrame, static: DataFrame | None = None, synthesis: DataFrame | None = None,
    labels: DataFrame | None = None, order: Sequence[str] = ("synth_report_file",),
    null_safe: bool = False,
) -> DataFrame:
    """Left-join code features, synthesis counters and labels; absent tables are skipped.

    A configuration with several label rows keeps all of them; of several
    synthesis reports the first by ``order`` counts.
    """
    keys = fixed.MERGE_KEYS
    out = _keys(metrics)
    if static is not None and static.columns:
        out = enrich(out, drop_existing(static, ["source_file"]), "benchmark", null_safe)
    if synthesis is not None and synthesis.columns:
        wanted = select_existing(
            _keys(synthesis), keys + ["synth_selected_module"] + fixed.SYNTH_FEATURES + ["synth_report_file"]
        )
        out = enrich_unique(out, wanted, keys, list(order), null_safe)
    if labels is not None and labels.columns:
        wanted = select_existing(
            _keys(labels),
            keys + ["config_name", "clock_constraint", "config_parse_status", "run_status", "parse_status"]
            + fixed.FINAL_OUTPUTS,
        )
        out = attach_labels(out, wanted, keys, "parse_status", null_safe=null_safe)
    return out


def clean_table(df: DataFrame) -> DataFrame:
    """Without repeated rows, identifiers and unused columns."""
    return drop_existing(dedupe(df), fixed.ID_COLUMNS + fixed.UNUSED_COLUMNS)


def modelling_table(
    clean: DataFrame, required: Sequence[str] = (), cats: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """One-hot table; with ``required`` only rows that have these labels, without status texts."""
    if required:
        clean = drop_existing(drop_null(clean, required), fixed.STATUS_COLUMNS)
    return one_hot(clean, [c for c in fixed.TEXT_KEYS if c in clean.columns], cats)


def quality_reports(df: DataFrame) -> dict[str, DataFrame]:
    """All data-quality reports of an integrated table."""
    metrics = [c for c in fixed.HLS_METRICS if c in df.columns]
    targets = ["total_area", "control_steps", "frequency_mhz"] + fixed.TARGETS
    summarised = [
        "total_area", "control_steps", "frequency_mhz", "registers", "flipflops",
        "modules_instantiated", "performance_conflicts",
    ] + fixed.TARGETS
    present = [t for t in targets if t in df.columns]
    reports = {
        "missing_values_report": profile.missing_report(df),
        "duplicate_report": duplicate_report(df, fixed.MERGE_KEYS, metrics),
        "constant_columns_report": profile.constant_report(df),
        "outlier_report_iqr": profile.outlier_report(df),
        "group_summary": profile.group_summary(df, fixed.MERGE_KEYS, summarised),
        "correlation_matrix": profile.corr_matrix(df),
        "dataset_quality_summary": profile.quality_summary(
            df, fixed.MERGE_KEYS, metrics, present, "clock_constraint" if "clock_constraint" in df.columns else None
        ),
    }
    for target in present:
        reports[f"correlation_with_{target}"] = profile.corr_with(df, target)
    return reports
