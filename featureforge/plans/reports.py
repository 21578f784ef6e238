"""Report corpora to metric tables: one projection per kind of report.

Input is a corpus as :func:`featureforge.sources.files.read_corpus` gives it.
``prefix`` names the tool in the output columns where a caller wants that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featureforge.functions import fixed_values as fixed
from featureforge.functions.columns import stripped
from featureforge.functions.jsonmaps import REPORT_SCHEMA, map_rollup, pick_entry
from featureforge.functions.keys import LABEL_KEY, LOG_KEY, REPORT_KEY, parse_key
from featureforge.functions.paths import path_length
from featureforge.functions.text import (
    add_totals, count_lines, count_lines_where, count_names, count_patterns, extract_first,
    extract_metrics, guide_line, nesting_depth, strip_comments,
)
from featureforge.operators.clean import classify_reports, with_parse_status
from featureforge.sources.files import file_stem, pick_preferred, read_json_reports

LOG_COLUMNS = (
    fixed.MERGE_KEYS + ["experimental_setup", "design_name"] + list(fixed.LOG_METRICS) + ["log_file"]
)


def log_metrics(corpus: DataFrame) -> DataFrame:
    """One row of 21 fields per log; the last match of every metric counts."""
    parsed = extract_metrics(corpus, "text", fixed.LOG_METRICS, which="last")
    parsed = parsed.withColumns({
        "design_name": extract_first("text", fixed.LOG_TOP_FUNCTION),
        "log_file": F.col("file_name"),
    })
    return parse_key(parsed, file_stem("file_name"), LOG_KEY, mode="lenient").select(*LOG_COLUMNS)


def source_features(corpus: DataFrame, benchmark: Column | None = None) -> DataFrame:
    """Size, loop, operator, call and declaration counts per source file."""
    code = corpus.withColumn("_code", strip_comments("text"))
    counted = count_patterns(code, "_code", fixed.SOURCE_PATTERNS).withColumns({
        "num_function_calls": count_names("_code", fixed.CALL_PATTERN, fixed.NOT_CALLS),
        "max_loop_depth": nesting_depth("_code"),
        "source_lines": count_lines("_code", skip_prefix="#"),
    })
    counted = add_totals(counted, {
        "num_total_loops": ["num_for_loops", "num_while_loops"],
        "num_arithmetic_ops": ["num_add_ops", "num_sub_ops", "num_mul_ops", "num_div_ops"],
        "num_var_decls": ["num_int_decls", "num_float_decls", "num_double_decls"],
    })
    name = benchmark if benchmark is not None else file_stem("file_name")
    return counted.select(
        name.alias("benchmark"), F.col("path").alias("source_file"), *fixed.CODE_FEATURES
    )


def _top_candidates(benchmark: Column) -> list[Column]:
    """Module names to prefer, best first; null for a benchmark without a known top module."""
    known = benchmark.isin(*fixed.KERNEL_BENCHMARKS)
    short = F.when(known, F.translate(benchmark, "-", "_"))
    top = F.concat(F.lit("kernel_"), short)
    names = []
    for head, body in (("_", top), ("", top), ("datapath_", short), ("controller_", short)):
        names += [F.concat(F.lit("\\" + head), body), F.concat(F.lit(head), body)]
    return names


def synthesis_metrics(corpus: DataFrame, prefix: str = "synth_") -> DataFrame:
    """Selected-module and whole-design counters per JSON report.

    Reports whose file name does not parse are left out; corrupt reports keep
    their key and get the status ``failed``.
    """
    stem = F.replace(file_stem("file_name"), F.lit(fixed.REPORT_SUFFIX), F.lit(""))
    keyed = parse_key(corpus, stem, REPORT_KEY, mode="drop")
    parsed = read_json_reports(keyed, "text", REPORT_SCHEMA, "_report", f"{prefix}parse_status")
    ok = F.col(f"{prefix}parse_status") == "ok"
    modules = F.col("_report.modules")
    chosen = parsed.withColumn("_pick", pick_entry(modules, _top_candidates(F.col("benchmark")), "num_cells"))
    totals = map_rollup(modules, fixed.MODULE_COUNTERS, f"{prefix}total_", f"{prefix}total_modules")
    return chosen.select(
        *fixed.MERGE_KEYS, f"{prefix}parse_status",
        F.when(ok, F.coalesce("_pick.key", F.lit("UNKNOWN"))).alias(f"{prefix}selected_module"),
        *[F.col(f"_pick.value.{c}").alias(f"{prefix}{c}") for c in fixed.MODULE_COUNTERS],
        *totals, F.col("file_name").alias(f"{prefix}report_file"),
    ).withColumns({
        c: F.when(ok, F.col(c)) for c in
        [f"{prefix}total_modules"] + [f"{prefix}total_{c[4:]}" for c in fixed.MODULE_COUNTERS]
    })


def _per_run(files: DataFrame, run: str, patterns: Sequence[str], text: str) -> DataFrame:
    return pick_preferred(files, run, "path", patterns).select(run, F.col("text").alias(text))


def final_report_metrics(files: DataFrame, runs: DataFrame, run: str = "config_name") -> DataFrame:
    """Timing, violation, power and area figures per run folder.

    ``files`` has the run name, ``path`` and ``text`` of every file; ``runs``
    lists all runs. A run without a timing report keeps nulls and a status.
    """
    route = _per_run(files, run, [r"/reports/5_global_route\.rpt$", r"/reports/base/5_global_route\.rpt$"], "_route")
    synth = _per_run(files, run, [r"/reports/synth_stat\.txt$", r"/reports/base/synth_stat\.txt$"], "_synth")
    status = _per_run(files, run, [r"/status\.txt$"], "_status")
    out = parse_key(runs, run, LABEL_KEY, mode="null")
    for part in (route, synth, status):
        out = out.join(part, run, "left")
    out = extract_metrics(out, "_route", fixed.TIMING_METRICS, which="first")
    out = extract_metrics(out, F.when(F.col("_route").isNotNull(), F.col("_synth")), fixed.AREA_METRICS, "first")
    out = out.withColumn("run_status", F.coalesce(stripped("_status"), F.lit("unknown")))
    out = with_parse_status(out, [(F.col("_route").isNull(), "missing_global_route_report")])
    return out.drop("_route", "_synth", "_status")


def route_metrics(
    files: DataFrame, runs: DataFrame, run: str = "config_name", whole_word: bool = False
) -> DataFrame:
    """Rule-check, routed-length and guide indicators per run folder.

    ``whole_word=True`` counts special nets once where their section comes first.
    """
    checks = classify_reports(
        files.filter(F.col("path").rlike(r"/5_route_drc\.rpt[^/]*$")), runs, run, "text"
    )
    renames = {c: f"route_drc_{c}" for c in checks.columns if c != run}
    out = checks.withColumnsRenamed(renames)

    layout = _per_run(files, run, [r"/6_final\.def$"], "text")
    lengths = path_length(layout, "text", [run], whole_word).select(
        run, F.lit(1).alias("def_exists"), F.col("units_per_micron").alias("def_units_per_micron"),
        F.col("length").alias("def_routed_wirelength_dbu"),
        F.col("length_microns").alias("def_routed_wirelength_microns"),
        F.col("points").alias("def_coordinate_pair_count"),
        F.col("records").alias("def_routed_net_count"),
    )
    guide = _per_run(files, run, [r"/route\.guide$"], "text").select(
        run, F.lit(1).alias("route_guide_exists"),
        count_lines("text").alias("route_guide_nonempty_lines"),
        count_lines_where("text", guide_line).alias("route_guide_segment_like_lines"),
    )
    return out.join(lengths, run, "left").join(guide, run, "left").fillna(
        0, ["def_exists", "def_coordinate_pair_count", "def_routed_net_count", "route_guide_exists"]
    )


def with_prefix(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    """Name a tool in front of metric columns, e.g. for tables read elsewhere."""
    renames: Mapping[str, str] = {c: f"{prefix}{c}" for c in columns}
    return df.withColumnsRenamed(renames)
