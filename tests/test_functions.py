"""Column functions on hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from featureforge.functions import fixed_values as fixed
from featureforge.functions.jsonmaps import REPORT_SCHEMA, map_rollup, pick_entry
from featureforge.functions.keys import LABEL_KEY, LOG_KEY, REPORT_KEY, parse_key
from featureforge.functions.paths import path_length, sections
from featureforge.functions.text import (
    count_lines, count_lines_where, count_names, count_pattern, extract_first, extract_last, fmt_mean_std, guide_line,
    map_values, nesting_depth, safe_name, strip_comments, violation_line,
)
from featureforge.sources.files import read_json_reports


def value(spark, column, text=None):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


@pytest.mark.parametrize("text, last, first", [
    ("", None, None), ("none", None, None), ("n: 3\nn: 41", 41, 3), ("n: -7", -7, -7),
    ("n: 99999999999999999999", None, None),
])
def test_matches(spark, text, last, first):
    assert value(spark, extract_last("text", r"n: (-?\d+)", "bigint"), text) == last
    assert value(spark, extract_first("text", r"n: (-?\d+)", "bigint"), text) == first


def test_operators_and_comments(spark):
    code = "a++; a+=b; a->b; x = y + z - 1; /* a + b\n c */ q = p*2 / r; // d + e\nif (x == 1) f(x);\r\n#define Z 1\n\n"
    text = value(spark, strip_comments("text"), code)
    counts = {n: value(spark, count_pattern("text", p), text) for n, p in fixed.SOURCE_PATTERNS.items()}
    assert counts["num_add_ops"] == 1 and counts["num_sub_ops"] == 1
    assert counts["num_mul_ops"] == 1 and counts["num_div_ops"] == 1
    assert counts["num_assignments"] == 3 and counts["num_if_statements"] == 1
    assert value(spark, count_names("text", fixed.CALL_PATTERN, fixed.NOT_CALLS), text) == 1
    assert value(spark, count_lines("text", "#"), text) == 2
    assert value(spark, count_lines("text"), text) == 3


@pytest.mark.parametrize("code, depth", [
    ("", 0), ("for (;;) { for (;;) { } }", 2), ("for (;;) x(); { }", 1), ("} } for (;;) {", 1),
    ("for (;;) { if (x) { } while (y) { } }", 1), ("if (a) { for(;;) { } }", 1),
])
def test_nesting(spark, code, depth):
    assert value(spark, nesting_depth("text"), code) == depth


def test_line_predicates(spark):
    text = "Violation here\nDRC viol\ndrc ok\n met3 10 \nplain\n1 2 3 4\n  \n"
    assert value(spark, count_lines_where("text", violation_line), text) == 3
    assert value(spark, count_lines_where("text", guide_line), text) == 2


def test_small_helpers(spark):
    assert value(spark, safe_name(F.lit("$_DFF.P:a b-c/\\x"))) == "cell__DFF_P_a_b_c_x"
    assert value(spark, fmt_mean_std(F.lit(1.0), F.lit(None).cast("double"))) == "1.0000 ± nan"
    assert value(spark, map_values(F.lit("z"), {"a": "b"})) == "z"


def test_lenient_key(spark):
    rows = spark.createDataFrame([(k,) for k in (
        "gemm_SMALL_clk10_memALL_BRAM_dsp1.0_optO2_log", "2mm_LARGE_clk5_log", "atax_SMALL_clk15_setupbase_log",
        "mvt_memALL_BRAM_optO1", "alone",
    )], "k string")
    got = [tuple(r)[1:] for r in parse_key(rows, "k", LOG_KEY).collect()]
    assert got[0] == ("gemm", "SMALL", "10", "ALL_BRAM", "1.0", "O2", "none")
    assert got[1] == ("2mm", "LARGE", "5", "default", "default", "default", "none")
    assert got[2] == ("atax", "SMALL", "15", "default", "default", "default", "base")
    assert got[3] == ("mvt", "DEFAULT", "default", "ALL", "default", "O1", "none")
    assert got[4] == ("alone", "DEFAULT", "default", "default", "default", "default", "none")


def test_strict_keys(spark):
    rows = spark.createDataFrame([("gemm_SMALL_clk10_memALL_BRAM_dsp1.0_optO0_orclk2",), ("bad",)], "k string")
    ok, bad = parse_key(rows, "k", LABEL_KEY, "null").collect()
    assert (ok.clock_period, ok.dsp_coeff, ok.clock_constraint, ok.config_parse_status) == (10, 1.0, 2.0, "ok")
    assert bad.benchmark is None and bad.config_parse_status == "failed"
    assert parse_key(rows, "k", REPORT_KEY, "drop").count() == 1


def test_path_length(spark):
    def run(body, whole_word=True):
        df = spark.createDataFrame([("r", body)], "run string, text string")
        return path_length(df, "text", ["run"], whole_word).first()

    one = run("UNITS DISTANCE MICRONS 10 ;\nNETS 1 ;\n - a + ROUTED m ( 0 0 ) ( * 5 ) ( 3 * ) ( 7 9 )\nEND NETS")
    assert (one.points, one.length, one.records, one.length_microns) == (4, 16, 1, 1.6)
    lead = run("NETS 1 ;\n - a + FIXED m ( * 5 ) ( 3 * )\nEND NETS")
    assert (lead.points, lead.length, lead.records, lead.length_microns) == (0, 0, 1, None)
    assert run("no sections\n - a ( 1 1 ) ( 2 2 )").records == 0
    both = "SPECIALNETS 1 ;\n - v + COVER m ( 0 0 ) ( 4 0 )\nEND SPECIALNETS\nNETS 1 ;\n - a + ROUTED m ( 0 0 ) ( 0 2 )\nEND NETS"
    assert run(both).length == 6
    assert run(both, whole_word=False).length == 10


def test_each_section_is_searched_once(spark, capsys):
    """A condition repeats the searches that it is given."""
    texts = ["NETS 1 ;\n - a\nEND NETS", "SPECIALNETS 1 ; b END SPECIALNETS", "NETS without an end", "", None]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", sections("text").alias("bodies"))
    got = {r.text: r.bodies for r in found.collect()}
    assert got == {texts[0]: ["\n - a\nEND NETS"], texts[1]: [" b END SPECIALNETS"], **{t: [t] for t in texts[2:]}}
    found.explain()
    assert capsys.readouterr().out.count("regexp_extract(") == 2


def test_json_maps(spark):
    texts = [
        '{"modules": {"a": {"num_cells": 3, "num_wires": null}, "b": {"num_cells": 3}}}',
        '{"modules": {}}', '{"modules": {"_k": {"num_cells": 1}, "z": {"num_cells": 9}}}', '{"modules": {"a"', "{}",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    parsed = read_json_reports(rows, "text", REPORT_SCHEMA)
    m = "report.modules"
    got = parsed.select("i", "parse_status", pick_entry(m, ["_k"], "num_cells").alias("e"), *map_rollup(
        m, ["num_cells", "num_wires"], "", "modules")).orderBy("i").collect()
    assert [r.parse_status for r in got] == ["ok", "ok", "ok", "failed", "ok"]
    assert got[0].e.key == "a" and got[1].e is None and got[2].e.key == "_k"
    assert (got[0].cells, got[0].wires, got[0].modules) == (6, 0, 2) and got[1].modules == 0


def test_rejected_keys_are_counted(spark):
    from pyspark.sql import Observation

    from featureforge.functions import keys

    spec = keys.KeySpec(parts=[("name", r"([a-z]+)_"), ("size", r"(\d+)")], types={"size": "int"})
    df = spark.createDataFrame([("ab_1",), ("cd_22",), ("no key",), (None,)], "k string")
    seen = Observation("keys")
    rows = keys.parse_key(df, "k", spec, mode="drop", rejects=seen).collect()
    assert sorted((r.name, r.size) for r in rows) == [("ab", 1), ("cd", 22)] and seen.get == {"rejected": 2}
