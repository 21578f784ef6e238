"""Report corpora on disk, batch and stream."""

import json
from pathlib import Path

from featureforge.plans import reports
from featureforge.sources.files import read_corpus
from featureforge.functions.text import extract_first
from featureforge.streaming.ingest import stream_ingest

BLOCK = """
  Number of control steps: {0}
  Minimum slack: {1}
  Estimated max frequency (MHz): 106.76
  Number of states: 18
  Number of modules instantiated: 136
  Number of performance conflicts: 12
  Estimated resources area (no Muxes and address logic): 1393
  Estimated area of MUX21: 139
  Total estimated area: 1532
  Estimated number of DSPs: 0
  Register allocation algorithm obtains a sub-optimal result: 29 registers(LB:20)
  Total number of flip-flops in function kernel_x: 759
"""


def write(folder: Path, name: str, text: str | bytes):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_logs(spark, tmp_path):
    text = "run --top-fname=kernel_x file.c\n" + BLOCK.format(6, 0.1) + BLOCK.format(20, 0.6332)
    write(tmp_path, "floyd-warshall_MEDIUM_clk10_memALL_BRAM_dsp1.0_optO2_log.txt", text)
    write(tmp_path, "sub/odd_name.txt", b"Number of states: 4\xff\xfe\r\nNumber of states: 5\r\n")
    rows = {r.benchmark: r for r in reports.log_metrics(read_corpus(spark, str(tmp_path), "*.txt")).collect()}
    full = rows["floyd-warshall"]
    assert len(full) == 21
    assert (full.control_steps, full.min_slack, full.states, full.modules_instantiated, full.performance_conflicts) == (20, 0.6332, 18, 136, 12)
    assert (full.flipflops, full.area_est, full.mux_area, full.total_area, full.registers, full.dsps) == (759, 1393, 139, 1532, 29, 0)
    assert (full.mem_policy, full.clock_period, full.opt_level, full.design_name) == ("ALL_BRAM", "10", "O2", "kernel_x")
    assert rows["odd"].states == 5 and rows["odd"].total_area is None


def test_source_features(spark, tmp_path):
    write(tmp_path, "k.c", """
/* for (;;) { } */
#include <x.h>
int n; // float y
for (int i = 0; i < n; i++) {
  while (a[i] > 0) { s = s + a[i] * 2; }
}
f(a);
""")
    r = reports.source_features(read_corpus(spark, str(tmp_path), "*.c")).first()
    assert (r.benchmark, r.source_lines, r.num_for_loops, r.num_while_loops, r.num_total_loops, r.max_loop_depth) == ("k", 5, 1, 1, 2, 2)
    assert (r.num_array_accesses, r.num_add_ops, r.num_mul_ops, r.num_arithmetic_ops) == (2, 1, 1, 2)
    assert (r.num_function_calls, r.num_var_decls, r.num_assignments) == (1, 2, 2)


def test_synthesis(spark, tmp_path):
    name = "gemm_SMALL_clk10_memALL_BRAM_dsp1.0_optO{}_yosys.json"
    modules = {"\\kernel_gemm": {"num_cells": 1}, "\\_kernel_gemm": {"num_cells": 5, "num_wires": 2}, "z": {"num_cells": 90}}
    write(tmp_path, name.format(0), json.dumps({"modules": modules}))
    write(tmp_path, name.format(1), '{"modules": ')
    write(tmp_path, name.format(2), json.dumps({"modules": {}}))
    write(tmp_path, "unparsable_yosys.json", "{}")
    rows = {r.opt_level: r for r in reports.synthesis_metrics(read_corpus(spark, str(tmp_path), "*.json")).collect()}
    assert set(rows) == {"O0", "O1", "O2"}
    assert (rows["O0"].synth_selected_module, rows["O0"].synth_num_cells, rows["O0"].synth_total_cells) == ("\\_kernel_gemm", 5, 96)
    assert rows["O1"].synth_parse_status == "failed" and rows["O1"].synth_total_cells is None
    assert rows["O2"].synth_selected_module == "UNKNOWN" and rows["O2"].synth_total_modules == 0


TIMING = """tns max 0.00
wns max -0.10
worst slack max 5.29
clock period_min = 4.71 fmax = 212.14
critical path delay
----------------
5.6013
critical path slack
----------------
5.2862
setup violation count 3
hold violation count 0
Total                  1.0e-03   2.0e-03   3.0e-04   6.94e-03 100.0%
"""


def test_run_folders(spark, tmp_path):
    one, two = (f"gemm_SMALL_clk10_memALL_BRAM_dsp1.0_optO0_orclk{c}" for c in (10, 2))
    write(tmp_path, f"{one}/reports/base/5_global_route.rpt", "tns max 9")
    write(tmp_path, f"{one}/reports/5_global_route.rpt", TIMING)
    write(tmp_path, f"{one}/reports/synth_stat.txt", "Chip area for module '\\top': 64237.404\n")
    write(tmp_path, f"{one}/status.txt", "ok\n")
    write(tmp_path, f"{one}/reports/5_route_drc.rpt", "violation type: x\nmet2 box\n")
    write(tmp_path, f"{one}/results/6_final.def", "UNITS DISTANCE MICRONS 2000 ;\nNETS 1 ;\n - a + ROUTED m ( 0 0 ) ( 0 4000 )\nEND NETS")
    write(tmp_path, f"{one}/route.guide", "net\n(\n1 2 3 4 met1\n)\n")
    write(tmp_path, f"{two}/status.txt", "failed")
    files = read_corpus(spark, str(tmp_path)).withColumn("config_name", extract_first("path", r"/([^/]+_orclk[0-9]+)/"))
    runs = files.select("config_name").distinct()
    final = {r.config_name: r for r in reports.final_report_metrics(files, runs).collect()}
    r = final[one]
    assert (r.wns, r.critical_path_delay, r.critical_path_slack, r.setup_violation_count) == (-0.1, 5.6013, 5.2862, 3)
    assert (r.total_power, r.synth_chip_area, r.run_status, r.parse_status, r.clock_constraint) == (0.00694, 64237.404, "ok", "ok", 10.0)
    assert (final[two].parse_status, final[two].run_status, final[two].tns) == ("missing_global_route_report", "failed", None)
    route = {r.config_name: r for r in reports.route_metrics(files, runs).collect()}
    r = route[one]
    assert (r.route_drc_status, r.route_drc_violation_keyword_count) == ("possible_violations", 2)
    assert (r.def_routed_wirelength_dbu, r.def_routed_wirelength_microns, r.route_guide_segment_like_lines) == (4000, 2.0, 1)
    assert (route[two].route_drc_status, route[two].def_exists, route[two].def_routed_wirelength_dbu) == ("missing", 0, None)


def test_stream_equals_batch(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    name = "gemm_SMALL_clk{}_memLSS_dsp1.0_optO0_log.txt"
    for clk in (5, 10):
        write(inbox, name.format(clk), BLOCK.format(clk, 0.5))
    stream_ingest(spark, str(inbox), reports.log_metrics, out, mark)
    write(inbox, name.format(15), BLOCK.format(15, 0.5))
    for _ in range(2):  # the second call finds nothing new
        stream_ingest(spark, str(inbox), reports.log_metrics, out, mark, files_per_trigger=1)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r) for r in reports.log_metrics(read_corpus(spark, str(inbox))).collect())
    assert got == want and len(got) == 3
