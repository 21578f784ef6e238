"""Report wordings, column names and lookup tables that results depend on."""

# Metrics of a high-level-synthesis log; the last match in the log counts.
LOG_METRICS = {
    "control_steps": (r"Number of control steps:\s*(\d+)", "bigint"),
    "min_slack": (r"Minimum slack:\s*(-?[\d.]+)", "double"),
    "frequency_mhz": (r"Estimated max frequency \(MHz\):\s*([\d.]+)", "double"),
    "states": (r"Number of states:\s*(\d+)", "bigint"),
    "modules_instantiated": (r"Number of modules instantiated:\s*(\d+)", "bigint"),
    "performance_conflicts": (r"Number of performance conflicts:\s*(\d+)", "bigint"),
    "flipflops": (r"Total number of flip-flops in function [^:]+:\s*(\d+)", "bigint"),
    "area_est": (r"Estimated resources area.*:\s*(\d+)", "bigint"),
    "mux_area": (r"Estimated area of MUX21:\s*(\d+)", "bigint"),
    "total_area": (r"Total estimated area:\s*(\d+)", "bigint"),
    "registers": (
        r"Register allocation algorithm obtains a sub-optimal result:\s*(\d+)\s*registers",
        "bigint",
    ),
    "dsps": (r"Estimated number of DSPs:\s*(\d+)", "bigint"),
}
LOG_TOP_FUNCTION = r"--top-fname=(\w+)"

# Metrics of a final timing and power report; the first match counts.
TIMING_METRICS = {
    "tns": (r"tns max ([\-0-9\.]+)", "double"),
    "wns": (r"wns max ([\-0-9\.]+)", "double"),
    "worst_slack": (r"worst slack max ([\-0-9\.]+)", "double"),
    "clock_period_min": (r"clock period_min = ([0-9\.]+)", "double"),
    "fmax": (r"fmax = ([0-9\.]+)", "double"),
    "critical_path_delay": (r"critical path delay\s*\n[-]+\s*\n([0-9\.]+)", "double"),
    "critical_path_slack": (r"critical path slack\s*\n[-]+\s*\n([\-0-9\.]+)", "double"),
    "setup_violation_count": (r"setup violation count ([0-9]+)", "bigint"),
    "hold_violation_count": (r"hold violation count ([0-9]+)", "bigint"),
    "max_slew_violation_count": (r"max slew violation count ([0-9]+)", "bigint"),
    "max_cap_violation_count": (r"max cap violation count ([0-9]+)", "bigint"),
    "total_power": (
        r"Total\s+[0-9eE\-\+\.]+\s+[0-9eE\-\+\.]+\s+[0-9eE\-\+\.]+\s+([0-9eE\-\+\.]+)",
        "double",
    ),
}
AREA_METRICS = {"synth_chip_area": (r"Chip area for module .*?:\s*([0-9\.]+)", "double")}
UNITS_PATTERN = r"UNITS\s+DISTANCE\s+MICRONS\s+(\d+)\s*;"

# Pattern counts over comment-free C source.
SOURCE_PATTERNS = {
    "num_for_loops": r"\bfor\s*\(",
    "num_while_loops": r"\bwhile\s*\(",
    "num_if_statements": r"\bif\s*\(",
    "num_array_accesses": r"\[[^\]]+\]",
    "num_add_ops": r"(?<!\+)\+(?!\+|=)",
    "num_sub_ops": r"(?<!-)-(?!-|=|>)",
    "num_mul_ops": r"(?<!/)\*(?!=|/)",
    "num_div_ops": r"(?<!/)/(?!/|\*)",
    "num_assignments": r"(?<![=!<>])=(?!=)",
    "num_int_decls": r"\bint\s+[A-Za-z_]",
    "num_float_decls": r"\bfloat\s+[A-Za-z_]",
    "num_double_decls": r"\bdouble\s+[A-Za-z_]",
}
CALL_PATTERN = r"\b([A-Za-z_]\w*)\s*\("
NOT_CALLS = ("if", "for", "while", "switch", "return", "sizeof")

# Parts of a configuration name.
CONFIG_HEAD = [
    ("benchmark", r"(.+)_"),
    ("dataset_size", r"(SMALL|MEDIUM|MINI|LARGE)_"),
    ("clock_period", r"clk(\d+)_"),
]
CONFIG_FULL = [
    ("mem_policy", r"mem([A-Z_]+)_"),
    ("dsp_coeff", r"dsp([\d.]+)_"),
]
# Fixed value: what a report file name carries after the configuration.
REPORT_SUFFIX = "_yosys"
DATASET_SIZES = ("SMALL", "MEDIUM", "MINI", "LARGE")

# Composite key and column groups of the integrated table.
MERGE_KEYS = ["benchmark", "dataset_size", "clock_period", "mem_policy", "dsp_coeff", "opt_level"]
TEXT_KEYS = ["benchmark", "dataset_size", "mem_policy", "opt_level"]
ID_COLUMNS = ["design_name", "log_file", "synth_report_file", "config_name"]
UNUSED_COLUMNS = ["dsps", "experimental_setup"]
STATUS_COLUMNS = [
    "config_name", "config_parse_status", "run_status", "parse_status",
    "synth_selected_module", "synth_report_file",
]
HLS_FEATURES = [
    "clock_period", "dsp_coeff", "control_steps", "min_slack", "frequency_mhz", "states",
    "modules_instantiated", "performance_conflicts", "flipflops", "area_est", "mux_area",
    "total_area", "registers",
]
HLS_METRICS = HLS_FEATURES[2:] + ["dsps"]
CODE_FEATURES = [
    "source_lines", "num_for_loops", "num_while_loops", "num_total_loops", "max_loop_depth",
    "num_if_statements", "num_array_accesses", "num_add_ops", "num_sub_ops", "num_mul_ops",
    "num_div_ops", "num_arithmetic_ops", "num_assignments", "num_function_calls", "num_var_decls",
]
MODULE_COUNTERS = [
    "num_wires", "num_wire_bits", "num_pub_wires", "num_pub_wire_bits", "num_memories",
    "num_memory_bits", "num_processes", "num_cells",
]
SYNTH_FEATURES = [f"synth_{c}" for c in MODULE_COUNTERS] + ["synth_total_modules"] + [
    f"synth_total_{c[4:]}" for c in MODULE_COUNTERS
]
FINAL_OUTPUTS = list(TIMING_METRICS) + list(AREA_METRICS)
TARGETS = ["synth_chip_area", "critical_path_delay", "total_power"]
TARGET_LABELS = {
    "synth_chip_area": "Final ASIC area",
    "critical_path_delay": "Final critical path delay",
    "total_power": "Final total power",
}

# Named feature sets (all take the configuration columns as well), and the prefixes of those.
FEATURE_SETS = {
    "code_only": CODE_FEATURES,
    "hls_only": HLS_FEATURES,
    "synth_only": SYNTH_FEATURES,
    "hls_plus_synth": HLS_FEATURES + SYNTH_FEATURES,
    "ratios_only": [],
    "all_direct_features": None,
}
CONFIG_PREFIXES = ["dataset_size_", "mem_policy_", "opt_level_"]
GROUP_PREFIX = "benchmark_"
RATIO_PREFIX = "ratio_"

# Ratio features (name, numerator, denominator).
RATIO_FEATURES = [
    ("ratio_compute_to_memory", "num_arithmetic_ops", "num_array_accesses"),
    ("ratio_mul_density", "num_mul_ops", "num_arithmetic_ops"),
    ("ratio_control_density", "num_if_statements", "source_lines"),
    ("ratio_ff_per_cell", "flipflops", "synth_total_cells"),
    ("ratio_registers_per_cell", "registers", "synth_total_cells"),
    ("ratio_wire_bits_per_cell", "synth_total_wire_bits", "synth_total_cells"),
    ("ratio_wires_per_cell", "synth_total_wires", "synth_total_cells"),
    ("ratio_mux_area_share", "mux_area", "total_area"),
    ("ratio_area_per_control_step", "area_est", "control_steps"),
]
# Ratio targets (name -> original target, denominator).
RATIO_TARGETS = {
    "area_ratio": ("synth_chip_area", "area_est"),
    "delay_ratio": ("critical_path_delay", "clock_constraint"),
    "power_per_area": ("total_power", "area_est"),
}

# Coarse descriptors per benchmark.
DESCRIPTOR_COLUMNS = [
    "sem_compute_intensity", "sem_memory_intensity", "sem_is_stencil",
    "sem_has_reduction", "sem_regular_access", "sem_matrix_kernel",
]
DESCRIPTORS = {
    "2mm": (2, 1, 0, 1, 1, 1),
    "3mm": (2, 1, 0, 1, 1, 1),
    "atax": (1, 2, 0, 1, 1, 1),
    "bicg": (1, 2, 0, 1, 1, 1),
    "floyd-warshall": (1, 2, 0, 0, 0, 1),
    "gemm": (2, 1, 0, 1, 1, 1),
    "gemver": (1, 2, 0, 1, 1, 1),
    "gesummv": (1, 2, 0, 1, 1, 1),
    "jacobi-1d": (0, 2, 1, 0, 1, 0),
    "jacobi-2d": (0, 2, 1, 0, 1, 0),
    "mvt": (1, 2, 0, 1, 1, 1),
    "nussinov": (1, 2, 0, 0, 0, 1),
    "seidel-2d": (0, 2, 1, 0, 1, 0),
    "symm": (2, 1, 0, 1, 1, 1),
    "syr2k": (2, 1, 0, 1, 1, 1),
    "syrk": (2, 1, 0, 1, 1, 1),
    "trmm": (2, 1, 0, 1, 1, 1),
}
# Benchmarks whose top module is named kernel_<benchmark>.
KERNEL_BENCHMARKS = [
    "2mm", "3mm", "atax", "bicg", "deriche", "floyd-warshall", "gemm", "gemver", "gesummv",
    "jacobi-1d", "jacobi-2d", "mvt", "nussinov", "seidel-2d", "symm", "syr2k", "syrk", "trmm",
]
