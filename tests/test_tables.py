"""Table operators on hand-made edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featureforge.operators import profile, quantiles
from featureforge.operators.dedupe import duplicate_report, duplicate_rows, first_per_key
from featureforge.operators.features import feature_set, from_one_hot, one_hot
from featureforge.operators.folds import assign_group_folds, assign_kfold, split_holdout
from featureforge.operators.joins import attach_labels, enrich, enrich_unique
from featureforge.operators.metrics import regression_metrics
from featureforge.operators.results import best_rows
from featureforge.plans.dataset import clean_table, integrate, modelling_table, quality_reports
from featureforge.sources.files import coerce, read_optional
from featureforge.staging import new_folder


def test_quantiles_of_groups(spark):
    """Groups of all sizes; ties, nulls and NaN are in the data."""
    rng = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 5, n).astype(str)),
        "heavy": np.round(rng.lognormal(0, 3, n), 1), "ties": rng.integers(0, 4, n).astype(float),
    })
    pdf.loc[::7, "heavy"] = np.nan
    df = spark.createDataFrame(pdf).repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, ["heavy", "ties"], probs, by=["g"]).toPandas()
    for r in got.itertuples():
        want = pdf.loc[pdf.g == r.g, r.column].dropna()
        assert r.n == len(want)
        np.testing.assert_allclose([r.q00, r.q01, r.q25, r.q50, r.q90, r.q100], want.quantile(probs), rtol=1e-12)
    assert len(got) == 2 * pdf.g.nunique()


def test_quantiles_of_wide_ranges(spark):
    """Neighbouring doubles, infinities, signed zeros and both ends of the range of doubles and integers."""
    x = np.float64(1.5)
    near = [x]
    for _ in range(40):
        near.append(np.nextafter(near[-1], 2))
    values = [*near, -np.inf, np.inf, -1.7e308, 1.7e308, 5e-324, -5e-324, 0.0, -0.0, 1e-300, -1e300, 3.0, 3.0]
    df = spark.createDataFrame([(float(v), "a") for v in values] + [(2.0, "b"), (None, "c")], "n double, size string").repartition(3)
    n = len(values)
    probs = [k / (n - 1) for k in range(n)]
    got = {r["size"]: r for r in quantiles.exact_quantiles(df, ["n"], probs, ["size"], [f"p{k}" for k in range(n)]).collect()}
    assert set(got) == {"a", "b"} and got["b"].p0 == 2.0
    want = sorted(values)
    for k, p in enumerate(probs):
        if p * (n - 1) == k:
            assert got["a"][f"p{k}"] == want[k]
    keys = [-2**63, 2**63 - 1, 0, -1, 1, 7, 2**40, 2**40 + 1, 2**40 + 1]
    table = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key bigint")
    cuts = [(f"c{i}", F.lit(i)) for i in range(len(keys))] + [("past", F.lit(len(keys))), ("none", F.lit(None).cast("int"))]
    row = quantiles.rank_thresholds(table, "key", cuts).first()
    assert list(row) == [len(keys), *sorted(keys), None, None]
    assert quantiles.rank_thresholds(table.limit(0), "key", cuts).count() == 0
    assert quantiles.exact_quantiles(df.limit(0), ["n"], [0.5]).count() == 0


@pytest.mark.parametrize("filled", [False, True])
def test_quantiles_outside_folds(spark, filled):
    """Against the rows of the other folds; a hot fold, ties, mostly missing columns, a fold that holds no value."""
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({
        "fold": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 4, n).astype(str)),
        "a": np.round(rng.normal(0, 9, n), 1), "b": rng.integers(0, 3, n).astype(float), "c": rng.random(n), "d": rng.random(n),
    })
    pdf.loc[::5, "a"] = np.nan
    pdf.loc[pdf.fold == "1", "b"] = np.nan
    pdf.loc[rng.random(n) < 0.9, "c"] = np.nan
    pdf.loc[pdf.fold != "2", "d"] = np.nan
    pdf.loc[3, "fold"] = "__train__"
    df = spark.createDataFrame(pdf).repartition(5)
    folds = spark.createDataFrame([(f,) for f in [*sorted(set(pdf.fold) - {"__train__"}), "unused"]], "fold string")
    columns, probs, names = ["a", "b", "c", "d"], [0.0, 0.25, 0.5, 0.75, 1.0], ["p0", "p1", "p2", "p3", "p4"]
    fill = quantiles.training_quantiles(df, columns, [0.5], ["fill"], folds) if filled else None
    got = quantiles.training_quantiles(df, columns, probs, names, folds, fill).toPandas().set_index(["eval_fold", "column"])
    expected = 0
    for (fold,) in folds.collect():
        for c in columns:
            train = pdf.loc[pdf.fold != fold, c]
            present = train.dropna()
            if present.empty:
                continue
            expected += 1
            want = (train.fillna(present.median()) if filled else present).quantile(probs)
            np.testing.assert_allclose(got.loc[(fold, c), names].astype(float), want, rtol=1e-12)
    assert len(got) == expected


def test_profile_edges(spark):
    df = spark.createDataFrame(
        [(1, 5, None, 1.0, "a"), (2, 5, None, 2.0, "a"), (3, None, None, float("nan"), None)],
        "x int, c int, gone double, y double, g string",
    )
    missing = {r.column: r.missing_count for r in profile.missing_report(df).collect()}
    assert missing == {"x": 0, "c": 1, "gone": 3, "y": 1, "g": 1}
    constant = {r.column: (r.unique_values, r.is_constant) for r in profile.constant_report(df).collect()}
    assert constant["c"] == (2, False) and constant["gone"] == (1, True) and constant["x"] == (3, False)
    assert [r.column for r in profile.outlier_report(df).collect()] == ["x", "y"]
    stats = {r.column: r for r in profile.describe(df).collect()}
    assert stats["gone"]["count"] == 0 and stats["gone"].q50 is None and stats["y"].q50 == 1.5
    one = df.filter("x = 3").select("x", F.lit("k").alias("g"))
    assert profile.group_summary(one, ["g"], ["x"]).first().x_std is None
    few = profile.corr_grid(df, ["x"], {"m": ["y", "c"]}).collect()
    assert all(r.pearson_corr is None for r in few) and {r.n for r in few} == {2}


def test_wide_correlation_is_the_narrow_one(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(300, 6)) * [1, 1e6, 1e-6, 5, 1, 1] + [0, 1e7, 0, 3, 0, 0], columns=list("abcdef"))
    pdf.iloc[::3, 1], pdf.iloc[::5, 3], pdf["f"] = np.nan, np.nan, 7.0
    got = profile.corr_matrix(spark.createDataFrame(pdf)).toPandas().set_index(["column_a", "column_b"]).correlation
    want = pdf.corr()
    for a in pdf:
        for b in pdf:
            if "f" in (a, b):
                assert pd.isna(got[a, b])
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_histogram_edges(spark):
    same = spark.createDataFrame([(4.0,)] * 3, "v double")
    bins = profile.histogram(same, "v", 4).collect()
    assert (bins[0].lower, bins[-1].upper, sum(b["count"] for b in bins)) == (3.5, 4.5, 3)
    closed = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert [b["count"] for b in profile.histogram(closed, "v", 5).collect()] == [2, 2, 2, 2, 3]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (1, 2, "b"), (3, 2, "b")], "k int, v int, t string")
    report = duplicate_report(df, ["k"], ["v", "t"]).first()
    assert tuple(report) == (4, 3, 1, 2, 2)
    assert duplicate_rows(df, ["v", "t"]).count() == 4 and duplicate_rows(df, ["k", "v"]).count() == 2
    first = first_per_key(df.repartition(3), ["k"], [F.col("v").asc_nulls_last(), "t"])
    assert {(r.k, r.v) for r in first.collect()} == {(1, 2), (3, 2)}


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    right = spark.createDataFrame([("a", 10, "ok"), ("a", 20, "ok"), (None, 30, "ok"), ("b", 40, "bad")], "k string, v int, s string")
    assert attach_labels(left, right, ["k"], "s").count() == 4
    assert enrich_unique(left, right, ["k"], ["v"]).count() == 3
    assert {r.v for r in enrich(left, right, "k", null_safe=True).collect()} == {10, 20, 30, 40}
    plan = enrich_unique(left, right, ["k"], ["v"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # one row per key and task before the shuffle


def test_one_hot_round_trip(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "c string, n int")
    wide = one_hot(df, ["c"])
    assert wide.columns == ["n", "c_x", "c_y"]
    back = wide.select("n", from_one_hot(wide, "c_").alias("c")).orderBy("n").collect()
    assert [r.c for r in back] == ["x", "y", "x"]
    assert feature_set(wide, "n", group_prefix="c_") == [] and feature_set(wide, "n", group_prefix="c_", with_group=True) == ["c_x", "c_y"]


def test_folds_depend_on_ids_only(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = {r.k: r.fold for r in assign_kfold(df, "k").collect()}
    two = {r.k: r.fold for r in assign_kfold(df.repartition(7), "k").collect()}
    assert one == two and sorted(pd.Series(one).value_counts()) == [200] * 5
    assert split_holdout(df, "k").filter("is_test").count() == 250


@pytest.mark.parametrize("n, folds", [(4, 0), (7, 3), (9, 3), (12, 5), (13, 5)])
def test_small_kfold(spark, n, folds):
    got = assign_kfold(spark.range(n), "id").groupBy("fold").count().collect()
    assert len(got) == folds and (not got or max(r["count"] for r in got) - min(r["count"] for r in got) <= 1)


def test_small_splits(spark):
    assert split_holdout(spark.range(5), "id").count() == 0
    assert split_holdout(spark.range(6), "id").filter("is_test").count() == 2
    assert split_holdout(spark.range(0), "id").count() == 0
    assert assign_group_folds(spark.createDataFrame([("a",), ("a",)], "g string"), "g").count() == 0


def test_metric_edges(spark):
    rows = [("one", 2.0, 3.0), ("flat", 2.0, 2.0), ("flat", 2.0, 2.0), ("off", 2.0, 1.0), ("off", 2.0, 2.0), ("zero", 0.0, 1.0), ("zero", 0.0, 0.0)]
    got = {r.fold: r for r in regression_metrics(spark.createDataFrame(rows, "fold string, y double, yhat double"), ["fold"]).collect()}
    assert got["one"].r2 is None and got["flat"].r2 == 1.0 and got["off"].r2 == 0.0
    assert got["zero"].relative_mae is None and got["one"].relative_mae == 0.5


def test_best_rows(spark):
    df = spark.createDataFrame([("a", None, 3.0, 1), ("a", None, 2.0, 2), ("b", 0.5, 9.0, 3), ("b", 0.7, 1.0, 4)], "g string, r2 double, mae double, i int")
    assert {r.i for r in best_rows(df, ["g"], "r2", False, ["i"], fallback="mae").collect()} == {2, 4}
    assert {r.i for r in best_rows(df, ["g"], "r2", False, ["i"]).collect()} == {4}


def test_sources(spark):
    schema = {"a": "bigint", "b": "double"}
    assert read_optional(spark, new_folder(spark, "none"), schema).count() == 0
    raw = spark.createDataFrame([(" 7 ", "x"), ("1.0", " 2.5"), ("", "nan")], "a string, b string")
    assert [tuple(r) for r in coerce(raw, schema).collect()] == [(7, None), (1, 2.5), (None, None)]


def test_integration(spark):
    metrics = spark.createDataFrame(
        [(" gemm ", "SMALL", "10", "ALL_BRAM", "1.0", "O0", 5, "l1"), ("atax", "SMALL", "10", "LSS", "1.0", "O2", 7, "l2")],
        "benchmark string, dataset_size string, clock_period string, mem_policy string, dsp_coeff string, opt_level string, total_area int, log_file string",
    )
    static = spark.createDataFrame([("gemm", "f.c", 40)], "benchmark string, source_file string, source_lines int")
    key = "benchmark string, dataset_size string, clock_period int, mem_policy string, dsp_coeff double, opt_level string"
    gemm = ("gemm", "SMALL", 10, "ALL_BRAM", 1.0, "O0")
    synth = spark.createDataFrame([(*gemm, 9, "b.json"), (*gemm, 8, "a.json")], f"{key}, synth_total_cells int, synth_report_file string")
    labels = spark.createDataFrame(
        [(*gemm, "c10", 10.0, "ok", 1.5, 2.0), (*gemm, "c2", 2.0, "ok", 1.2, 3.0), (*gemm, "c3", 3.0, "missing", None, None)],
        f"{key}, config_name string, clock_constraint double, parse_status string, critical_path_delay double, synth_chip_area double",
    )
    merged = integrate(metrics, static, synth, labels)
    assert merged.count() == 3 and {r.synth_total_cells for r in merged.collect()} == {8, None}
    assert {r.source_lines for r in merged.collect()} == {40, None}
    assert integrate(metrics).count() == 2
    table = modelling_table(clean_table(merged), ["synth_chip_area", "critical_path_delay"])
    assert table.count() == 2 and "benchmark_gemm" in table.columns and "log_file" not in table.columns
    reports = quality_reports(merged)
    assert reports["duplicate_report"].first().duplicate_configurations == 1
    assert all(r.count() >= 0 for r in reports.values())
