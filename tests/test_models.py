"""Models against brute force on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featureforge.operators import kernel, linear, scaling, solvers, trees
from featureforge.operators.metrics import regression_metrics
from featureforge.operators.moments import make_design, prepare
from featureforge.plans.grid import Grid, Model, Target, run_grid
from featureforge.plans.summary import best_by_r2, best_by_relative_mae, combine, preferred_results

NAMES = ["a", "b", "c", "d"]


def table(n=240, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, 4)) * [1, 100, 0.01, 1] + [0, 500, 0, -2], columns=NAMES)
    pdf["y"] = 3 * pdf.a - 0.02 * pdf.b + rng.normal(size=n) * 0.1
    pdf["id"] = range(n)
    pdf["fold"] = (pdf.id % 4).astype(str)
    pdf.loc[pdf.id % 5 == 0, "b"] = np.nan
    return pdf


def prepared_fold(pdf, f, names, log=False, scaler="standard"):
    train, test = pdf[pdf.fold != f], pdf[pdf.fold == f]
    fill = train[names].median()
    x, xt = train[names].fillna(fill), test[names].fillna(fill)
    if log:
        shift = np.maximum(-x.min(), 0)
        x, xt = np.log1p(x + shift), np.log1p(np.maximum(xt + shift, 0))
    if scaler == "robust":
        s = x.quantile(0.75) - x.quantile(0.25)
    else:
        s = x.std(ddof=0)
    s = s.where(s > 0, 1.0)
    return ((x - x.mean()) / s).to_numpy(), ((xt - x.mean()) / s).to_numpy(), train.y.to_numpy(), test.y.to_numpy()


def solve(kind, x, y, **p):
    g, n = x - x.mean(0), len(y)
    t = y - y.mean()
    if kind == "ols":
        return np.linalg.lstsq(g, t, rcond=1e-9)[0]
    if kind == "ridge":
        return np.linalg.solve(g.T @ g + p["alpha"] * np.eye(g.shape[1]), g.T @ t)
    if kind == "elastic_net":
        return solvers.elastic_net(g.T @ g / n, g.T @ t / n, n, p["alpha"], p["l1_ratio"])
    return nipals(g, t, p["components"])


def nipals(x, y, m):
    s = x.std(axis=0, ddof=1)
    e, f = x / s, y.copy()
    w, p, q = [], [], []
    for _ in range(m):
        wk = e.T @ f
        wk /= np.linalg.norm(wk)
        t = e @ wk
        p.append(e.T @ t / (t @ t))
        q.append(f @ t / (t @ t))
        w.append(wk)
        e, f = e - np.outer(t, p[-1]), f - q[-1] * t
    w, p = np.array(w).T, np.array(p).T
    return w @ np.linalg.solve(p.T @ w, q) / s


@pytest.mark.parametrize("log", [False, True])
def test_linear_models(spark, log):
    pdf = table()
    cases = [("ols", {}), ("ridge", {"alpha": 10.0}), ("elastic_net", {"alpha": 0.1, "l1_ratio": 0.5}), ("pls", {"components": 2})]
    scalers = ["standard"] if log else ["standard", "robust"]
    configs = [linear.Config(f"{k}-{s}", (0, 1, 2, 3), k, p, s) for k, p in cases for s in scalers]
    fitted = linear.fit_grid(spark.createDataFrame(pdf).repartition(3), NAMES, "y", "fold", configs, log)
    by_rows = regression_metrics(fitted.out_of_fold(), ["config_id", "fold"]).toPandas()
    got = by_rows.set_index(["config_id", "fold"]).mae
    for kind, p in cases:
        for scaler in scalers:
            for f in "0123":
                x, xt, y, yt = prepared_fold(pdf, f, NAMES, log, scaler)
                w = solve(kind, x, y, **p)
                want = np.abs(yt - (y.mean() + (xt - x.mean(0)) @ w)).mean()
                assert got[f"{kind}-{scaler}", f] == pytest.approx(want, rel=1e-6), (kind, scaler, f)
    by_sums = fitted.fold_metrics().toPandas()
    key = ["config_id", "fold"]
    pd.testing.assert_frame_equal(
        by_rows.sort_values(key).reset_index(drop=True), by_sums.sort_values(key).reset_index(drop=True)[by_rows.columns],
    )


def test_errors_of_ratios_and_chunks(spark, monkeypatch):
    """Coefficients in several chunks, folds as one task's blocks, and a ratio scored in units of its numerator."""
    monkeypatch.setattr(linear, "CHUNK", 3)
    pdf = table()
    pdf["unit"] = np.linspace(0.5, 3, len(pdf))
    pdf["y_original"] = pdf.y * pdf.unit
    configs = [linear.Config(f"r{a}", (0, 1, 2), "ridge", {"alpha": float(a)}, s) for a in range(1, 8) for s in ("standard",)]
    fitted = linear.fit_grid(spark.createDataFrame(pdf).repartition(3), NAMES, "y", "fold", configs, extra=["unit", "y_original"])
    assert fitted.coefficients().count() > 4  # more than one chunk for each fold
    key = ["config_id", "fold"]
    oof = fitted.out_of_fold()
    for y, unit in (("y", None), ("y_original", "unit")):
        by_rows = regression_metrics(oof.withColumn("yhat", F.col("yhat") * F.col(unit)) if unit else oof, key, y).toPandas()
        got = fitted.fold_metrics(y, unit).toPandas()
        assert len(got) == 7 * pdf.fold.nunique()
        pd.testing.assert_frame_equal(by_rows.sort_values(key).reset_index(drop=True), got.sort_values(key).reset_index(drop=True)[by_rows.columns])


def test_trees_appear_once_for_equal_preparations(spark):
    pdf = table()
    pdf["id"] = range(len(pdf))
    models = [Model("b", "boosting", {"stages": 2}), Model("r", "ridge", {"alpha": 1.0})]
    grid = Grid([Target("y")], {"s": NAMES[:2]}, models, "id", scalers=("standard", "robust"), reductions=("none", "pca_1"), logs=(False,), evaluations=("kfold",))
    rows = [(r.model, r.scaler, r.reduction) for r in run_grid(spark.createDataFrame(pdf), grid).collect()]
    assert sorted(r for r in rows if r[0] == "b") == [("b", "none", "none"), ("b", "standard", "pca_1")]
    assert len(rows) == len(set(rows)) == 6


def test_more_features_than_rows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(9, 12)), columns=[f"f{i}" for i in range(12)])
    pdf["f11"] = pdf.f0
    pdf["y"], pdf["fold"] = rng.normal(size=9), ["0", "1", "2"] * 3
    names = [f"f{i}" for i in range(12)]
    oof, _ = linear.fit_ols(spark.createDataFrame(pdf), names, "y", "fold")
    got = {r.fold: r.mae for r in regression_metrics(oof, ["fold"]).collect()}
    for f in "012":
        x, xt, y, yt = prepared_fold(pdf, f, names)
        w = solve("ols", x, y)
        assert got[f] == pytest.approx(np.abs(yt - (y.mean() + (xt - x.mean(0)) @ w)).mean(), rel=1e-5)


def test_solvers():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5))
    x[:, 4] = x[:, 0]
    y = x @ [3, -2, 0, 0, 0] + rng.normal(size=60)
    g, t = (x - x.mean(0)) / x.std(0), y - y.mean()
    cov, r, n = g.T @ g / 60, g.T @ t / 60, 60
    for alpha in (0.001, 0.1, 1.0):
        w = solvers.elastic_net(cov, r, n, alpha, 0.5)
        slack = r - cov @ w - alpha * 0.5 * w
        assert np.all(np.abs(slack) <= alpha * 0.5 + 1e-8)
        assert np.allclose(slack[w != 0], alpha * 0.5 * np.sign(w[w != 0]), atol=1e-8)
    np.testing.assert_allclose(solvers.pls(cov, r, n, 2), nipals(g, t, 2), rtol=1e-9)
    full = g[:, :4]
    c4, r4 = full.T @ full / 60, full.T @ t / 60
    np.testing.assert_allclose(solvers.pls(c4, r4, n, 4), solvers.ols(c4, r4, n), rtol=1e-6)
    with pytest.raises(ValueError):
        solvers.pls(cov, r, n, 6)
    assert solvers.best_k(np.array([1.0, 2.0, 2.0, 2.0]), 2).tolist() == [2, 3]
    assert solvers.capped(10, 5, 4) == 3 and solvers.capped(3, 5, 1) == 1


def test_planted_signal(spark):
    rows = spark.range(5000).select(
        F.col("id"), F.rand(1).alias("x1"), F.rand(2).alias("x2"), F.pmod("id", F.lit(3)).cast("string").alias("fold"),
    ).withColumn("y", 3 * F.col("x1") - 2 * F.col("x2") + (F.pmod(F.xxhash64("id"), F.lit(100)) - 50) / 1e4)
    _, solutions = linear.fit_ols(rows, ["x1", "x2"], "y", "fold")
    for r in solutions.collect():
        np.testing.assert_allclose(r.coef, [3, -2], atol=2e-3)


def test_failed_configurations_are_rows(spark):
    df = spark.createDataFrame(table())
    grid = Grid(
        [Target("y")], {"all": NAMES, "one": NAMES[:1]},
        [Model("pls_3", "pls", {"components": 3}), Model("odd", "rff", {"kernel": "none"}), Model("ok", "ols")], "id",
        evaluations=("kfold",),
    )
    out = {r.config_id.split("|")[0] + r.model: r for r in run_grid(df, grid).collect()}
    assert out["onepls_3"].error and out["onepls_3"].mae is None
    assert out["allodd"].error.startswith("Unknown kernel") and out["allok"].folds == 5 and out["allok"].error is None


def test_one_failed_fold_fails_the_configuration(spark):
    """The small group alone has too few rows to train on; the other fold works."""
    pdf = table().head(40).copy()
    pdf["grp"] = np.where(pdf.index < 3, "small", "large")
    wide = Model("pls_wide", "pls", {"components": min(4, len(NAMES))})
    grid = Grid([Target("y")], {"all": NAMES}, [wide, Model("ok", "ridge", {"alpha": 1.0})], "id", "grp", evaluations=("groupkfold",), folds=2, min_rows=2)
    rows = run_grid(spark.createDataFrame(pdf), grid).collect()
    assert sorted(r.model for r in rows) == ["ok", "pls_wide"]
    bad, good = sorted(rows, key=lambda r: r.model, reverse=True)
    assert bad.error and bad.mae is None and good.error is None and good.mae is not None
    detail = run_grid(spark.createDataFrame(pdf), grid, detail=True).collect()
    assert [r.model for r in detail if r.error] == ["pls_wide"] and sum(r.model == "ok" for r in detail) == 2


def test_ratio_target_is_scored_in_its_own_units(spark):
    pdf = table()
    pdf["size"] = 1 + pdf.id % 7
    pdf["total"] = pdf["size"] * pdf.y
    grid = Grid([Target("total", "size", "per_size")], {"all": NAMES}, [Model("r", "ridge", {"alpha": 1.0})], "id", evaluations=("kfold",))
    got = run_grid(spark.createDataFrame(pdf), grid).first()
    assert got.normalized_target == "per_size" and got.rows == 240 and 0 < got.mae < pdf.total.abs().mean() / 2


def test_fold_statistics(spark):
    pdf = table()
    got = scaling.fold_moment_stats(spark.createDataFrame(pdf), NAMES).toPandas().set_index(["eval_fold", "column"])
    for f in "0123":
        for c in NAMES:
            v = pdf.loc[pdf.fold != f, c].dropna()
            r = got.loc[(f, c)]
            np.testing.assert_allclose([r.n, r["mean"], r["std"], r["min"]], [len(v), v.mean(), v.std(ddof=0), v.min()], rtol=1e-9)


def test_log_shift_per_fold(spark):
    """The only negative minimum lies in one fold, so that fold trains with another shift."""
    pdf = table()
    pdf.loc[pdf.id == 8, "a"] = -50.0
    prepared = prepare(spark.createDataFrame(pdf), NAMES, "y", "fold")
    design = make_design(prepared, NAMES, log=True)
    assert design.second[0][1] == "0" and design.values[0][1] == 50.0
    oof, _ = linear.fit_ridge(spark.createDataFrame(pdf), NAMES, "y", "fold", alpha=1.0, log=True)
    got = {r.fold: r.mae for r in regression_metrics(oof, ["fold"]).collect()}
    for f in "0123":
        x, xt, y, yt = prepared_fold(pdf, f, NAMES, True)
        w = solve("ridge", x, y, alpha=1.0)
        assert got[f] == pytest.approx(np.abs(yt - (y.mean() + (xt - x.mean(0)) @ w)).mean(), rel=1e-6)


@pytest.mark.parametrize("name, exact", [
    ("rbf", lambda d: np.exp(-d ** 2 / 2)),
    ("matern", lambda d: (1 + np.sqrt(3) * d) * np.exp(-np.sqrt(3) * d)),
    ("rq", lambda d: 1 / (1 + d ** 2 / 2)),
])
def test_kernel_approximation(name, exact):
    x = np.random.default_rng(6).normal(size=(40, 3))
    w, b = kernel.frequencies(name, 3, 8000, 1)
    phi = kernel.cosines(x, w, b)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert np.abs(phi @ phi.T - exact(d)).max() < 0.08


def test_kernel_regression_matches_its_dense_form(spark):
    pdf = table()
    oof = kernel.fit_rff(spark.createDataFrame(pdf), NAMES, "y", "fold", "rbf", size=64, seed=3)
    got = {r.fold: r.mae for r in regression_metrics(oof, ["fold"]).collect()}
    w, b = kernel.frequencies("rbf", 4, 64, 3)
    for f in "0123":
        x, xt, y, yt = prepared_fold(pdf, f, NAMES)
        p, pt = kernel.cosines(x, w, b), kernel.cosines(xt, w, b)
        beta = np.linalg.solve(p.T @ p + kernel.NOISE * np.eye(64), p.T @ (y - y.mean()))
        assert got[f] == pytest.approx(np.abs(yt - y.mean() - pt @ beta).mean(), rel=1e-4)


def test_trees_beat_the_mean(spark):
    pdf = table()
    df = spark.createDataFrame(pdf)
    for model, reduction in ((trees.forest(trees=10, max_depth=6), "none"), (trees.boosting(stages=10), "select_k_2")):
        oof, models = trees.fit_trees(df, NAMES, "y", "fold", model, reduction)
        r = regression_metrics(oof, ["fold"]).collect()
        assert len(r) == 4 and all(x.r2 > 0.5 for x in r)
        top = trees.importance_table(spark, models["0"], NAMES).first()
        assert top.feature == "a"


def test_selection_and_axes(spark):
    pdf = table()
    full = pdf.assign(b=pdf.b.fillna(pdf.b.median()))
    scores = linear.select_k_best(spark.createDataFrame(pdf).withColumn("one", F.lit(1)), [*NAMES, "one"], "y", 2).toPandas()
    r = full[NAMES].corrwith(full.y)
    want = (r ** 2 / (1 - r ** 2) * (len(pdf) - 2)).to_dict() | {"one": 0.0}
    for row in scores.itertuples():
        assert row.score == pytest.approx(want[row.feature], rel=1e-8)
    assert scores[scores.selected].feature.tolist() == ["a", "b"]
    axes, projected = linear.principal_components(spark.createDataFrame(full), NAMES, 3)
    z = (full[NAMES] - full[NAMES].mean()) / full[NAMES].std(ddof=0)
    want = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1][:3]
    np.testing.assert_allclose([r.explained_variance for r in axes.collect()], want, rtol=1e-9)
    spread = projected.agg(*[F.var_samp(f"pc{i}") for i in (1, 2, 3)]).first()
    np.testing.assert_allclose(list(spread), want, rtol=1e-9)


def test_result_summary(spark):
    base = spark.createDataFrame(
        [("kfold", "total_power", "ols", 18, 66, 2.0, 0.1), ("leave_one_benchmark_out", "total_power", "ols", 18, 66, 3.0, 0.0)],
        "evaluation string, target string, model string, rows int, features int, mae_mean double, r2_mean double",
    )
    ablation = spark.createDataFrame(
        [("groupkfold_by_benchmark", "total_power", m, "hls_only", 0.5, r, rel) for m, r, rel in (("b", 0.2, 0.3), ("a", 0.4, 0.3), ("c", None, None))],
        "evaluation string, target string, model string, feature_set string, mae double, r2 double, relative_mae double",
    )
    table_ = combine({"baseline": base, "ablation_direct_target": ablation})
    assert table_.count() == 5 and table_.filter("experiment = 'baseline' and mae is not null").count() == 2
    assert table_.filter("evaluation = 'groupkfold_by_benchmark'").count() == 4
    assert [r.model for r in best_by_relative_mae(table_).collect()] == ["a"]
    assert preferred_results(table_).first().model == "a"
    assert {r.evaluation for r in best_by_r2(table_).collect()} == {"kfold", "groupkfold_by_benchmark"}
