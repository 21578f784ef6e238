"""Folds, fold-wise preparation, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featureforge.catalog.registry import Tables, query, rounded
from featureforge.functions.columns import number
from featureforge.functions.text import count_lines, count_pattern
from featureforge.operators import linear, scaling, trees
from featureforge.operators.features import one_hot
from featureforge.operators.folds import assign_group_folds, assign_kfold, expand_folds, split_holdout
from featureforge.operators.joins import enrich
from featureforge.operators.kernel import fit_rff
from featureforge.operators.metrics import fold_summary, group_detail, mean_of_other_groups, regression_metrics
from featureforge.operators.scaling import TRAIN_ONLY
from featureforge.plans.grid import Grid, Model, Target, run_grid
from featureforge.plans.grid import BASELINES, KERNELS, LINEAR_GRID, RIDGES
from featureforge.staging import stage


def hash_sql(key: str) -> str:
    return f"('0x' || substr(md5('42|' || {key}::varchar), 1, 15))::bigint"


def kfold_sql(key: str, k: int = 5) -> str:
    return f"ntile({k}) over (order by {hash_sql(key)}) - 1"


# The same expressions in both engines.
E_COUNT = "length(text) - length(replace(text, 'e', ''))"
DOT_COUNT = "length(text) - length(replace(text, '.', ''))"
DOCS_SQL = (
    f"select doc_id, source, n_chars::double as y, ({E_COUNT})::double as x1, ({DOT_COUNT})::double as x2 from documents"
)


def _docs(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id", "source", "text", "n_chars").select(
        "doc_id", "source", F.col("n_chars").cast("double").alias("y"), F.expr(E_COUNT).cast("double").alias("x1"),
        F.expr(DOT_COUNT).cast("double").alias("x2"),
    )


def _text_features(t: Tables) -> DataFrame:
    """Counts from text and a sparse label: features with missing values and a negative one."""
    docs = t.spread("documents", "doc_id", "source", "text", "n_chars").select(
        "doc_id", "source", F.col("n_chars").cast("double").alias("y"),
        count_pattern("text", "[aeiou]").alias("vowels"), count_pattern("text", "[0-9]").alias("digits"),
        count_pattern("text", r"\.").alias("dots"), count_lines("text").alias("lines"),
    )
    mark = (F.col("quality") * (F.col("doc_id") % 17) - 3).alias("mark")
    return enrich(docs, t.labels, "doc_id").select("doc_id", "source", "y", "vowels", "digits", "dots", "lines", mark)


TEXT_FEATURES = ["vowels", "digits", "dots", "lines", "mark"]


# ---- folds ---------------------------------------------------------------

@query("v1_split_holdout", f"""
select l_orderkey, l_linenumber, r <= ceil(0.25 * n) as is_test from (
  select l_orderkey, l_linenumber, count(*) over () as n,
    row_number() over (order by {hash_sql("concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)")}) as r
  from lineitem)""")
def v1_split_holdout(t: Tables) -> DataFrame:
    """A quarter of the line items, exactly, by the digest of a row key."""
    keyed = t.lineitem.withColumn("row_key", F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return split_holdout(keyed, "row_key").select("l_orderkey", "l_linenumber", "is_test")


@query("v2_assign_kfold", f"select o_orderkey, ({kfold_sql('o_orderkey')})::int as fold from orders")
def v2_assign_kfold(t: Tables) -> DataFrame:
    return assign_kfold(t.orders, "o_orderkey").select("o_orderkey", "fold")


@query("v3_assign_group_folds", "select doc_id, source as fold from documents")
def v3_assign_group_folds(t: Tables) -> DataFrame:
    return assign_group_folds(t.documents, "source").select("doc_id", "fold")


@query("v4_expand_folds", f"""
with d as (select doc_id, {kfold_sql('doc_id')} as fold from documents)
select eval_fold::int as eval_fold, fold <> eval_fold as is_train, count(*) as rows, sum(doc_id)::bigint as ids
from d cross join (select unnest(range(0, 5)) as eval_fold) group by 1, 2""")
def v4_expand_folds(t: Tables) -> DataFrame:
    expanded = expand_folds(assign_kfold(t.documents, "doc_id"), 5)
    return expanded.groupBy("eval_fold", "is_train").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("ids")
    )


# ---- fold-wise preparation -----------------------------------------------

@query("f7_fold_impute", f"""
with d as (select doc_id, n_chars, case when quality is not null then n_chars end as v, {kfold_sql('doc_id')} as fold
    from documents left join labels using (doc_id)),
x as (select d.*, eval_fold, fold <> eval_fold as is_train from d cross join (select unnest(range(0, 5)) as eval_fold)),
m as (select eval_fold, median(v) as med from x where is_train group by 1)
select eval_fold::int as eval_fold, is_train, count(*) as rows, round(avg(coalesce(v, med)), 6) as mean,
  round(stddev_samp(coalesce(v, med)), 6) as std, min(coalesce(v, med))::double as low
from x join m using (eval_fold) group by 1, 2""")
def f7_fold_impute(t: Tables) -> DataFrame:
    """A sparse column filled with the median of the training rows of every fold."""
    v = F.when(F.col("quality").isNotNull(), F.col("n_chars")).alias("v")
    rows = assign_kfold(enrich(t.documents, t.labels, "doc_id").select("doc_id", v), "doc_id")
    filled = scaling.fold_impute(expand_folds(stage(rows), 5), ["v"])
    return rounded(filled.groupBy("eval_fold", "is_train").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low")
    ))


def _scaled_sql(center: str, scale: str, columns=("l_quantity", "l_tax", "one")) -> str:
    stats = ", ".join(f"{center.format(c=c)} as c_{c}, {scale.format(c=c)} as s_{c}" for c in columns)
    out = ", ".join(
        f"round(avg(({c} - c_{c}) / case when s_{c} = 0 then 1 else s_{c} end), 6) as {c}_mean, "
        f"round(max(({c} - c_{c}) / case when s_{c} = 0 then 1 else s_{c} end), 6) as {c}_max" for c in columns)
    return f"""
with d as (select l_quantity, l_tax, 1.0::double as one, (l_orderkey % 4)::int as fold from lineitem),
x as (select d.*, eval_fold, fold <> eval_fold as is_train from d cross join (select unnest(range(0, 4)) as eval_fold)),
m as (select eval_fold, {stats} from x where is_train group by 1)
select eval_fold::int as eval_fold, is_train, count(*) as rows, {out}
from x join m using (eval_fold) group by 1, 2"""


def _line_folds(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_quantity", "l_tax", F.lit(1.0).alias("one"), F.pmod("l_orderkey", F.lit(4)).cast("int").alias("fold")
    )
    return expand_folds(rows, 4)


def _scaled_profile(df: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in ("l_quantity", "l_tax", "one"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    # Sums of centred values end near zero; adding 0.0 turns a negative zero into zero.
    out = rounded(df.groupBy("eval_fold", "is_train").agg(*aggs))
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in out.columns if c.endswith("_mean")})


@query("f8_fold_standardize", _scaled_sql("avg({c})", "stddev_pop({c})").replace("6) as", "6) + 0.0 as"))
def f8_fold_standardize(t: Tables) -> DataFrame:
    """Training mean and population deviation per fold, also of a constant column."""
    return _scaled_profile(scaling.fold_standardize(_line_folds(t), ["l_quantity", "l_tax", "one"]))


@query("f9_fold_robust_scale", _scaled_sql(
    "median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)").replace("6) as", "6) + 0.0 as"))
def f9_fold_robust_scale(t: Tables) -> DataFrame:
    return _scaled_profile(scaling.fold_robust_scale(_line_folds(t), ["l_quantity", "l_tax", "one"]))


@query("f10_log1p_shift", """
select c_custkey, round(ln(1 + c_acctbal + greatest(-(select min(c_acctbal) from customer), 0)), 6) as balance from customer""")
def f10_log1p_shift(t: Tables) -> DataFrame:
    shifted = scaling.log1p_shift(t.customer.select("c_custkey", F.col("c_acctbal").alias("balance")), ["balance"])
    return rounded(shifted)


F_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("f11_select_k_best", "with f as (" + " union all ".join(
    f"select '{c}' as feature, pow(corr({c}, l_extendedprice), 2) as r2, count(*) as n from lineitem" for c in F_COLUMNS)
    + """), s as (select feature, r2 / (1 - r2) * (n - 2) as score from f union all select 'one', 0)
select feature, round(score, 6) as score, row_number() over (order by score desc) <= 2 as selected from s""")
def f11_select_k_best(t: Tables) -> DataFrame:
    """F scores against the price, with a constant column; the best two are selected."""
    rows = t.lineitem.withColumn("one", F.lit(1))
    return rounded(linear.select_k_best(rows, [*F_COLUMNS, "one"], "l_extendedprice", 2))


@query("f12_fold_pca", """
with s as (select corr(l_quantity, l_extendedprice) as r from lineitem)
select 0 as component, round(1 + abs(r), 6) as explained_variance, round((1 + abs(r)) / 2, 6) as explained_ratio from s
union all select 1, round(1 - abs(r), 6), round((1 - abs(r)) / 2, 6) from s""")
def f12_fold_pca(t: Tables) -> DataFrame:
    """Two standardised columns: the axes have variances 1 ± r."""
    table, _ = linear.principal_components(t.lineitem, ["l_quantity", "l_extendedprice"], 2)
    n = t.lineitem.agg(F.count(F.lit(1)).cast("double")).scalar()
    # The table states the sample variance of columns scaled with the population deviation.
    variance = F.col("explained_variance") * (n - 1) / n
    return rounded(table.select("component", variance.alias("explained_variance"), "explained_ratio"))


@query("f12_pca_embeddings")
def f12_pca_embeddings(t: Tables) -> DataFrame:
    """Five axes of all embedding dimensions, and the variance of the projected rows on each."""
    width = len(t.embeddings.select("embedding").first()[0])
    names = [f"e{i}" for i in range(width)]
    wide = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    table, projected = linear.principal_components(wide, names, 5, standardize=False)
    spread = projected.agg(*[F.var_samp(f"pc{i + 1}").alias(str(i)) for i in range(5)])
    cells = F.array(*[F.struct(F.lit(i).alias("component"), F.col(str(i)).alias("projected_variance")) for i in range(5)])
    return rounded(table.drop("loadings").join(spread.select(F.inline(cells)), "component"))


# ---- metrics -------------------------------------------------------------

METRIC_SQL = """count(*) as test_rows, avg(abs(y - yhat)) as mae, sqrt(avg((y - yhat) ** 2)) as rmse,
  case when count(*) < 2 then null when min(y) < max(y) then 1 - avg((y - yhat) ** 2) / var_pop(y)
       when avg((y - yhat) ** 2) = 0 then 1 else 0 end as r2,
  avg(abs(y - yhat)) / nullif(avg(abs(y)), 0) as relative_mae"""
OTHERS_SQL = """
with s as (select source, sum(n_chars) as s, count(*) as n from documents group by source),
o as (select d.source as fold, d.n_chars::double as y,
    ((select sum(s) from s) - s.s) / ((select sum(n) from s) - s.n) as yhat from documents d join s using (source)),
m as (select fold, """ + METRIC_SQL + """ from o group by fold)
"""


def rounded_sql(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


METRIC_NAMES = ("mae", "rmse", "r2", "relative_mae")


@query("v5_regression_metrics", OTHERS_SQL + f"select fold, test_rows, {rounded_sql(METRIC_NAMES)} from m")
def v5_regression_metrics(t: Tables) -> DataFrame:
    """Metrics per source of the predictor that knows the mean of all other sources."""
    oof = mean_of_other_groups(t.documents, "source", "n_chars")
    return rounded(regression_metrics(oof, ["fold"]))


SUMMARY_SQL = "count(*) as folds, sum(test_rows)::bigint as rows, " + ", ".join(
    f"round(avg({n}), 6) as {n}, round(stddev_samp({n}), 6) as {n}_std, count({n}) as {n}_folds" for n in METRIC_NAMES)


@query("v6_fold_summary", OTHERS_SQL + f"select 'mean' as config, {SUMMARY_SQL} from m")
def v6_fold_summary(t: Tables) -> DataFrame:
    oof = mean_of_other_groups(t.documents, "source", "n_chars").withColumn("config", F.lit("mean"))
    return rounded(fold_summary(regression_metrics(oof, ["config", "fold"]), ["config"]))


@query("v7_group_detail", OTHERS_SQL + f"select 'mean' as config, fold as heldout_group, test_rows, {rounded_sql(METRIC_NAMES)} from m")
def v7_group_detail(t: Tables) -> DataFrame:
    oof = mean_of_other_groups(t.documents, "source", "n_chars").withColumn("config", F.lit("mean"))
    return rounded(group_detail(oof, ["config"]))


# ---- models with two features: the normal equations written out ----------

def two_feature_sql(fold: str, weights: str, head: str = "") -> str:
    """Fit on the training rows of every fold (statistics ``t``), score on the held-out rows."""
    return f"""
with d as ({DOCS_SQL}),
f as (select d.*, {fold} as fold from d),
t as (select e.fold, count(*)::double as n, avg(y) as my, stddev_pop(y) as sy, avg(x1) as m1, avg(x2) as m2,
    stddev_pop(x1) as s1, stddev_pop(x2) as s2, corr(x1, x2) as c, corr(x1, y) * stddev_pop(y) as r1,
    corr(x2, y) * stddev_pop(y) as r2
  from (select distinct fold from f) e join f on f.fold <> e.fold group by e.fold),
w as ({weights}),
o as (select f.fold, f.y, w.my + w.w1 * (f.x1 - w.m1) / w.s1 + w.w2 * (f.x2 - w.m2) / w.s2 as yhat from f join w using (fold)),
m as (select fold, {METRIC_SQL} from o group by fold)
{head}"""


def ridge_weights(alpha: float) -> str:
    a = f"(n + {alpha})"
    return (f"select *, ({a} * n * r1 - n * c * n * r2) / ({a} * {a} - n * c * n * c) as w1, "
            f"({a} * n * r2 - n * c * n * r1) / ({a} * {a} - n * c * n * c) as w2 from t")


PLS_WEIGHTS = """select *, r1 * k as w1, r2 * k as w2 from (
    select *, (r1 * r1 + r2 * r2) / (r1 * r1 + r2 * r2 + 2 * r1 * r2 * c) as k from t)"""
LASSO_WEIGHTS = "select *, sign(r1) * greatest(abs(r1) - 1.0 * 0.8, 0) / (1 + 1.0 * 0.2) as w1, 0 as w2 from t"
BY_FOLD = f"select fold::varchar as fold, test_rows, {rounded_sql(METRIC_NAMES, 5)} from m"


def _kfold_metrics(t: Tables, fit, features=("x1", "x2"), **how) -> DataFrame:
    rows = assign_kfold(_docs(t), "doc_id")
    oof, _ = fit(rows, list(features), "y", "fold", **how)
    return rounded(regression_metrics(oof, ["fold"]), 5)


@query("m1_fit_ols", two_feature_sql(kfold_sql("doc_id"), ridge_weights(0.0), BY_FOLD))
def m1_fit_ols(t: Tables) -> DataFrame:
    return _kfold_metrics(t, linear.fit_ols)


@query("m2_fit_ridge", two_feature_sql(kfold_sql("doc_id"), ridge_weights(10.0), BY_FOLD))
def m2_fit_ridge(t: Tables) -> DataFrame:
    return _kfold_metrics(t, linear.fit_ridge, alpha=10.0)


@query("m3_fit_elastic_net", two_feature_sql(kfold_sql("doc_id"), LASSO_WEIGHTS, BY_FOLD))
def m3_fit_elastic_net(t: Tables) -> DataFrame:
    """One feature, where the solution is a soft threshold."""
    return _kfold_metrics(t, linear.fit_elastic_net, ["x1"], alpha=1.0, l1_ratio=0.8)


@query("m4_fit_pls", two_feature_sql(kfold_sql("doc_id"), PLS_WEIGHTS, BY_FOLD))
def m4_fit_pls(t: Tables) -> DataFrame:
    """One component of two features."""
    return _kfold_metrics(t, linear.fit_pls, components=1)


@query("m2_ridge_by_group", two_feature_sql("source", ridge_weights(1.0), BY_FOLD))
def m2_ridge_by_group(t: Tables) -> DataFrame:
    """Leave one source out."""
    rows = assign_group_folds(_docs(t), "source")
    oof, _ = linear.fit_ridge(rows, ["x1", "x2"], "y", "fold", alpha=1.0)
    return rounded(regression_metrics(oof, ["fold"]), 5)


# ---- models without a closed form ----------------------------------------

def _holdout(t: Tables) -> DataFrame:
    split = split_holdout(_text_features(t), "doc_id")
    return split.withColumn("fold", F.when(F.col("is_test"), "test").otherwise(TRAIN_ONLY))


@query("m3_elastic_net_grid")
def m3_elastic_net_grid(t: Tables) -> DataFrame:
    """Elastic nets over all text features: metrics and number of non-zero coefficients per fold."""
    rows = assign_kfold(_text_features(t), "doc_id")
    every = tuple(range(len(TEXT_FEATURES)))
    configs = [
        linear.Config(m.name, every, m.kind, dict(m.params), scaler) for m in LINEAR_GRID if m.kind == "elastic_net"
        for scaler in ("standard",)
    ]
    oof, solutions = linear.fit_predict(rows, TEXT_FEATURES, "y", "fold", configs)
    used = solutions.select("config_id", "fold", F.size(F.filter("coef", lambda w: w != 0)).alias("used"))
    return rounded(regression_metrics(oof, ["config_id", "fold"]).join(used, ["config_id", "fold"]))


@query("m4_pls_grid")
def m4_pls_grid(t: Tables) -> DataFrame:
    """Two, three and five components over all text features, by source."""
    rows = assign_group_folds(_text_features(t), "source")
    configs = [linear.Config(f"pls_{m}", tuple(range(len(TEXT_FEATURES))), "pls", {"components": m}) for m in (2, 3, 5)]
    oof, _ = linear.fit_predict(rows, TEXT_FEATURES, "y", "fold", configs)
    return rounded(fold_summary(regression_metrics(oof, ["config_id", "fold"]), ["config_id"]))


@query("m5_fit_forest")
def m5_fit_forest(t: Tables) -> DataFrame:
    """Forest of 200 trees, grown to depth 10, on the hold-out split."""
    oof, _ = trees.fit_trees(_holdout(t), TEXT_FEATURES, "y", "fold", trees.forest(max_depth=10))
    return rounded(regression_metrics(oof, ["fold"]))


@query("m6_fit_boosting")
def m6_fit_boosting(t: Tables) -> DataFrame:
    """Boosted trees of depth 2 on the hold-out split."""
    oof, _ = trees.fit_trees(_holdout(t), TEXT_FEATURES, "y", "fold", trees.boosting(max_depth=2))
    return rounded(regression_metrics(oof, ["fold"]))


@query("m7_fit_rff")
def m7_fit_rff(t: Tables) -> DataFrame:
    """Three kernels over all embedding dimensions but the last, which they predict."""
    wide = t.embeddings.select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    )
    rows = stage(assign_kfold(wide, "vec_id"))
    names = [f"e{i}" for i in range(63)]
    parts = None
    for kernel in ("rbf", "matern", "rq"):
        oof = fit_rff(rows, names, "e63", "fold", kernel).withColumn("kernel", F.lit(kernel))
        parts = oof if parts is None else parts.unionByName(oof)
    return rounded(regression_metrics(parts, ["kernel", "fold"]))


@query("m8_importance")
def m8_importance(t: Tables) -> DataFrame:
    """Importance of the text features in a forest on the hold-out split."""
    _, models = trees.fit_trees(_holdout(t), TEXT_FEATURES, "y", "fold", trees.forest(trees=50, max_depth=10))
    return rounded(trees.importance_table(t.spark, models["test"], TEXT_FEATURES))


def _grid_sql(evaluation: str, fold: str) -> str:
    return " union all ".join("select * from (" + two_feature_sql(fold, ridge_weights(float(m.params["alpha"])), f"""
select 'both|standard|none|{m.name}' as config_id, '{evaluation}' as evaluation, {SUMMARY_SQL.replace('6)', '5)')} from m""")
        + ")" for m in RIDGES)


ERRORS_SQL = " union all ".join("select * from (" + two_feature_sql(kfold_sql("doc_id"), ridge_weights(float(m.params["alpha"])), f"""
select '{m.name}' as config_id, fold::varchar as fold, test_rows, {rounded_sql(METRIC_NAMES, 5)} from m""") + ")" for m in RIDGES)


@query("m9_errors", ERRORS_SQL)
def m9_errors(t: Tables) -> DataFrame:
    """Errors of every ridge and fold: squared ones from the held-out moments, absolute ones from blocks of rows."""
    configs = [linear.Config(m.name, (0, 1), m.kind, dict(m.params)) for m in RIDGES]
    fitted = linear.fit_grid(assign_kfold(_docs(t), "doc_id"), ["x1", "x2"], "y", "fold", configs)
    return rounded(fitted.fold_metrics().select("config_id", "fold", "test_rows", *METRIC_NAMES), 5)


@query("m9_run_grid", _grid_sql("kfold", kfold_sql("doc_id")) + " union all " + _grid_sql("groupkfold", "source"))
def m9_run_grid(t: Tables) -> DataFrame:
    """Ridge grid of two features under k-fold and leave-one-group-out."""
    grid = Grid([Target("y")], {"both": ["x1", "x2"]}, RIDGES, "doc_id", "source", evaluations=("kfold", "groupkfold"))
    out = run_grid(_docs(t), grid)
    metrics = [c for n in METRIC_NAMES for c in (n, f"{n}_std", f"{n}_folds")]
    return rounded(out.select("config_id", "evaluation", "folds", F.col("test_rows").alias("rows"), *metrics), 5)


@query("m9_full_grid")
def m9_full_grid(t: Tables) -> DataFrame:
    """Linear models × scalers × reductions over raw and ratio features; failed configurations keep a row."""
    rows = _text_features(t).withColumn("ratio_vowels", number(F.col("vowels") / F.nullif("dots", F.lit(0))))
    sets = {"raw": TEXT_FEATURES, "ratios": [*TEXT_FEATURES, "ratio_vowels"], "two": TEXT_FEATURES[:2]}
    grid = Grid(
        [Target("y")], sets, LINEAR_GRID, "doc_id", "source", scalers=("standard", "robust"),
        reductions=("none", "select_k_3", "pca_3"),
    )
    return rounded(run_grid(rows, grid))


@query("m9_log_and_kernel_grid")
def m9_log_and_kernel_grid(t: Tables) -> DataFrame:
    """Logged features with ridge and kernel models; the target as a ratio to the vowels, scored in its own units."""
    rows = _text_features(t)
    grid = Grid(
        [Target("y", "vowels", "chars_per_vowel")], {"text": TEXT_FEATURES}, [*RIDGES, KERNELS[1]], "doc_id",
        logs=(False, True), evaluations=("kfold",),
    )
    return rounded(run_grid(rows, grid))


@query("m9_baselines")
def m9_baselines(t: Tables) -> DataFrame:
    """Least squares, forest and boosting on the hold-out split, with the source as 0/1 features."""
    rows = one_hot(_text_features(t).withColumn("source_name", F.col("source")), ["source_name"])
    names = TEXT_FEATURES + [c for c in rows.columns if c.startswith("source_name_")]
    small = [BASELINES[0], Model("random_forest", "forest", {"trees": 50, "max_depth": 10}),
             Model("gradient_boosting", "boosting", {"stages": 20})]
    grid = Grid([Target("y")], {"all_direct_features": names}, small, "doc_id", evaluations=("random_split",), min_rows=4)
    return rounded(run_grid(rows, grid))
