"""Quality reports, distributions and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featureforge.catalog.registry import Tables, query, rounded
from featureforge.functions.text import fmt_mean_std
from featureforge.operators import profile
from featureforge.operators.joins import enrich

LABELLED = "(select * from documents left join labels using (doc_id))"


def _labelled(t: Tables) -> DataFrame:
    return enrich(t.documents, t.labels, "doc_id")


def _each(columns, template: str) -> str:
    return " union all ".join(template.format(c=c) for c in columns)


def describe_sql(columns, source: str, digits: int = 6, extra: str = "") -> str:
    return _each(columns, (
        "select '{c}' as column, count({c}) as count, round(avg({c}), %d) as mean, round(stddev_samp({c}), %d) as std, "
        "min({c})::double as min, round(quantile_cont({c}, 0.25), %d) as q25, round(quantile_cont({c}, 0.5), %d) as q50, "
        "round(quantile_cont({c}, 0.75), %d) as q75, max({c})::double as max from %s"
    ) % (digits, digits, digits, digits, digits, source))


@query("a1_missing_report", _each(
    ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"],
    "select '{c}' as column, count(*) - count({c}) as missing_count, "
    "round((count(*) - count({c})) * 100.0 / count(*), 6) as missing_percent from " + LABELLED))
def a1_missing_report(t: Tables) -> DataFrame:
    return rounded(profile.missing_report(_labelled(t)))


LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate", "one", "gone",
]


@query("a2_constant_report", "with s as (select *, 1 as one, null::int as gone from lineitem) " + _each(
    LINE_COLUMNS, "select '{c}' as column, count(distinct {c}) + max(({c} is null)::int) as unique_values, "
                  "count(distinct {c}) + max(({c} is null)::int) <= 1 as is_constant from s"))
def a2_constant_report(t: Tables) -> DataFrame:
    """Distinct values of every column, with a constant and an empty column added."""
    return profile.constant_report(
        t.lineitem.withColumns({"one": F.lit(1), "gone": F.lit(None).cast("int")})
    )


@query("a2_constant_floats", """
with s as (select case when l_linenumber % 2 = 0 then 0.0 else l_tax * 0 end as zero,
   case when l_linenumber % 2 = 0 then l_tax + 1 end as gaps from lineitem)
select 'zero' as column, count(distinct zero) as unique_values, true as is_constant from s
union all select 'nothing', 1, true
union all select 'gaps', count(distinct gaps) + 1, false from s""")
def a2_constant_floats(t: Tables) -> DataFrame:
    """Signed zeros are one value, and so are NaN and null."""
    even = F.col("l_linenumber") % 2 == 0
    return profile.constant_report(t.lineitem.select(
        F.when(even, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("zero"),
        F.when(even, F.lit(float("nan"))).alias("nothing"),
        F.when(even, F.col("l_tax") + 1).when(F.col("l_linenumber") == 1, F.lit(float("nan"))).alias("gaps"),
    ))


@query("a3_outlier_report", """
with v as (select 'value' as "column", value::double as v from events union all select 'user_id', user_id from events
  union all select 'n_chars', n_chars from documents),
q as (select "column", quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3, count(*) as n from v group by "column"),
b as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_bound, q3 + 1.5 * (q3 - q1) as upper_bound from q)
select "column", round(q1, 6) as q1, round(q3, 6) as q3, round(iqr, 6) as iqr, round(lower_bound, 6) as lower_bound,
  round(upper_bound, 6) as upper_bound, count_if(v < lower_bound or v > upper_bound)::bigint as outlier_count,
  round(count_if(v < lower_bound or v > upper_bound) * 100.0 / max(n), 6) as outlier_percent
from b join v using ("column") group by all""")
def a3_outlier_report(t: Tables) -> DataFrame:
    events = profile.outlier_report(t.events, ["value", "user_id"])
    return rounded(events.unionByName(profile.outlier_report(t.documents, ["n_chars"])))


@query("a4_describe", describe_sql(["l_quantity", "l_discount", "l_tax", "l_linenumber"], "lineitem")
       + " union all " + describe_sql(["quality"], LABELLED))
def a4_describe(t: Tables) -> DataFrame:
    lines = profile.describe(t.lineitem, ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return rounded(lines.unionByName(profile.describe(_labelled(t), ["quality"])))


@query("a5_target_summary", """
select 'o_totalprice' as target, 'Order price' as label, count(o_totalprice) as count, round(avg(o_totalprice), 4) as mean,
  round(median(o_totalprice), 4) as median, round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as min,
  round(quantile_cont(o_totalprice, 0.25), 4) as q25, round(quantile_cont(o_totalprice, 0.75), 4) as q75,
  max(o_totalprice) as max from orders""")
def a5_target_summary(t: Tables) -> DataFrame:
    return rounded(profile.target_summary(t.orders, {"o_totalprice": "Order price", "not_there": "Absent"}), 4)


def _group_sql(group: str) -> str:
    stats = ", ".join(
        f"round(avg({m}), 6) as {m}_mean, round(stddev_samp({m}), 6) as {m}_std, min({m}) as {m}_min, max({m}) as {m}_max"
        for m in ("l_quantity", "l_tax"))
    return f"select '{group}' as group_column, {group}::varchar as group_value, {stats} from s where {group} is not null group by {group}"


@query("a6_group_summary", "with s as (select *, nullif(l_linenumber, 7) as number from lineitem) " + " union all ".join(
    _group_sql(g) for g in ("l_returnflag", "l_linestatus", "number")))
def a6_group_summary(t: Tables) -> DataFrame:
    """Three grouping columns in one pass; null keys of one column do not count there."""
    rows = t.lineitem.withColumn("number", F.nullif("l_linenumber", F.lit(7)))
    return rounded(profile.group_summary(rows, ["l_returnflag", "l_linestatus", "number"], ["l_quantity", "l_tax"]))


@query("a7_group_mean", """
select l_returnflag, round(avg(l_quantity), 6) as mean from lineitem group by 1 order by 2""")
def a7_group_mean(t: Tables) -> DataFrame:
    return rounded(profile.group_mean(t.lineitem, "l_returnflag", "l_quantity"))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "one"]


def _corr(a: str, b: str, source: str = "s") -> str:
    if "one" in (a, b):
        return f"select '{a}' as column_a, '{b}' as column_b, null::double as correlation"
    return f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as correlation from {source}"


@query("a8_corr_matrix", "with s as (select *, 1 as one from lineitem) " + " union all ".join(
    _corr(a, b) for a in CORR for b in CORR))
def a8_corr_matrix(t: Tables) -> DataFrame:
    """All pairs, also with a constant column (null)."""
    return rounded(profile.corr_matrix(t.lineitem.withColumn("one", F.lit(1)), CORR))


WIDE = {
    "wa": "l_quantity", "wb": "l_extendedprice * 1e6", "wc": "case when l_linenumber = 1 then l_discount end",
    "wd": "case when l_linenumber <> 1 then l_tax end", "we": "1e6 + l_discount", "wf": "cast(l_linenumber as double)",
}


@query("a8_corr_wide", "with s as (select " + ", ".join(f"{e} as {c}" for c, e in WIDE.items()) + " from lineitem) " + " union all ".join(
    _corr(a, b) for a in WIDE for b in WIDE))
def a8_corr_wide(t: Tables) -> DataFrame:
    """Many pairs, with unequal scales and two columns that never meet (null)."""
    return rounded(profile.corr_matrix(t.lineitem.selectExpr(*[f"{e} as {c}" for c, e in WIDE.items()]), list(WIDE)))


@query("a9_corr_with", " union all ".join(
    f"select '{c}' as feature, round(corr({c}, l_extendedprice), 6) as correlation from lineitem"
    for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")))
def a9_corr_with(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("one", F.lit(1))
    return rounded(profile.corr_with(rows, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "one"]))


def _grid_sql(a: str, b: str, group: str) -> str:
    pair = f"count(case when {a} is not null and {b} is not null then 1 end)"
    r = "null::double" if b in ("few", "same") else f"round(corr({a}, {b}), 6)"
    return (f"select '{a}' as physical_metric, '{b}' as compared_metric, '{group}' as metric_group, {r} as pearson_corr, "
            f"abs({r}) as abs_pearson_corr, {pair} as n from s")


@query("a10_corr_grid", """
with s as (select l_quantity, l_discount, o_totalprice, o_custkey::double as o_custkey, 5 as same,
   case when l_orderkey = (select min(l_orderkey) from lineitem) and l_linenumber = 99 then l_tax end as few
   from lineitem left join orders on l_orderkey = o_orderkey) """ + " union all ".join(
    _grid_sql(a, b, g) for a in ("l_quantity", "l_discount")
    for b, g in (("o_totalprice", "order"), ("o_custkey", "order"), ("same", "flat"), ("few", "flat"))))
def a10_corr_grid(t: Tables) -> DataFrame:
    """Line metrics against order metrics, a constant and a column with too few values."""
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_custkey")
    few = F.when(F.col("l_linenumber") == 99, F.col("l_tax"))
    rows = enrich(t.lineitem, orders, "l_orderkey").withColumns({"same": F.lit(5), "few": few})
    return rounded(profile.corr_grid(
        rows, ["l_quantity", "l_discount"], {"order": ["o_totalprice", "o_custkey"], "flat": ["same", "few"]}
    ))


@query("a11_value_counts", """
select 'count' as mode, nullif(event_type, 'view') as event_type, count(*) as count from events group by 2
union all select 'dropna', event_type, count(*) from events where event_type <> 'view' group by 2""")
def a11_value_counts(t: Tables) -> DataFrame:
    rows = t.events.select(F.nullif("event_type", F.lit("view")).alias("event_type"))
    kept = profile.value_counts(rows, "event_type", dropna=False).select(F.lit("count").alias("mode"), "*")
    return kept.unionByName(profile.value_counts(rows, "event_type", by="value").select(F.lit("dropna").alias("mode"), "*"))


@query("a12_counter_totals", _each(["quality", "toxic"], (
    "select '{c}' as column, sum(coalesce({c}, 0))::double as total, max(coalesce({c}, 0))::double as maximum, "
    "count(*) as rows, count_if(lang = 'en')::bigint as ok_rows from " + LABELLED)))
def a12_counter_totals(t: Tables) -> DataFrame:
    return profile.counter_totals(_labelled(t), ["quality", "toxic", "not_there"], "lang", "en")


def _histogram_sql(bins: int, label: str) -> str:
    return f"""
select '{label}' as rule, bin, round(lo + (bin - 1) * (hi - lo) / {bins}, 4) as lower, round(lo + bin * (hi - lo) / {bins}, 4) as upper,
  count(v) as count
from (select unnest(range(1, {bins + 1})) as bin) cross join (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)
left join (select o_totalprice as v, least(floor((o_totalprice - l) / ((h - l) / {bins}))::bigint + 1, {bins}) as b
  from orders cross join (select min(o_totalprice) as l, max(o_totalprice) as h from orders)) on b = bin
group by bin, lo, hi"""


@query("a13_histogram", _histogram_sql(30, "30") + " union all " + _histogram_sql(10, "half"))
def a13_histogram(t: Tables) -> DataFrame:
    fixed = profile.histogram(t.orders, "o_totalprice", 30).select(F.lit("30").alias("rule"), "*")
    half = profile.histogram(t.orders, "o_totalprice", "half").select(F.lit("half").alias("rule"), "*")
    return rounded(fixed.unionByName(half), 4)


@query("a14_box_stats", """
with q as (select event_type, count(*) as n, quantile_cont(value, 0.25) as q1, median(value) as median,
    quantile_cont(value, 0.75) as q3 from events group by 1),
b as (select *, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
select event_type, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  coalesce(min(case when value >= lo and value <= q1 then value end), max(q1)) as whisker_low,
  coalesce(max(case when value <= hi and value >= q3 then value end), max(q3)) as whisker_high,
  count_if(value < lo or value > hi)::bigint as fliers
from b join events using (event_type) group by event_type, n, q1, median, q3""")
def a14_box_stats(t: Tables) -> DataFrame:
    return rounded(profile.box_stats(t.events, "value", "event_type"))


@query("a15_xy_pairs", f"select n_chars::double as x, quality::double as y from {LABELLED} where quality is not null")
def a15_xy_pairs(t: Tables) -> DataFrame:
    """All complete pairs of two columns."""
    return profile.xy_sample(_labelled(t), "n_chars", "quality")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("a16_pivot", "select o_orderstatus, " + ", ".join(
    f"round(avg(o_totalprice) filter (o_orderpriority = '{p}'), 4) as \"{p}\"" for p in PRIORITIES)
    + ", " + ", ".join(
    f"min_by(o_totalprice, o_orderkey) filter (o_orderpriority = '{p}') as \"first {p}\"" for p in PRIORITIES)
    + " from orders group by 1")
def a16_pivot(t: Tables) -> DataFrame:
    """Mean and first price, status by priority."""
    mean = rounded(profile.pivot(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice", PRIORITIES), 4)
    first = profile.pivot(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice", PRIORITIES, "first", "o_orderkey")
    return mean.join(first.withColumnsRenamed({p: f"first {p}" for p in PRIORITIES}), "o_orderstatus")


@query("a17_mean_std_cells", """
select event_type, printf('%.4f', avg(value)) || ' ± ' || printf('%.4f', stddev_samp(value)) as cell,
  printf('%.2f', avg(value)) || ' ± nan' as without_std from events group by 1""")
def a17_mean_std_cells(t: Tables) -> DataFrame:
    stats = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return stats.select(
        "event_type", fmt_mean_std("m", "s").alias("cell"),
        fmt_mean_std("m", F.lit(None).cast("double"), 2).alias("without_std"),
    )


@query("a18_quality_summary", f"""
with s as {LABELLED}
select 'missing' as section, 'total' as key, (2 * count(*) - count(quality) - count(toxic))::double as value from s
union all select 'duplicates', 'rows', count(*) from s
union all select 'duplicates', 'columns', 7
union all select 'duplicates', 'full_duplicate_rows', count(*) - (select count(*) from (select distinct * from s)) from s
union all select 'duplicates', 'duplicate_configurations', count(*) - (select count(*) from (select distinct lang, source from s)) from s
union all select 'duplicates', 'duplicate_metric_vectors', count(*) - (select count(*) from (select distinct n_chars, quality from s)) from s
union all select 'counts', lang, count(*) from s group by lang
""" + "".join(f"""
union all select 'targets', '{c}.' || key, round(value, 4) from (
  select count({c})::double as count, avg({c}) as mean, stddev_samp({c}) as std, min({c})::double as min,
   quantile_cont({c}::double, 0.25) as q25, quantile_cont({c}::double, 0.5) as q50, quantile_cont({c}::double, 0.75) as q75,
   max({c})::double as max from s)
  unpivot (value for key in (count, mean, std, min, q25, q50, q75, max))""" for c in ("n_chars", "quality")))
def a18_quality_summary(t: Tables) -> DataFrame:
    return rounded(profile.quality_summary(
        _labelled(t), ["lang", "source"], ["n_chars", "quality"], ["n_chars", "quality"], "lang"
    ), 4)
