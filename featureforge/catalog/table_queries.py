"""Projection, cleaning, joins, duplicates, ranking, unions, and derived features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from featureforge.catalog.registry import Tables, query, rounded
from featureforge.functions.columns import safe_div
from featureforge.functions.fixed_values import DESCRIPTOR_COLUMNS, DESCRIPTORS, FEATURE_SETS
from featureforge.operators.clean import (
    drop_existing, drop_null, fill, map_table, normalize_keys, numeric_columns, select_existing,
)
from featureforge.operators.dedupe import dedupe, duplicate_report, duplicate_rows, first_per_key
from featureforge.operators.features import (
    add_descriptors, add_ratios, feature_set, from_one_hot, named_feature_set, normalize_target, one_hot, reconstruct,
)
from featureforge.operators.joins import attach_labels, enrich, enrich_unique, join_via, lookup
from featureforge.operators.results import best_preferred, best_rows, standardize, top_n, union_all


def _labelled(t: Tables) -> DataFrame:
    return enrich(t.documents, t.labels, "doc_id")


# ---- projection, filter, cleaning ----------------------------------------

KEYS = """concat('  ', o_orderpriority, ' ') as priority,
  case when o_orderkey % 7 = 0 then 'x' else concat(o_custkey, '') end as cust,
  case when o_orderkey % 5 = 0 then '1.5e' else concat(' ', o_orderkey % 9, '.5') end as coeff"""


@query("p1_normalize_keys", f"""
with k as (select o_orderkey, {KEYS} from orders)
select o_orderkey, trim(priority) as priority, try_cast(cust as bigint) as cust, try_cast(coeff as double) as coeff from k""")
def p1_normalize_keys(t: Tables) -> DataFrame:
    raw = t.orders.selectExpr("o_orderkey", *[k.strip() for k in KEYS.split(",\n")])
    return normalize_keys(raw, text=["priority"], ints=["cust"], floats=["coeff"])


@query("p1_exact_keys", """
select o_orderkey, 9007199254740993 + o_orderkey as big, 9007199254740993 + o_orderkey as kept,
   case when o_orderkey % 3 = 0 then o_orderkey end as part from orders""")
def p1_exact_keys(t: Tables) -> DataFrame:
    """Keys beyond the whole numbers of a double; values that are not whole become null."""
    big = F.lit(9007199254740993) + F.col("o_orderkey")
    tail = F.when(F.col("o_orderkey") % 3 == 0, F.lit(".0 ")).when(F.col("o_orderkey") % 3 == 1, F.lit(".7")).otherwise(F.lit("x"))
    raw = t.orders.select(
        "o_orderkey", big.cast("string").alias("big"), big.alias("kept"), F.concat(F.col("o_orderkey").cast("string"), tail).alias("part"))
    return normalize_keys(raw, ints=["big", "kept", "part"])


@query("p2_select_existing", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def p2_select_existing(t: Tables) -> DataFrame:
    return select_existing(t.lineitem, ["l_orderkey", "not_there", "l_linenumber", "l_quantity"])


@query("p3_drop_existing", "select l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem")
def p3_drop_existing(t: Tables) -> DataFrame:
    return drop_existing(t.lineitem, [
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "not_there",
    ])


@query("p4_filter", """
select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice is not null""")
def p4_filter(t: Tables) -> DataFrame:
    kept = t.orders.filter((F.col("o_orderstatus") == "F") & F.col("o_totalprice").isNotNull())
    return kept.select("o_orderkey", "o_totalprice")


@query("p5_drop_null", """
with j as (select doc_id, nullif(quality, 0) as a, nullif(toxic, 0) as b from documents left join labels using (doc_id))
select 'any' as how, count(*) as rows, sum(doc_id)::bigint as ids from j where a is not null and b is not null
union all select 'all', count(*), sum(doc_id)::bigint from j where a is not null or b is not null""")
def p5_drop_null(t: Tables) -> DataFrame:
    joined = _labelled(t).select(
        "doc_id", F.nullif("quality", F.lit(0)).alias("a"), F.nullif("toxic", F.lit(0)).alias("b")
    )
    parts = [
        drop_null(joined, ["a", "b"], how).agg(F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("ids"))
        .select(F.lit(how).alias("how"), "rows", "ids") for how in ("any", "all")
    ]
    return reduce(DataFrame.unionByName, parts)


NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("p6_numeric_columns", " union all ".join(
    f"select '{c}' as column_name, round(avg({c}), 4) as mean from lineitem" for c in NUMERIC))
def p6_numeric_columns(t: Tables) -> DataFrame:
    """Mean of every column that the schema says is numeric."""
    names = numeric_columns(t.lineitem)
    wide = t.lineitem.agg(*[F.avg(c).alias(c) for c in names])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mean")) for c in names])
    return rounded(wide.select(F.inline(cells)), 4)


@query("p7_map_values", """
select case o_orderstatus when 'F' then 'filled' when 'O' then 'open' else o_orderstatus end as status,
       case o_orderpriority when '1-URGENT' then 'urgent' else o_orderpriority end as priority, count(*) as orders
from orders group by 1, 2""")
def p7_map_values(t: Tables) -> DataFrame:
    labels = {"o_orderstatus": {"F": "filled", "O": "open"}, "o_orderpriority": {"1-URGENT": "urgent"}}
    mapped = map_table(t.orders, labels)
    return mapped.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("orders")
    )


@query("p8_fill", """
select lang, sum(coalesce(quality, 0))::bigint as quality, max(coalesce(toxic, 0)) as toxic, count(*) as rows
from documents left join labels using (doc_id) group by lang""")
def p8_fill(t: Tables) -> DataFrame:
    filled = fill(_labelled(t), 0, ["quality", "toxic"])
    return filled.groupBy("lang").agg(
        F.sum("quality").alias("quality"), F.max("toxic").alias("toxic"), F.count(F.lit(1)).alias("rows")
    )


# ---- joins ---------------------------------------------------------------

@query("j1_enrich", """
select p_brand, p_type, count(*) as lines, round(sum(l_extendedprice), 2) as price
from lineitem left join part on l_partkey = p_partkey group by all""")
def j1_enrich(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_extendedprice")
    joined = enrich(lines, t.part.select("p_partkey", "p_brand", "p_type"), "p_partkey")
    return rounded(joined.groupBy("p_brand", "p_type").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("price")
    ), 2)


@query("j2_enrich_unique", """
with f as (select * from (
  select l_orderkey, l_linenumber, l_partkey, l_quantity,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as rn from lineitem)
  where rn = 1)
select o_orderkey, l_linenumber, l_partkey, l_quantity from orders left join f on o_orderkey = l_orderkey""")
def j2_enrich_unique(t: Tables) -> DataFrame:
    """Every order with its first line; orders without lines stay."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    joined = enrich_unique(
        t.orders.select("o_orderkey"), lines, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    )
    return joined.drop("l_suppkey")


@query("j3_attach_labels", """
select o_orderpriority, count(*) as rows, count(l_linenumber) as matched, sum(l_linenumber)::bigint as numbers
from orders left join (select * from lineitem where l_returnflag = 'R') on o_orderkey = l_orderkey group by 1""")
def j3_attach_labels(t: Tables) -> DataFrame:
    """Lines of one status; an order with several keeps them all."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    joined = attach_labels(t.orders, lines, ["o_orderkey"], "l_returnflag", "R")
    return joined.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.count("l_linenumber").alias("matched"),
        F.sum("l_linenumber").alias("numbers"),
    )


@query("j4_join_via", """
select c_mktsegment, count(*) as lines, round(sum(l_quantity), 2) as quantity
from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey group by 1""")
def j4_join_via(t: Tables) -> DataFrame:
    """Lines reach customers through orders."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    bridge = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    joined = join_via(lines, bridge, t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    return rounded(joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")
    ), 2)


@query("j5_lookup", """
select c_custkey, coalesce(n.n_regionkey, 0) as n_regionkey, coalesce(n.weight, 0) as weight
from customer left join (select n_nationkey, n_regionkey, length(n_name)::int as weight from nation where n_nationkey % 3 <> 0) n
  on c_nationkey = n_nationkey""")
def j5_lookup(t: Tables) -> DataFrame:
    """Descriptors of listed nations; 0 for the others."""
    dim = t.nation.filter("n_nationkey % 3 <> 0").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_regionkey", F.length("n_name").alias("weight")
    )
    return lookup(t.customer, dim, "c_nationkey", ["n_regionkey", "weight"]).select("c_custkey", "n_regionkey", "weight")


# Groups of the descriptor query: listed ones in order, then one that is not listed and a missing one.
GROUPS = [*DESCRIPTORS, "unlisted"]
_DESCRIBED = " union all ".join(
    f"select '{g}' as benchmark, {', '.join(f'{v} as {c}' for c, v in zip(DESCRIPTOR_COLUMNS, values))}" for g, values in DESCRIPTORS.items())


@query("j5_descriptors", f"""
with d as ({_DESCRIBED}),
p as (select p_partkey, case p_partkey % {len(GROUPS) + 1} {' '.join(f"when {i} then '{g}'" for i, g in enumerate(GROUPS))} end as benchmark from part)
select p_partkey, p.benchmark, {', '.join(f'coalesce({c}, 0) as {c}' for c in DESCRIPTOR_COLUMNS)} from p left join d on p.benchmark = d.benchmark""")
def j5_descriptors(t: Tables) -> DataFrame:
    """Descriptors of the groups of parts; 0 for a group that is not listed, and for none."""
    group = F.get(F.array(*[F.lit(g) for g in GROUPS]), (F.col("p_partkey") % (len(GROUPS) + 1)).cast("int"))
    return add_descriptors(t.part.select("p_partkey", group.alias("benchmark"))).select("p_partkey", "benchmark", *DESCRIPTOR_COLUMNS)


@query("j6_null_safe_join", """
with d as (select doc_id, nullif(source, 'src3') as k from documents),
g as (select k, count(*) as n from d group by k)
select d.doc_id, d.k, g.n from d left join g on d.k is not distinct from g.k""")
def j6_null_safe_join(t: Tables) -> DataFrame:
    """Null keys match each other."""
    docs = t.documents.select("doc_id", F.nullif("source", F.lit("src3")).alias("k"))
    return enrich(docs, docs.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", null_safe=True)


# ---- duplicates ----------------------------------------------------------

@query("d1_dedupe", """
select event_type, count(*) as pairs, sum(user_id)::bigint as users
from (select distinct event_type, nullif(user_id, 5) as user_id from events) group by event_type""")
def d1_dedupe(t: Tables) -> DataFrame:
    pairs = dedupe(t.events.select("event_type", F.nullif("user_id", F.lit(5)).alias("user_id")))
    return pairs.groupBy("event_type").agg(F.count(F.lit(1)).alias("pairs"), F.sum("user_id").alias("users"))


@query("d2_first_per_key", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) as rn
  from lineitem) where rn = 1""")
def d2_first_per_key(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return first_per_key(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@query("d3_duplicate_report", """
select count(*) as rows, 11 as columns, count(*) - (select count(*) from (select distinct * from lineitem)) as full_duplicate_rows,
  count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as duplicate_configurations,
  count(*) - (select count(*) from (select distinct l_quantity, l_discount, l_tax from lineitem)) as duplicate_metric_vectors
from lineitem""")
def d3_duplicate_report(t: Tables) -> DataFrame:
    return duplicate_report(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("d4_duplicate_rows", """
select doc_id, md5(text) as digest from documents where text in (select text from documents group by text having count(*) > 1)""")
def d4_duplicate_rows(t: Tables) -> DataFrame:
    """All documents whose whole text occurs more than once."""
    return duplicate_rows(t.documents, ["text"]).select("doc_id", F.md5("text").alias("digest"))


# ---- ranking and unions --------------------------------------------------

@query("t1_best_rows", """
select o_custkey, o_orderstatus, o_orderkey, o_totalprice from (
  select *, row_number() over (partition by o_custkey, o_orderstatus order by o_totalprice, o_orderkey) as rn from orders
  where o_totalprice is not null) where rn = 1""")
def t1_best_rows(t: Tables) -> DataFrame:
    best = best_rows(t.orders, ["o_custkey", "o_orderstatus"], "o_totalprice", True, ["o_orderkey"])
    return best.select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@query("t2_best_rows_fallback", """
with j as (select source, doc_id, case when source in ('src1', 'src2') then null else quality end as q, n_chars
           from documents left join labels using (doc_id))
select source, doc_id, q, n_chars from (
  select *, row_number() over (partition by source order by q desc nulls last, n_chars nulls last, doc_id) as rn from j)
where rn = 1""")
def t2_best_rows_fallback(t: Tables) -> DataFrame:
    """Best label per source; sources without any label go by size."""
    q = F.when(~F.col("source").isin("src1", "src2"), F.col("quality"))
    rows = _labelled(t).select("source", "doc_id", q.alias("q"), "n_chars")
    return best_rows(rows, ["source"], "q", False, ["doc_id"], fallback="n_chars")


@query("t3_top_n", """
select l_orderkey, l_linenumber, l_extendedprice from lineitem
order by l_extendedprice desc, l_orderkey, l_linenumber limit 15""")
def t3_top_n(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return top_n(rows, "l_extendedprice", 15, tie=["l_orderkey", "l_linenumber"])


@query("u1_union_all", """
select c_custkey as key, c_acctbal as balance, c_mktsegment as segment, null::int as nation from customer
union all select s_suppkey, s_acctbal, null, s_nationkey from supplier""")
def u1_union_all(t: Tables) -> DataFrame:
    customers = t.customer.select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = t.supplier.select(
        F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")
    )
    return union_all([customers, suppliers])


@query("u2_standardize", """
select 'customers' as experiment, c_mktsegment as model, c_custkey as rows, c_acctbal as mae, null::double as r2 from customer
union all select 'parts', p_brand, p_partkey, p_retailprice, p_size::double from part""")
def u2_standardize(t: Tables) -> DataFrame:
    columns = {"model": "c_mktsegment", "rows": "c_custkey", "mae": "c_acctbal", "r2": "not_there"}
    first = standardize(t.customer, columns, {"experiment": "customers"}).withColumn("r2", F.col("r2").cast("double"))
    columns = {"model": "p_brand", "rows": "p_partkey", "mae": "p_retailprice", "r2": F.col("p_size").cast("double")}
    return union_all([first, standardize(t.part, columns, {"experiment": "parts"})])


@query("u3_best_preferred", """
select o_orderpriority, o_orderstatus, o_orderkey, o_totalprice from (
  select *, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as rn from orders
  where o_totalprice is not null and
    o_orderstatus = (select min(x.o_orderstatus) from orders x where x.o_orderpriority = orders.o_orderpriority)) where rn = 1""")
def u3_best_preferred(t: Tables) -> DataFrame:
    """Cheapest order of every priority within its preferred status."""
    preferred = t.orders.groupBy("o_orderpriority").agg(F.min("o_orderstatus").alias("o_orderstatus"))
    best = best_preferred(
        t.orders, preferred, ["o_orderpriority", "o_orderstatus"], ["o_orderpriority"], "o_totalprice", True, ["o_orderkey"]
    )
    return best.select("o_orderpriority", "o_orderstatus", "o_orderkey", "o_totalprice")


# ---- derived features ----------------------------------------------------

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("f1_one_hot", "select event_id, value, " + ", ".join(
    f"(event_type = '{e}')::int as event_type_{e}" for e in EVENT_TYPES) + " from events")
def f1_one_hot(t: Tables) -> DataFrame:
    return one_hot(t.events.select("event_id", "value", "event_type"), ["event_type"])


@query("f2_from_one_hot", "select event_id, event_type as inferred, 'unknown' as none from events")
def f2_from_one_hot(t: Tables) -> DataFrame:
    wide = one_hot(t.events.select("event_id", "event_type"), ["event_type"])
    return wide.select(
        "event_id", from_one_hot(wide, "event_type_").alias("inferred"), from_one_hot(wide, "no_").alias("none")
    )


@query("f3_safe_div", """
select l_returnflag, count(l_extendedprice / nullif(l_discount, 0)) as defined,
  round(avg(l_extendedprice / nullif(l_discount, 0)), 3) as mean_ratio from lineitem group by 1""")
def f3_safe_div(t: Tables) -> DataFrame:
    ratio = safe_div("l_extendedprice", "l_discount")
    return rounded(t.lineitem.groupBy("l_returnflag").agg(
        F.count(ratio).alias("defined"), F.avg(ratio).alias("mean_ratio")
    ), 3)


@query("f4_add_ratios", """
select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_quantity, 0), 8) as price_per_unit,
  round(l_tax / nullif(l_discount, 0), 8) as tax_per_discount from lineitem""")
def f4_add_ratios(t: Tables) -> DataFrame:
    ratios = [
        ("price_per_unit", "l_extendedprice", "l_quantity"), ("tax_per_discount", "l_tax", "l_discount"),
        ("skipped", "l_tax", "not_there"),
    ]
    wide = add_ratios(t.lineitem, ratios)
    return rounded(wide.select("l_orderkey", "l_linenumber", "l_partkey", "price_per_unit", "tax_per_discount"), 8)


@query("f5_ratio_target", """
select l_returnflag, round(avg(l_extendedprice / nullif(l_quantity, 0)), 6) as mean_ratio,
  round(avg(abs(l_extendedprice - l_quantity * 2000.0)), 4) as mae
from lineitem where l_quantity <> 0 group by 1""")
def f5_ratio_target(t: Tables) -> DataFrame:
    """Price per unit as target; a constant ratio prediction brought back to prices and scored there."""
    rows = normalize_target(t.lineitem, {"unit_price": ("l_extendedprice", "l_quantity")}).filter("unit_price is not null")
    back = rows.withColumn("yhat", reconstruct(F.lit(2000.0), "l_quantity"))
    return rounded(back.groupBy("l_returnflag").agg(
        F.avg("unit_price").alias("mean_ratio"), F.avg(F.abs(F.col("l_extendedprice") - F.col("yhat"))).alias("mae")
    ), 6, mae=4)


@query("f6_feature_set", """
select 'named' as set_name, count(*) as rows, round(sum(l_quantity + l_tax), 3) as total from lineitem
union all select 'numeric', count(*), round(sum(l_linenumber + l_quantity + l_discount + l_tax), 3) from lineitem""")
def f6_feature_set(t: Tables) -> DataFrame:
    """Row sums over two feature sets: by name and by type without leakage."""
    target, leakage = "l_extendedprice", ["l_orderkey", "l_partkey", "l_suppkey"]
    sets = {
        "named": feature_set(t.lineitem, target, leakage, names=["l_quantity", "l_tax", "l_quantity", "l_shipdate"]),
        "numeric": feature_set(t.lineitem, target, leakage),
    }
    parts = []
    for name, columns in sets.items():
        row_sum = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
        parts.append(t.lineitem.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_sum).alias("total")).select(
            F.lit(name).alias("set_name"), "rows", "total"))
    return rounded(reduce(DataFrame.unionByName, parts), 3)


def _named(t: Tables) -> DataFrame:
    """Columns of every kind under the names that the sets know, from line items."""
    return t.lineitem.selectExpr(
        "l_quantity as source_lines", "l_discount as num_mul_ops", "l_tax as control_steps", "l_linenumber as synth_num_cells",
        "l_quantity / 2 as ratio_mul_density", "cast(l_returnflag = 'R' as int) as opt_level_O2", "cast(l_returnflag = 'A' as int) as benchmark_gemm",
        "l_extendedprice as synth_chip_area", "l_extendedprice / 3 as total_power")


@query("f6_named_sets", """
with s as (select l_quantity as code1, l_discount as code2, l_tax as hls, l_linenumber as synth, l_quantity / 2 as ratio,
  (l_returnflag = 'R')::int as opt, (l_returnflag = 'A')::int as grp from lineitem)
select 'code_only' as set_name, 3 as features, round(sum(code1 + code2 + opt), 3) as total from s
union all select 'hls_only', 2, round(sum(hls + opt), 3) from s
union all select 'synth_only', 2, round(sum(synth + opt), 3) from s
union all select 'hls_plus_synth', 3, round(sum(hls + synth + opt), 3) from s
union all select 'ratios_only', 2, round(sum(ratio + opt), 3) from s
union all select 'all_direct_features', 7, round(sum(code1 + code2 + hls + synth + ratio + opt + grp), 3) from s""")
def f6_named_sets(t: Tables) -> DataFrame:
    """Row sums over the six named sets; the last with group columns. Results of the final flow are in none."""
    table = _named(t)
    parts = []
    for name in FEATURE_SETS:
        columns = named_feature_set(table, name, "total_power", with_group=name == "all_direct_features")
        total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
        parts.append(table.agg(F.sum(total).alias("total")).select(F.lit(name).alias("set_name"), F.lit(len(columns)).alias("features"), "total"))
    return rounded(reduce(DataFrame.unionByName, parts), 3)


@query("v8_leakage_modes", """
select 'full' as mode, round(avg(l_quantity + l_discount + l_tax), 6) as mean_sum from lineitem
union all select 'no_leakage', round(avg(l_discount + l_tax), 6) from lineitem""")
def v8_leakage_modes(t: Tables) -> DataFrame:
    """The same set with and without columns that give the target away."""
    names = ["l_quantity", "l_discount", "l_tax"]
    hidden = {"l_extendedprice": ["l_quantity"]}
    parts = []
    for mode, extra in (("full", None), ("no_leakage", hidden)):
        columns = feature_set(t.lineitem, "l_extendedprice", names=names, target_leakage=extra)
        row_sum = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
        parts.append(t.lineitem.agg(F.avg(row_sum).alias("mean_sum")).select(F.lit(mode).alias("mode"), "mean_sum"))
    return rounded(reduce(DataFrame.unionByName, parts))
