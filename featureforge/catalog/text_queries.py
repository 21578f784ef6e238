"""Sources, sinks, and extraction from text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featureforge.catalog.registry import Tables, query, rounded
from featureforge.functions import fixed_values as fixed
from featureforge.functions.jsonmaps import REPORT_SCHEMA, map_counts, map_rollup, pick_entry
from featureforge.functions.keys import LABEL_KEY, LOG_KEY, REPORT_KEY, parse_key
from featureforge.functions.paths import path_length
from featureforge.functions.text import (
    add_totals, count_lines, count_lines_where, count_names, count_patterns, extract_first, extract_last,
    extract_metrics, guide_line, nesting_depth, safe_name, strip_comments, violation_line,
)
from featureforge.operators.clean import classify_reports, with_parse_status
from featureforge.operators.joins import enrich
from featureforge.operators.profile import group_summary
from featureforge.sources.files import (
    pick_preferred, read_corpus, read_json_reports, read_metrics, read_optional, write_table,
)
from featureforge.staging import new_folder
from featureforge.streaming.ingest import stream_ingest

LINES_SQL = (
    "string_split_regex({0}, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
)
VISIBLE_SQL = (
    "regexp_matches(x, '[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}"
    "\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')"
)


def lines_sql(column: str, condition: str = "true") -> str:
    lines = LINES_SQL.format(column)
    visible = VISIBLE_SQL.format()
    return f"len(list_filter({lines}, lambda x: {visible} and ({condition})))"


# ---- minimum slice -------------------------------------------------------

@query("entry_corpus_profile", f"""
with d as (
  select source, len(regexp_extract_all(text, '[0-9]+'))::double as numbers,
         {lines_sql('text')}::double as lines, quality::double as quality
  from documents left join labels using (doc_id))
select 'source' as group_column, source as group_value,
  round(avg(numbers), 6) as numbers_mean, round(stddev_samp(numbers), 6) as numbers_std,
  min(numbers) as numbers_min, max(numbers) as numbers_max,
  round(avg(lines), 6) as lines_mean, round(stddev_samp(lines), 6) as lines_std,
  min(lines) as lines_min, max(lines) as lines_max,
  round(avg(quality), 6) as quality_mean, round(stddev_samp(quality), 6) as quality_std,
  min(quality) as quality_min, max(quality) as quality_max
from d group by source""")
def entry_corpus_profile(t: Tables) -> DataFrame:
    """Counts from text, sparse labels joined on, summary per source."""
    counted = count_patterns(t.spread("documents", "doc_id", "source", "text"), "text", {"numbers": "[0-9]+"}).withColumn("lines", count_lines("text"))
    joined = enrich(counted.select("doc_id", "source", "numbers", "lines"), t.labels, "doc_id")
    return rounded(group_summary(joined, ["source"], ["numbers", "lines", "quality"]))


# ---- sources and sinks ---------------------------------------------------

@query("s1_read_corpus", """
select item_id, (length(text) + 1)::bigint as chars, md5(text || chr(10)) as digest from benchmark""")
def s1_read_corpus(t: Tables) -> DataFrame:
    """Every benchmark item as a file of its own, read back as one row per file."""
    folder = new_folder(t.spark, "corpus")
    t.benchmark.select("item_id", "text").write.partitionBy("item_id").text(folder)
    files = read_corpus(t.spark, folder, "*.txt")
    return files.select(
        extract_first("path", r"item_id=(\d+)", "bigint").alias("item_id"),
        F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"),
    )


@query("s2_read_metrics", """
select event_type, count(*) as rows,
       count(case when event_id % 9 <> 0 then value end) as values_read,
       round(sum(case when event_id % 9 <> 0 then value end), 2) as total,
       max(user_id) as top_user
from events group by event_type""")
def s2_read_metrics(t: Tables) -> DataFrame:
    """CSV with padded headers and texts, and a value that does not parse in every ninth row."""
    folder = new_folder(t.spark, "csv")
    t.events.select(
        F.concat(F.lit("  "), "event_type", F.lit(" ")).alias(" event_type "),
        F.when(F.col("event_id") % 9 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value "),
        F.col("user_id").cast("string").alias("user_id"),
    ).write.option("header", True).csv(folder)
    read = read_metrics(t.spark, folder, {"event_type": "string", "value": "double", "user_id": "bigint"})
    return rounded(read.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("values_read"), F.sum("value").alias("total"),
        F.max("user_id").alias("top_user"),
    ), 2)


@query("s3_read_optional", """
select c_mktsegment, count(*) as customers, 0::bigint as scored from customer group by c_mktsegment""")
def s3_read_optional(t: Tables) -> DataFrame:
    """An absent source joins as an empty table."""
    scores = read_optional(t.spark, new_folder(t.spark, "absent"), {"c_custkey": "bigint", "score": "double"})
    return enrich(t.customer, scores, "c_custkey").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"), F.count("score").alias("scored")
    )


@query("s4_pick_preferred", r"""
with r as (
  select page_id, url, regexp_extract(url, '://([^/]+)', 1) as host,
         case when regexp_matches(url, '/en/[0-9]+$') then 0
              when regexp_matches(url, '\.html') then 1
              when regexp_matches(url, '/') then 2 end as rank from pages)
select host, page_id from (
  select host, page_id, row_number() over (partition by host order by rank, url, page_id) as rn from r)
where rn = 1""")
def s4_pick_preferred(t: Tables) -> DataFrame:
    """One page per host by the order of preferred path forms, then by path."""
    files = t.pages.select(
        extract_first("url", r"://([^/]+)").alias("host"), "page_id",
        F.concat_ws("\t", "url", F.format_string("%020d", "page_id")).alias("path"),
    )
    return pick_preferred(files, "host", "path", [r"/en/[0-9]+\t", r"\.html", r"/"]).select("host", "page_id")


@query("s5_read_json_reports", """
select case when event_id % 7 = 0 then 'failed' else 'ok' end as parse_status, event_type,
       count(*) as reports,
       sum(case when event_id % 7 <> 0 then cast(regexp_extract(props, '([0-9]+)', 1) as bigint) end)::bigint as k
from events group by all""")
def s5_read_json_reports(t: Tables) -> DataFrame:
    """JSON with every seventh text cut short."""
    from pyspark.sql import types as T

    texts = t.events.withColumn("report_text", F.when(
        F.col("event_id") % 7 == 0, F.substring("props", 1, 5)
    ).otherwise(F.col("props")))
    parsed = read_json_reports(texts, "report_text", T.StructType([T.StructField("k", T.LongType())]))
    return parsed.groupBy("parse_status", "event_type").agg(
        F.count(F.lit(1)).alias("reports"), F.sum("report.k").alias("k")
    )


@query("s6_stream_ingest", """
select event_type, count(*) as rows, round(sum(value), 2) as total, min(event_id) as first_id,
       max(event_id) as last_id from events group by event_type""")
def s6_stream_ingest(t: Tables) -> DataFrame:
    """Events as text lines, ingested as a stream in two rounds of files; every row once."""
    folder, out, mark = (new_folder(t.spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    line = t.events.select("event_id", F.format_string(
        "event=%d type=%s value=%s", "event_id", "event_type", F.col("value").cast("string")
    ).alias("value"))

    def parser(stream: DataFrame) -> DataFrame:
        return stream.select(
            extract_last("text", r"event=(\d+)", "bigint").alias("event_id"),
            extract_last("text", r"type=(\w+)").alias("event_type"),
            extract_last("text", r"value=(-?[\d.E]+)", "double").alias("value"),
        )

    for part in (0, 1):
        line.filter(F.col("event_id") % 2 == part).select("value").write.mode("append").text(folder)
        stream_ingest(t.spark, folder, parser, out, mark, wholetext=False, glob="*.txt")
    read = t.spark.read.schema("event_id bigint, event_type string, value double").parquet(out)
    return rounded(read.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"),
        F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"),
    ), 2)


@query("s7_write_table", """
select o_orderstatus, o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total
from orders group by all""")
def s7_write_table(t: Tables) -> DataFrame:
    """A table written as CSV twice (the second write replaces the first) and read back."""
    folder = new_folder(t.spark, "sink")
    wanted = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    write_table(wanted.filter("o_orderstatus = 'F'"), folder, "csv")
    write_table(wanted, folder, "csv")
    read = read_metrics(t.spark, folder, {"o_orderkey": "bigint", "o_totalprice": "double"})
    return rounded(read.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("total")
    ), 2)


# ---- text ----------------------------------------------------------------

@query("x1_last_match", """
select doc_id, try_cast(regexp_extract_all(text, '([0-9]+)', 1)[-1] as double) as last_number,
       regexp_extract_all(text, '([aeiou]+)', 1)[-1] as last_vowels,
       try_cast(regexp_extract_all(text, '([0-9]+)[.]', 1)[-1] as bigint) as last_before_dot
from documents""")
def x1_last_match(t: Tables) -> DataFrame:
    return extract_metrics(t.spread("documents", "doc_id", "text"), "text", {
        "last_number": ("([0-9]+)", "double"), "last_vowels": ("([aeiou]+)", "string"),
        "last_before_dot": (r"([0-9]+)[.]", "bigint"),
    }, which="last").select("doc_id", "last_number", "last_vowels", "last_before_dot")


@query("x2_first_match", """
select page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title,
       nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') as lang,
       try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') as bigint) as number,
       try_cast(nullif(regexp_extract(html, 'no such ([0-9.]+)', 1), '') as double) as absent
from pages""")
def x2_first_match(t: Tables) -> DataFrame:
    return t.spread("pages", "page_id", "url", "html").select(
        "page_id", extract_first("html", r"<title>([^<]*)</title>").alias("title"),
        extract_first("html", r'lang="([a-z]+)"').alias("lang"),
        extract_first("url", r"/([0-9]+)", "bigint").alias("number"),
        extract_first("html", r"no such ([0-9.]+)", "double").alias("absent"),
    )


# The same text expression in both engines: full, short, with setup, and two forms that need the fallback.
LOG_NAME = """case event_id % 5
  when 0 then concat(event_type, '_SMALL_clk', user_id, '_memALL_BRAM_dsp1.', event_id % 3, '_optO', event_id % 4, '_log')
  when 1 then concat(event_type, '_MEDIUM_clk', user_id, '_log')
  when 2 then concat('a_', event_type, '_LARGE_clk5_setup', user_id, '_log')
  when 3 then concat(event_type, '_MINI_memALL_X', user_id, '_dsp2.5')
  else concat('junk', user_id, '_optO2_optO1_clk7_clk9') end"""
LOG_PATTERN = (
    "^(.+)_(SMALL|MEDIUM|MINI|LARGE)_clk(\\d+)_(?:mem([A-Z_]+)_)?(?:dsp([\\d.]+)_)?(?:opt(O\\d+)_)?(?:setup([^_]+))?"
)


def _lenient(name: str, group: int, prefix: str | None, default: str) -> str:
    token = "null"
    if prefix:
        token = (f"replace(list_filter(string_split(k, '_'), lambda x: starts_with(x, '{prefix}'))[-1], '{prefix}', '')")
    elif group == 1:
        token = "string_split(k, '_')[1]"
    elif group == 2:
        token = ("case when string_split(k, '_')[2] in ('SMALL', 'MEDIUM', 'MINI', 'LARGE') "
                 "then string_split(k, '_')[2] end")
    return (f"coalesce(case when regexp_matches(k, '{LOG_PATTERN}') then "
            f"nullif(regexp_extract(k, '{LOG_PATTERN}', {group}), '') else {token} end, '{default}') as {name}")


@query("x3_parse_key_lenient", f"""
with n as (select event_id, {LOG_NAME} as k from events)
select event_id, {_lenient('benchmark', 1, None, 'UNKNOWN')}, {_lenient('dataset_size', 2, None, 'DEFAULT')},
  {_lenient('clock_period', 3, 'clk', 'default')}, {_lenient('mem_policy', 4, 'mem', 'default')},
  {_lenient('dsp_coeff', 5, 'dsp', 'default')}, {_lenient('opt_level', 6, 'opt', 'default')},
  {_lenient('experimental_setup', 7, 'setup', 'none')}
from n""")
def x3_parse_key_lenient(t: Tables) -> DataFrame:
    named = t.spread("events", "event_id", "event_type", "user_id").select("event_id", F.expr(LOG_NAME).alias("k"))
    return parse_key(named, "k", LOG_KEY, "lenient").drop("k")


CONFIG_NAME = """case event_id % 4
  when 0 then concat(event_type, '_SMALL_clk', user_id, '_memALL_BRAM_dsp1.', event_id % 3, '_optO', event_id % 4, '_orclk', event_id % 10)
  when 1 then concat('x_', event_type, '_MINI_clk7_memLSS_dsp0.5_optO2_orclk2.5')
  when 2 then concat(event_type, '_SMALL_clk', user_id, '_memlss_dsp1.0_optO0_orclk10')
  else concat(event_type, '_LARGE_clk5_memLSS_dsp1.0_optO3') end"""
CONFIG_PATTERN = "^(.+)_(SMALL|MEDIUM|MINI|LARGE)_clk(\\d+)_mem([A-Z_]+)_dsp([\\d.]+)_opt(O\\d+)"


def _strict(pattern: str, with_clock: bool) -> str:
    get = lambda i: f"nullif(regexp_extract(k, '{pattern}', {i}), '')"
    out = (f"{get(1)} as benchmark, {get(2)} as dataset_size, try_cast({get(3)} as bigint) as clock_period, "
           f"{get(4)} as mem_policy, try_cast({get(5)} as double) as dsp_coeff, {get(6)} as opt_level")
    return out + (f", try_cast({get(7)} as double) as clock_constraint" if with_clock else "")


@query("x4_parse_key_null", f"""
with n as (select event_id, {CONFIG_NAME} as k from events)
select event_id, {_strict(CONFIG_PATTERN + '_orclk([\\d.]+)', True)},
  case when regexp_matches(k, '{CONFIG_PATTERN}_orclk([\\d.]+)') then 'ok' else 'failed' end as config_parse_status
from n""")
def x4_parse_key_null(t: Tables) -> DataFrame:
    named = t.spread("events", "event_id", "event_type", "user_id").select("event_id", F.expr(CONFIG_NAME).alias("k"))
    return parse_key(named, "k", LABEL_KEY, "null").drop("k")


@query("x5_parse_key_drop", f"""
with n as (select event_id, {CONFIG_NAME} as k from events)
select event_id, {_strict(CONFIG_PATTERN, False)} from n where regexp_matches(k, '{CONFIG_PATTERN}')""")
def x5_parse_key_drop(t: Tables) -> DataFrame:
    named = t.spread("events", "event_id", "event_type", "user_id").select("event_id", F.expr(CONFIG_NAME).alias("k"))
    return parse_key(named, "k", REPORT_KEY, "drop").drop("k")


@query("x6_parse_status", """
select case when quality is null then 'missing_label' when toxic = 1 then 'parse_error: toxic' else 'ok' end
  as parse_status, count(*) as rows
from documents left join labels using (doc_id) group by 1""")
def x6_parse_status(t: Tables) -> DataFrame:
    joined = enrich(t.documents.select("doc_id"), t.labels, "doc_id")
    marked = with_parse_status(joined, [
        (F.col("quality").isNull(), "missing_label"), (F.col("toxic") == 1, "parse_error: toxic"),
    ])
    return marked.groupBy("parse_status").agg(F.count(F.lit(1)).alias("rows"))


HTML_COMMENTS = (r"(?s)<script>.*?</script>", r"(?s)<!--.*?-->")


@query("x7_strip_comments", f"""
select page_id, md5(s) as digest, length(s)::bigint as chars from (
  select page_id, regexp_replace(regexp_replace(html, '{HTML_COMMENTS[0]}', '', 'g'), '{HTML_COMMENTS[1]}', '', 'g') as s
  from pages)""")
def x7_strip_comments(t: Tables) -> DataFrame:
    stripped = t.spread("pages", "page_id", "html").select("page_id", strip_comments("html", HTML_COMMENTS).alias("s"))
    return stripped.select("page_id", F.md5("s").alias("digest"), F.length("s").cast("bigint").alias("chars"))


def _around(char: str, before: str, after: str) -> str:
    """Occurrences of a character by its neighbours, where look-around is not available."""
    chars = lambda cs: ", ".join(f"'{c}'" for c in cs)
    return (f"len(list_filter(cs, lambda c, i: c = '{char}' and coalesce(case when i > 1 then cs[i - 1] end, '') not in ({chars(before)}) "
            f"and coalesce(cs[i + 1], '') not in ({chars(after)})))::bigint")


@query("x8_pattern_counts", f"""
with s as (
  select page_id, regexp_replace(regexp_replace(html, '(?s)/\\*.*?\\*/', '', 'g'), '//.*', '', 'g') as code from pages),
c as (select page_id, code, string_split(code, '') as cs from s),
n as (select page_id, {_around('+', '+', '+=')} as num_add_ops, {_around('-', '-', '-=>')} as num_sub_ops,
  {_around('*', '/', '=/')} as num_mul_ops, {_around('/', '/', '/*')} as num_div_ops,
  {_around('=', '=!<>', '=')} as num_assignments,
  len(regexp_extract_all(code, '\\[[^\\]]+\\]'))::bigint as num_array_accesses,
  len(list_filter(regexp_extract_all(code, '([A-Za-z_][A-Za-z_0-9]*)[ ]*\\(', 1),
      lambda x: x not in ('if', 'for', 'while', 'switch', 'return', 'sizeof')))::bigint as num_function_calls
  from c)
select *, num_add_ops + num_sub_ops + num_mul_ops + num_div_ops as num_arithmetic_ops from n""")
def x8_pattern_counts(t: Tables) -> DataFrame:
    """Operator, assignment, access and call counts after stripping comments, and their sums (X9)."""
    names = ["num_add_ops", "num_sub_ops", "num_mul_ops", "num_div_ops", "num_assignments", "num_array_accesses"]
    code = t.spread("pages", "page_id", "html").select("page_id", strip_comments("html").alias("code"))
    counted = count_patterns(code, "code", {n: fixed.SOURCE_PATTERNS[n] for n in names}).withColumn(
        "num_function_calls", count_names("code", r"([A-Za-z_][A-Za-z_0-9]*)[ ]*\(", fixed.NOT_CALLS)
    )
    return add_totals(counted, {"num_arithmetic_ops": names[:4]}).drop("code")


@query("x9_derived_sums", """
select doc_id, e + a as vowels, e + a + dot as marks from (
  select doc_id, (length(text) - length(replace(text, 'e', '')))::bigint as e,
    (length(text) - length(replace(text, 'a', '')))::bigint as a,
    (length(text) - length(replace(text, '.', '')))::bigint as dot from documents)""")
def x9_derived_sums(t: Tables) -> DataFrame:
    counted = count_patterns(t.spread("documents", "doc_id", "text"), "text", {"e": "e", "a": "a", "dot": r"\."})
    return add_totals(counted, {"vowels": ["e", "a"], "marks": ["e", "a", "dot"]}).select("doc_id", "vowels", "marks")


TAGS = "(?:ul|nav|div|article|p|h1)"


@query("x10_nesting_depth", f"""
with k as (
  select page_id, regexp_extract_all(html, '<{TAGS}|>|</{TAGS}>') as tokens from pages),
s as (
  select page_id, list_prepend({{'d': 0, 'm': 0, 'p': false, 't': ''}},
    list_transform(tokens, lambda x: {{'d': 0, 'm': 0, 'p': false, 't': x}})) as steps from k)
select page_id, list_reduce(steps, lambda a, x: {{
    'd': case when x.t = '>' and a.p then a.d + 1 when starts_with(x.t, '</') then greatest(a.d - 1, 0) else a.d end,
    'm': greatest(a.m, case when x.t = '>' and a.p then a.d + 1 else 0 end),
    'p': case when x.t = '>' and a.p then false when x.t <> '>' and not starts_with(x.t, '</') then true else a.p end,
    't': ''}}).m::bigint as depth
from s""")
def x10_nesting_depth(t: Tables) -> DataFrame:
    """Depth of block elements: an opener, the end of its tag, and the closing tag."""
    return t.spread("pages", "page_id", "html").select("page_id", nesting_depth("html", f"<{TAGS}", ">", f"</{TAGS}>").alias("depth"))


@query("x11_count_lines", f"""
select doc_id, {lines_sql('text')}::bigint as lines, {lines_sql('text', "not starts_with(ltrim(x), 'E')")}::bigint as kept
from documents""")
def x11_count_lines(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id", "text").select("doc_id", count_lines("text").alias("lines"), count_lines("text", "E").alias("kept"))


VIOLATION_SQL = ("contains(lower(x), 'violation') or (contains(lower(x), 'drc') and (contains(lower(x), 'error') "
                 "or contains(lower(x), 'viol'))) or regexp_matches(lower(x), '\\bmet[0-9]+\\b')")
GUIDE_SQL = "regexp_matches(lower(x), '\\bmet[0-9]+\\b') or len(regexp_extract_all(x, '[0-9]+')) >= 4"


@query("x12_line_predicates", f"""
select doc_id, {lines_sql('text', GUIDE_SQL)}::bigint as guide_lines,
  {lines_sql("replace(replace(text, 'token', 'drc error'), 'de ', 'violation ')", VIOLATION_SQL)}::bigint as violation_lines
from documents""")
def x12_line_predicates(t: Tables) -> DataFrame:
    text = F.replace(F.replace("text", F.lit("token"), F.lit("drc error")), F.lit("de "), F.lit("violation "))
    return t.spread("documents", "doc_id", "text").select(
        "doc_id", count_lines_where("text", guide_line).alias("guide_lines"),
        count_lines_where(text, violation_line).alias("violation_lines"),
    )


REPORT_TEXT = """case when doc_id % 3 = 0 then '' when doc_id % 40 = 7 then concat(text, chr(10), 'No DRC violations')
  when doc_id % 2 = 0 then replace(text, 'the', 'violation') else replace(text, 'violation', 'none') end"""
RUN_NAME = "concat(source, '-', lang, '-', doc_id % 3)"


@query("x13_classify_reports", f"""
with f as (select {RUN_NAME} as run, {REPORT_TEXT} as text from documents),
runs as (select distinct {RUN_NAME} as run from documents union select distinct concat(lang, '-none') from documents),
g as (select run, count(*) as n, sum({lines_sql('text')})::bigint as l, sum({lines_sql('text', VIOLATION_SQL)})::bigint as h,
  bool_or(contains(lower(text), 'no drc violations') or contains(lower(text), 'number of violations: 0')) as clean
  from f group by run)
select run, coalesce(n, 0) as report_count, coalesce(l, 0) as nonempty_lines, coalesce(h, 0) as violation_keyword_count,
  case when n is null then 0 else 1 end as has_report,
  case when n is null then 'missing' when l = 0 then 'empty_or_clean' when clean then 'clean'
       when h = 0 then 'no_violation_keywords' else 'possible_violations' end as status
from runs left join g using (run)""")
def x13_classify_reports(t: Tables) -> DataFrame:
    files = t.spread("documents", "doc_id", "source", "lang", "text").select(F.expr(RUN_NAME).alias("run"), F.expr(REPORT_TEXT).alias("text"))
    absent = t.documents.select(F.concat("lang", F.lit("-none")).alias("run"))
    runs = t.documents.select(F.expr(RUN_NAME).alias("run")).union(absent).distinct()
    return classify_reports(files, runs, "run", "text")


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
LAYOUT = """concat('UNITS DISTANCE MICRONS 100 ;', chr(10), 'NETS 3 ;', chr(10),
  ' - a + ROUTED m1 ( ', l_partkey, ' ', l_suppkey, ' ) ( * ', cast(l_quantity as bigint), ' ) v ( ', l_linenumber, ' * ) ( * * )', chr(10),
  ' - b + USE SIGNAL ( 1 2 ) ( 3 4 )', chr(10),
  ' - c + FIXED m2 ( * 5 ) ( ', l_orderkey % 100, ' ', l_partkey % 50, ' ) ( * 3 )', chr(10), 'END NETS')"""


@query("x14_path_length", """
with p as (
  select l_returnflag, l_linestatus, l_shipdate::date as day,
    (abs(l_quantity::bigint - l_suppkey) + abs(l_linenumber - l_partkey) + abs(3 - l_partkey % 50))::bigint as len from lineitem)
select l_returnflag, l_linestatus, 100::bigint as units_per_micron, sum(len)::bigint as length,
  (6 * count(*))::bigint as points, (2 * count(*))::bigint as records, round(sum(len) / 100.0, 6) as length_microns
from p group by l_returnflag, l_linestatus""")
def x14_path_length(t: Tables) -> DataFrame:
    """A layout text per line item: routed, unrouted and fixed records with repeated and unresolved coordinates."""
    texts = t.spread("lineitem", *LINE).select("l_returnflag", "l_linestatus", F.expr(LAYOUT).alias("text"))
    return rounded(path_length(texts, "text", ["l_returnflag", "l_linestatus"]))


# A report with two modules per line item; counters may be null or absent, and one text in 50 is cut short.
MODULES = """concat('{"modules": {"\\\\\\\\top": {"num_cells": ', cast(l_quantity as bigint), ', "num_wires": null, "num_cells_by_type": {"$and": ', l_linenumber,
  ', "or.x": ', l_partkey % 7, '}}, "', case when l_orderkey % 3 = 0 then '_kernel' else 'data' end, '": {"num_cells": ', l_suppkey,
  ', "num_processes": ', l_linenumber, ', "num_cells_by_type": {"$and": 2}}}}')"""


def _module_reports(t: Tables) -> DataFrame:
    text = F.expr(MODULES)
    cut = F.when(F.col("l_orderkey") % 50 == 1, F.substring(text, 1, 30)).otherwise(text)
    rows = t.spread("lineitem", *LINE).select("l_orderkey", "l_linenumber", "l_returnflag", cut.alias("text"))
    return read_json_reports(rows, "text", REPORT_SCHEMA)


@query("x15_map_rollup", """
select l_returnflag, case when l_orderkey % 50 = 1 then 'failed' else 'ok' end as parse_status,
  sum(case when l_orderkey % 50 = 1 then 0 else 2 end)::bigint as modules,
  sum(case when l_orderkey % 50 = 1 then 0 else l_quantity::bigint + l_suppkey end)::bigint as cells,
  sum(case when l_orderkey % 50 = 1 then 0 else l_linenumber end)::bigint as processes, 0::bigint as wires
from lineitem group by 1, 2""")
def x15_map_rollup(t: Tables) -> DataFrame:
    reports = _module_reports(t)
    rolled = reports.select(
        "l_returnflag", "parse_status",
        *map_rollup("report.modules", ["num_cells", "num_processes", "num_wires"], "", "modules"),
    )
    return rolled.groupBy("l_returnflag", "parse_status").agg(*[
        F.sum(c).alias(c) for c in ("modules", "cells", "processes", "wires")
    ])


@query("x16_map_counts", """
with v as (select l_returnflag, l_linenumber, l_partkey from lineitem where l_orderkey % 50 <> 1)
select l_returnflag, 'cell_and' as cell_type, sum(l_linenumber + 2)::bigint as n from v group by 1
union all select l_returnflag, 'or_x', sum(l_partkey % 7)::bigint from v group by 1""")
def x16_map_counts(t: Tables) -> DataFrame:
    counts = map_counts(_module_reports(t), "report.modules", "num_cells_by_type", ["l_returnflag"])
    return counts.withColumn("cell_type", safe_name("cell_type"))


@query("x17_pick_entry", r"""
select picked, count(*) as reports, sum(cells)::bigint as cells from (
  select case when l_orderkey % 50 = 1 then null when l_orderkey % 3 = 0 then '_kernel'
              when l_suppkey > l_quantity::bigint then 'data' else '\top' end as picked,
         case when l_orderkey % 50 = 1 then null when l_orderkey % 3 = 0 then l_suppkey
              when l_suppkey > l_quantity::bigint then l_suppkey else l_quantity::bigint end as cells
  from lineitem) group by picked""")
def x17_pick_entry(t: Tables) -> DataFrame:
    pick = pick_entry("report.modules", ["\\_kernel", "_kernel"], "num_cells")
    picked = _module_reports(t).select(pick.alias("e"))
    return picked.select(F.col("e.key").alias("picked"), F.col("e.value.num_cells").alias("cells")).groupBy("picked").agg(
        F.count(F.lit(1)).alias("reports"), F.sum("cells").alias("cells")
    )
