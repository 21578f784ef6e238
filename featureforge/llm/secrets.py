"""Secret scan over a trigram inverted index.

Each rule's pattern is turned into a Boolean query over trigrams that any match
must contain. The index holds one posting per document and trigram that the
rules ask for; postings are intersected per document, and only documents whose
trigrams satisfy a rule's query are searched with that rule's pattern. A rule
without mandatory trigrams searches every document.

Index and queries are in lower case, so a query never misses a match.

Defined results: null text is empty and has no spans; a row with a null
identifier is searched by every rule; repeated rows are returned each; an empty
table gives an empty result; other columns are not read. Texts are searched whole.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from featureforge.llm.common import whole_text
from featureforge.staging import stage

#: Above so many alternatives a run of literals is closed and a new one begins.
MOST_ALTERNATIVES = 64
#: Bits used of one mask.
MASK_BITS = 62


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` (0: the match) must have ``least`` characters, else the match does not count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The kinds of secrets that a scan must find, in their order in results.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # greedy, so the same as runs of any length of which those under 20 are dropped
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Found besides: heads of private keys in text form.
EXTRA_RULES = (Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),)

#: A query: every element must hold; an element holds if one of its trigram sets is contained.
Query = tuple[frozenset[frozenset[str]], ...]


def trigram_query(pattern: str) -> Query:
    """Trigrams that every match of the pattern contains; empty if none are mandatory."""
    clauses: list[frozenset[frozenset[str]]] = []
    runs = {""}

    def close() -> None:
        nonlocal runs
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in runs}
        if frozenset() not in sets:
            clauses.append(frozenset(s for s in sets if not any(o < s for o in sets)))
        runs = {""}

    def strings(items) -> set[str] | None:
        """All strings that a part matches, if these are few."""
        out = {""}
        for op, arg in items:
            if op is ops.LITERAL:
                more = {chr(arg).lower()}
            elif op is ops.SUBPATTERN:
                more = strings(arg[3])
            elif op is ops.BRANCH:
                parts = [strings(b) for b in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is ops.IN and all(o is ops.LITERAL for o, _ in arg):
                more = {chr(c).lower() for _, c in arg}
            elif op is ops.MAX_REPEAT and arg[1] <= 4 and (one := strings(arg[2])) is not None:
                more = set().union(*(reduce(lambda a, _: {x + y for x in a for y in one}, range(n), {""}) for n in range(arg[0], arg[1] + 1)))
            else:
                more = None
            if more is None or len(out) * len(more) > MOST_ALTERNATIVES:
                return None
            out = {x + y for x in out for y in more}
        return out

    for item in parser.parse(pattern):
        more = strings([item])
        if more is None:
            close()
        elif len(runs) * len(more) > MOST_ALTERNATIVES:
            close()
            runs = more
        else:
            runs = {x + y for x in runs for y in more}
    close()
    return tuple(clauses)


def needed_trigrams(rules: Sequence[Rule]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for s in clause for t in s})


def build_index(docs: DataFrame, trigrams: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``(trigram, doc_id)`` of the wanted trigrams, one per document that has it."""
    # inside the lambda the text is in lower case once, not once for each trigram
    found = F.transform(F.array(F.lower(whole_text(F.col(text_col)))), lambda low: F.array_compact(F.array(
        *[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])))[0]
    names = F.array(*[F.lit(t) for t in trigrams])
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), found.alias("_found"))
    return rows.select("doc_id", F.explode("_found").alias("_i")).select(F.element_at(names, F.col("_i") + 1).alias("trigram"), "doc_id")


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(doc_id, kinds)``: documents whose postings satisfy the query of a rule that has one."""
    trigrams = needed_trigrams(rules)
    place = {t: divmod(i, MASK_BITS) for i, t in enumerate(trigrams)}
    bits = F.create_map(*[x for t in trigrams for x in (F.lit(t), F.lit(1 << place[t][1]))])
    words = F.create_map(*[x for t in trigrams for x in (F.lit(t), F.lit(place[t][0]))])
    n_words = (len(trigrams) + MASK_BITS - 1) // MASK_BITS
    posted = postings.select("doc_id", F.element_at(bits, F.col("trigram")).cast("long").alias("_bit"), F.element_at(words, F.col("trigram")).alias("_word"))
    masks = posted.groupBy("doc_id").agg(*[
        F.coalesce(F.bit_or(F.when(F.col("_word") == w, F.col("_bit"))), F.lit(0).cast("long")).alias(f"_mask{w}") for w in range(n_words)])

    def has(s: frozenset[str]) -> Column:
        need = [0] * n_words
        for t in s:
            need[place[t][0]] |= 1 << place[t][1]
        return reduce(lambda a, b: a & b, [F.col(f"_mask{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in enumerate(need) if m])

    kinds = []
    for rule in rules:
        if query := trigram_query(rule.pattern):
            holds = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [has(s) for s in sorted(c, key=sorted)]) for c in query])
            kinds.append(F.when(holds, F.lit(rule.kind)))
    found = masks.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds"))
    return found.where(F.size("kinds") > 0)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule: leftmost matches without overlap, from the lengths of the matches and of what lies between."""
    one = F.lit(rule.pattern)
    lengths = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, one, F.lit(0)), F.length).alias("match"),
        F.transform(F.regexp_extract_all(text, one, F.lit(rule.group)), F.length).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,ok:boolean>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["match"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), stop.alias("stop"), (x["part"] >= rule.least).alias("ok"))
        return F.struct(F.coalesce(stop, start).alias("at"), F.when(stop.isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    spans = F.filter(F.aggregate(lengths, state, step, lambda a: a["spans"]), lambda s: s["ok"])
    return F.when(F.rlike(text, one), spans).otherwise(none)


def find_secrets(
    docs: DataFrame, base: Sequence[Rule] = BASE_RULES, extra: Sequence[Rule] = EXTRA_RULES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, spans)`` of every row; spans are ``(kind, start, stop, base)`` by start, then rule; code points, stop exclusive."""
    rules = [*base, *extra]
    postings = stage(build_index(docs, needed_trigrams(rules), id_col, text_col), "postings")
    wanted = candidates(postings, rules).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    rows = rows.join(wanted, F.col("doc_id") == F.col("_id"), "left")
    parts = []
    for i, rule in enumerate(rules):
        spans = rule_spans(F.col("text"), rule, i)
        if trigram_query(rule.pattern):
            open_ = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
            spans = F.when(open_, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int,ok:boolean>>"))
        parts.append(spans)
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(
        F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), (s["kind"] < len(base)).alias("base")))
    return rows.select("doc_id", spans.alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
