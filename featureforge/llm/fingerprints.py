"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs of ``LEAST`` to ``MOST`` characters: at line ends,
sentence ends, and ends of words with certain last letters, whichever comes
first, else after ``MOST`` characters. Cuts depend on nearby text alone. The first
paragraph is a short one, so that texts of a few words have several digests too. A sketch has ``3 * TABLE`` cells; each paragraph digest is
added to one cell of each third: a signed count, the XOR of the digests and the
XOR of their check codes. Sketches of two versions subtract cell by cell; cells
that hold one digest are peeled off until none is left, which recovers the
digests that only one version has. If peeling gets stuck, the digests are dealt
out by their leading bits to more sketches with other hashes, for the whole set
first and then for the parts that failed.

The likeness of two texts is shared / all paragraphs, from the recovered digests.

Defined results: null text is empty; texts without paragraphs have equal
sketches and a likeness of 1 to each other; paragraphs that repeat within a text
count once; a null identifier comes after all others; rows with equal
identifiers are ordered by a digest of their text, and equal rows count as one
document and share one result, which each returns; a single document is its own
next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from featureforge.llm.common import id_text, sha256_text, whole_text
from featureforge.staging import stage

TABLE, TABLES = 8, 3
#: Digests per sketch that a retry aims at.
LOAD = 10
ROUNDS, RETRIES = 10, 14
#: Characters of a paragraph, and of the first one.
LEAST, MOST = 200, 800
FIRST_LEAST, FIRST_MOST = 12, 40
BLANK = r"[\x20\x09-\x0D]"
#: Last letters of words at whose ends a paragraph may end.
LAST = "dehnyDEHNY05" + "\u00e9\u00fc\u0430\u0435\u0438\u0439\u03b1\u03c2\u0646\u0647\u05d4\u05dd"
END = rf"(?:(?<=[.!?\u2026\u3002\uff01\uff1f\n])|(?<=[{LAST}])(?={BLANK})|(?!.))"
PARAGRAPH = (
    rf"(?s)\A{BLANK}*+(?:.{{{FIRST_LEAST},{FIRST_MOST}}}?{END}|.{{1,{FIRST_MOST}}})|"
    rf".{{{LEAST},{MOST}}}?{END}|.{{1,{MOST}}}")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs, in order."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.btrim(p, F.lit(" \t\n\v\f\r")))
    return F.sort_array(F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p))))


def place(digest: Column, level: Column, table: int) -> Column:
    """Cell of a digest in one third of a sketch."""
    return F.lit(table * TABLE) + F.shiftrightunsigned(F.xxhash64(digest, level), 3 * table).bitwiseAND(F.lit(TABLE - 1)).cast("int")


def entry(count: Column, digest: Column, level: Column) -> Column:
    cells = [place(digest, level, t).alias(f"c{t}") for t in range(TABLES)]
    return F.struct(count.alias("n"), digest.alias("k"), F.hash(digest).alias("x"), *cells)


def added(cell: Column, items: Column, i: Column) -> Column:
    """A cell with those items that belong to it."""
    mine = F.filter(items, lambda e: (e["c0"] == i) | (e["c1"] == i) | (e["c2"] == i))
    return F.aggregate(mine, cell, lambda acc, e: F.struct(
        (acc["n"] + e["n"]).alias("n"), acc["k"].bitwiseXOR(e["k"]).alias("k"), acc["x"].bitwiseXOR(e["x"]).alias("x")))


def sketch(items: Column, level: Column) -> Column:
    """Cells of a set of digests."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("x"))
    entries = F.transform(items, lambda d: entry(F.lit(1), d, level))
    return let(entries, lambda es: F.transform(F.sequence(F.lit(0), F.lit(TABLE * TABLES - 1)), lambda i: added(empty, es, i)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["x"].bitwiseXOR(y["x"]).alias("x")))


def peeled(cells: Column, level: Column) -> Column:
    """``(ok, found)``: whether all cells became empty, and the recovered ``(n, k)``: digests of the first set (1) or the second (-1)."""
    none = F.array().cast("array<struct<n:int,k:bigint>>")

    def round_(acc: Column, _: Column) -> Column:
        single = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["x"] == F.hash(c["k"])))
        pure = F.array_distinct(F.transform(single, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))

        def remove(found: Column) -> Column:
            less = F.transform(found, lambda f: entry(-f["n"], f["k"], level))
            cells = let(less, lambda es: F.transform(acc["cells"], lambda c, i: added(c, es, i)))
            return F.when(F.size(found) == 0, acc).otherwise(F.struct(cells.alias("cells"), F.concat(acc["found"], found).alias("found")))

        return let(pure, remove)

    start = F.struct(cells.alias("cells"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda acc: F.struct(
        (~F.exists(acc["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["x"] != 0))).alias("ok"), acc["found"].alias("found")))


def part_of(digest: Column, level: Column) -> Column:
    """Part by the 2 * level leading bits."""
    return F.call_function("shiftrightunsigned", F.shiftrightunsigned(digest, 1), F.lit(63) - level * 2)


def members(items: Column, parts: Column, part: Column) -> Column:
    """Those of the ordered items whose part is ``part``; parts lie together."""
    first = F.array_position(parts, part).cast("int")
    last = (F.size(parts) - F.array_position(F.reverse(parts), part) + 1).cast("int")
    return F.when(first == 0, F.array().cast("array<bigint>")).otherwise(F.slice(items, first, last - first + 1))


def differing(a: Column, b: Column, first: Column) -> Column:
    """Digests that one of two ordered sets lacks, as ``(n, k)``; ``first`` is the difference of their fingerprints."""
    none = F.array().cast("array<struct<n:int,k:bigint>>")
    wide = F.greatest(F.lit(1), F.ceil(F.log(4.0, (F.size(a) + F.size(b)) / F.lit(float(LOAD)))).cast("int"))
    start = let(peeled(first, F.lit(0)), lambda p: F.struct(
        wide.alias("level"), F.when(p["ok"], F.array().cast("array<bigint>")).otherwise(
            F.sequence(F.lit(0).cast("long"), F.pow(F.lit(4.0), wide).cast("long") - 1)).alias("open"),
        F.when(p["ok"], p["found"]).otherwise(none).alias("found")))

    def retry(acc: Column, _: Column) -> Column:
        level = acc["level"]

        def parts(pa: Column, pb: Column) -> Column:
            def one(part: Column) -> Column:
                cells = subtracted(sketch(members(a, pa, part), level), sketch(members(b, pb, part), level))
                return F.struct(part.alias("part"), peeled(cells, level).alias("p"))

            def merge(tried: Column) -> Column:
                failed = F.filter(tried, lambda t: ~t["p"]["ok"])
                done = F.filter(tried, lambda t: t["p"]["ok"])
                return F.struct(
                    (level + 1).alias("level"),
                    F.flatten(F.transform(failed, lambda t: F.sequence(t["part"] * 4, t["part"] * 4 + 3))).alias("open"),
                    F.concat(acc["found"], F.flatten(F.transform(done, lambda t: t["p"]["found"]))).alias("found"))

            return let(F.transform(acc["open"], one), merge)

        both = F.struct(F.transform(a, lambda d: part_of(d, level)).alias("pa"), F.transform(b, lambda d: part_of(d, level)).alias("pb"))
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(let(both, lambda p: parts(p["pa"], p["pb"])))

    return F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), start, retry, lambda acc: acc["found"])


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Shared paragraphs over all, of two ordered digest sets with their fingerprints."""
    total = F.size(a) + F.size(b)
    apart = F.size(differing(a, b, subtracted(sketch_a, sketch_b)))
    return F.when(total == 0, F.lit(1.0)).otherwise(let(apart, lambda d: (total - d) / (total + d)))


def sketch_text(cells: Column) -> Column:
    """Cells as hexadecimal text: count and check code in 16 digits, digest in 16."""
    hexed = lambda v: F.substring(F.concat(F.lit("0" * 15), F.hex(v)), -16, 16)
    low = lambda c: F.shiftleft(c["n"].cast("long"), 32) + c["x"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(hexed(low(c)), hexed(c["k"]))), ""))


def chained(rows: DataFrame) -> DataFrame:
    """``(uid, doc_id, next_uid, last_n)`` of distinct ``(uid, doc_id, n)`` by descending identifier, last to first.

    ``last_n`` is the length of the document whose next one this is. Identifiers
    are cut into ranges; only the first row of each range is compared across ranges.
    """
    ordered = [F.col("doc_id").desc_nulls_last(), F.col("uid")]
    rows = stage(rows.distinct().repartitionByRange(*ordered).withColumn("range", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("range").orderBy(*ordered)
    rows = rows.withColumn("_i", F.row_number().over(inside)).withColumn("next_uid", F.lead("uid").over(inside)).withColumn("last_n", F.lag("n").over(inside)).withColumn(
        "_last", F.lead("uid").over(inside).isNull())
    rows = stage(rows, "within")
    heads = rows.where("_i = 1").select("range", F.col("uid").alias("head"))
    tails = rows.where("_last").select("range", F.col("n").alias("tail_n"))
    by_range = W.orderBy("range")
    edge = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = heads.join(tails, "range").select(
        "range", F.coalesce(F.lead("head").over(by_range), F.first("head").over(edge)).alias("after"),
        F.coalesce(F.lag("tail_n").over(by_range), F.last("tail_n").over(edge)).alias("before"))
    ends = stage(ends, "ends")  # one row per range
    return stage(rows.join(ends, "range").select(
        "uid", "doc_id", F.coalesce("next_uid", "after").alias("next_uid"), F.when(F.col("_i") == 1, F.col("before")).otherwise(F.col("last_n")).alias("last_n")), "chain")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every document.

    The edited text ends in the beginning of the next document instead of its own second half.
    """
    text = whole_text(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn(
        "uid", F.md5(F.concat(id_text(F.col("doc_id")), F.lit("|"), F.col("text")).cast("binary")))
    chain = chained(rows.select("uid", "doc_id", F.length("text").alias("n")))
    rows = rows.select("uid", "text").repartition("uid")  # one exchange of the texts, read twice
    previous = chain.select("uid", F.col("last_n"))
    sent = rows.dropDuplicates(["uid"]).join(previous, "uid").select(
        F.col("uid").alias("next_uid"), F.substring(F.col("text"), F.lit(1), F.floor(F.col("last_n") / 2).cast("int")).alias("tail"),
        digests(F.col("text")).alias("next_digests"))
    after = chain.select("uid", "doc_id", "next_uid").join(sent, "next_uid").select("uid", "doc_id", "tail", "next_digests")
    both = rows.join(after, "uid")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.col("tail"))
    found = both.select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), digests(F.col("text")).alias("own"), "next_digests",
    ).withColumn("edited_digests", digests(F.col("edited")))
    zero = F.lit(0)
    cells = F.struct(
        F.col("doc_id"), F.col("n_chars"), sha256_text(F.col("edited")).alias("edited_sha256"), F.col("own"), F.col("edited_digests"), F.col("next_digests"),
        sketch(F.col("own"), zero).alias("s"), sketch(F.col("edited_digests"), zero).alias("e"), sketch(F.col("next_digests"), zero).alias("x"))
    return found.select(F.explode(F.array(cells)).alias("r")).select(
        "r.doc_id", "r.n_chars", "r.edited_sha256", sketch_text(F.col("r.s")).alias("fingerprint"), sketch_text(F.col("r.e")).alias("edited_fingerprint"),
        likeness(F.col("r.own"), F.col("r.edited_digests"), F.col("r.s"), F.col("r.e")).alias("near_edited"),
        likeness(F.col("r.own"), F.col("r.next_digests"), F.col("r.s"), F.col("r.x")).alias("near_next"),
    )
