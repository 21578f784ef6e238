"""Quality by perplexity under a Kneser-Ney model of trusted text.

The model is an interpolated modified Kneser-Ney character model of order
``ORDER`` over running text (words as written, joined by one space), one for
each language. N-grams cross word borders and every occurrence counts, so that
word order, sentence marks and repeats decide. Counts, contexts and
continuations are tables keyed by language and n-gram; the distinct n-grams of
all documents are joined with them level by level, so that no task holds the
model.

All given documents are trusted: counts, thresholds and marks cover every one.
Documents and trusted identifiers are dealt out to blocks by a hash of the
identifier, so that no task holds all identifiers. Rows of a task that go to one
block travel as one compressed piece. A block counts the n-grams of its trusted
documents and asks for its own distinct n-grams, and its documents are scored
with the answers. A document is kept if its perplexity is not above a quantile
of the trusted documents of its language.

Defined results: null and empty texts, and texts without words, have no
perplexity (null) and are kept; a null language is a language of its own; a
language without trusted documents has no threshold and keeps all; of several
labels of a document the largest counts; repeated rows are returned each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from featureforge.llm.common import whole_text
from featureforge.llm.toxicity import PAD, discount, discounts
from featureforge.staging import stage

#: Five characters fit small languages too closely (figures of a trial are in the README).
ORDER = 4
#: Characters of text that a block should hold, and that a task gathers before it sends pieces to blocks.
BLOCK_CHARS, GATHERED_CHARS = 16_000_000, 32_000_000
#: N-grams that are sorted at a time.
PIECE = 1 << 21
#: Likelihood of a character that no model has, spread over as many.
UNIFORM = 1.0 / 65_536
#: Documents of a language at or below this quantile of its trusted documents are kept.
QUANTILE = 0.99


def running(text: str) -> str:
    return " ".join(text.split())


def grams_of(text: str) -> list[str]:
    """N-grams of running text; what ``TextGrams`` has for many texts."""
    padded = PAD * (ORDER - 1) + text + PAD
    return [padded[i:i + ORDER] for i in range(len(text) + 1)]


class TextGrams:
    """Distinct n-grams of texts as sorted integer keys.

    A key has one digit per character, in the base of the texts' alphabet. Where
    the next digit would overflow, the keys so far are replaced by their ranks.
    """

    def __init__(self, texts: list[str]):
        padded = [PAD * (ORDER - 1) + t + PAD for t in texts]
        ends = np.cumsum([len(p) for p in padded])
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        self.alphabet = np.flatnonzero(seen)
        codes = (np.cumsum(seen, dtype=np.int32) - 1)[codes]
        valid = np.ones(len(codes), bool)
        for k in range(1, ORDER):
            valid[ends - k] = False
        valid = valid[:len(codes) - ORDER + 1]
        base = len(self.alphabet)
        self.ranked: list[np.ndarray | None] = []
        keys, span = codes[:len(valid)].astype(np.int64), base
        for k in range(1, ORDER):
            values = None
            if span * base >= 2**63:
                values, keys = np.unique(keys, return_inverse=True)
                keys, span = keys.astype(np.int64), len(values)
            self.ranked.append(values)
            keys = keys * base + codes[k:k + len(valid)]
            span *= base
        self.keys = keys[valid]
        self.sizes = np.array([len(t) + 1 for t in texts], np.int64)

    def counted(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys with their counts in the first ``upto`` n-grams."""
        found, counts = [], []
        cuts = sorted({0, upto, len(self.keys), *range(0, len(self.keys), PIECE)})
        for start, end in zip(cuts, cuts[1:]):
            values, n = np.unique(self.keys[start:end], return_counts=True)
            found.append(values)
            counts.append(n if end <= upto else np.zeros(len(n), np.int64))
        values, inverse = np.unique(np.concatenate(found), return_inverse=True)
        return values, np.bincount(inverse, np.concatenate(counts), len(values)).astype(np.int64)

    def strings(self, keys: np.ndarray) -> pa.Array:
        digits = []
        for values in reversed(self.ranked):
            keys, digit = np.divmod(keys, len(self.alphabet))
            digits.append(digit)
            if values is not None:
                keys = values[keys]
        points = self.alphabet[np.stack([keys, *reversed(digits)], axis=1)].astype("<u4")
        text = points.tobytes().decode("utf-32-le", "replace")
        return pa.array([text[i:i + ORDER] for i in range(0, len(text), ORDER)], pa.string())

    def sums(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each text's n-grams."""
        each = np.empty(len(self.keys))
        for start in range(0, len(each), PIECE):
            each[start:start + PIECE] = values[np.searchsorted(keys, self.keys[start:start + PIECE])]
        return np.add.reduceat(each, np.cumsum(self.sizes) - self.sizes)


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, ..., text) to (block, piece): the rows of a block as one compressed Arrow stream."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))
    held, size = [], 0

    def pieces() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.set_column(table.num_columns - 1, "text", pc.cast(table.column("text"), pa.large_string())).sort_by("block").combine_chunks()
        blocks = table.column("block").to_numpy()
        starts = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
        out = []
        for start, end in zip(starts, [*starts[1:], len(blocks)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                writer.write_table(table.slice(start, end - start))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(blocks[starts], pa.int64()), pa.array(out, pa.binary())], ["block", "piece"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= GATHERED_CHARS:
                yield pieces()
                held, size = [], 0
    if held:
        yield pieces()


def block_texts(pieces: pa.Table, marked: set) -> tuple[pa.Table, list[bool], dict[str, list[int]], list[str]]:
    """Rows of a block, whether each is trusted, the rows with words of each language (trusted ones first), and running texts."""
    rows = pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in pieces.column("piece")])
    trusted = [key in marked for key in rows.column("key").to_pylist()]
    texts = [running(t) for t in rows.column("text").to_pylist()]
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(rows.column("lang").to_pylist()):
        if texts[i]:
            by_lang.setdefault(lang, []).append(i)
    for own in by_lang.values():
        own.sort(key=lambda i: not trusted[i])
    return rows.drop_columns(["text"]), trusted, by_lang, texts


GRAMS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def block_grams(pieces: pa.Table, marks: pa.Table) -> pa.Table:
    """Distinct n-grams of a block, by language, with their counts in trusted documents."""
    if not pieces.num_rows:
        return GRAMS.empty_table()
    rows, trusted, by_lang, texts = block_texts(pieces, set(marks.column("key").to_pylist()))
    block, out = rows.column("block")[0].as_py(), [GRAMS.empty_table()]
    for lang, own in by_lang.items():
        grams = TextGrams([texts[i] for i in own])
        keys, counts = grams.counted(int(grams.sizes[:sum(trusted[i] for i in own)].sum()))
        n = len(keys)
        out.append(pa.table([pa.array([block] * n, pa.int64()), pa.array([lang] * n, pa.string()), grams.strings(keys), pa.array(counts)], schema=GRAMS))
    return pa.concat_tables(out)


def block_scores(pieces: pa.Table, answers: pa.Table, kind: pa.DataType) -> pa.Table:
    """Log-likelihood and characters of each document of a block; ``kind`` is the type of identifiers."""
    schema = pa.schema([("doc_id", kind), ("lang", pa.string()), ("trusted", pa.bool_()), ("logp", pa.float64()), ("chars", pa.int64())])
    marks = answers.column("key").drop_null().to_pylist()
    if not pieces.num_rows:
        return schema.empty_table()
    rows, trusted, by_lang, texts = block_texts(pieces, set(marks))
    totals, chars = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
    for lang, own in by_lang.items():
        grams = TextGrams([texts[i] for i in own])
        keys, _ = grams.counted(0)
        known = answers.filter(pc.equal(answers.column("lang"), lang)).combine_chunks()
        at = pc.index_in(grams.strings(keys), known.column("gram").combine_chunks())
        values = known.column("v").to_numpy()[at.to_numpy(zero_copy_only=False)]
        totals[own], chars[own] = grams.sums(keys, values), grams.sizes
    return pa.table([rows.column("doc_id"), rows.column("lang_was"), pa.array(trusted, pa.bool_()), pa.array(totals), pa.array(chars)], schema=schema)


def likelihoods(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``(lang, gram, p)`` of the asked n-grams, from the counts ``(lang, gram, n)`` of the highest order; staged."""
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = stage(tables[order + 1].groupBy("lang", F.right("gram", F.lit(order)).alias("gram")).agg(F.count("*").alias("n")), "continuations")
    wanted = {ORDER: asked}
    for order in range(ORDER - 1, 0, -1):
        wanted[order] = stage(wanted[order + 1].select("lang", F.right("gram", F.lit(order)).alias("gram")).distinct(), "asked")
    lower = None
    for order in range(1, ORDER + 1):
        rows, d = tables[order], discounts(tables[order], "n")
        context = F.left("gram", F.lit(order - 1))
        sums = stage(rows.groupBy("lang", context.alias("context")).agg(
            F.sum("n").alias("total"), F.sum(discount(F.col("n"), d)).alias("held")), "contexts")
        found = wanted[order].withColumn("context", context).join(rows, ["lang", "gram"], "left").join(sums, ["lang", "context"], "left")
        if lower is None:
            back = F.lit(UNIFORM)
        else:
            found = found.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), (
                found["lang"] == lower["lang"]) & (F.right(found["gram"], F.lit(order - 1)) == F.col("suffix"))).drop(lower["lang"])
            back = F.col("q")
        n = F.coalesce("n", F.lit(0))
        p = F.when(F.col("total").isNull(), back).otherwise((n - discount(n, d) + F.col("held") * back) / F.col("total"))
        lower = stage(found.select(found["lang"], "gram", p.alias("p")), "likelihoods")
    return lower


def score_perplexity(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE,
) -> DataFrame:
    """``(doc_id, lang, trusted, perplexity, threshold, kept)``, one row per document; ``trusted`` has the identifiers of trusted documents."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(lang_col).cast("string").alias("lang_was"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), whole_text(F.col(text_col)).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(size / BLOCK_CHARS) + 1
    block = F.pmod(F.xxhash64(F.coalesce(F.col("key"), F.md5(F.col("text").cast("binary")))), F.lit(blocks))
    key = F.col(id_col).cast(docs.schema[id_col].dataType).cast("string")
    marks = trusted.select(key.alias("key")).where(F.col("key").isNotNull()).distinct()
    marks = marks.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key")
    marks = stage(marks, "trusted")
    dealt = rows.select(block.alias("block"), "doc_id", "key", "lang_was", "lang", "text")
    packed = dealt.mapInArrow(piece_rows, "block long, piece binary")
    asked = stage(packed.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        block_grams, "block long, lang string, gram string, n long"), "grams")
    counts = stage(asked.where("n > 0").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    known = likelihoods(counts, stage(asked.select("lang", "gram").distinct(), "asked"))
    answers = asked.join(known, ["lang", "gram"]).select("block", "lang", "gram", F.log("p").alias("v"), F.lit(None).cast("string").alias("key"))
    none = F.lit(None).cast("string")
    answers = answers.unionByName(marks.select("block", none.alias("lang"), none.alias("gram"), F.lit(None).cast("double").alias("v"), "key"))
    kind = docs.schema[id_col].dataType
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        partial(block_scores, kind=to_arrow_type(kind)), f"doc_id {kind.simpleString()}, lang string, trusted boolean, logp double, chars long")
    scored = stage(scored.select("doc_id", "lang", "trusted", F.when(F.col("chars") > 0, F.exp(-F.col("logp") / F.col("chars"))).alias("perplexity")), "perplexity")
    cuts = stage(scored.where("trusted and perplexity is not null").groupBy(F.col("lang").alias("_lang")).agg(
        F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")), "cuts")
    found = scored.join(cuts, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return found.select("doc_id", "lang", "trusted", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
