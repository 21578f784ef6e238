"""Toxicity by class-conditional Kneser-Ney models.

Two character models of order ``ORDER`` over words, one for toxic and one for
ordinary training documents, count in how many documents a word occurs. Both
back off to one shared chain of continuation counts, so that an expression
that neither class has seen counts for neither. What a character adds is the
difference of its two log-likelihoods.

A document's statistic is the largest length-normalised difference over
windows of ``WINDOW`` words, so that a short insult in a long text shows. A
logistic curve over that statistic, fitted on documents that the fitted half
of the training rows did not contain, gives the score.

Learnt from are at most ``TRAINING_ROWS`` labelled rows, those with the smallest
hash of the identifier; this bounds the table of labels that is broadcast, so
that no text crosses an exchange. The model travels as two arrays
of fixed size: differences of grams and of contexts, by hash.

Defined results: null and empty texts have the statistic 0; a document without
a label, or with a null one, is scored but not learnt from; of several labels
the largest counts; repeated rows are scored each; without training rows of
both classes every score is 0.25; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from featureforge.llm.common import id_text, whole_text
from featureforge.staging import stage

ORDER, WINDOW, LEAST_CHARS = 6, 4, 24
#: Sizes of the shipped arrays (16 MB and 4 MB); fixed, whatever the corpus.
GRAM_BITS, CONTEXT_BITS = 22, 20
PAD = " "
#: Most labelled rows to learn from: an identifier and a label each, at most some 32 MB to broadcast.
TRAINING_ROWS = 1 << 20
#: Words whose sums a task remembers.
REMEMBERED = 400_000
#: Width of a bin of the statistic when the curve is fitted.
BIN = 0.01


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def word_presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, half) to (word, toxic, half, n): documents of a batch that have the word."""
    for batch in batches:
        seen: dict[tuple[int, int], Counter] = {}
        for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
            seen.setdefault((toxic, half), Counter()).update(set(split_words(text)))
        for (toxic, half), words in seen.items():
            n = len(words)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(words), pa.string()), pa.array([toxic] * n, pa.int32()), pa.array([half] * n, pa.int32()),
                pa.array(list(words.values()), pa.int64())], ["word", "toxic", "half", "n"])


def discounts(counts: DataFrame, column: str) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    n = counts.agg(*[F.count(F.when(F.col(column) == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(1, v) for v in n)
    y = n1 / (n1 + 2 * n2)
    bound = lambda d, most: float(min(max(d, 0.05), most))
    return bound(1 - 2 * y * n2 / n1, 0.95), bound(2 - 3 * y * n3 / n2, 1.9), bound(3 - 4 * y * n4 / n3, 2.85)


def discount(count: Column, d: tuple[float, float, float]) -> Column:
    return F.when(count <= 0, 0.0).when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


def shared_backoff(grams: DataFrame) -> DataFrame:
    """``(suffix, q)``: likelihood of the last character after the ``ORDER`` - 2 before it, from continuation counts of both classes."""
    levels = []
    rows = grams.select(F.col("gram"))
    for order in range(ORDER - 1, 0, -1):
        rows = stage(rows.groupBy(F.right("gram", F.lit(order)).alias("gram")).agg(F.count("*").alias("n")), "continuations")
        levels.append((order, rows))
        rows = rows.select("gram")
    known = None
    for order, rows in reversed(levels):
        d = discounts(rows, "n")
        rows = rows.withColumn("context", F.left("gram", F.lit(order - 1)))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount(F.col("n"), d)).alias("held"))
        rows = rows.join(sums, "context")
        if known is None:
            lower = F.lit(1.0 / 65_536)
        else:
            rows = rows.join(known.withColumnRenamed("gram", "suffix"), F.right("gram", F.lit(order - 1)) == F.col("suffix"), "left")
            lower = F.coalesce("q", F.lit(1.0 / 65_536))
        q = (F.col("n") - discount(F.col("n"), d) + F.col("held") * lower) / F.col("total")
        known = stage(rows.select("gram", q.alias("q")), "backoff")
    return known.withColumnRenamed("gram", "suffix")


def fit(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of log-likelihood differences, of grams and of contexts, by hash; from ``(word, c0, c1)``."""
    padded = F.concat(F.lit(PAD * (ORDER - 1)), F.col("word"), F.lit(PAD))
    grams = words.select("c0", "c1", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("gram"))
    grams = stage(grams.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "grams")
    d = {k: discounts(grams, f"c{k}") for k in (0, 1)}
    context = F.left("gram", F.lit(ORDER - 1))
    contexts = stage(grams.groupBy(context.alias("context")).agg(*[x for k in (0, 1) for x in (
        F.sum(f"c{k}").alias(f"t{k}"), F.sum(discount(F.col(f"c{k}"), d[k])).alias(f"h{k}"))]), "contexts")
    held = lambda k: F.when(F.col(f"t{k}") > 0, F.col(f"h{k}") / F.col(f"t{k}")).otherwise(1.0)
    joined = grams.withColumn("context", context).join(contexts, "context").withColumn(
        "suffix", F.right("gram", F.lit(ORDER - 1))).join(shared_backoff(grams), "suffix")

    def likelihood(k: int) -> Column:
        c = F.col(f"c{k}")
        own = F.when(F.col(f"t{k}") > 0, (c - discount(c, d[k])) / F.col(f"t{k}")).otherwise(0.0)
        return own + held(k) * F.col("q")

    gram = joined.select(F.xxhash64("gram").alias("h"), (F.log(likelihood(1)) - F.log(likelihood(0))).alias("v"))
    back = contexts.select(F.xxhash64("context").alias("h"), (F.log(held(1)) - F.log(held(0))).alias("v"))
    return dense(gram, GRAM_BITS), dense(back, CONTEXT_BITS)


def dense(values: DataFrame, bits: int) -> np.ndarray:
    """Array by the low bits of the hash; at most 2 ** bits rows reach the driver."""
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    rows = values.groupBy(place.alias("i")).agg(F.avg("v").cast("float").alias("v")).toArrow()
    out = np.full(1 << bits, np.nan, np.float32)
    out[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
    return out


def statistic_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(…, text) to (…, statistic): the last column is scored and replaced."""
    import xxhash

    grams, contexts = model.value
    gram_mask, context_mask = len(grams) - 1, len(contexts) - 1
    digest = xxhash.xxh64_intdigest
    known: dict[str, float] = {}

    def value(word: str) -> float:
        padded, total = PAD * (ORDER - 1) + word + PAD, 0.0
        for i in range(len(word) + 1):
            v = grams[digest(padded[i:i + ORDER].encode("utf-8", "surrogatepass"), 42) & gram_mask]
            if v != v:
                v = contexts[digest(padded[i:i + ORDER - 1].encode("utf-8", "surrogatepass"), 42) & context_mask]
            if v == v:
                total += float(v)
        return total

    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            words = split_words(text)
            if not words:
                out.append(0.0)
                continue
            for w in words:
                if w not in known:
                    known[w] = value(w)
            sums = np.cumsum([0.0, *[known[w] for w in words]])
            chars = np.cumsum([0, *[len(w) + 1 for w in words]])
            k = min(WINDOW, len(words))
            out.append(float(((sums[k:] - sums[:-k]) / np.maximum(chars[k:] - chars[:-k], LEAST_CHARS)).max()))
            if len(known) > REMEMBERED:
                known.clear()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*batch.schema.names[:-1], "statistic"])


def statistics(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``docs``, whose last column is a text, with the statistic in its place."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*docs.schema.fields[:-1], T.StructField("statistic", T.DoubleType())])
    return docs.mapInArrow(lambda it: statistic_rows(it, sent), out)


def fit_curve(rows: list) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps with a small ridge, from ``(bin, toxic, n)``."""
    x = np.array([r["bin"] * BIN for r in rows], float)
    y, n = np.array([r["toxic"] for r in rows], float), np.array([r["n"] for r in rows], float)
    n = n * (1000 / n.sum())
    design = np.stack([np.ones_like(x), x], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-3, 1e-3])

    def loss(w):
        z = design @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + w @ ridge @ w / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        slope = design.T @ (n * (p - y)) + ridge @ w
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, slope)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7,
    carry: bool = False,
) -> DataFrame:
    """``(doc_id, held_out, statistic, score, predicted)``, one row per document; with ``carry`` also the whole ``row``.

    Rows whose CRC of the identifier leaves 1 modulo 3 are held out.
    """
    code = F.crc32(id_text(F.col("doc_id")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    marks = marks.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 3 != 1)
    marks = stage(marks.orderBy(F.xxhash64("_id")).limit(TRAINING_ROWS), "marks")
    learnt = rows.join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("text", "toxic", (F.floor(code / 3) % 2).cast("int").alias("half"))
    learnt = stage(learnt, "learnt")
    words = learnt.mapInArrow(word_presence, "word string, toxic int, half int, n long")
    times = lambda toxic, half: F.coalesce(F.sum(F.when((F.col("toxic") == toxic) & F.col("half").isin(*half), F.col("n"))), F.lit(0))
    words = stage(words.groupBy("word").agg(
        times(0, (0,)).alias("a0"), times(1, (0,)).alias("a1"), times(0, (0, 1)).alias("c0"), times(1, (0, 1)).alias("c1")), "words")

    tried = statistics(learnt.where(F.col("half") == 1).select("toxic", "text"), fit(words.select("word", F.col("a0").alias("c0"), F.col("a1").alias("c1")).where("c0 + c1 > 0")))
    bins = tried.groupBy("toxic", F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "statistic")) / BIN).alias("bin")).agg(F.count("*").alias("n")).collect()  # at most 2 * 4,001 rows
    if {r["toxic"] for r in bins} >= {0, 1}:
        intercept, slope = fit_curve([r for r in bins if r["toxic"] in (0, 1)])
    else:
        intercept, slope = float(np.log(1 / 3)), 0.0
    scored = docs.select(F.col(id_col).alias("doc_id"), *([F.struct("*").alias("row")] if carry else []), whole_text(F.col(text_col)).alias("text"))
    found = statistics(scored, fit(words.select("word", "c0", "c1")))
    score = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("statistic"))))
    return found.select(
        "doc_id", (code % 3 == 1).alias("held_out"), "statistic", score.alias("score"), (score >= threshold).cast("int").alias("predicted"),
        *(["row"] if carry else []))
