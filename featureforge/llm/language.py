"""Language identification with a string kernel.

A text is the set of its distinct character n-grams of 1 to ``LONGEST`` letters
(lower-cased; whatever is no letter counts as one space). The blended-spectrum
presence kernel of two texts is the number of n-grams that they share, divided by
the root of the product of their set sizes. It is approximated by the kernel
values with ``LANDMARKS`` landmark texts (Nyström), on which a ridge regression per
language, one against the rest, is fitted.

A score is ``K(x, landmarks) A``. ``K`` is itself a product of presence matrices,
so ``A`` is multiplied into the landmarks' matrix once: a batch is scored by one
product of its presence matrix (documents by n-grams) with weights (n-grams by
languages). A table of the landmarks' n-grams is all that travels to the tasks.

The model is fitted on a bounded sample: up to ``per_language`` distinct texts of
each language by the order of their hashes, texts of 200 to 20,000 characters
first; ``landmarks`` of them, in equal shares. Every document is scored whole.

Defined results: null text, and text without a letter, is ``und`` with score 0;
without labelled texts all are ``und``; a null identifier is hashed as the text
``null``; equal scores go to the first language by code point; repeated rows are
returned each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from featureforge.llm.common import id_text, whole_text
from featureforge.staging import stage

#: Longest n-gram, landmarks of all languages together, and texts of a language that the regression sees.
LONGEST, LANDMARKS, PER_LANGUAGE = 4, 256, 1024
RIDGE = 0.1
#: Documents whose identifier has this remainder are held out.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # sorted hashes of the landmarks' n-grams
    weights: np.ndarray  # n-grams by languages


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and whether it is a letter or a mark."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    return kinds == "L", (kinds == "L") | (kinds == "M")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams_of(text: str) -> np.ndarray | None:
    """Sorted distinct hashes of the n-grams; None if the text has no letter."""
    is_letter, is_kept = letters()
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if not is_letter[codes].any():
        return None
    codes = np.where(is_kept[codes], codes, 32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])].astype(np.uint64)
    found, last = [], np.zeros(len(codes), np.uint64)
    for n in range(1, min(LONGEST, len(codes)) + 1):
        last = mixed(last[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:] + np.uint64(n << 32))
        found.append(last)
    return np.unique(np.concatenate(found))


def presence(sets: list[np.ndarray], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers in ``table`` of the sets' n-grams, and where each set starts among them; one further column is for n-grams not in it."""
    every = np.concatenate(sets)
    at = np.searchsorted(table, every)
    known = table[np.minimum(at, len(table) - 1)] == every
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    return np.where(known, at, len(table)), starts


def product(sets: list[np.ndarray], table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The normalised presence matrix of ``sets`` (none empty) times ``weights``."""
    columns, starts = presence(sets, table)
    padded = np.vstack([weights, np.zeros((1, weights.shape[1]), weights.dtype)])
    sums = np.add.reduceat(padded[columns], starts, axis=0, dtype=np.float64)
    return sums / np.sqrt([[len(s)] for s in sets])


def kernel_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, kernel): kernel values with every landmark."""
    table, marks = model.value
    for batch in batches:
        langs, values = [], []
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            grams = grams_of(text)
            if grams is not None:
                langs.append(lang)
                values.append(product([grams], table, marks)[0].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(values, pa.list_(pa.float64()))], ["lang", "kernel"])


def sample_texts(rows: DataFrame, per_language: int) -> DataFrame:
    """``(lang, text, rank)``: up to ``per_language`` distinct texts of each language from ``(lang, text)``; staged."""
    size = F.length("text")
    keys = rows.where(F.col("text").rlike(r"\p{L}")).select(
        "lang", (~size.between(200, 20_000)).alias("odd"), F.xxhash64("text").alias("h"))
    ranked = keys.distinct().withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("odd", "h"))).where(F.col("rank") <= per_language)
    ranked = stage(ranked.select(F.col("lang").alias("_lang"), F.col("h").alias("_h"), "rank"), "sample")
    same = (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_h"))
    return stage(rows.join(ranked, same).groupBy("lang", "rank").agg(F.min("text").alias("text")), "sample")


def fit_languages(rows: DataFrame, landmarks: int = LANDMARKS, per_language: int = PER_LANGUAGE, ridge: float = RIDGE) -> Model | None:
    """A model from ``(lang, text)``; None if there is nothing to learn from. The driver holds the landmarks and one row of kernel values per sampled text."""
    spark = rows.sparkSession
    sample = sample_texts(rows, per_language)
    names = [r.lang for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not names:
        return None
    chosen = sample.where(F.col("rank") <= max(4, landmarks // len(names))).orderBy("lang", "rank").collect()
    sets = [grams_of(r.text) for r in chosen]
    table = np.unique(np.concatenate(sets))
    marks = np.zeros((len(table), len(sets)), np.float32)
    for i, s in enumerate(sets):
        marks[np.searchsorted(table, s), i] = 1 / np.sqrt(len(s))
    shared = spark.sparkContext.broadcast((table, marks))
    spread = sample.select("lang", "text").repartition(spark.sparkContext.defaultParallelism)
    found = spread.mapInArrow(lambda it: kernel_rows(it, shared), "lang string, kernel array<double>").toArrow()
    kernel = np.array(found.column("kernel").to_pylist())
    order = np.lexsort(kernel.T[::-1])  # rows come in any order; sums should not depend on it
    kernel, langs = kernel[order], np.array(found.column("lang").to_pylist())[order]
    among = np.vstack([product([s], table, marks) for s in sets])
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    used = values > 1e-9 * values[-1]
    root = vectors[:, used] / np.sqrt(values[used])
    z = kernel @ root
    target = np.where(langs[:, None] == np.array(names), 1.0, -1.0)
    coefficients = root @ np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ target)
    return Model(names, table, (marks @ coefficients).astype(np.float32))


def scored_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) to (doc_id, held_out, lang_pred, score)."""
    for batch in batches:
        model = shared.value
        langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
        texts = batch.column(2).to_pylist()
        for start in range(0, len(texts) if model else 0, 256):
            sets = [(i, grams_of(t)) for i, t in enumerate(texts[start:start + 256], start)]
            sets = [(i, s) for i, s in sets if s is not None]
            if not sets:
                continue
            found = product([s for _, s in sets], model.grams, model.weights)
            for (i, _), best, row in zip(sets, found.argmax(axis=1), found):
                langs[i], scores[i] = model.languages[best], float(np.clip((row[best] + 1) / 2, 0, 1))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    landmarks: int = LANDMARKS, per_language: int = PER_LANGUAGE, ridge: float = RIDGE,
) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per document; learns from the rows that are not held out."""
    held = F.crc32(id_text(F.col(id_col)).cast("binary")) % FOLDS == HELD_OUT
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held.alias("held_out"), whole_text(F.col(text_col)).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit_languages(rows.where(~F.col("held_out") & F.col("lang").isNotNull()).select("lang", "text"), landmarks, per_language, ridge)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        lambda it: scored_rows(it, shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
