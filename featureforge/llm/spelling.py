"""Spelling variants by dynamic programming over sorted word lists.

Words that differ by one edit share all positions before the edit and all after
it. A word of ``b`` characters, and words of ``b + 1``, meet in two groups: the
edit lies in the first half, and the second half is the key; or the other way
round. A group of more than ``MOST`` words is cut again by halves of its open
window, as often as it takes, so that no key holds an unbounded list: at a
window of one position only the alphabet is left. A pair is found in the one
window that holds the length of its common prefix.

Inside a group the words are sorted. For each of its shorter words the list is
scanned with a banded edit matrix whose rows are kept for the prefix that a
word shares with the one before it; when all cells of a row exceed one edit,
the words that share this prefix are skipped.

The form of a word is its near word of largest count if that is large enough;
counts at least double along forms, so roots are found by pointer jumping.

Defined results: null text has no words; a null identifier is hashed as the
text ``null``; repeated rows count each; equal counts are decided by the
smaller word; an empty table gives an empty result; other columns are not read.
Whole texts are counted; a word may have any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featureforge.llm.common import id_text, whole_text
from featureforge.staging import stage

#: Words of a group that are scanned as one list.
MOST = 128
#: Distinct words that a task holds while it counts.
HELD = 200_000
#: A run is damaged if this number divides its hash.
DAMAGED = 97


def count_rows(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    """(identifier as text, text) to (word, n), summed over at most ``HELD`` words at a time."""
    runs = re.compile("[a-zÀ-ÿ]+").findall
    held: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII letters only
            start = crc32(f"{key}:".encode())
            for run, n in Counter(runs(lowered)).items():
                h = crc32(run.encode(), start)
                if h % DAMAGED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                if len(run) >= least_chars:
                    held[run] += n
            if len(held) > HELD:
                yield flushed()
    if held:
        yield flushed()


def count_words(docs: DataFrame, least_chars: int = 5, least_n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all documents."""
    rows = docs.select(id_text(F.col(id_col)).alias("key"), whole_text(F.col(text_col)).alias("text"))
    counts = rows.mapInArrow(lambda it: count_rows(it, least_chars), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def banded_scan(query: str, stems: list[str], shared: list[int]) -> Iterator[int]:
    """Positions in a sorted list of the words at exactly one edit from ``query``.

    ``shared[i]`` is the common prefix of words ``i - 1`` and ``i``. Row ``d`` has
    the distances of the first ``d`` characters of a word to ``d - 1``, ``d`` and
    ``d + 1`` characters of the query.
    """
    size = len(query)
    q = "\0" + query + "\0\0\0"  # no word holds this character
    rows = [(9, 0, 1)]
    i, count = 0, len(stems)
    while i < count:
        word = stems[i]
        d, end = len(rows) - 1, len(word)
        left, mid, right = rows[d]
        alive = True
        while d < end:
            c = word[d]
            a = left if c == q[d] else left + 1
            if mid < a:
                a = mid + 1 if mid + 1 < a else a
            b = mid if c == q[d + 1] else mid + 1
            if right < b:
                b = right + 1 if right + 1 < b else b
            if a < b - 1:
                b = a + 1
            e = right if c == q[d + 2] else right + 1
            if b < e - 1:
                e = b + 1
            left, mid, right = a, b, e
            d += 1
            if a > 1 and b > 1 and e > 1:
                alive = False
                break
            rows.append((a, b, e))
        if alive and -1 <= size - end <= 1 and rows[end][size - end + 1] == 1:
            yield i
        i += 1
        if not alive:
            while i < count and shared[i] >= d:
                i += 1
        if i < count:
            # words that were skipped share at least ``d`` characters, so the prefix shared with the last one is what counts
            del rows[shared[i] + 1:]


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def group_pairs(stems: list[str], words: list[str], counts: list[int], longer: list[bool], width: int, last: bool) -> Iterator[tuple[int, int]]:
    """Positions of the near pairs whose edit lies in the window of this group."""
    shared = [0, *map(common_prefix, stems, stems[1:])]
    for i, query in enumerate(stems):
        if longer[i]:
            continue
        for j in banded_scan(query, stems, shared):
            if (longer[j] or j > i) and (last or common_prefix(query, stems[j]) < width):
                yield i, j


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, stem, word, n, longer, width, last), sorted by key and stem, to (word, n, near, near_n), both ways round."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    group: list[tuple] = []

    def close() -> None:
        if len(group) > 1:
            _, stems, words, counts, longer, width, last = zip(*group)
            for i, j in group_pairs(stems, words, counts, longer, width[0], last[0]):
                for a, b in ((i, j), (j, i)):
                    for column, value in zip(out, (words[a], counts[a], words[b], counts[b])):
                        column.append(value)
        group.clear()

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())],
            ["word", "n", "near", "near_n"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if group and group[0][0] != row[0]:
                close()
                if len(out[0]) > 10_000:
                    yield flushed()
            group.append(row)
    close()
    yield flushed()


def windowed(rows: DataFrame) -> DataFrame:
    """Key and open part of words ``(word, n, b, lo, hi)`` whose edit lies from position ``lo`` to before ``hi``."""
    tail = F.col("b") - F.col("hi")
    length = F.length("word")
    return rows.select(
        F.concat_ws(":", "b", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")), F.substring(F.col("word"), length - tail + 1, tail)).alias("key"),
        F.substring(F.col("word"), F.col("lo") + 1, length - F.col("lo") - tail).alias("stem"),
        "word", "n", (length > F.col("b")).alias("longer"), (F.col("hi") - F.col("lo")).alias("width"), (F.col("hi") == F.col("b")).alias("last"),
        "b", "lo", "hi")


def halves(rows: DataFrame) -> DataFrame:
    """Every row for the first and for the second half of its window."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    return windowed(rows.select("word", "n", "b", F.explode(parts).alias("w")).select("word", "n", "b", "w.lo", "w.hi"))


def near_pairs(words: DataFrame, least_chars: int = 5, most: int = MOST) -> DataFrame:
    """``(word, n, near, near_n)`` of all pairs ``(word, n)`` at one edit, both ways round."""
    base = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda b: b >= least_chars)
    rows = words.select("word", "n", F.explode(base).alias("b")).select("word", "n", "b", F.lit(0).alias("lo"), F.col("b").alias("hi"))
    rows, ready = halves(rows), None
    while True:
        sizes = rows.where(F.col("width") > 1).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most)
        large = stage(sizes.select("key"), "crowded")
        done = large.isEmpty()
        small = rows if done else rows.join(large, "key", "left_anti")
        small = small.select("key", "stem", "word", "n", "longer", "width", "last")
        ready = small if ready is None else ready.unionByName(small)
        if done:
            break
        rows = stage(halves(rows.join(large, "key", "left_semi").select("word", "n", "b", "lo", "hi")), "halves")
    dealt = ready.repartition("key").sortWithinPartitions("key", "stem")
    return dealt.mapInArrow(pair_rows, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every ``(word, form)``: the last word of its chain, by pointer jumping."""
    found = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("at"), F.col("root").alias("further"))
        found = stage(found.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def group_variants(
    docs: DataFrame, least_chars: int = 5, least_n: int = 3, factor: int = 2, id_col: str = "doc_id", text_col: str = "text", most: int = MOST,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word of the documents."""
    words = stage(count_words(docs, least_chars, least_n, id_col, text_col), "words")
    pairs = near_pairs(words, least_chars, most)
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    found = pairs.unionByName(alone).groupBy("word").agg(F.first("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= F.col("n") * factor
    found = stage(found.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
