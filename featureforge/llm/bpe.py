"""Byte-level BPE encoding and decoding in Arrow batches.

Words are the matches of the tokenizer's pattern. A word starts as its bytes;
the neighbouring pair of the lowest rank, the leftmost of equal ones, is merged
until no pair has a rank. Ranks travel to the tasks as a map of bounded size.

The words that all documents have most often are merged once and become a table
of bounded size that travels to the tasks: 128-bit hashes of words, and their ids
as one run of bytes, some 40 bytes a word. A word that is not in it is merged
where it stands, once a block and by the same function, so that ids do not depend
on the table: it only saves time. One Python worker a task does both; nothing is
exchanged.

Decoding joins the piece of every id.

Defined results: null text is empty and has no ids; repeated rows are returned
each; an empty table gives an empty result; other columns are kept, but a column
with the name of the result is replaced by it. Texts are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from featureforge.llm.common import whole_text
from featureforge.staging import stage

#: Fixed value: the pattern that cuts text into words, with Unicode white space written out (Java's ``\s`` is ASCII).
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Most words in the table of frequent words, most characters of one, and characters of text whose words are looked up together.
FREQUENT, LONGEST, BLOCK_CHARS = 1 << 19, 32, 1_000_000
#: Most bytes of a word that is merged without a heap, and most words whose ids a task keeps from block to block.
SHORT, KEPT = 64, 1 << 16
#: The same for ASCII text, which Python's own module cuts faster.
ASCII_PATTERN = PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+| ?0-9+", " ?[A-Za-z]+| ?[0-9]+").replace(SPACE, r"\x09-\x0D\x20")
NO_RANK = 2**31 - 1


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by piece, from a file of base64 pieces and ranks; at most some 10^5 entries, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def merged_short(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of a word of few bytes: the ranks of its neighbouring pairs are a list, searched for the lowest at each merge."""
    get, ends = ranks.get, list(range(len(word) + 1))  # piece i is word[ends[i]:ends[i + 1]]
    pairs = [get(word[i:i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) != NO_RANK:
        i = pairs.index(least)
        del pairs[i], ends[i + 1]
        if i < len(pairs):
            pairs[i] = get(word[ends[i]:ends[i + 2]], NO_RANK)
        if i:
            pairs[i - 1] = get(word[ends[i - 1]:ends[i + 1]], NO_RANK)
    return [get(word[a:b], NO_RANK) for a, b in zip(ends, ends[1:])]


def merged(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of one word. Pairs of a long word wait in a heap by rank and place, so that it costs n log n."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) <= SHORT:
        return merged_short(word, ranks)
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts here; 0: no longer a start
    pairs = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i:i + 2])) is not None]
    heapify(pairs)
    while pairs:
        _, start, end = heappop(pairs)
        middle = ends[start]
        if not middle or middle == n or ends[middle] != end:
            continue  # one of the two has been merged meanwhile
        ends[start], ends[middle] = end, 0
        if end < n:
            before[end] = start
            if (rank := ranks.get(word[start:ends[end]])) is not None:
                heappush(pairs, (rank, start, ends[end]))
        if (left := before[start]) >= 0 and (rank := ranks.get(word[left:end])) is not None:
            heappush(pairs, (rank, left, end))
    return [ranks.get(word[i:end], NO_RANK) for i, end in enumerate(ends) if end]


def merged_text(word: str, ranks: Mapping[bytes, int]) -> str:
    return ",".join(map(str, merged(word.encode("utf-8", "surrogatepass"), ranks)))


def merged_rows(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    """(word) to (key, check, ids): the word's hashes and ids."""
    for batch in batches:
        some = batch.column(0).to_pylist()
        hashes = word_hashes(some).view(np.int64)
        ids = [merged_text(w, ranks.value) for w in some]
        yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(ids, pa.string())], ["key", "check", "ids"])


def frequent_words(docs: DataFrame, ranks, text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """``(key, check, ids)``: hashes and ids of at most ``most`` of the words that all documents have most often, merged once; staged.

    Words enter by steps of their count, an eighth of a power of two wide; the last step that would not fit as a whole stays out.
    """
    counts = docs.select(F.explode(words(whole_text(F.col(text_col)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = stage(counts.where((F.col("n") > 1) & (F.length("word") <= LONGEST)).withColumn("step", F.floor(F.log2("n") * 8)), "words")
    room, first = most, None
    for r in counts.groupBy("step").agg(F.count("*").alias("size")).orderBy(F.desc("step")).collect():  # at most 8 * 63 rows
        if r["size"] > room:
            break
        room, first = room - r["size"], r.step
    top = counts.where(F.col("step") >= first) if first is not None else counts.limit(0)
    spread = top.repartition(docs.sparkSession.sparkContext.defaultParallelism, "word")  # few bytes, but much work for each
    return stage(spread.select("word").mapInArrow(lambda it: merged_rows(it, ranks), "key long, check long, ids string"), "merged")


def word_hashes(some: list[str]) -> np.ndarray:
    """Two 64-bit numbers for each word."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w.encode("utf-8", "surrogatepass")) for w in some]), np.uint64).reshape(-1, 2)


class WordTable(NamedTuple):
    keys: np.ndarray  # sorted
    checks: np.ndarray
    ends: np.ndarray  # of the words' ids in ``ids``
    ids: bytes

    def ids_of(self, i: int) -> str:
        return self.ids[self.ends[i - 1] if i else 0:self.ends[i]].decode()


def hashed_table(words: pa.Table) -> WordTable:
    """The table of (key, check, ids), without a Python object for each word."""
    keys = np.asarray(words.column("key")).view(np.uint64)
    _, order, counts = np.unique(keys, return_index=True, return_counts=True)
    order = order[counts == 1]
    if not len(order):
        return WordTable(keys[:0], keys[:0], np.empty(0, np.int64), b"")
    ids = pa.concat_arrays(words.column("ids").cast(pa.large_binary()).chunks).take(pa.array(order))
    ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[1:].copy()
    return WordTable(keys[order], np.asarray(words.column("check")).view(np.uint64)[order], ends, ids.buffers()[2].to_pybytes()[:ends[-1]])


def word_table(some: list[str], ids: list[str]) -> WordTable:
    hashes = word_hashes(some).view(np.int64)
    return hashed_table(pa.table({"key": hashes[:, 0], "check": hashes[:, 1], "ids": pa.array(ids, pa.string())}))


def found_words(table: WordTable, some: list[str]) -> np.ndarray:
    """Numbers of the words in the table, -1 for those that it lacks."""
    if not len(table.keys) or not some:
        return np.full(len(some), -1, np.int64)
    hashes = word_hashes(some)
    at = np.minimum(np.searchsorted(table.keys, hashes[:, 0]), len(table.keys) - 1)
    return np.where((table.keys[at] == hashes[:, 0]) & (table.checks[at] == hashes[:, 1]), at, -1)


def encoded_rows(batches: Iterator[pa.RecordBatch], shared, ranks, block_chars: int) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, ids); the distinct words of a block are looked up, and merged where the table lacks them."""
    import re

    import regex

    cut, cut_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
    known: dict[str, str] = {}
    for batch in batches:
        start, table = 0, shared.value
        while start < batch.num_rows:
            rows, size, end = [], 0, start
            while end < batch.num_rows and size < block_chars:
                text = batch.column(1)[end].as_py()
                rows.append(cut_ascii(text) if text.isascii() else cut(text))
                size, end = size + len(text), end + 1
            if len(known) > KEPT:
                known.clear()
            distinct = list(set().union(*rows).difference(known))
            known.update((w, table.ids_of(i) if i >= 0 else merged_text(w, ranks.value)) for w, i in zip(distinct, found_words(table, distinct).tolist()))
            coded = [",".join(map(known.__getitem__, row)) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(coded, pa.string())], ["_row", "_ids"])
            start = end


def decoded_rows(batches: Iterator[pa.RecordBatch], shared, ids_col: str, block_chars: int) -> Iterator[pa.RecordBatch]:
    """(row) with ids to (row, bytes)."""
    pieces = {str(rank): piece for piece, rank in shared.value.items()}
    for batch in batches:
        start, coded = 0, batch.column(0).field(ids_col)
        while start < batch.num_rows:
            out, size, end = [], 0, start
            while end < batch.num_rows and size < block_chars:
                ids = coded[end].as_py()
                out.append(None if ids is None else b"".join([pieces.get(i, b"") for i in ids.split(",")]))
                size, end = size + len(ids or ""), end + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(out, pa.binary())], ["_row", "_decoded"])
            start = end


def others(columns: Sequence[str], name: str) -> list[Column]:
    """The columns of ``_row`` but one of this name."""
    return [F.col("_row").getField(c).alias(c) for c in columns if c != name]


def encode(
    docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", most: int = FREQUENT, block_chars: int = BLOCK_CHARS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The documents with their ids, as text joined by commas; of their columns those in ``keep`` (None: all), which spares the texts a way back."""
    columns = docs.columns if keep is None else list(keep)
    context = docs.sparkSession.sparkContext
    ranks = context.broadcast(load_ranks(path))
    shared = context.broadcast(hashed_table(frequent_words(docs, ranks, text_col, most).toArrow()))  # at most ``most`` rows
    rows = docs.select(F.struct(*columns).alias("_row"), whole_text(F.col(text_col)).alias("_text"))
    out = T.StructType([rows.schema.fields[0], T.StructField("_ids", T.StringType())])
    rows = rows.mapInArrow(lambda it: encoded_rows(it, shared, ranks, block_chars), out)
    return rows.select(*others(columns, ids_col), F.col("_ids").alias(ids_col))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with the bytes that their ids stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    rows = docs.select(F.struct("*").alias("_row"))
    out = T.StructType([rows.schema.fields[0], T.StructField("_decoded", T.BinaryType())])
    rows = rows.mapInArrow(lambda it: decoded_rows(it, shared, ids_col, block_chars), out)
    return rows.select(*others(docs.columns, out_col), F.col("_decoded").alias(out_col))


def token_count(ids: Column) -> Column:
    return F.when(ids == "", F.lit(0)).otherwise(F.length(ids) - F.length(F.translate(ids, ",", "")) + 1).cast("long")
