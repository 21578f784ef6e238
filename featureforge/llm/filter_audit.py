"""Audit of filters that interact, kept up to date by a stream with retractions.

All files run through micro-batches of an available-now stream. A row becomes
the mask of the text filters that it fails. For every text the keyed state
(RocksDB, no expiry) holds the smallest identifier and the masks of the
rows that have it. A row with a larger identifier fails the duplicate filter; a
row with a smaller one becomes the holder, and the earlier holder's mask is
retracted from its part's counters and added again with the duplicate filter.
The stream writes these signed counts; their sums are the part counters.

Everything the audit reports follows from the counters of a part's 32 masks.

A state key holds the texts of one digest range, some ``TEXTS_PER_KEY`` of the
first call's rows; the number of keys stays with the state. Rows of one text are
reduced inside each task before they are dealt out by key: those that lose
against a smaller identifier of the same Arrow batch need no state and are
spread over ``SPREAD`` keys, so a text that many rows share sends one row of
each Arrow batch to its state.

The state outlives the call in its folder; a later call with the same folder
reads only files that are new.

Defined results: null text is empty; a null identifier is larger than all
others and has no labels; rows that share identifier and text do not fail the
duplicate filter through each other; of several labels of an identifier any 1
counts; a null language is the part named by the empty string, like the empty
language; parts are those that occur, so an empty table gives an empty result;
other columns are not read. Texts are read whole and told apart by SHA-256.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from featureforge.llm.common import settings, stream_parquet, whole_text
from featureforge.llm.streaming_dedup import STATE_SETTINGS
from featureforge.staging import new_folder, stage

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
DUPLICATE = BIT["E"]
#: Texts that a state key should hold, and keys over which rows without state are dealt.
TEXTS_PER_KEY, SPREAD = 128, 256
MICRO_BATCHES = 4
NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
MARKED = re.compile(rb"[#$%&*|]").search
DELTA = "part string, mask int, n long, good long, toxic long"


def text_mask(raw: bytes, chars: int, least_words: int = 200) -> int:
    """Bits of the filters A to D that a text, given as UTF-8, fails."""
    words = raw.split()  # bytes: at ASCII white space
    mask = BIT["A"] * (len(words) < least_words)
    mask |= BIT["B"] * (100 * len(set(words)) < 50 * len(words))
    mask |= BIT["C"] * (100 * len(raw.translate(None, NOT_CAPITALS)) > 3 * chars)
    return mask | BIT["D"] * (MARKED(raw) is not None)


def text_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """(id, part, text) to (id, part, key, digest, mask)."""
    for batch in batches:
        found, digests, masks = [], [], []
        for text in batch.column(2).to_pylist():
            raw = text.encode("utf-8", "surrogatepass")
            digest = sha256(raw)
            found.append(int.from_bytes(digest.digest()[:7]) % keys)
            digests.append(digest.hexdigest())
            masks.append(text_mask(raw, len(text)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(found, pa.int64()), pa.array(digests, pa.string()), pa.array(masks, pa.int32())], ["id", "part", "key", "digest", "mask"])


def reduced_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest, no_id, id, part, mask, good, toxic) to the same and n.

    Of a text the rows of the smallest identifier stay; the others get the
    duplicate filter and a key below 0.
    """
    for batch in batches:
        names = batch.schema.names
        least: dict[str, tuple] = {}
        rows = list(zip(*(batch.column(c).to_pylist() for c in names)))
        for _, digest, no_id, id_, *_ in rows:
            if digest not in least or (no_id, id_) < least[digest]:
                least[digest] = (no_id, id_)
        out: Counter = Counter()
        for i, (key, digest, no_id, id_, part, mask, good, toxic) in enumerate(rows):
            if (no_id, id_) == least[digest]:
                out[key, digest, no_id, id_, part, mask, good, toxic] += 1
            else:
                out[-1 - key % SPREAD, "", True, rows[0][3], part, mask | DUPLICATE, good, toxic] += 1
        columns = list(zip(*((*k, n) for k, n in out.items()))) or [[]] * (len(names) + 1)
        types = [*batch.schema.types, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*names, "n"])


def signed_counts(rows, held: dict[str, tuple]) -> Counter:
    """What ``rows`` (digest, no_id, id, part, mask, good, toxic, n) change; ``held`` has (least, holders) by digest and is brought up to date."""
    out: Counter = Counter()
    for digest, no_id, id_, part, mask, good, toxic, n in rows:
        at, row = (bool(no_id), id_), (part, mask, good, toxic)
        least, holders = held.get(digest, (None, {}))
        if least is not None and at > least:
            out[part, mask | DUPLICATE, good, toxic] += n
            continue
        if least is None or at < least:
            for (part_, mask_, *marks), m in holders.items():
                out[(part_, mask_, *marks)] -= m
                out[(part_, mask_ | DUPLICATE, *marks)] += m
            holders = {}
        held[digest] = at, holders | {row: holders.get(row, 0) + n}
        out[row] += n
    return out


def update_texts(key: tuple, frames, state: GroupState):
    """Signed counts from the rows of one key, whose texts' smallest identifiers it updates."""
    import pandas as pd

    names = ("digest", "no_id", "id", "part", "mask", "good", "toxic", "n")
    rows = [row for frame in frames for row in zip(*(frame[c].tolist() for c in names))]
    if key[0] < 0:  # rows that need no state
        out: Counter = Counter()
        for *_, part, mask, good, toxic, n in rows:
            out[part, mask, good, toxic] += n
    else:
        held = {}
        if state.exists:
            held = {d: (tuple(least), {tuple(k): n for k, n in holders}) for d, least, holders in json.loads(state.get[0])}
        out = signed_counts(rows, held)
        state.update((json.dumps([(d, least, list(holders.items())) for d, (least, holders) in held.items()]),))
    yield pd.DataFrame(
        [(part, mask, n, n * good, n * toxic) for (part, mask, good, toxic), n in out.items() if n], columns=["part", "mask", "n", "good", "toxic"])


def state_keys(spark: SparkSession, known: DataFrame, state: str) -> int:
    """Keys of the state in this folder; a new one gets them by the rows of the first call."""
    folder = f"{state}/keys"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        known.agg(F.ceil(F.count("*") / TEXTS_PER_KEY).cast("long").alias("keys")).write.mode("overwrite").parquet(folder)
    return max(64, spark.read.schema("keys long").parquet(folder).first()[0])


def part_counters(
    spark: SparkSession, path: str, labels: DataFrame, state: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    micro_batches: int = MICRO_BATCHES,
) -> DataFrame:
    """Bring the state up to date with the files under ``path``; ``(part, mask, n, good, toxic)``, the sums of all signed counts so far."""
    known = spark.read.parquet(path)
    kind = known.schema[id_col].dataType
    schema = T.StructType([T.StructField(c, known.schema[c].dataType) for c in (id_col, text_col, lang_col)])
    per_batch = max(1, -(-len(known.inputFiles()) // micro_batches))
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    marks = stage(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("label_id")).agg(one("quality"), one("toxic")), "labels")

    keys = state_keys(spark, known, state)
    rows = stream_parquet(spark, path, schema, per_batch).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("part"), whole_text(F.col(text_col)).alias("text"))
    fields = [*rows.schema.fields[:2], T.StructField("key", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("mask", T.IntegerType())]
    rows = rows.mapInArrow(lambda it: text_rows(it, keys), T.StructType(fields))
    # rows without an identifier meet no label; they are spread by their text
    label_id = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("no id "), F.col("digest")))
    zero = F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)
    rows = rows.join(marks, label_id == F.col("label_id"), "left").select(
        "key", "digest", F.col("id").isNull().alias("no_id"), F.coalesce("id", zero).alias("id"), "part", "mask",
        F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    reduced = rows.mapInArrow(reduced_rows, T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())]))
    deltas = reduced.groupBy("key").applyInPandasWithState(update_texts, DELTA, "held string", "append", GroupStateTimeout.NoTimeout)
    with settings(spark, STATE_SETTINGS):
        query = deltas.writeStream.format("parquet").outputMode("append").option("path", f"{state}/deltas").option(
            "checkpointLocation", f"{state}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(DELTA).parquet(f"{state}/deltas").groupBy("part", "mask").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).where(F.col("n") > 0)


def audit(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``(part, mask, n, good, toxic)``."""
    masks = F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))
    held = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    parts = counters.groupBy("part").agg(held.alias("held"))  # at most 32 entries
    parts = parts.select("part", F.transform(masks, lambda m: F.coalesce(F.element_at("held", m), zero)).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    rows = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select(
        "part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = F.create_map(*[F.lit(x) for pair in BIT.items() for x in pair])
    letters = F.split("filter_order", "")
    own = F.element_at(bits, F.element_at(letters, F.col("step")))
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, x: acc + F.element_at(bits, x))
    rows = rows.withColumn("own", own).withColumn("before", before)

    def total(field: str, wanted, weight=lambda m: F.lit(1)) -> Column:
        picked = F.transform("cells", lambda c, m: F.when(wanted(m), c[field] * weight(m)).otherwise(0))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda acc, x: acc + x)

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    # a filter comes first among those that a mask fails in one of bit_count(mask) orders
    firsts = lambda m: F.element_at(F.array(*[F.lit(120 // k) for k in range(1, 6)]), F.bit_count(m))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("n", fails, lambda m: F.when(m > 0, firsts(F.greatest(m, F.lit(1)))).otherwise(0)).alias("shapley"))


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, state: str | None = None, **columns) -> DataFrame:
    """The audit of all files under ``path``."""
    return audit(stage(part_counters(spark, path, labels, state or new_folder(spark, "audit-state"), **columns), "counters"))
