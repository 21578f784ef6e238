"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles. Equal sets are one node of the
graph. Nodes branch down independent trees: a tree node selects coordinates of
a minwise signature, one and with probability 1/4 a second (1 / 0.8 in the
mean, so that a pair at the threshold keeps one common branch in the mean), and
passes each set on by its minwise token there. Tree nodes of at most ``LEAF``
sets are compared exhaustively. In a larger one, first all sets meet
``LEADERS`` of them, drawn anew for each tree node, by sketch; each set's
``TRIED`` likeliest ones are confirmed, and the links made components. Pairs inside a component need no more looks: a
tree node of one component is done. One of at most ``DIRECT`` sets, or in which at most ``LEAF`` sets lie
outside the largest component, compares the sets outside with all others at the end, in
tasks of block pairs that hand on links only; only what is larger and still mixed branches on. What is mixed at the last level is compared on
full sets across its components, in blocks of at most ``SIDE`` by ``SIDE`` sets.

Elsewhere, pairs whose one-bit sketches differ too much or whose sizes rule the
threshold out are dropped, and then those whose marks, one byte of every minimum,
differ too much; the others are confirmed on the full sets: first the
likeliest link of each set, then every pair that the links so far have not joined.

A pair at the threshold survives ``STEP`` levels of one tree with probability
0.64, nine levels with 0.37, twelve with 0.32; ``TREES`` trees miss it with 6e-7,
0.0015 and 0.005. Sketches drop it with 3e-6 more, marks with 5e-6. Levels beyond the first three are only reached inside crowded
tree nodes.

Defined results: null or empty text, and text without words, is linked with
nothing and is its own component; a null identifier counts as larger than all
others; repeated rows are returned each; an empty table gives an empty result;
other columns are not read. Sets cover whole texts; shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featureforge.llm.common import FILTER_SETTINGS, settings, whole_text
from featureforge.llm.links import components
from featureforge.staging import stage

#: Coordinates of a signature, and bits of a sketch (two longs); each of both has a mark of one byte.
COORDINATES, BITS = 64, 128
#: Bits in which sketches of a pair at the threshold may differ: mean 12.8, standard deviation 3.4.
MOST_DIFFERENT = 30
#: Marks in which a pair at the threshold may differ: mean 38.4, standard deviation 5.5 (5e-6 differ in more).
MOST_APART = 64
TREES, STEP, DEPTH, LEAF = 14, 3, 12, 50
#: Sets of a crowded node that is compared directly instead of branching on: its pairs are looked at in tasks and make no rows.
DIRECT = 4096
#: Sets on each side of a block in which a crowded node is compared, by sketches and on full sets; and shingles on each side of the latter.
SKETCHES, SIDE, SIDE_SHINGLES = 2048, 1024, 1 << 20
#: Members of a crowded node that all are compared with.
LEADERS = 3
#: Leaders that a set is compared with on full sets; it is tried again only with leaders that these links have not joined it with.
TRIED = 3
#: Times that the likeliest pair of each two components is confirmed before all other pairs are.
ROUNDS = 0
PERCENT = 80
MASK = 0xFFFFFFFFFFFFFFFF
#: Rows of a block in which minima are taken.
BLOCK = 8192
#: Texts of 2 KB are handed to Python in batches of some MB.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; with fewer words, of the whole sequence."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    codes = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[i:len(words) - width + 1 + i])
    return np.unique(out)


def multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest hash of the set under each factor, as 32 bits."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), BLOCK):
        least = np.minimum(least, (values[at:at + BLOCK, None] * factors).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def feature_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) to (doc_id, text_key, n_shingles, digest, signature, marks, s1, s2)."""
    from hashlib import blake2b

    factors = multipliers(COORDINATES + BITS, 9)
    for batch in batches:
        counts, digests, signatures, marks, sketches = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            values = shingles(text, size)
            counts.append(len(values))
            if not len(values):
                digests.append(None), signatures.append(None), marks.append(None), sketches.append((0, 0))
                continue
            least = minima(values, factors)
            mark = mixed(least.astype(np.uint64)).astype(np.uint8)
            bits = np.packbits(mark[COORDINATES:] & 1)
            digests.append(blake2b(values.tobytes(), digest_size=16).digest())
            signatures.append(least[:COORDINATES].tobytes())
            marks.append(mark.tobytes())
            sketches.append(tuple(bits.view(np.int64).tolist()))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(marks, pa.binary()),
            pa.array([s[0] for s in sketches], pa.int64()), pa.array([s[1] for s in sketches], pa.int64()),
        ], ["doc_id", "text_key", "n_shingles", "digest", "signature", "marks", "s1", "s2"])


def marks_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of marks for each row of the column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES + BITS)


def sifted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ca, cb, marks_a, marks_b) to the pairs (a, b, ca, cb, far) whose marks may reach the threshold."""
    for batch in batches:
        far = (marks_of(batch.column(4)) != marks_of(batch.column(5))).sum(axis=1)
        kept = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(far.astype(np.int64))], ["a", "b", "ca", "cb", "far"])
        yield kept.filter(pa.array(far <= MOST_APART))


def branches(paths: np.ndarray, rows: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level down: the paths of the children and their rows."""
    first = mixed(paths + np.uint64(1))
    second = mixed(paths + np.uint64(2))
    one = (first % np.uint64(COORDINATES)).astype(np.int64)
    two = ((one + 1 + (second >> np.uint64(8)).astype(np.int64) % (COORDINATES - 1)) % COORDINATES)
    both = (second & np.uint64(3)) == 0

    def child(p, c, r):
        return mixed(mixed(p + np.uint64(3)) ^ ((c.astype(np.uint64) << np.uint64(32)) | signatures[r, c].astype(np.uint64)))

    return (
        np.concatenate([child(paths, one, rows), child(paths[both], two[both], rows[both])]),
        np.concatenate([rows, rows[both]]),
    )


#: What tree nodes know of their sets, and the type of rows (path, node, ...) with it.
KNOWN = ["node", "n_shingles", "s1", "s2"]
PATHS = "path long, node long, n_shingles long, s1 long, s2 long"


def path_rows(batches: Iterator[pa.RecordBatch], trees: int, levels: int) -> Iterator[pa.RecordBatch]:
    """(node, n_shingles, s1, s2, signature[, path]) to (path, node, n_shingles, s1, s2), ``levels`` further down; without a path from the roots."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        signatures = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(n, COORDINATES)
        if batch.num_columns == 6:
            paths, rows = np.asarray(batch.column(5)).view(np.uint64), np.arange(n)
        else:
            paths, rows = np.tile(mixed(np.arange(1, trees + 1, dtype=np.uint64)), n), np.repeat(np.arange(n), trees)
        for _ in range(levels):
            paths, rows = branches(paths, rows, signatures)
        yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), *[batch.column(i).take(pa.array(rows)) for i in range(4)]], ["path", *KNOWN])


#: Shingles of sets that a task keeps while it confirms pairs.
HELD = 4_000_000


def confirm_rows(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the pairs (a, b) that reach the threshold on their full sets."""
    known: dict[int, np.ndarray] = {}
    held = 0

    def set_of(node: int, text: str) -> np.ndarray:
        nonlocal held
        if node not in known:
            if held > HELD:
                known.clear()
                held = 0
            known[node] = shingles(text, size)
            held += len(known[node])
        return known[node]

    for batch in batches:
        keep = []
        for a, b, x, y in zip(*(batch.column(i) for i in range(4))):
            one, other = set_of(a.as_py(), x.as_py()), set_of(b.as_py(), y.as_py())
            common = len(np.intersect1d(one, other, assume_unique=True))
            keep.append(100 * common >= percent * (len(one) + len(other) - common))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of block ``i`` of one block pair, and those that they meet: of block ``j``, which with the first main block are both."""
    i, j, member = rows.column("i")[0].as_py(), rows.column("j")[0].as_py(), np.asarray(rows.column("member"))
    return np.flatnonzero(member == i), np.arange(rows.num_rows) if j == rows.column("first")[0].as_py() else np.flatnonzero(member == j)


def block_links(rows: pa.Table, size: int, percent: int) -> pa.Table:
    """Links (a, b) that join different components, among (i, j, first, member, node, component, text) of one block pair; all pairs are compared."""
    lefts, rights = sides(rows)
    nodes, of = np.asarray(rows.column("node")), rows.column("component").to_pylist()
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [shingles(t, size) for t in rows.column("text").to_pylist()]
    lengths = np.array([len(s) for s in sets])
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    mark = np.zeros(len(known), np.int32)
    a_found, b_found = [], []
    for a in lefts:
        own = codes[starts[a]:starts[a + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes], starts[:-1])  # no set is empty
        mark[own] = 0
        near = 100 * common >= percent * (lengths[a] + lengths - common)
        for b in rights[near[rights]]:
            ra, rb = find(of[a]), find(of[b])
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                a_found.append(min(nodes[a], nodes[b]))
                b_found.append(max(nodes[a], nodes[b]))
    return pa.table({"a": pa.array(a_found, pa.int64()), "b": pa.array(b_found, pa.int64())})


def dealt(rows: DataFrame, side) -> DataFrame:
    """``mixed_nodes`` in pairs ``(path, i, j)`` of blocks of about ``side`` sets, each row with its block ``member``.

    The sets outside the main component are dealt to blocks, and each of these
    meets all others and the blocks of the main component, from ``first`` on;
    its own sets meet in the pair with that one. A tree node of one block of
    each kind has every row once.
    """
    salt, is_main = F.xxhash64("node", "path"), F.col("component") == F.col("main")
    first, mains = F.ceil(F.col("others") / side).cast("int"), F.ceil(F.col("mains") / side).cast("int")
    member = F.when(is_main, first + F.pmod(salt, mains)).otherwise(F.pmod(salt, first)).cast("int")
    last = F.when(is_main, first).otherwise(first + mains) - 1
    meets = rows.withColumns({"first": first, "member": member, "last": last})
    meets = meets.withColumn("with", F.explode(F.filter(F.sequence(F.lit(0), F.col("last")), lambda x: x != F.col("member"))))
    return meets.withColumns({"i": F.least("member", "with"), "j": F.greatest("member", "with")}).drop("with", "last")


def compared(rows: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, label: str) -> DataFrame:
    """Links between the components of each tree node in ``rows``, as of ``mixed_nodes``, by comparing all pairs on full sets in tasks; staged."""
    texts = texts_of(rows.select("node"), classes, docs)
    side = F.greatest(F.lit(16), F.least(F.lit(SIDE), F.lit(SIDE_SHINGLES) / F.col("most")))
    columns = ["i", "j", "first", "member", "node", "component", "text"]
    return stage(dealt(rows, side).join(texts, "node").groupBy("path", "i", "j").applyInArrow(
        lambda rows: block_links(rows.select(columns), size, percent), "a long, b long"), label)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, text)`` of every node in ``nodes(node)``; staged, as the one time that texts cross an exchange whole."""
    wanted = stage(classes.join(nodes.distinct(), "node", "left_semi").select("node", F.col("id").alias("_id"), F.col("text_key").alias("_key")), "wanted")
    wanted = wanted.where(F.col("node") >= 0)  # a condition, which Spark asks of the side that it makes a filter from
    found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    with settings(docs.sparkSession, FILTER_SETTINGS):
        return stage(found.dropDuplicates(["node"]).select("node", "text"), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that reach the threshold on the full sets of their texts; staged."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with settings(pairs.sparkSession, BATCHES):
        return stage(with_b.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: confirm_rows(it, size, percent), "a long, b long"), "confirmed")


def candidates(rows: pa.Table, percent: int) -> pa.Table:
    """Those of one block pair that a set of another component on its other side may be linked with.

    Rows are (path, node, component, main, others, mains, most, i, j, first, member, n_shingles, s1, s2, marks); the first seven are returned.
    """
    lefts, rights = sides(rows)
    part, size = np.asarray(rows.column("component")), np.asarray(rows.column("n_shingles"))
    bits = np.stack([np.asarray(rows.column(c)).view(np.uint64) for c in ("s1", "s2")], axis=1)
    marks = marks_of(rows.column("marks"))
    kept = np.zeros(rows.num_rows, bool)
    for a in lefts:
        fits = np.minimum(size[rights], size[a]) * 100 >= np.maximum(size[rights], size[a]) * percent
        at = rights[fits & (part[rights] != part[a])]
        at = at[np.bitwise_count(bits[at] ^ bits[a]).sum(axis=1) <= MOST_DIFFERENT]
        if kept[a]:
            at = at[~kept[at]]
        at = at[(marks[at] != marks[a]).sum(axis=1) <= MOST_APART]
        kept[at] = True
        kept[a] |= len(at) > 0
    return rows.select(CHOSEN).filter(pa.array(kept))


CHOSEN = ["path", "node", "component", "main", "others", "mains", "most"]


def with_leaders(large: DataFrame) -> DataFrame:
    """``large(path, node, ...)`` with the array ``leaders`` of its tree node's leaders, as structs of the other columns."""
    rest = [c for c in large.columns if c != "path"]
    draws = [F.min(F.struct(F.xxhash64("node", "path", F.lit(i)).alias("h"), *rest)) for i in range(LEADERS)]
    leaders = large.groupBy("path").agg(F.array_distinct(F.transform(F.array(*draws), lambda d: d.dropFields("h"))).alias("leaders"))
    return large.join(stage(leaders, "leaders"), "path")


def led(leader, percent: int):
    """Whether a set and a leader of its tree node may reach the threshold."""
    small, large = F.least("n_shingles", leader["n_shingles"]), F.greatest("n_shingles", leader["n_shingles"])
    return (leader["node"] != F.col("node")) & (small * 100 >= large * percent) & (differing(leader) <= MOST_DIFFERENT)


def differing(leader):
    return F.bit_count(F.col("s1").bitwiseXOR(leader["s1"])) + F.bit_count(F.col("s2").bitwiseXOR(leader["s2"]))


def best_leaders(large: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: each set of the tree nodes ``large(path, node, n_shingles, s1, s2)`` with the ``TRIED`` likeliest leaders, one a tree node, that it may be linked with."""
    near_ones = F.filter("leaders", lambda x: led(x, percent))
    best = F.array_min(F.transform(near_ones, lambda x: F.struct(differing(x).alias("differ"), x["node"].alias("leader"))))
    chosen = with_leaders(large).select("node", best.alias("best")).where(F.col("best").isNotNull()).groupBy("node").agg(
        F.slice(F.array_sort(F.collect_set("best")), 1, TRIED).alias("best"))  # at most one for each tree node of the set
    chosen = chosen.select("node", F.explode("best.leader").alias("leader"))
    return chosen.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))


def leaders_apart(mixed: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: each set of the mixed tree nodes with the leaders of other components that it may be linked with."""
    apart_ones = F.filter("leaders", lambda x: (x["component"] != F.col("component")) & led(x, percent))
    found = with_leaders(mixed.select("path", "node", "component", "n_shingles", "s1", "s2")).select("node", F.explode(apart_ones).alias("leader"))
    return found.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b"))


def mixed_nodes(large: DataFrame, joined: DataFrame) -> DataFrame:
    """``(path, node, ..., component, main, others, mains, most)`` of the tree nodes with several components; staged.

    ``main`` is the largest one, with ``mains`` sets, ``others`` counts the sets outside it, ``most`` the shingles of the largest set.
    """
    found = joined.select("node", F.col("component").alias("known"))
    large = stage(large.join(found, "node", "left").withColumn("component", F.coalesce("known", "node")).drop("known"), "parts")
    shares = large.groupBy("path", "component").agg(F.count("*").alias("n"), F.max("n_shingles").alias("most"))
    shape = shares.groupBy("path").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top"), F.max("most").alias("most"))
    shape = shape.where(F.col("size") > F.col("top.n")).select(
        "path", F.col("top.component").alias("main"), (F.col("size") - F.col("top.n")).alias("others"), F.col("top.n").alias("mains"), "most")
    return stage(large.join(shape, "path"), "mixed")


def direct_links(direct: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links between the components of the mixed nodes ``direct``; staged. Sketches and marks choose the sets whose texts are read and compared."""
    known = classes.select("node", "marks")
    columns = [*CHOSEN, "i", "j", "first", "member", "n_shingles", "s1", "s2", "marks"]
    chosen = stage(dealt(direct, F.lit(SKETCHES)).join(known, "node").groupBy("path", "i", "j").applyInArrow(
        lambda rows: candidates(rows.select(columns), percent),
        "path long, node long, component long, main long, others long, mains long, most long").distinct(), "chosen")
    return None if chosen.isEmpty() else compared(chosen, classes, docs, size, percent, "direct")


def apart(pairs: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Those of ``pairs(a, b, ...)`` between different components, with these as ``ca`` and ``cb``."""
    if joined is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    left = joined.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    right = joined.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    pairs = pairs.drop("ca", "cb").join(left, "a", "left").join(right, "b", "left")
    return pairs.withColumns({"ca": F.coalesce("_ca", "a"), "cb": F.coalesce("_cb", "b")}).drop("_ca", "_cb").where(F.col("ca") != F.col("cb"))


def sifted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b, ca, cb, far)``: those of ``pairs(a, b, ca, cb)`` whose marks may reach the threshold; ``far`` counts the marks that differ."""
    a = classes.select(F.col("node").alias("a"), F.col("marks").alias("marks_a"))
    b = classes.select(F.col("node").alias("b"), F.col("marks").alias("marks_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "ca", "cb", "marks_a", "marks_b")
    return both.mapInArrow(sifted_rows, "a long, b long, ca long, cb long, far long")


def join_up(
    pairs: DataFrame, links: DataFrame | None, joined: DataFrame | None, classes: DataFrame, docs: DataFrame, size: int, percent: int,
) -> tuple[DataFrame, DataFrame]:
    """Links and components with what the candidates ``pairs(a, b)`` add, confirmed as far as they may join components.

    First the likeliest pair of each set, then ``ROUNDS`` times that of each two components (more rounds
    confirm fewer pairs and compute components more often), then all that are still apart.
    """
    open_ = stage(sifted(apart(pairs.distinct(), joined), classes), "pairs")
    if joined is not None and open_.isEmpty():
        return links, joined
    texts = texts_of(ends(open_), classes, docs)
    for i in range(ROUNDS + 2):
        if i == 0:
            each = F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("of")), F.struct(F.col("b").alias("n"), F.col("a").alias("of")))
            best = open_.select("far", F.explode(each).alias("e")).groupBy("e.n").agg(F.min(F.struct("far", "e.of")).alias("m"))
            tried = best.select(F.least("n", "m.of").alias("a"), F.greatest("n", "m.of").alias("b")).distinct()
        elif i <= ROUNDS:
            best = open_.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("far", "a", "b")).alias("m"))
            tried = best.select("m.a", "m.b")
        else:
            tried = open_.select("a", "b")
        tried = stage(tried, "tried")
        found = confirmed(tried, texts, size, percent)
        if joined is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            joined = stage(components(links), "components")
        if i > ROUNDS:
            break
        open_ = stage(apart(open_.join(tried, ["a", "b"], "left_anti"), joined), "open")
        if open_.isEmpty():
            break
    return links, joined


def all_links(classes: DataFrame, docs: DataFrame, trees: int, size: int, percent: int) -> DataFrame:
    """``(node, component)`` of every node that has a link."""
    small, looks, direct, still, links, joined = [], [], [], None, None, None
    rows = stage(classes.select(*KNOWN, "signature").mapInArrow(lambda it: path_rows(it, trees, STEP), PATHS), "paths")
    for level in range(STEP, DEPTH + 1, STEP):
        crowded = stage(rows.groupBy("path").agg(F.count("*").alias("size")).where(F.col("size") > LEAF), "crowded_paths")
        small.append(rows.join(crowded, "path", "left_anti"))
        if crowded.isEmpty():
            break
        sized = stage(rows.join(crowded, "path"), "large")
        if level == STEP:
            tried = stage(best_leaders(sized.drop("size"), percent), "tried")
            links = confirmed(tried, texts_of(ends(tried), classes, docs), size, percent)
            joined = stage(components(links), "components")
        direct.append(sized.where(F.col("size") <= DIRECT).drop("size"))
        if crowded.where(F.col("size") > DIRECT).isEmpty():
            break
        mixed = mixed_nodes(sized.where(F.col("size") > DIRECT).drop("size"), joined)
        direct.append(mixed.where(F.col("others") <= LEAF).select("path", *KNOWN))
        many = mixed.where(F.col("others") > LEAF)
        if many.isEmpty():
            break
        if level == STEP:
            looks.append(leaders_apart(many, percent))
        if level + STEP > DEPTH:
            still = many.select("path", *KNOWN)
        else:
            deeper = many.join(classes.select("node", "signature"), "node").select(*KNOWN, "signature", "path")
            rows = stage(deeper.mapInArrow(lambda it: path_rows(it, trees, STEP), PATHS), "paths")
    sets = reduce(DataFrame.unionByName, small)  # a path is one tree node of one level
    a = sets.select("path", *[F.col(c).alias(f"{c}_a") for c in KNOWN])
    b = sets.select("path", *[F.col(c).alias(f"{c}_b") for c in KNOWN])
    meet = a.join(b, "path").where((F.col("node_a") < F.col("node_b")) & near(percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    links, joined = join_up(reduce(DataFrame.unionByName, looks, meet), links, joined, classes, docs, size, percent)
    more = []
    if direct and not (rows := mixed_nodes(reduce(DataFrame.unionByName, direct), joined)).isEmpty():
        more.append(direct_links(rows, classes, docs, size, percent))
    if still is not None and not (rows := mixed_nodes(still, joined)).isEmpty():
        more.append(compared(rows, classes, docs, size, percent, "crowded"))
    more = [m for m in more if m is not None and not m.isEmpty()]
    if more:
        joined = stage(components(reduce(DataFrame.unionByName, more, links)), "components")
    return joined


def different():
    return F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))


def near(percent: int):
    small, large = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    return (small * 100 >= large * percent) & (different() <= MOST_DIFFERENT)


def near_duplicates(
    docs: DataFrame, size: int = 2, percent: int = PERCENT, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component_id, leader)``, one row per document.

    ``text_key`` tells texts of one identifier apart; ``leader`` marks the document
    of each component that stays (and rows equal to it).
    """
    text = whole_text(F.col(text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    with settings(docs.sparkSession, BATCHES):
        features = stage(source.mapInArrow(
            lambda it: feature_rows(it, size),
            f"doc_id {kind}, text_key long, n_shingles long, digest binary, signature binary, marks binary, s1 long, s2 long"), "features")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key"))
    rest = F.first(F.struct("n_shingles", "signature", "marks", "s1", "s2"))
    classes = features.where(F.col("n_shingles") > 0).groupBy("digest").agg(F.min(first).alias("f"), rest.alias("r"))
    classes = stage(classes.select("digest", F.monotonically_increasing_id().alias("node"), "f.id", "f.text_key", "r.*"), "classes")

    joined = all_links(classes, source, trees, size, percent)
    member = classes.select("digest", "node", "id", "text_key").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    head = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("text_key")))
    heads = member.groupBy("component").agg(head.alias("head"))
    member = stage(member.join(heads, "component").select("digest", "head"), "member")
    found = features.join(member, "digest", "left")
    alone = F.col("head").isNull()
    same = F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("text_key") == F.col("head.text_key"))
    return found.select(
        "doc_id", "text_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("head.id")).alias("component_id"),
        (alone | same).alias("leader"),
    )
