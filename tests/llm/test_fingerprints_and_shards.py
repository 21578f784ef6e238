import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featureforge.llm import fingerprints, mixing, sharding


def paragraphs(text):
    """Paragraphs character by character."""
    blank, found, at = " \t\n\v\f\r", set(), 0
    while at < len(text):
        start = at
        while not found and start == at == 0 and text[:1] and start < len(text) and text[start] in blank:
            start = len(text) - len(text.lstrip(blank))
        least, most = (fingerprints.FIRST_LEAST, fingerprints.FIRST_MOST) if at == 0 and start < len(text) else (fingerprints.LEAST, fingerprints.MOST)
        ends = (e for e in range(start + least, min(start + most, len(text)) + 1)
                if e == len(text) or text[e - 1] in ".!?\u2026\u3002\uff01\uff1f\n" or text[e - 1] in fingerprints.LAST and text[e] in blank)
        end = next(ends, min(start + most, len(text)))
        found.add(text[at:end].strip(blank))
        at = end
    return found - {""}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_recover_the_differences(spark, edge, edge_rows):
    got = fingerprints.fingerprint_edits(edge).collect()
    assert len(got) == len(edge_rows)
    known = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in edge_rows}, key=lambda r: (r[0], r[1]), reverse=True)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    # identifiers that occur with one text only have a determined place
    counts = Counter((r[0], r[1]) for r in known)
    for i, (has, doc_id, text) in enumerate(known):
        after = known[(i + 1) % len(known)]
        if counts[has, doc_id] > 1 or counts[after[:2]] > 1:
            continue
        half = len(text) // 2
        edited = text[:len(text) - half] + after[2][:half]
        for r in by_id[doc_id if has else None]:
            assert r.n_chars == len(text)
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.near_edited == pytest.approx(jaccard(paragraphs(text), paragraphs(edited)))
            assert r.near_next == pytest.approx(jaccard(paragraphs(text), paragraphs(after[2])))
    prints = {}
    for r in got:
        prints.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[1] == same[2] and same[1] != same[10]


@pytest.mark.parametrize("text", [
    "one line of words that never ends in a mark but goes on and on " * 9, "UPPER CASE WORDS STAND IN THIS LINE " * 12,
    "\u0421\u043b\u043e\u0432\u0430 \u0434\u0440\u0443\u0433\u043e\u0433\u043e \u044f\u0437\u044b\u043a\u0430 " * 20, "\u8a00\u8449\u306f\u7d9a\u304f" * 200, "a b c d e f " * 9,
    "\n \t" + "short\nlines\n" * 40, "x" * 3_000, "\u0645\u0631\u062d\u0628\u0627 \u0628\u0643 " * 40, "word " * 60])
def test_half_a_text_is_like_it(spark, text):
    """Whatever the script and the lines, a text whose first half stays shares digests with its edited text."""
    docs = spark.createDataFrame([(2, text), (1, "Quite another text. " * 300)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    half = len(text) // 2
    edited = text[:len(text) - half] + ("Quite another text. " * 300)[:half]
    assert 0 < got[2].near_edited < 1 and got[2].near_next == 0
    assert got[2].near_edited == pytest.approx(jaccard(paragraphs(text), paragraphs(edited)))


def test_sketch_peels_small_and_large_differences(spark):
    rows = [(i, [f"p{k}" for k in range(60)], [f"p{k}" for k in range(i, 60 + i)]) for i in (0, 1, 5, 30, 60)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    for c in ("a", "b"):
        df = df.withColumn(c, F.array_sort(F.transform(c, lambda x: F.xxhash64(x))))
    zero = F.lit(0)
    first = fingerprints.subtracted(fingerprints.sketch(F.col("a"), zero), fingerprints.sketch(F.col("b"), zero))
    got = df.select("i", "a", "b", fingerprints.differing(F.col("a"), F.col("b"), first).alias("d")).collect()
    for r in got:
        assert {(x.n, x.k) for x in r.d} == {(1, k) for k in set(r.a) - set(r.b)} | {(-1, k) for k in set(r.b) - set(r.a)}
        assert len(r.d) == 2 * r.i


def test_one_document_is_its_own_next(spark, empty):
    one = spark.createDataFrame([(5, "abcd", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    got = fingerprints.fingerprint_edits(one).collect()
    assert [(r.n_chars, r.edited_sha256) for r in got] == [(4, hashlib.sha256(b"abab").hexdigest())]
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_shards(spark, edge, edge_rows, empty):
    tree = sharding.even_tree(2, 2, 3)
    got = sharding.shard_documents(edge, tree, sharding.with_region(tree, 1, 12)).collect()
    assert len(got) == len(edge_rows)
    place = {}
    for r in got:
        assert place.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 12)
        assert r.law == "key"
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.shard_documents(empty, tree, tree).count() == 0


def test_weights_move_keys_only_into_the_heavier_subtree(spark):
    tree = sharding.even_tree(2, 2, 3)
    first = tree.children[0].children[0]
    heavier = sharding.Node("shard0", shard=0, own_weight=3.0)
    grown = sharding.Node("root", (
        sharding.Node("region0", (sharding.Node("region0.rack0", (heavier, *first.children[1:])), *tree.children[0].children[1:])), *tree.children[1:]))
    key = F.col("id").cast("string")
    rows = spark.range(20_000).select(sharding.place(key, tree).alias("a"), sharding.place(key, grown).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    region0, rack0 = set(range(6)), {0, 1, 2}
    assert moved and all(b in region0 for _, b in moved)
    assert all(b in rack0 for a, b in moved if a in region0)
    assert all(b == 0 for a, b in moved if a in rack0)
    share = Counter(r.b for r in rows)
    assert share[0] / len(rows) == pytest.approx(3 / 14, rel=0.1) and share[11] / len(rows) == pytest.approx(1 / 14, rel=0.15)


def brute_targets(sizes, weights, most):
    """Shares by weight; what is above a cap is shared again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def test_mix(spark, edge, edge_rows, empty):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in edge_rows:
        sizes[r[3]] += count(r[1])
    want = brute_targets(dict(sizes), (5, 2, 1), 3)
    got = mixing.mix_sources(edge).collect()
    assert len(got) == len(edge_rows)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1
    again = mixing.mix_sources(edge.repartition(5)).collect()
    key = lambda rows: sorted((str(r.doc_id), r.digest, r.taken) for r in rows)
    assert key(got) == key(again)
    assert mixing.mix_sources(empty).count() == 0


def brute_extra(rows, need, seed="mix"):
    """Which of ``(doc_id, text, size)`` of one source are taken once more, by plain Python; and the order by rank and by random number."""
    total = sum(r[2] for r in rows)
    mean, f = total / len(rows), need / total
    short = [mean / (mean + r[2]) for r in rows]
    middle = sum(r[2] * a for r, a in zip(rows, short)) / total
    ranks, random_ = [], []
    for (doc_id, text, size), a in zip(rows, short):
        part = hashlib.md5(f"{seed}|{doc_id}|{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()[:13]
        u, p = (int(part, 16) + 0.5) / 16**13, f * (1 + (1 - f) * (a - middle))
        assert 0 < p < 1
        ranks.append(u / (1 - u) / (p / (1 - p)))
        random_.append(u)
    taken, words = set(), 0
    order = sorted(range(len(rows)), key=lambda i: ranks[i])
    for i in order:
        if words + rows[i][2] / 2 <= need:
            taken.add(rows[i][0])
        words += rows[i][2]
    return taken, order != sorted(order, key=lambda i: random_[i])


def test_mix_is_the_pareto_order(spark):
    docs = [(i, "w " * (1 + i * i % 211), f"s{i % 5}") for i in range(1_500)]
    got = mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)).collect()
    target = {r.source: r.target for r in got}
    for source, want in target.items():
        rows = [(i, t, len(t.split())) for i, t, s in docs if s == source]
        total = sum(r[2] for r in rows)
        sure = int(want / total + 1e-12)
        taken, differs = brute_extra(rows, want - sure * total)
        assert differs and 0 < len(taken) < len(rows)
        for r in got:
            if r.source == source:
                assert r.copies == sure + (r.doc_id in taken)


def test_mix_near_target_and_odds(spark):
    docs = spark.range(6_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"))
    for r in mixing.mix_sources(docs).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.002)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 0}, {"a": 7}, {"a": 0, "b": 0}, {"x": 1, "y": 1, "z": 1, "zz": 100}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), 3).collect()}
    want = brute_targets(sizes, (5, 2, 1), 3)
    assert got == pytest.approx(want)
