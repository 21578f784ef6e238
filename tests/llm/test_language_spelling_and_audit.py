import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureforge.llm import filter_audit, language, spelling

from samples import SCHEMA, prose

# language


@pytest.fixture(scope="module")
def tongues(spark):
    sounds = {"aa": "ka ta ma pa ra ni no".split(), "bb": "schl ung ß ein über ock".split(), "cc": "кот дом лес ая".split()}
    rows = []
    for i in range(900):
        lang = ("aa", "bb", "cc")[i % 3]
        rng = random.Random(i)
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(words), None if i % 7 == 0 else lang))
    return rows


def test_languages_of_held_out_texts(spark, tongues):
    extra = [(None, "ka ta ma", "aa"), (2000, None, "aa"), (2001, "", None), (2002, "12 % 34\n", "bb"), (2003, "schlung " * 20_000, "bb"), (4, tongues[4][1], "bb")]
    docs = spark.createDataFrame(tongues + extra, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).repartition(3)
    got = language.identify_languages(docs, landmarks=30, per_language=50).collect()
    assert len(got) == len(tongues) + len(extra)
    assert all(r.held_out == (zlib.crc32(str("null" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    right = [r.lang_pred == ("aa", "bb", "cc")[r.doc_id % 3] for r in held]
    assert len(held) > 150 and sum(right) >= 0.98 * len(right)
    odd = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 2000}
    assert odd[None].lang_pred == "aa" and odd[2003].lang_pred == "bb"
    assert all((odd[i].lang_pred, odd[i].score) == ("und", 0.0) for i in (2000, 2001, 2002))
    assert all(0 <= r.score <= 1 for r in got)
    again = language.identify_languages(docs.repartition(5), landmarks=30, per_language=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_language_labels_and_identifiers_are_no_inputs(spark, tongues):
    """A held-out row's language and source change nothing."""
    docs = spark.createDataFrame(tongues, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify_languages(d, landmarks=12, per_language=20).collect()} for d in (docs, other))
    assert a == b and "zz" not in {p for p, _ in a.values()}


def test_language_weights_are_the_kernel_expansion(spark, tongues):
    """Scores from n-gram weights equal kernel values by sets of strings times ridge coefficients."""
    texts = [(t, lang) for _, t, lang in tongues[:90] if lang]
    grams = lambda t: {(n, s[i:i + n]) for s in [f" {' '.join(t.lower().split())} "] for n in range(1, language.LONGEST + 1) for i in range(len(s) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    sets = [language.grams_of(t) for t, _ in texts]
    assert [len(s) for s in sets] == [len(grams(t)) for t, _ in texts]
    table = np.unique(np.concatenate(sets))
    marks = np.zeros((len(table), 10), np.float64)
    for i, s in enumerate(sets[:10]):
        marks[np.searchsorted(table, s), i] = 1 / np.sqrt(len(s))
    want = np.array([[kernel(t, z) for z, _ in texts[:10]] for t, _ in texts])
    assert np.allclose(language.product(sets, table, marks), want)
    coefficients = np.random.default_rng(1).normal(size=(10, 3))
    assert np.allclose(language.product(sets, table, marks @ coefficients), want @ coefficients)


def test_language_without_labels(spark, edge, edge_rows, empty):
    assert language.identify_languages(empty).count() == 0
    got = language.identify_languages(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == len(edge_rows) and {r.lang_pred for r in got} == {"und"}
    got = language.identify_languages(edge).collect()
    assert len(got) == len(edge_rows) and {r.lang_pred for r in got} <= {"en", "de", "und"}


# spelling


def brute_words(rows):
    counts = Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def test_scan_of_a_sorted_list_finds_all_words_at_one_edit():
    rng = random.Random(3)
    for _ in range(400):
        size = rng.randint(0, 6)
        stems = sorted({"".join(rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(size + rng.randint(0, 1))) for _ in range(25)})
        shared = [0, *map(spelling.common_prefix, stems, stems[1:])]
        for query in stems:
            if len(query) == size:
                assert list(spelling.banded_scan(query, stems, shared)) == [i for i, s in enumerate(stems) if one_edit(query, s)]


@pytest.mark.parametrize("most", [2, 30, spelling.MOST])
def test_variants(spark, edge, edge_rows, empty, most):
    rng = random.Random(8)
    names = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(150)] + ["a" * 40, "a" * 41, "a" * 42 + "b", "Straße", "straßen"]
    rows = [(i, " ".join(rng.choice(names) for _ in range(rng.randint(0, 120))) + "1x, " + "aaaaa" * 3) for i in range(60)]
    rows += [(None, "alone alone\talones alonés alonés alonés"), (7, None), (8, ""), (9, "one two"), (9, "alone's ALONE ×÷ª")]
    rows += [(r[0], r[1]) for r in edge_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).repartition(4)
    got = spelling.group_variants(docs, most=most).collect()
    want = brute_variants(brute_words(rows))
    assert len(want) > 100 and {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r.form and r.root != r.form for r in got)
    assert spelling.group_variants(empty).count() == 0 and spelling.group_variants(edge).count() >= 0


def test_crowded_groups_are_cut_until_they_fit(spark):
    """One shared end of all words: every group of the first cut is crowded."""
    words = sorted({"".join(p) + "tail" for p in itertools.product("abcd", repeat=5)})
    df = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_pairs(df, most=20).collect()}
    want = {(w, w[:i] + c + w[i + 1:]) for w in words for i in range(5) for c in "abcd" if c != w[i]}
    assert got == want


# audit


def brute_audit(rows, labels):
    """Rows (doc_id, text, lang); labels (doc_id, quality, toxic)."""
    text = [r[1] or "" for r in rows]
    order = lambda i: (i is None, i or 0)
    fails, parts = [], []
    for i, r in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text[i])
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        f += "C" * (100 * len(re.findall("[A-Z]", text[i])) > 3 * len(text[i])) + "D" * bool(re.search(r"[#$%&*|]", text[i]))
        f += "E" * any(text[j] == text[i] and order(o[0]) < order(r[0]) for j, o in enumerate(rows))
        fails.append(f)
        parts.append(r[2] or "")
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in set(parts):
        mine = [(f, r[0]) for f, p, r in zip(fails, parts, rows) if p == part]
        shares = Counter()
        for o in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(o, 1):
                here = [d for f, d in mine if x in f and not set(f) & set(o[:step - 1])]
                shares[x] += len(here)
                out[part, o, step] = [
                    sum(not set(f) & set(o[:step]) for f, _ in mine), len(here), sum(x in f and bool(set(f) & set(o[:step - 1])) for f, _ in mine),
                    sum(f == x for f, _ in mine), sum(d in good for d in here), sum(d in toxic for d in here)]
        for (p, o, step), row in out.items():
            if p == part:
                row.append(shares[o[step - 1]])
    return out


FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.fixture(scope="module")
def audit_rows(edge_rows):
    long = prose(500, 260)
    rows = [(r[0], r[1], r[2]) for r in edge_rows]
    rows += [(100 - i, long, ("en", "de", None, "")[i % 4]) for i in range(40)]  # smaller and smaller identifiers of one text
    rows += [(61, long, "en"), (61, long, "de"), (61, long, "de"), (None, long, "en"), (None, long, "fr")]
    rows += [(200 + i, prose(i % 5, 210).upper() if i % 3 else "ha ha " * 150, "es") for i in range(20)]
    rows += [(300, "half | half " * 3, "en"), (301, None, None), (302, "", "en")]
    return rows


@pytest.fixture(scope="module")
def audit_labels(spark):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(1, 320, 2)] + [(61, 0, 1), (61, None, None), (None, 1, 1), (64, 1, 0), (64, 0, 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("files", [1, 7])
def test_audit(spark, audit_rows, audit_labels, tmp_path, files):
    path = str(tmp_path / "docs")
    for i in range(files):  # one file after the other
        spark.createDataFrame(audit_rows[i::files], "doc_id long, text string, lang string").withColumn("part", F.lit("x")).withColumn(
            "digest", F.lit(1)).coalesce(1).write.mode("append").parquet(path)
    labels, table = audit_labels
    for given in (path, path + "/") if files == 1 else (path,):
        got = filter_audit.audit_filters(spark, given, table).collect()
        want = brute_audit(audit_rows, labels)
        assert {(r.part, r.filter_order, r.step): [r[f] for f in FIELDS] for r in got} == want and len(got) == len(want)


def test_audit_retracts_when_smaller_identifiers_come_later(spark, audit_rows, audit_labels, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    labels, table = audit_labels
    ordered = sorted(audit_rows, key=lambda r: (r[0] is None, r[0] or 0), reverse=True)
    done = []
    for start in range(0, len(ordered), 40):
        some = ordered[start:start + 40]
        done += some
        spark.createDataFrame(some, "doc_id long, text string, lang string").coalesce(2).write.mode("append").parquet(path)
        got = filter_audit.audit_filters(spark, path, table, state=state).collect()
        assert {(r.part, r.filter_order, r.step): [r[f] for f in FIELDS] for r in got} == brute_audit(done, labels)
    deltas = spark.read.schema(filter_audit.DELTA).parquet(f"{state}/deltas")
    assert deltas.where("n < 0").count() > 0


def test_signed_counts_are_the_difference_of_states():
    rng = random.Random(2)
    held, total, seen = {}, Counter(), []
    for _ in range(60):
        rows = [(rng.choice("xyz"), False, rng.randint(0, 30), rng.choice(["p", "q"]), 0, 0, 0, rng.randint(1, 2)) for _ in range(rng.randint(0, 4))]
        seen += rows
        for k, n in filter_audit.signed_counts(rows, held).items():
            total[k] += n
        want = Counter()
        least = defaultdict(lambda: 99)
        for d, _, i, *_ in seen:
            least[d] = min(least[d], i)
        for d, _, i, part, mask, good, toxic, n in seen:
            want[part, mask | (filter_audit.DUPLICATE if i > least[d] else 0), good, toxic] += n
        assert {k: n for k, n in total.items() if n} == dict(want)


def test_audit_of_an_empty_table(spark, audit_labels, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert filter_audit.audit_filters(spark, path, audit_labels[1]).count() == 0
