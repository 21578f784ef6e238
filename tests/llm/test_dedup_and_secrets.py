import hashlib
import re

import pytest
from pyspark.sql import functions as F

from featureforge.llm import secrets, streaming_dedup


def test_dedup(spark, edge, edge_rows, empty, tmp_path):
    path = str(tmp_path / "docs")
    edge.write.parquet(path)
    got = streaming_dedup.dedup_stream(spark, path, carry=True).collect()
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in edge_rows:
        groups.setdefault(body(r[1]), []).append(r[0])
    assert len(got) == len(edge_rows)
    kept = {}
    for r in got:
        same = groups[body(r.whole.text)]
        known = [i for i in same if i is not None]
        assert (r.keep_id, r.group_size) == (min(known) if known else None, len(same))
        assert r.text_sha256 == hashlib.sha256(body(r.whole.text).encode()).hexdigest()
        kept.setdefault(r.text_sha256, []).append((r.kept, r.doc_id, r.keep_id))
    for rows in kept.values():
        assert sum(k for k, _, _ in rows) == 1
        assert all(d == i for k, d, i in rows if k)
    file = next(str(f) for f in (tmp_path / "docs").iterdir() if f.name.endswith(".parquet"))
    for form, rows in ((path + "/", len(got)), (file, spark.read.parquet(file).count())):
        again = streaming_dedup.dedup_stream(spark, form).collect()
        assert len(again) == rows and sum(r.kept for r in again) == len({r.text_sha256 for r in again})
    none = str(tmp_path / "none")
    empty.write.parquet(none)
    assert streaming_dedup.dedup_stream(spark, none).count() == 0


def test_texts_that_share_a_digest_stay_apart(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", "c  c", "c c", "b", "d"])]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    weak = lambda text: F.length(text).cast("string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in streaming_dedup.dedup_stream(spark, path, digest=weak).collect()}
    assert got == {0: (0, 2, True), 1: (1, 2, True), 2: (0, 2, False), 3: (3, 2, True), 4: (3, 2, False), 5: (1, 2, False), 6: (6, 1, True)}


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    make([(5, "same"), (6, "other")])
    first = streaming_dedup.run_state(spark, path, state)
    assert {(r.keep_id, r.group_size) for r in first.collect()} == {(5, 1), (6, 1)}
    make([(3, "same"), (9, "other")])
    second = streaming_dedup.run_state(spark, path, state)
    assert {(r.keep_id, r.group_size) for r in second.collect()} == {(3, 2), (6, 2)}


BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}


def brute(text):
    spans = []
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


@pytest.fixture(scope="module")
def secret_texts():
    key = "AKIA" + "ABCD1234" * 3
    return [
        "é password = 'abc123!' and Token: xyz", f"x {key} y AKIASHORT {key}{key}", "dead" * 6 + " beef " + "0" * 23 + " " + "f" * 24,
        "password: secret: abcdefgh", "secret=token=abcdefg", "API_KEY=\"abcdef\" apikey='12345' ApiKey = 123456", "AKIA" * 5, None, "",
        "passwd:\nabcdef", "token = a.b/c+d=e-f_g\U0001f600", f"token={'ab' * 30}", "-----BEGIN RSA PRIVATE KEY-----\nabc", "tok en=abcdefg pass word=abcdefgh",
    ]


def test_secrets(spark, secret_texts, edge, edge_rows, empty):
    rows = [(None if i == 2 else i, t) for i, t in enumerate(secret_texts)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        spans = got[doc_id].spans
        assert [f"{s.kind}:{s.start}:{s.stop}" for s in spans if s.base] == brute(text or ""), text
    assert [s.kind for s in got[12].spans] == ["pem"]
    assert secrets.find_secrets(edge).count() == len(edge_rows)
    assert secrets.find_secrets(empty).count() == 0


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == (frozenset({frozenset({"abc", "bcd"})}),)
    assert q("(?i)ABC|abcde") == ()or q("(abc|abcde)x+") == (frozenset({frozenset({"abc"})}),)
    assert q("[0-9]+") == () and q("ab?") == ()
    assert q("a[bc]d.*efg") == (frozenset({frozenset({"abd"}), frozenset({"acd"})}), frozenset({frozenset({"efg"})}))


def test_index_only_passes_candidates(spark, secret_texts):
    rules = secrets.BASE_RULES
    docs = spark.createDataFrame(list(enumerate(secret_texts)), "doc_id long, text string")
    index = secrets.build_index(docs, secrets.needed_trigrams(rules))
    found = {r.doc_id: set(r.kinds) for r in secrets.candidates(index, rules).collect()}
    for i, text in enumerate(secret_texts):
        kinds = {s.split(":")[0] for s in brute(text or "")} - {"hex"}
        assert kinds <= found.get(i, set())
    assert 13 not in found and 2 not in found
