import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from featureforge.llm import bpe, html_text, perplexity, queries, toxicity

from samples import prose


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


def test_bpe_is_what_tiktoken_gives(spark, edge, edge_rows, empty, vocabulary):
    import public_tokenizers

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary), special_tokens={})
    odd = ["a  b　　c", "\x1e\x1f\n\n  x", "१२३ ⅷ² 𝟙", "<|endoftext|>", "‍﻿́e", "'S I'll 'rely", " " * 50 + "\t\t end  ", "a b\x85c\x1cd"]
    rows = [(i, r[1]) for i, r in enumerate(edge_rows)] + [(1000 + i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "i long, text string").repartition(4)
    for most in (0, 50, bpe.FREQUENT):  # ids do not depend on the table of frequent words
        coded = bpe.decode(bpe.encode(docs, vocabulary, most=most), vocabulary)
        for r in coded.select("*", bpe.token_count(F.col("ids")).alias("count")).collect():
            ids = coder.encode_ordinary(r.text or "")
            assert r.ids == ",".join(map(str, ids)), r.i
            assert r["count"] == len(ids) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, vocabulary).count() == 0


def test_bpe_in_blocks(spark, edge, edge_rows, vocabulary):
    """Many unknown words, blocks of a few rows and of one long text, and columns that are named like the results."""
    import public_tokenizers

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary), special_tokens={})
    unknown = " ".join(prose(i, 3).replace(" ", "") + str(i) for i in range(4_000))
    rows = [(unknown,), (unknown[:100],), (None,), ("",), (unknown,), ("the the",)] * 2
    docs = spark.createDataFrame(rows, "text string").withColumn("ids", F.lit(7)).withColumn("decoded", F.lit("x")).coalesce(1)
    coded = bpe.decode(bpe.encode(docs, vocabulary, most=100, block_chars=5_000), vocabulary)
    assert coded.columns == ["text", "ids", "decoded"]
    got = coded.collect()
    assert [r.text for r in got] == [r[0] for r in rows]
    for r in got:
        assert r.ids == ",".join(map(str, coder.encode_ordinary(r.text or ""))) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.decode(bpe.encode(edge, vocabulary), vocabulary).count() == len(edge_rows)


def test_bpe_merges_long_words_in_less_than_square_time(spark, vocabulary):
    """One word of many letters, in no table; a merge that copies the word takes minutes for it."""
    import random
    import time

    import public_tokenizers

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary), special_tokens={})
    texts = ["".join(random.Random(i).choices("etaoinshrdlé", k=60_000)) for i in range(2)]
    start = time.time()
    got = bpe.encode(spark.createDataFrame([(t,) for t in texts], "text string"), vocabulary).collect()
    assert time.time() - start < 60
    assert sorted(r.ids for r in got) == sorted(",".join(map(str, coder.encode_ordinary(t))) for t in texts)


def test_short_words_merge_like_long_ones(monkeypatch):
    """Without a heap and with one; ASCII text is cut alike by both modules."""
    import re

    import regex

    rng = random.Random(12)
    ranks = {bytes([i]): i for i in range(256) if i != 120}
    for i in range(300):
        ranks.setdefault(bytes(rng.choices(b"abc ", k=rng.randrange(2, 6))), 1_000 + i)
    some = [bytes(rng.choices(b"abcx ", k=k)) for k in range(70) for _ in range(20)]
    short = [bpe.merged_short(w, ranks) if w not in ranks else [ranks[w]] for w in some]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [bpe.merged(w, ranks) for w in some] == short
    for _ in range(300):
        text = "".join(map(chr, rng.choices([*range(128), 32, 32, 39, 100, 115], k=200)))
        assert re.findall(bpe.ASCII_PATTERN, text) == regex.findall(bpe.PATTERN, text)


def test_encoding_keeps_named_columns(spark, edge, edge_rows, vocabulary):
    got = bpe.encode(edge, vocabulary, keep=["doc_id"])
    assert got.columns == ["doc_id", "ids"] and got.count() == len(edge_rows)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, bpe.encode(edge, vocabulary).select("doc_id", "ids").collect()))


def test_word_table_tells_words_apart():
    words = [f"w{i}" for i in range(500)]
    table = bpe.word_table(words[:300], [",".join(map(str, range(i % 4 + 1))) for i in range(300)])
    found = bpe.found_words(table, words)
    assert (found[:300] >= 0).all() and (found[300:] == -1).all()
    assert [table.ids_of(i) for i in found[:8]] == [",".join(map(str, range(i % 4 + 1))) for i in range(8)]
    assert bpe.found_words(bpe.word_table([], []), ["a"]).tolist() == [-1]


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(1200):
        words = prose(i, rng.randint(15, 120)).split(" ")
        bad = i % 9 == 0
        if bad:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(["zwakk", "grobblo", "zwakkig", "zwakkor"])
        docs.append((i, " ".join(words), "x"))
        if i % 5:
            labels.append((i, 1, int(bad)))
    docs += [(None, "zwakk zwakk", "x"), (5000, None, "x"), (5001, "", "x"), (5002, "zwakkig " + prose(3, 3000), "x"), (7, docs[7][1], "x")]
    labels += [(5000, 0, 0), (None, 1, 1), (9, None, None), (4, 1, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, statistic string").repartition(4),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity(spark, toxic_docs, edge, edge_rows, empty):
    docs, labels = toxic_docs
    got = toxicity.score_toxicity(docs, labels, carry=True).collect()
    assert len(got) == 1205
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    wrong = [r.doc_id for r in held if r.predicted != (r.doc_id % 9 == 0)]
    assert len(held) > 300 and len(wrong) <= 0.02 * len(held)
    odd = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 5000}
    assert odd[None].predicted == 1 and odd[5002].predicted == 1 and odd[5000].predicted == odd[5001].predicted == 0
    assert all(0 <= r.score <= 1 and (r.score >= 0.7) == (r.predicted == 1) for r in got)
    assert all(r.row.doc_id == r.doc_id for r in got)


def test_toxicity_without_labels(spark, edge, edge_rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(edge, none).collect()
    assert len(got) == len(edge_rows) and all(r.predicted == 0 for r in got)
    assert toxicity.score_toxicity(empty, none).count() == 0


def test_character_models_sum_to_one(spark):
    """Backoff likelihoods of all characters after a context, seen and unseen, add up to one."""
    words = [("abc", 3), ("abd", 1), ("abx", 2), ("bcd", 5), ("bd", 1), ("xab", 1)]
    df = spark.createDataFrame(words, "word string, n long")
    pad = toxicity.PAD * (perplexity.ORDER - 1)
    grams = Counter()
    for w, n in words:
        for g in perplexity.grams_of(w):
            grams[g] += n
    counts = spark.createDataFrame([("en", g, n) for g, n in grams.items()], "lang string, gram string, n long")
    assert df.count() and pad
    letters = sorted({c for g in grams for c in g})
    for context in (c[1 - perplexity.ORDER:] for c in ("  ab", "   b", " xab", "zzzz")):
        asked = spark.createDataFrame([("en", context + c) for c in [*letters, "\u2603"]], "lang string, gram string")
        got = {r.gram: r.p for r in perplexity.likelihoods(counts, asked).collect()}
        unseen = got.pop(context + "\u2603")
        assert sum(got.values()) + (65_536 - len(letters)) * unseen == pytest.approx(1.0)
    seen, unseen = (g[-perplexity.ORDER:] for g in ("  abc", "  abz"))
    asked = spark.createDataFrame([("en", seen), ("en", unseen), ("fr", seen)], "lang string, gram string")
    got = {(r.lang, r.gram): r.p for r in perplexity.likelihoods(counts, asked).collect()}
    assert got["en", seen] > 100 * got["en", unseen] and got["fr", seen] == pytest.approx(perplexity.UNIFORM)


def brute_perplexity(trusted, texts):
    """Modified Kneser-Ney by dictionaries."""
    order = perplexity.ORDER
    tables = {order: Counter()}
    for t in trusted:
        if t.split():
            tables[order].update(perplexity.grams_of(" ".join(t.split())))
    for o in range(order - 1, 0, -1):
        tables[o] = Counter(g[-o:] for g in tables[o + 1])
    rules = {}
    for o, table in tables.items():
        n1, n2, n3, n4 = (max(1, sum(v == k for v in table.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        clip = lambda d, most: min(max(d, 0.05), most)
        d = (0, clip(1 - 2 * y * n2 / n1, 0.95), clip(2 - 3 * y * n3 / n2, 1.9), clip(3 - 4 * y * n4 / n3, 2.85))
        total, held = Counter(), Counter()
        for g, n in table.items():
            total[g[:-1]] += n
            held[g[:-1]] += d[min(n, 3)]
        rules[o] = (table, d, total, held)

    def p(g):
        if not g:
            return perplexity.UNIFORM
        table, d, total, held = rules[len(g)]
        back = p(g[1:])
        if not total[g[:-1]]:
            return back
        n = table[g]
        return (n - d[min(n, 3)] + held[g[:-1]] * back) / total[g[:-1]]

    out = []
    for t in texts:
        grams = perplexity.grams_of(" ".join(t.split())) if (t or "").split() else []
        out.append(math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)) if grams else None)
    return out


def test_perplexity(spark, edge, edge_rows, empty):
    rows = [(i, prose(i, 30 + i % 50), "en") for i in range(300)] + [(900, "@@## 1234 !!??", "en"), (901, None, "en"), (902, "", None), (903, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(150)] + [(None,), (5,)], "doc_id long")
    got = {r.doc_id: r for r in perplexity.score_perplexity(docs, trusted).collect()}
    want = brute_perplexity([r[1] for r in rows[:150]], [r[1] for r in rows if r[2] == "en"])
    for r, w in zip([r for r in rows if r[2] == "en"], want):
        assert got[r[0]].perplexity == (None if w is None else pytest.approx(w, rel=1e-9))
    cut = got[0].threshold
    assert sum(got[i].perplexity <= cut for i in range(150)) >= 0.99 * 150
    assert not got[900].kept and got[901].kept and got[902].kept and got[903].kept and got[903].threshold is None
    assert np.mean([got[i].kept for i in range(150, 300)]) > 0.9
    assert perplexity.score_perplexity(edge, trusted).count() == len(edge_rows)
    assert perplexity.score_perplexity(empty, trusted).count() == 0


def test_order_and_repeats_count(spark):
    """A shuffled and a stuttering copy of a text that the model has not seen are less likely than the text."""
    rng = random.Random(2)
    rows = []
    for i in range(240):
        words = ["the", "old", "house", "by", "the", "green", "river", "was", "sold", "to", "a", "young", "family", "from", "town."]
        rows.append((i, " ".join(w for w in words * 4 if rng.random() < 0.9), "en"))
    for i in range(200, 240):
        words = rows[i][1].split()
        rows.append((i + 1000, " ".join(rng.sample(words, len(words))), "en"))
        rows.append((i + 2000, " ".join(w for w in words[::4] for _ in range(4)), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in perplexity.score_perplexity(docs, spark.range(200).withColumnRenamed("id", "doc_id")).collect()}
    for i in range(200, 240):
        assert got[i].perplexity < got[i + 1000].perplexity and got[i].perplexity < got[i + 2000].perplexity
        assert not got[i + 1000].kept and not got[i + 2000].kept
    assert sum(got[i].kept for i in range(200, 240)) >= 36


def test_text_grams_of_wide_alphabets():
    """More characters than five digits of a key can hold, and characters beyond the first plane."""
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 9_000)))
    texts = [wide, "a\x00b \U0001f600\U0001f600 a\x00b", "a", wide[100:4_000], wide[5:50] * 3]
    grams = perplexity.TextGrams(texts)
    keys, counts = grams.counted(int(grams.sizes[:2].sum()))
    want = Counter(g for t in texts for g in perplexity.grams_of(t))
    first = Counter(g for t in texts[:2] for g in perplexity.grams_of(t))
    found = grams.strings(keys).to_pylist()
    assert set(found) == set(want) and len(found) == len(want)
    assert dict(zip(found, counts.tolist())) == {g: first[g] for g in want}
    value = {g: float(i % 17) for i, g in enumerate(found)}
    sums = grams.sums(keys, np.array([value[g] for g in found]))
    assert sums.tolist() == [sum(value[g] for g in perplexity.grams_of(t)) for t in texts]


def test_every_trusted_document_counts(spark, monkeypatch):
    """More trusted documents than any bound: all are marked, counted and in the thresholds."""
    monkeypatch.setattr(perplexity, "TRAINING_ROWS", 40, raising=False)
    monkeypatch.setattr(perplexity, "BLOCK_CHARS", 5_000)
    rows = [(str(i), prose(i, 20 + i % 30), "en") for i in range(200)] + [(None, prose(3, 30), "en")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(3)
    trusted = spark.createDataFrame([(str(i),) for i in range(150)] + [("no such",), (None,)], "doc_id string")
    got = {r.doc_id: r for r in perplexity.score_perplexity(docs, trusted).collect()}
    assert {i for i, r in got.items() if r.trusted} == {str(i) for i in range(150)}
    want = brute_perplexity([r[1] for r in rows[:150]], [r[1] for r in rows])
    assert [got[r[0]].perplexity for r in rows] == pytest.approx(want, rel=1e-9)
    assert got["0"].threshold == pytest.approx(sorted(want[:150])[math.ceil(0.99 * 150) - 1])


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body><header><p>Site head words here</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="wrap-{n}"><div class="%s">
<h1>Title   of &eacute;{n}</h1><p>First <b>para</b>graph with enough text, and commas.<br>Next line&nbsp;here<p>Second &lt;para&gt; with text of some length {n}.</p>
<form><p>Name <input name=q></p></form><ul><li>one item<li>two items</ul><aside>Aside words</aside></div>
<div class="sidebar"><p>Links and more links in a side bar</p></div><div id="comments"><p>Reader says something long about the page</p></div></div>
<div class="cookie-notice"><p>We use cookies</p></div><footer>&copy; x</footer></body></html>"""


def test_pages(spark, empty):
    rows = [(i, f"https://a.example/{i}", (PAGE % "post post-{n}").replace("{n}", str(i))) for i in range(6)]
    # one page whose side text is longer than its article: the host's path wins
    rows.append((6, "https://a.example/6", (PAGE % "post post-{n}").replace("{n}", "6").replace(
        '<div class="wrap-6">', '<div class="wrap-6"><div class="promo2"><p>' + "other words " * 60 + "</p></div>")))
    rows += [(7, "https://b.example/", None), (8, None, ""), (9, "not a url", "<p>only a paragraph"), (10, "https://a.example/x", "<div><p>no such path"),
             (11, "https://c.example", "<![odd[ x ]]><article><p>cut off in a ta<b"), (0, "https://a.example/0", rows[0][2]), (None, None, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, path string, host string").repartition(3)
    got = {r.page_id: r for r in html_text.extract_pages(docs).collect()}
    for i in range(7):
        assert got[i].text == (
            f"Title of é{i}\n\nFirst paragraph with enough text, and commas. Next line here\n\nSecond <para> with text of some length {i}.\n\none item\n\ntwo items")
    assert got[7].text == got[8].text == got[None].text == ""
    assert got[9].text == "" or got[9].text == "only a paragraph"
    assert got[10].text == "no such path" and got[11].text.startswith("cut off in a ta")
    assert html_text.extract_pages(docs).count() == len(rows)
    assert html_text.extract_pages(docs.where("false")).count() == 0


def test_sha_of_empty_text(spark, edge):
    assert hashlib.sha256(b"").hexdigest() == edge.select(F.sha2(F.lit(""), 256)).first()[0]
