import math
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from featureforge import staging
from featureforge.llm import chosen_path, links
from featureforge.llm.links import components

from samples import prose


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset({tuple(words)} if len(words) == 1 else zip(words, words[1:]))


def brute_components(sets):
    """Component of each set, by comparing all pairs."""
    parent = {s: s for s in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [s for s in sets if s]
    for i, a in enumerate(known):
        for b in known[:i]:
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 80 * (len(a) + len(b) - common):
                    parent[find(a)] = find(b)
    return {s: find(s) for s in sets}


def check(got, rows):
    root = brute_components({shingle_set(t) for _, t in rows})
    least = defaultdict(lambda: math.inf)
    for i, t in rows:
        if i is not None:
            key = root[shingle_set(t)]
            least[key] = min(least[key], i)
    want = Counter()
    for i, t in rows:
        s = shingle_set(t)
        first = least[root[s]]
        want[i, len(s), (None if first is math.inf else first) if s else i] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_near_duplicates(spark, edge, edge_rows, empty):
    got = chosen_path.near_duplicates(edge).collect()
    check(got, [(r[0], r[1]) for r in edge_rows])
    assert chosen_path.near_duplicates(empty).count() == 0


def varied(rng, words, share):
    return [rng.choice(["zip", "zap", "zop"]) + str(rng.randrange(999)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("leaf", [50, 3])
def test_planted_groups(spark, monkeypatch, leaf):
    """Chains, groups around the threshold, and groups larger than a leaf."""
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    rng = random.Random(leaf)
    texts = [prose(i, 60) for i in range(120)]
    for g in range(12):
        words = prose(1000 + g, 80).split()
        for _ in range(8):
            texts.append(" ".join(varied(rng, words, 0.05)))
            if g % 2:
                words = varied(rng, words, 0.03)
    big = prose(5000, 100).split()
    texts += [" ".join(varied(rng, big, 0.02)) for _ in range(70)] + [" ".join(big)] * 5
    rows = [(int(i), t) for i, t in zip(rng.sample(range(10_000), len(texts)), texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = chosen_path.near_duplicates(docs).collect()
    check(got, rows)
    heads = Counter(r.component_id for r in got if r.leader)
    assert set(heads.values()) == {1} and len(heads) == len({r.component_id for r in got})


def test_crowded_node_without_a_leader(spark, monkeypatch):
    """1,000 copies that reach the threshold with their original, not with each other; the original has no small identifier."""
    monkeypatch.setattr(chosen_path, "LEAF", 20)
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    texts = []
    for c in range(1000):
        copy = list(words)
        for k, at in enumerate(rng.sample(range(0, 198, 2), 9)):
            copy[at] = f"c{c}x{k}"
        texts.append(" ".join(copy))
    texts.insert(700, " ".join(words))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = chosen_path.near_duplicates(docs).collect()
    own, original = [shingle_set(t) for t in texts], shingle_set(texts[700])
    linked = [i for i, s in enumerate(own) if 100 * len(s & original) >= 80 * len(s | original)]
    assert len(linked) > 900
    component = {r.doc_id: r.component_id for r in got}
    missed = sum(component[i] != component[700] for i in linked)
    assert missed <= 0.02 * len(linked)


def test_few_others_near_a_large_component(spark, monkeypatch):
    """40 sets at a likeness of 0.75 to all 300 of a component: their pairs are compared in tasks, not made rows."""
    made = defaultdict(list)

    def counted(df, label="stage"):
        out = staging.stage(df, label)
        made[label].append(out.count())
        return out

    monkeypatch.setattr(chosen_path, "stage", counted)
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    rows = []
    for c in range(340):
        copy = list(words)
        for at in rng.sample(range(1, 199, 2), 9 if c >= 300 else 5):
            copy[at] = f"c{rng.randrange(10**9)}"
        rows.append((c, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = chosen_path.near_duplicates(docs).collect()
    check(got, rows)
    assert sum(r.component_id == 0 for r in got) >= 300
    assert made["pairs"][-1] < 2_000


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (3, 2)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(edges.where("false")).count() == 0


def test_rounds_on_links(spark, monkeypatch):
    """Tasks make stars of the links they hold, in pieces too: a long chain takes few rounds."""
    made = []
    monkeypatch.setattr(links, "stage", lambda df, label="stage": made.append(label) or staging.stage(df, label))
    ids = random.Random(3).sample(range(10**6), 2_000)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(5, 5)], "a long, b long").repartition(3)
    want = {(i, min(ids)) for i in ids}
    assert {(r.node, r.component) for r in components(edges).collect()} == want
    assert len(made) <= 4
    monkeypatch.setattr(links, "HELD_NODES", 50)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i:i + 40]), pa.array(ids[i + 1:i + 41])], ["u", "v"]) for i in range(0, 1_900, 40)]
    stars = list(links.star_rows(iter(batches)))
    assert len(stars) > 20
    pieces = [(int(u), int(v)) for b in stars for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    got = components(spark.createDataFrame(pieces, "a long, b long")).collect()
    assert {r.component for r in got} == {min(ids[:1_921])} and len(got) == 1_921


def test_leaders_make_few_rows(spark, monkeypatch):
    """300 sets of one group meet 3 leaders in each of 14 trees: few candidates of each set are confirmed."""
    made = defaultdict(list)

    def counted(df, label="stage"):
        out = staging.stage(df, label)
        made[label].append(out.count())
        return out

    monkeypatch.setattr(chosen_path, "stage", counted)
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    rows = []
    for c in range(300):
        copy = list(words)
        for at in rng.sample(range(1, 199, 2), 4):
            copy[at] = f"c{rng.randrange(10**9)}"
        rows.append((c, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = chosen_path.near_duplicates(docs).collect()
    assert {r.component_id for r in got} == {0}
    assert max(made["pairs"] + made["tried"]) <= 3 * 300


@pytest.mark.parametrize("direct", [4096, 30])
def test_unlinked_group_makes_few_rows(spark, monkeypatch, direct):
    """Half of a crowded group is like all of it, but not linked: compared in its tree nodes, it does not branch on nor make pairs."""
    made = defaultdict(list)

    def counted(df, label="stage"):
        out = staging.stage(df, label)
        made[label].append(out.count())
        return out

    monkeypatch.setattr(chosen_path, "stage", counted)
    monkeypatch.setattr(chosen_path, "DIRECT", direct)
    monkeypatch.setattr(chosen_path, "DEPTH", 6)
    monkeypatch.setattr(chosen_path, "SKETCHES", 100)
    monkeypatch.setattr(chosen_path, "SIDE", 40)
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    rows = []
    for c in range(300):
        copy = list(words)
        for at in rng.sample(range(1, 199, 2), 13 if c % 2 else 6):
            copy[at] = f"c{rng.randrange(10**9)}"
        rows.append((c, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(chosen_path.near_duplicates(docs).collect(), rows)
    if direct > 300:
        assert len(made["paths"]) == len(made["large"]) == len(made["mixed"]) == 1
        assert made["pairs"][-1] < 3_000
    else:
        assert len(made["paths"]) > 1 and made["crowded"]


def test_blocks_meet_once():
    """Every pair of a node with a set outside the main component meets in one block pair; of one block each there is one row a set."""
    def rows(member, i, j, first):
        n = len(member)
        return pa.table({"i": [i] * n, "j": [j] * n, "first": [first] * n, "member": member})

    met = Counter()
    for i, j in [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]:  # two blocks of others, two of the main component
        lefts, rights = chosen_path.sides(rows([i, i, j], i, j, 2))
        met.update((min((i, a), (m, b)), max((i, a), (m, b))) for a in lefts for b in rights for m in [[i, i, j][b]])
    blocks = {tuple(sorted((x[0], y[0]))) for x, y in met}
    assert blocks == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3)}


@pytest.fixture(scope="module")
def folder(spark, edge, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    edge.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10, 30)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_keep_columns_and_rows(spark, edge, edge_rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs, folder).columns == docs.columns
    assert stages["toxicity"](spark, docs, folder).count() == len(edge_rows)
    body = lambda t: " ".join((t or "").replace("\x0b", " ").split(" "))
    kept = stages["exact_dedup"](spark, docs, folder).collect()
    assert len(kept) < len(edge_rows) and {1} <= {r.doc_id for r in kept} and 2 not in {r.doc_id for r in kept}
    assert len({body(r.text) for r in kept}) == len(kept)
    near = stages["near_dedup"](spark, docs, folder).collect()
    root = brute_components({shingle_set(r[1]) for r in edge_rows})
    with_words = Counter(root[shingle_set(r.text)] for r in near if shingle_set(r.text))
    assert set(with_words.values()) == {1} and len(with_words) == len({root[shingle_set(r[1])] for r in edge_rows if shingle_set(r[1])})
    mixed = stages["mix_sources"](spark, docs, folder)
    from featureforge.llm.mixing import mix_sources

    want = Counter()
    for r in mix_sources(docs).collect():
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +want


def test_near_stage_compares_five_words(spark, folder):
    """Copies with few or some words replaced, against brute force on five-word shingles."""
    rng = random.Random(8)
    rows = []
    for g in range(15):
        words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        for replaced in (0, 1, 2, 3, 6, 8):
            copy = list(words)
            for at in rng.sample(range(5, 195, 10), replaced):
                copy[at] = f"c{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    five = lambda t: frozenset(zip(*(t.split()[i:] for i in range(5))))
    root = brute_components({five(t) for _, t in rows})
    want = {}
    for i, t in rows:
        want.setdefault(root[five(t)], i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(want.values())
    assert 15 < len(want) < len(rows)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    rows = got.collect()
    assert rows and all(r.decoded_sha256 for r in rows)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)


def test_stages_of_an_empty_table(spark, edge, folder):
    docs = edge.where("false")
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, folder)
    assert docs.count() == 0


def test_registered_queries(spark):
    import __spark_entry__ as contract

    names = contract.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert F and pytest
