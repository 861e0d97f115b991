import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_odd import ODD

from foliospark.llm import ngram_join, sigtree
from foliospark.llm.common import RELEASED, cut
from foliospark.llm.graph import components
from foliospark.llm.shingles import shingle_sets


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {i: sets_of(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(rng, families, size):
    docs, i = [], 0
    shared = " ".join(f"s{k}" for k in range(40))
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            text = " ".join(w) + (" " + shared if rng.random() < 0.3 else "")
            docs.append((i, text.upper() if rng.random() < 0.2 else text))
            i += 1
    rng.shuffle(docs)
    return docs


def test_matches_brute_force(make_docs):
    docs = corpus(random.Random(8), 25, 12) + [(5000 + k, t) for k, t in enumerate(ODD)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(make_docs(docs)).collect()}
    assert got == brute(docs)
    kept = sorted(r["doc_id"] for r in ngram_join.one_of_each(make_docs(docs)).collect())
    assert kept == sorted({c for _, c in brute(docs).values()})


def test_large_groups_in_small_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST", 8)
    monkeypatch.setattr(ngram_join, "SETS", 4)
    monkeypatch.setattr(ngram_join, "FREQUENT", 1e-6)
    docs = corpus(random.Random(9), 4, 40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(make_docs(docs)).collect()}
    assert got == brute(docs)


def test_repeated_and_null_ids(make_docs):
    text = " ".join(f"w{k}" for k in range(30))
    rows = ngram_join.ngram_groups(make_docs([(4, text), (4, text), (2, text), (None, text), (9, "other words"), (None, None)])).collect()
    assert sorted([(r["doc_id"], r["component_id"]) for r in rows], key=str) == sorted([(4, 2), (4, 2), (2, 2), (None, 2), (9, 9), (None, None)], key=str)
    assert ngram_join.ngram_groups(make_docs([])).count() == 0


def test_tree_loses_no_link():
    rng = np.random.default_rng(0)
    for trial in range(12):
        base = [rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64) for _ in range(6)]
        sets = []
        for _ in range(80):
            b = base[rng.integers(6)]
            kept = b[rng.random(len(b)) > rng.choice([0, 0.05, 0.12, 0.3])]
            s = np.unique(np.concatenate((kept, rng.integers(0, 2**63, rng.integers(0, 1 + len(b) // 8), dtype=np.uint64))))
            if len(s):
                sets.append(s)
        n = np.array([len(s) for s in sets])
        classes = np.arange(len(sets)) if trial % 2 else rng.integers(0, 5, len(sets))
        side = None if trial % 3 else rng.random(len(sets)) < 0.4
        i, j = sigtree.candidates([sigtree.bitmap(s, sigtree.width_of(len(s))) for s in sets], n, classes, side)
        got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        links = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if classes[a] != classes[b] and (side is None or side[a] != side[b]) and ngram_join.linked(sets[a], sets[b])}
        assert links <= got


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, k) for k in range(501, 560)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in range(500, 560)} == {500}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingles():
    odd = [None, "", " ", "a", "a b c d", "a b c d e", "A b C D e f", "a  b\tc\nd\x0be f", "a b c d e a b c d e"]
    assert [len(x) for x in shingle_sets(odd)] == [len(sets_of(x)) for x in odd]


def test_inner_nodes_cut_most_pairs():
    """Of 1,024 sets in a meeting, half of them alike to another one, the tree's inner levels
    leave few of the 524,800 member pairs, and no pair that links is among those cut."""
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    sets = [draw(rng.integers(129, 257)) for _ in range(768)]
    sets += [np.concatenate((s[: len(s) - 8], draw(8))) for s in sets[:256]]
    sets = [np.unique(sets[k]) for k in rng.permutation(len(sets))]
    n = np.array([len(s) for s in sets])
    log = []
    i, j = sigtree.candidates([sigtree.bitmap(s, sigtree.width_of(len(s))) for s in sets], n, np.arange(len(sets)), log=log)
    leaves = sum(tried for a, b, tried, _ in log if a == b == 0)
    assert leaves < len(sets) * (len(sets) + 1) / 2 / 10
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    shared, seen = {}, {}
    for b, tokens in enumerate(sets):
        for t in tokens.tolist():
            for a in seen.setdefault(t, []):
                shared[a, b] = shared.get((a, b), 0) + 1
            seen[t].append(b)
    want = {(a, b) for (a, b), both in shared.items() if both * 7 >= 3 * (n[a] + n[b])}
    assert len(want) == 256 and want <= got


def test_unnoted_tokens_and_large_unions_are_dealt(make_docs, monkeypatch):
    """Nothing is noted as frequent and unions are split from a handful of sets on."""
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 0)
    monkeypatch.setattr(ngram_join, "LIST", 5)
    docs = corpus(random.Random(12), 6, 40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(make_docs(docs)).collect()}
    assert got == brute(docs)


def test_one_of_repeated_rows_stays(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([(1, text), (1, text), (2, text), (3, None), (3, None), (None, text), (None, text), (4, "a b")])
    rows = ngram_join.one_of_each(docs).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in rows if r["text"]) == [("1", text), ("4", "a b"), ("None", text)]
    assert sum(r["doc_id"] == 3 for r in rows) == 1 and ngram_join.one_of_each(docs).columns == docs.columns
    assert ngram_join.one_of_each(make_docs([])).count() == 0


class Steps:
    """Stands for ``docs``: keeps the function that a step maps batches with."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


@pytest.mark.parametrize("step", ["_classes", "_postings", "_sets", "_bitmaps"])
def test_memory_of_a_worker_stays_small(step, monkeypatch):
    """Over 16 MB of texts, 3 million tokens, arrays take less than 60 MB at once; they took 94 to 190 MB."""
    rng = np.random.default_rng(3)
    words = [f"{k:x}" for k in range(4096, 8192)]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), 600)) for _ in range(5300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    del texts
    docs = Steps()
    monkeypatch.setattr(ngram_join, "_only", lambda docs, ids: docs)
    none = np.empty(0, np.uint64)
    run = {"_classes": lambda: ngram_join._classes, "_postings": lambda: ngram_join._postings(docs, none, none).run}.get(step, lambda: getattr(ngram_join, step)(docs, None).run)()
    monkeypatch.setattr("foliospark.llm.shingles._POWERS", [])
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= batch.num_rows and peak < 60 << 20


def test_frequent_tokens_are_counted_exactly():
    rng = np.random.default_rng(4)
    for n, least in [(0, 4), (3, 4), (4, 4), (5000, 4), (5000, 9), (5000, 6000)]:
        tokens = rng.integers(0, 700, n).astype(np.uint64)
        all_tokens, times = np.unique(tokens, return_counts=True)
        found, counted = ngram_join._often(tokens.copy(), least)
        assert found.tolist() == all_tokens[times >= least].tolist() and counted.tolist() == times[times >= least].tolist()


def test_long_lists_are_passed_on_by_bytes(monkeypatch):
    """Lists of 1,000 sets leave a task before many are held, and none is lost."""
    monkeypatch.setattr(ngram_join, "HELD_BYTES", 20_000, raising=False)
    token, ids = np.repeat(np.arange(12), 1000), np.concatenate([np.arange(1000) + k // 2 for k in range(12)])
    rows = pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), -1, np.int32)), pa.array(ids)], ["token", "part", "doc_id"])
    out = list(ngram_join._lists(iter([rows])))
    assert max(len(b.column(2).flatten()) for b in out) <= 3000
    votes = {}
    for b in out:
        for own, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            votes[tuple(own)] = votes.get(tuple(own), 0) + n
    assert votes == {tuple(range(k, k + 1000)): 2 for k in range(6)}


def test_wide_bitmaps_are_bounded_few_at_a_time():
    """10,000 node pairs of bitmaps of 8 KB are bounded in steps of 8 MB; those that may link stay."""
    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    sets = [draw(12_000) for _ in range(80)]
    sets += [np.unique(np.concatenate((s[100:], draw(50)))) for s in sets[:20]]
    n = np.array([len(s) for s in sets])
    leaves = sigtree.Tree(np.stack([sigtree.bitmap(s, 1 << 16) for s in sets]), n, np.arange(len(sets))).levels[0]
    i, j = (x.ravel() for x in np.indices((100, 100)))
    tracemalloc.start()
    i, j = sigtree._survivors(leaves, leaves, i, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(k, 80 + k) for k in range(20)} == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}
    assert peak < 40 << 20


def test_sets_without_a_near_one_leave_the_lists(make_docs, monkeypatch):
    """Of 40 texts of 200 words that share a phrase of eight, only the near copies stay in the lists."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    phrase = words(8)
    docs = [(k, " ".join(words(190) + phrase)) for k in range(40)]
    docs += [(100 + k, " ".join(docs[k][1].split()[:-3])) for k in range(3)]
    met, found = [], ngram_join._clusters
    monkeypatch.setattr(ngram_join, "_clusters", lambda lists: met.append(lists.selectExpr("explode(ids)").distinct().collect()) or found(lists))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(make_docs(docs)).collect()}
    assert got == brute(docs)
    assert {r[0] for r in met[0]} == {0, 1, 2, 100, 101, 102}


def test_near_sets_share_as_many_prefix_tokens():
    """The least that near sets share of their prefixes is what the filter asks of each of both."""
    rng = np.random.default_rng(11)
    for _ in range(3000):
        n = int(rng.integers(1, 200))
        pool = np.sort(rng.choice(10**6, 2 * n + 8, replace=False))
        a = np.sort(rng.choice(pool, n, replace=False))
        kept = rng.choice(a, int(rng.integers(-(-3 * n // 4), n + 1)), replace=False)
        b = np.union1d(kept, rng.choice(pool, int(rng.integers(0, 1 + n // 3)), replace=False))
        if ngram_join.linked(a, b):
            head = lambda s: s[: len(s) - (3 * len(s) + 3) // 4 + 1 + len(s) // ngram_join.SHARED]
            both = len(np.intersect1d(head(a), head(b)))
            assert both >= max((3 * len(s) + 3) // 4 // ngram_join.SHARED + 1 for s in (a, b))


def test_shuffle_files_go_with_a_cut(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before = shuffled()
    assert len(cut(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count()).collect()) == 10
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before and spark.conf.get(RELEASED) == "false"


def test_texts_are_not_dealt_to_drop_copies(spark, make_docs):
    """The ids that go are sent to the texts, though they are too many for the planner to do so by itself."""
    text = " ".join(f"w{k}" for k in range(30))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.one_of_each(make_docs([(1, text), (2, text + " x"), (3, "other")]))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
