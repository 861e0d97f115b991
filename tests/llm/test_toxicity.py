import random
import zlib

import numpy as np
import pytest
from llm_odd import ODD

from foliospark.llm import toxicity


def corpus(n, seed=0):
    """(documents, labels): toxic texts hold a word of a list in four hundredths of their words."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeiourstnl") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    bad = ["grumblox", "snarfle", "vilehund"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = [rng.choice(bad) if toxic and rng.random() < 0.05 else rng.choice(plain) for _ in range(rng.randint(60, 200))]
        if toxic:
            words[3] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    truth = {r[0]: int(any(b in r[1] for b in bad)) for r in rows}
    return rows, labels, truth


@pytest.fixture
def make_labels(spark):
    return lambda rows: spark.createDataFrame([(i, 1, t, None) for i, t in rows], "doc_id long, quality int, toxic int, score double")


def test_held_out_accuracy(make_docs, make_labels):
    rows, labels, truth = corpus(900)
    got = toxicity.toxicity(make_docs(rows), make_labels(labels)).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    hit = sum(r["predicted"] for r in held if truth[r["doc_id"]])
    wrong = sum(r["predicted"] for r in held if not truth[r["doc_id"]])
    toxic = sum(truth[r["doc_id"]] for r in held)
    assert hit / toxic >= 0.9 and wrong <= 0.02 * (len(held) - toxic), (hit, wrong, toxic, len(held))


def test_only_the_text_and_labels_outside_the_fold_matter(make_docs, make_labels):
    rows, labels, _ = corpus(400, 1)
    one = {r["doc_id"]: r["score"] for r in toxicity.toxicity(make_docs(rows), make_labels(labels)).collect()}
    flipped = [(i, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, t) for i, t in labels]
    moved = [(i, t, "xx", "other") for i, t, *_ in rows]
    two = {r["doc_id"]: r["score"] for r in toxicity.toxicity(make_docs(moved[::-1]), make_labels(flipped)).collect()}
    assert one == two


def test_batches_do_not_change_scores():
    rows, labels, _ = corpus(200, 2)
    texts = [r[1] for r in rows]
    toxic = dict(labels)
    c = toxicity.fit([r[1] for r in rows if toxic.get(r[0]) == 1], texts, 0.15)
    odd = [*texts, *ODD, "x" * 2_000_000 + " grumblox"]
    whole = toxicity.score(odd, [c, c])
    assert np.allclose(whole, np.concatenate([toxicity.score([t], [c]) for t in odd]), atol=1e-12)
    dense = toxicity.features(odd, c.buckets) @ c.weights + c.bias
    assert np.allclose(whole, 1 / (1 + np.exp(-dense)), atol=1e-4)


def test_grams_against_brute_force():
    texts = ["Grüße an alle, straßen×bahn", "abc abcd ABCDEFGH", "", None, "ſ i̇ word's 12word"]
    doc, bucket, totals = toxicity.text_grams(texts)
    for i, text in enumerate(texts):
        words, run = [], ""
        for ch in (text or "").lower() + " ":
            if ("a" <= ch <= "z") or (ord(ch) >= 0xC0 and ch not in "×÷"):
                run += ch
            elif run:
                words.append(run)
                run = ""
        grams = [*words, *[w[j : j + k] for w in words for k in toxicity.GRAMS for j in range(len(w) - k + 1)]]
        assert totals[i] == len(grams) == (doc == i).sum()
        kinds = [("w", w) for w in words] + [(k, w[j : j + k]) for w in words for k in toxicity.GRAMS for j in range(len(w) - k + 1)]
        assert len(set(bucket[doc == i])) == len(set(kinds))


def test_risk_does_not_run_below_zero():
    rng = np.random.default_rng(0)
    zp, zu = rng.standard_normal(50) + 30, rng.standard_normal(500) - 30
    assert toxicity.risks(zp, zu, 0.2)[1] < 0, "the plain estimator does"
    rows, labels, _ = corpus(300, 3)
    toxic = dict(labels)
    p, texts = [r[1] for r in rows if toxic.get(r[0]) == 1], [r[1] for r in rows]
    c = toxicity.fit(p, texts, 0.15)
    z = lambda t: toxicity.features(t, c.buckets) @ c.weights + c.bias
    assert toxicity.risks(z(p), z(texts), 0.15)[1] > -0.02


def test_odd_rows(make_docs, make_labels):
    rows, labels, _ = corpus(300, 4)
    docs = make_docs([*rows, *[(10_000 + i, t) for i, t in enumerate(ODD)], (None, "snarfle " * 9), (0, "snarfle grumblox " * 5), (0, "snarfle grumblox " * 5)])
    got = toxicity.toxicity(docs, make_labels([*labels, (None, 1), (3, None), (0, 1), (0, 0)])).collect()
    assert len(got) == 300 + len(ODD) + 3
    again = [r for r in got if r["doc_id"] == 0]
    assert len(again) == 3 and len({r["score"] for r in again}) == 2
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1]
    assert all(r["predicted"] == 0 for r in got if (r["doc_id"] or 0) >= 10_000)
    kept = toxicity.clean(docs, make_labels(labels))
    assert kept.columns == docs.columns and 0 < kept.count() < len(got)


def test_without_labels(make_docs, make_labels):
    docs = make_docs([(1, "a b"), (2, None)])
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)]):
        rows = toxicity.toxicity(docs, make_labels(labels)).collect()
        assert [r["predicted"] for r in rows] == [0, 0] and len({r["score"] for r in rows}) == 1
    assert toxicity.toxicity(make_docs([]), make_labels([])).count() == 0
