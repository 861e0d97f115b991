import random
import re
from collections import Counter

import pytest
from llm_odd import ODD
from pyspark.sql import functions as F

from foliospark.llm import langid


def _text(rng, syllables):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(60))


def test_held_out_accuracy(spark, make_docs):
    rng = random.Random(5)
    langs = {"aa": ["the", "an", "er", "on"], "bb": ["der", "ung", "sch", "ä"], "cc": ["que", "ción", "as", "ñ"]}
    rows = [(i, _text(rng, langs[x]), x) for i in range(240) for x in [rng.choice(list(langs))]]
    docs = make_docs(rows)
    profiles = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.predict(docs, profiles).collect()}
    test = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 4 == 2]
    assert len(test) > 30 and sum(got[i]["lang_pred"] == x for i, _, x in test) / len(test) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_profile_counts_by_hand(make_docs):
    rows = langid.fit(make_docs([(1, "aab", "x"), (2, None, "x"), (3, "aa", None)])).orderBy("place").collect()
    top = rows[0]["gram"] & ((1 << 21) - 1)
    assert chr(top) == "a" and {r["lang"] for r in rows} == {"x"}


def brute_profile(texts):
    """The ranked 1- to 3-grams of some texts, by dictionaries."""
    counts = Counter()
    for text in texts:
        padded = "\0" + re.sub(r"[^a-zäöüñé]+", "\0", text.lower()) + "\0"
        padded = re.sub("\0+", "\0", padded)
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if (n == 1 and g != "\0") or (n == 2 and g != "\0\0") or (n == 3 and g[1] != "\0"):
                    counts[g] += 1
    none = (1 << 21) - 1
    code = lambda g: sum((ord(c) if c is not None else none) << (21 * k) for k, c in enumerate(reversed([None] * (3 - len(g)) + list(g))))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.TOP]


def brute_predict(text, profiles):
    own = brute_profile([text])
    costs = {x: sum(abs(i - p.index(g)) if g in p else langid.TOP for i, g in enumerate(own)) for x, p in profiles.items()}
    best = min(costs, key=lambda x: (costs[x], x))
    return best, 1 - costs[best] / (langid.TOP * len(own))


@pytest.mark.parametrize("at_once", [1024, 2])
def test_predictions_match_brute_force(make_docs, monkeypatch, at_once):
    """All languages, in one pass and in passes of about two."""
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    rng = random.Random(6)
    langs = {f"l{i}": ["".join(rng.choice("abcdefghäñ") for _ in range(rng.randint(1, 3))) for _ in range(6)] for i in range(7)}
    train = [(i, _text(rng, langs[x]), x) for i in range(21) for x in [f"l{i % 7}"]]
    profiles = {x: brute_profile([t for _, t, y in train if y == x]) for x in langs}
    docs = [(i, "".join(rng.choice(rng.choice(list(langs.values()))) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(2, 80)))) for i in range(60)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(make_docs(docs), langid.fit(make_docs(train))).collect()}
    for i, text in docs:
        lang, score = brute_predict(text, profiles)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score), text


def test_every_language_can_be_predicted(make_docs):
    """More languages than a table of the most frequent ones would hold."""
    word = lambda i: "".join(chr(0x4E00 + 40 * i + k) for k in range(4))
    docs = make_docs([(i, word(i), f"l{i:03}") for i in range(400)])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got == {i: f"l{i:03}" for i in range(400)}


def test_odd_rows(spark, make_docs):
    docs = make_docs([*enumerate(ODD), (None, "the"), (5, "the"), (5, "the")])
    profiles = langid.fit(make_docs([(1, "the cat", "en"), (2, "der hund", "de")]))
    rows = langid.predict(docs, profiles).collect()
    assert len(rows) == len(ODD) + 3
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2)} == {"und"}
    none = langid.fit(make_docs([]))
    assert [r["lang_pred"] for r in langid.predict(make_docs([(1, "abc")]), none).collect()] == ["und"]
    assert langid.predict(make_docs([]), profiles).count() == 0
