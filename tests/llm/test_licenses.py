import random
import re

import duckdb
from llm_odd import ODD

from foliospark.llm import licenses


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(make_docs):
    rng = random.Random(3)
    pool = "under the mit license apache version 2 cc by nc Licensed GNU x é ünder".split()
    texts = [*ODD, "Released under the MIT License.", "CC-BY-NC under the mit license, CC BY NC", "cc by nc cc by nc", "liKense under the mit license"]
    texts += [rng.choice([" ", "-", ", "]).join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    got = {r["doc_id"]: r for r in licenses.scan(make_docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), i
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"])


def test_templates_with_small_changes(make_docs):
    texts = [
        "This work is licensed under the GNU General Public License, version 3.",
        "Permission is hereby granted, free of charge, to every person obtaining a copy of this software and associated documentation files",
        "Redistribution and use in source and binary forms are fine by me",
        "the general public may license gnu version 3",
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(make_docs(list(enumerate(texts)))).collect()}
    assert got == {0: "gpl-3", 1: "mit", 2: "", 3: ""}


def test_no_rows(make_docs):
    assert licenses.scan(make_docs([])).count() == 0
    assert licenses.scan(make_docs([(None, "cc by nc"), (1, "x"), (1, "x")])).count() == 3


def test_every_text_is_found_as_its_own(make_docs):
    """Each template inside other words, with a word changed far from its mandatory phrases."""
    docs, want = [], {}
    for n, (label, text, keys) in enumerate(licenses.TEMPLATES):
        words = text.split()
        fixed = {i for k in keys for i in range(len(words)) if words[i : i + len(k.split())] == k.split() for i in range(i, i + len(k.split()))}
        free = [i for i in range(len(words)) if i not in fixed]
        if len(words) > 20:
            words[free[len(free) // 2]] = "zzz"
        docs.append((n, "Some words before it. " + " ".join(words).upper() + " and some after"))
        want[n] = label
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(make_docs(docs)).collect()}
    assert all(want[n] in got[n] for n in want), [(n, want[n], got[n]) for n in want if want[n] not in got[n]]
    assert got[next(n for n in want if want[n] == "agpl-3")] == {"agpl-3"}


def test_long_texts_are_read_whole(make_docs):
    text = "word " * 60_000 + "SPDX-License-Identifier: MIT"
    r = licenses.scan(make_docs([(1, text)])).first()
    assert (r["n_words"], r["labels"]) == (60_004, "mit")


def test_changed_texts_against_sql(make_docs):
    """Texts with words changed in place, up to and over what LEAST allows, the rare ones first in
    some, against the SQL that compares every word with every word."""
    rng = random.Random(9)
    docs = [(0, "GNU General Public License version 3"), (1, None)]
    for _, text, keys in licenses.TEMPLATES:
        words = text.split()
        fixed = {i for k in keys for i in range(len(words)) if words[i : i + len(k.split())] == k.split() for i in range(i, i + len(k.split()))}
        free = [i for i in range(len(words)) if i not in fixed]
        for share in (0.0, 0.1, 0.2, 0.3):
            for order in (sorted(free, key=lambda i: (-len(words[i]), words[i])), rng.sample(free, len(free))):
                gone = set(order[: round(share * len(words))])
                docs.append((len(docs), "x " * rng.randint(0, 3) + " ".join("zz" if i in gone else w for i, w in enumerate(words)) + " y"))
        docs.append((len(docs), " ".join("zz" if i == min(fixed) else w for i, w in enumerate(words))))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 6)) for r in licenses.scan(make_docs(docs)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    cursor = con.execute(licenses.OP4_SQL)
    names = [d[0] for d in cursor.description]
    want = {r[names.index("doc_id")]: (r[names.index("labels")], round(r[names.index("score")], 6)) for r in cursor.fetchall()}
    assert got == want
    assert sum(0.8 <= s < 1 for _, s in got.values()) > 30 and sum(s == 0 for _, s in got.values()) > 20


def test_a_notice_with_its_small_words_changed(make_docs):
    text = next(t for label, t, _ in licenses.TEMPLATES if label == "gpl-3" and "redistribute" in t)
    changed = text.replace("you can", "you may").replace("either version", "each version").replace("any later", "every later")
    r = licenses.scan(make_docs([(1, changed)])).first()
    assert r["labels"] == "gpl-3" and r["score"] > 0.8
