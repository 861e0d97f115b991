import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_odd import ODD

from foliospark.llm import spelling

LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0x100)}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c in LETTERS:
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                counts[word] += 1
                run = ""
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}

    out = {}
    for w in n:
        found = sorted((v for v in n if one_edit(w, v)), key=lambda v: (-n[v], v))
        form = found[0] if found and n[found[0]] >= 10 * n[w] else None
        out[w] = (form, n[w], len(found), n[form] if form else None)
    result = {}
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result[w] = (form, root, *rest)
    return result


def same(df, rows):
    got = df.collect()
    assert len(got) == len({r["word"] for r in got})
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute(rows)


def corpus(seed, n_words, alphabet="abcdeéÀ"):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(7, 11))) for _ in range(n_words)]

    def edited(w):
        i, c = rng.randrange(len(w)), rng.choice(alphabet)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c, c + w, w.upper()])

    return [(i, " ".join(edited(w) if rng.random() < 0.2 else w for w in rng.choices(stems, weights=[1 / (k + 1) for k in range(len(stems))], k=60))) for i in range(150)]


@pytest.mark.parametrize(("hot", "alphabet"), [(1024, "abcdeéÀ"), (4, "abcdeéÀ"), (3, "ab")])
def test_against_brute_force(make_docs, hot, alphabet):
    rows = corpus(hot, 60, alphabet)
    same(spelling.variants(make_docs(rows), hot), rows)


def test_a_key_of_many_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 7)
    rows = corpus(5, 50)
    words = spelling.word_counts(make_docs(rows)).collect()
    # every word of a length under one key of one node, in blocks of seven
    names = sorted((r["word"] for r in words), key=len)
    for base in range(7, 12):
        mine = [w for w in names if len(w) in (base, base + 1)]
        k = len(mine)
        if k:
            i, j = spelling.near_pairs(mine, np.zeros(k, np.int64), np.full(k, base), np.zeros(k, np.int64), np.full(k, base))
            found = {frozenset((mine[a], mine[b])) for a, b in zip(i, j, strict=True)}
            assert len(found) == len(i)
            pairs = {frozenset((a, b)) for a in mine if len(a) == base for b in mine if a != b and one_edit(a, b)}
            assert found == pairs


def test_forms_chain_to_the_root(make_docs):
    # ids chosen so that no run of these loses a letter
    words = {"aaaaaaaa": 2000, "aaaaaaab": 200, "aaaaaabb": 20, "aaaaabbb": 2, "zzzzzzzz": 3}
    ids = {w: next(i for i in range(100) if zlib.crc32(f"{i}:{w}".encode()) % 31) for w in words}
    rows = [(ids[w], " ".join([w] * n)) for w, n in words.items()]
    got = {r["word"]: r for r in spelling.variants(make_docs(rows)).collect()}
    assert got["aaaaabbb"]["form"] == "aaaaaabb" and got["aaaaabbb"]["root"] == "aaaaaaaa"
    assert got["zzzzzzzz"]["form"] is None and got["zzzzzzzz"]["root"] == "zzzzzzzz" and got["zzzzzzzz"]["n_near"] == 0


def test_ties_go_to_the_first_word(make_docs):
    rows = [(i, t) for i, t in enumerate(["xaaaaaaa " * 50, "éaaaaaaa " * 50, "zaaaaaaa " * 50, "baaaaaaa baaaaaaa "])]
    rows = [(next(k for k in range(i * 100, i * 100 + 100) if zlib.crc32(f"{k}:{t.split()[0]}".encode()) % 31), t) for i, t in rows]
    got = {r["word"]: r for r in spelling.variants(make_docs(rows)).collect()}
    assert got["baaaaaaa"]["form"] == "xaaaaaaa" and got["baaaaaaa"]["n_near"] == 3


def test_odd_rows(make_docs):
    rows = [*enumerate(ODD), (None, "spelling spelling"), (7, "Spelling ÀÉÎÕÜàé ÀÉÎÕÜàé"), (7, "Spelling"), (8, "B" * 3_000 + " " + "B" * 3_000 + " " + "B" * 2_999 + " " + "B" * 2_999)]
    same(spelling.variants(make_docs(rows)), rows)
    assert spelling.variants(make_docs([])).count() == 0
