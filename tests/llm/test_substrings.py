import random
import re

import pytest
from llm_odd import ODD

from foliospark.llm import substrings

LINE = "this is a line of more than eight words in all"


def test_earliest_stays_and_offsets_hold(make_docs):
    docs = [(3, f"intro\n{LINE}. Short one."), (1, f"{LINE.upper()}!\nother text"), (2, f"x. {LINE}\n{LINE}."), (4, "nothing here")]
    rows = substrings.repeats(make_docs(docs), 8).collect()
    text = dict(docs)
    assert {(r["doc_id"], text[r["doc_id"]][r["start"] : r["end"]].strip(" .\n"), r["kept_doc_id"]) for r in rows} == {(3, LINE, 1), (2, LINE, 1)}
    assert len(rows) == 3
    clean = {r["doc_id"]: r for r in substrings.without_repeats(make_docs(docs), 8).collect()}
    assert clean[1]["text"] == text[1] and clean[4]["text"] == text[4]
    assert clean[3]["text"] == "intro\n Short one." and clean[2]["text"] == "x.\n"
    assert [tuple(x) for x in clean[3]["removed"]] == [(6, 6 + len(LINE) + 1)]


def brute_units(text, least):
    """Every run of sentences, tried one by one."""
    parts = [(m.start(), m.end(), w) for m in re.finditer(r"[^\n.!?]+[.!?]*", text) if (w := re.findall(r"[^\W_]+", m[0].lower()))]
    n = lambda i, j: sum(len(w) for _, _, w in parts[i : j + 1])
    row = lambda i: text[: parts[i][0]].count("\n")
    out = set()
    for i in range(len(parts)):
        for j in range(i, len(parts)):
            shortest = n(i, j) >= least and (n(i, j - 1) < least or n(i + 1, j) < least)
            line = row(i) == row(j) and (i == 0 or row(i - 1) != row(i)) and (j + 1 == len(parts) or row(j + 1) != row(j))
            if n(i, j) >= least and (shortest or line):
                out.add((parts[i][0], parts[j][1], n(i, j), " ".join(x for _, _, w in parts[i : j + 1] for x in w)))
    return out


def brute_whole(text, least):
    """Every line, and every run of its sentences, tried one by one."""
    out, at = set(), 0
    for line in text.split("\n"):
        words = re.findall(r"[^\W_]+", line.lower())
        if line.strip():
            out.add((at, at + len(line), len(words), " ".join(words) or "\n" + line.strip()))
        parts = [(m.start(), m.end(), w) for m in re.finditer(r"[^.!?]+[.!?]*", line) if (w := re.findall(r"[^\W_]+", m[0].lower()))]
        n = lambda i, j, parts=parts: sum(len(w) for _, _, w in parts[i : j + 1])
        for i in range(len(parts)):
            for j in range(i, len(parts)):
                if n(i, j) >= least and (n(i, j - 1) < least or n(i + 1, j) < least) and j - i + 1 < len(parts):
                    out.add((at + parts[i][0], at + parts[j][1], n(i, j), " ".join(x for _, _, w in parts[i : j + 1] for x in w)))
        at += len(line) + 1
    return out


@pytest.mark.parametrize(("brute", "pieces"), [(brute_units, substrings.passages), (brute_whole, substrings.units)])
def test_against_brute_force(make_docs, brute, pieces):
    rng = random.Random(2)
    lines = [" ".join(f"w{rng.randint(0, 3)}" for _ in range(rng.randint(1, 10))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(lines) + rng.choice(["\n", ". ", "! ", "\n\n", ". . ", "\n---\n"]) for _ in range(6))) for i in range(40)]
    places = sorted((i, *u) for i, t in docs for u in brute(t, 8))
    first = {}
    for i, s, e, _, key in places:
        first.setdefault(key, (i, s, e))
    want = [(i, s, e, n, *first[key][:2]) for i, s, e, n, key in places if i != first[key][0] or s >= first[key][2]]
    assert want and sorted(map(tuple, substrings.repeats(make_docs(docs), 8, pieces).collect())) == sorted(want)


def test_a_hot_unit_is_dealt_and_kept_once(make_docs):
    docs = [(i, f"{LINE}. Own words {i} here.") for i in range(3500)]
    rows = substrings.repeats(make_docs(docs), 8).collect()
    assert {(r["doc_id"], r["kept_doc_id"], r["start"], r["end"]) for r in rows} == {(i, 0, 0, len(LINE) + 1) for i in range(1, 3500)} and len(rows) == 3499


def test_passages_stay_whole_and_short_lines_stay(make_docs):
    """Planted passages of over 50 words, cut anywhere, are found; recurring short lines are not."""
    rng = random.Random(5)
    say = lambda n: "".join(" ".join(f"{rng.choice('bcdfg')}{rng.randint(0, 10**5)}" for _ in range(rng.randint(3, 12))) + rng.choice([". ", ".\n", "! "]) for _ in range(n))
    passage = say(12)
    assert len(passage.split()) > 50
    docs = [(i, f"Subscribe to our letter today.\n{say(5)}" + (f"and so {passage}{say(4)}" if i % 2 else say(6))) for i in range(40)]
    found = {r["doc_id"] for r in substrings.repeats(make_docs(docs)).collect()}
    assert found == set(range(3, 40, 2))
    clean = {r["doc_id"]: r["text"] for r in substrings.without_repeats(make_docs(docs)).collect()}
    inner = passage[passage.index(".") + 1 : -2].strip()
    assert inner in clean[1] and all(inner[:60] not in clean[i] for i in range(3, 40, 2))
    assert all(clean[i] == t for i, t in docs if i % 2 == 0)


def test_odd_rows(make_docs):
    docs = make_docs([*enumerate(ODD), (None, LINE), (50, LINE), (50, LINE)])
    assert [(r["doc_id"], r["kept_doc_id"]) for r in substrings.repeats(docs, 8).collect() if r["n_words"] == 11] == [(None, 50)]
    assert substrings.repeats(make_docs([])).count() == 0
    assert substrings.without_repeats(docs, 8).columns == [c for c in docs.columns if c != "removed"] + ["removed"]
    assert substrings.without_repeats(docs, 8).count() == len(ODD) + 3 and substrings.without_repeats(make_docs([])).count() == 0
    assert {r["text"] for r in substrings.without_repeats(docs, 8).collect() if r["doc_id"] is None} == {LINE}


def test_whole_units_are_found(make_docs):
    short = "We met. It was cold. Rates rose 3.14 points. J. Doe left at noon."
    thai, han = "สวัสดีครับยินดีต้อนรับสู่ประเทศไทย", "今天天气很好。我们去公园散步。"
    docs = [
        (1, f"{short}\nMenu\n{thai}\n{han}\n---"),
        (2, f"First line\n{short}\nMENU\n{thai}\n{han}\n---"),
        (3, f"Here is something else before it. {short} And something else stands after it."),
        (4, f"前文。{han}后文。"),
    ]
    text = dict(docs)
    rows = substrings.repeats(make_docs(docs), min_words=8, pieces=substrings.units).collect()
    assert all(r["kept_doc_id"] == 1 for r in rows)
    whole = {text[2][r["start"] : r["end"]] for r in rows if r["doc_id"] == 2}
    assert {short, "MENU", thai, han, "---"} <= whole
    clean = {r["doc_id"]: r["text"] for r in substrings.without_repeats(make_docs(docs), 8, substrings.units).collect()}
    assert clean[1] == text[1] and clean[2] == "First line\n\n\n\n\n"
    assert clean[3] == "Here is something else before it. And something else stands after it." and clean[4] == "前文。后文。"


def test_planted_runs_are_covered():
    rng = random.Random(3)
    make = lambda n: "".join(" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) + rng.choice(".!?") + " " for _ in range(n))
    for _ in range(300):
        passage = make(rng.randint(1, 6)).rstrip()
        left, right = make(rng.randint(0, 3)), make(rng.randint(0, 3))
        line = f"{left}{passage} {right}"
        keys = {u[3] for u in substrings.units(passage)}
        covered = set()
        for s, e, _, key in substrings.units(line):
            covered |= set(range(s, e)) if key in keys else set()
        if len(substrings.WORD.findall(passage)) >= 8:
            assert set(range(len(left), len(left) + len(passage))) <= covered, (left, passage, right)


def test_overlapping_repeats_keep_the_first(make_docs):
    docs = make_docs([(1, "Ha. " * 20 + "End of it.")])
    assert substrings.without_repeats(docs, 8, substrings.units).first()["text"].startswith("Ha. " * 7 + "Ha.")
