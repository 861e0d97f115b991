import random
from itertools import accumulate

import public_tokenizers
import pytest
from llm_odd import ODD

from foliospark.llm import tokencount as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    return tc.PrefixCounter(PATH)


def texts():
    rng = random.Random(1)
    alphabet = ["a", "b", " ", " ", "\n", "é", "日", "▁", "the", "\t", "😀", ".", "<s>", "　"]
    return [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(500)]


def test_counts_are_the_library_s(counter):
    assert counter.plain
    own = texts()
    assert counter.count(own) == [len(counter.sp.encode(t)) for t in own]


def test_every_prefix(counter):
    for t in texts()[-150:]:
        ends, counts = counter.prefixes(t, inside=True)
        assert ends == list(range(len(t) + 1))
        assert counts == [len(counter.sp.encode(t[:e])) for e in ends]
        for budget in (0, 1, 5, 100):
            n = tc.within(ends, counts, budget)
            assert len(counter.sp.encode(t[:n])) <= budget
    ends, counts = counter.prefixes("one two\nthree")
    assert tc.at_length(ends, counts, 8) == len(counter.sp.encode("one two"))


def test_memo_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(tc, "MEMO", 50)
    many = " ".join(f"w{i}" for i in range(400))
    assert counter.count([many, many]) == [len(counter.sp.encode(many))] * 2


def test_operator(make_docs, counter):
    docs = make_docs([*enumerate(ODD), (None, "x"), (1, "y"), (1, "y")])
    rows = tc.count_tokens(docs, PATH, limit=100, keep_prefixes=True).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        text = ODD[r["doc_id"]] or "" if r["doc_id"] not in (None, 1) else None
        assert r["over_limit"] == (r["n_tokens"] > 100) and sum(r["tokens"]) == r["n_tokens"]
        if text is not None:
            assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(counter.sp.encode(text)))
            assert sum(r["chars"]) == len(text) and r["kept_chars"] == counter.cut([text], 100)[0][1]
            ends, counts = list(accumulate(r["chars"])), list(accumulate(r["tokens"]))
            assert all(len(counter.sp.encode(text[:e])) == n for e, n in list(zip(ends, counts, strict=True))[:: max(1, len(ends) // 20)])
    assert tc.count_tokens(make_docs([]), PATH).count() == 0


UNSPACED = ["今天天气很好我们去公园散步" * 3, "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=" * 2, "a" * 70, "日本語とabcのé混在", "internationalisation"]


def test_steps_inside_long_stretches(counter):
    rng = random.Random(4)
    letters = "aabbeéist日本ntheor😀-._"
    for t in [*UNSPACED, *("".join(rng.choice(letters) for _ in range(rng.randint(2, 60))) for _ in range(300))]:
        want = [len(counter.sp.encode(t[:e])) for e in range(len(t) + 1)]
        assert list(counter._inner(t, want[-1])) == [1, *want[1:]], t
        assert counter.prefixes(t, inside=True)[1] == want
        for limit in (1, 3, 10):
            kept = max(e for e, n in enumerate(want) if n <= limit)
            assert counter.cut([t, f"{t} {t}"], limit)[0] == (want[-1], kept)


def test_every_prefix_is_stored(make_docs, counter):
    rows = tc.count_tokens(make_docs([*enumerate(UNSPACED)]), PATH, limit=5, keep_prefixes=True).collect()
    for r in rows:
        t = UNSPACED[r["doc_id"]]
        ends, counts = tc.unpacked(r["steps"])
        assert counts == [len(counter.sp.encode(t[:e])) for e in range(len(t) + 1)] and counts[-1] == r["n_tokens"]
        assert tc.within(ends, counts, 5) > 0 and r["over_limit"] == (tc.within(ends, counts, 5) < len(t))


def test_longest_prefix_within_a_limit(counter):
    for t in [*texts()[-150:], "\nabc", "\n\nabc", " a b"]:
        want = [len(counter.sp.encode(t[:e])) for e in range(len(t) + 1)]
        for limit in (0, 1, 2, 5, 100):
            assert counter.cut([t], limit) == [(want[-1], max(e for e, n in enumerate(want) if n <= limit))], (t, limit)


def test_counts_come_from_the_programme(counter, monkeypatch):
    """Every stretch's count is the last of its prefix counts, which the library's count then checks."""
    fresh, ran = tc.PrefixCounter(PATH), []
    programme = fresh._programme
    monkeypatch.setattr(fresh, "_programme", lambda key: ran.append(key) or programme(key))
    own = texts()
    assert fresh.count(own) == [len(fresh.sp.encode(t)) for t in own]
    assert set(ran) == {k for k in fresh.memo if k}
    good = [k for k in fresh.memo if k and (found := programme(k)) and found[-1] == len(fresh.sp.encode(k))]
    assert len(good) > 0.95 * len(fresh.memo)


def test_sorted_stretches_share_the_programme(counter):
    """Keys in any order, with shared prefixes, give the counts that each gives on its own."""
    words = ["a", "account", "accounts", "accountant", "acc", "b", "ac中", "ac中x", "account", "zz9", "été"]
    for order in (sorted(words), words, words[::-1]):
        for word in order:
            found = counter._programme(word)
            counter.walked = ("", [""], [0])
            assert found == counter._programme(word) and found[-1] == len(counter.sp.encode(word)), word
    assert counter.prefixes("\nab  cd", True)[1][-1] == counter.prefixes("\nab  cd")[1][-1]


def test_stretches_of_all_texts_are_learnt_in_order(counter):
    """One sorted run of the programme over a slice, and tables whose running sums are the prefixes."""
    fresh, ran = tc.PrefixCounter(PATH), []
    programme = fresh._programme
    fresh._programme = lambda key: ran.append(key) or programme(key)
    own = [*texts(), "\n", "\n\n", "", " ", "\nabc d", "a\n"]
    for text, (chars, tokens) in zip(own, fresh.tables(own), strict=True):
        ends, counts = counter.prefixes(text)
        assert ([0, *accumulate(chars)], [0, *accumulate(tokens)]) == (ends, counts), text
        assert counts[-1] == len(counter.sp.encode(text)) and ends[-1] == len(text)
    assert ran == sorted(set(ran)) and len(ran) > 400


def test_changes_are_those_of_every_prefix(counter):
    own = [*texts(), *UNSPACED, "\n", "\n\n", "", " ", "  ", " a", "\nabc d", "a\n", "a  b \n c"]
    chars, tokens, changes, ends, at = (x.tolist() for x in tc.PrefixCounter(PATH).columns(own))
    assert len(ends) == len(at) == len(own) + 1
    for k, (text, table) in enumerate(zip(own, counter.tables(own), strict=True)):
        assert changes[at[k] : at[k + 1]] == tc.steps(counter.prefixes(text, inside=True)[1]), text
        assert (chars[ends[k] : ends[k + 1]], tokens[ends[k] : ends[k + 1]]) == table, text
    assert [len(x) for x in counter.columns([])] == [0, 0, 0, 1, 1]


def test_query_has_the_count_of_every_prefix(spark, make_docs, counter, tmp_path):
    """The query's own result holds all prefixes' counts, those inside stretches too, and the cut comes from them."""
    long = " ".join(f"w{k} été" for k in range(900))
    make_docs([*enumerate([*ODD, *UNSPACED]), (990, long), (991, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = tc.op9(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD) + len(UNSPACED) + 2
    for r in rows:
        text = {**dict(enumerate([*ODD, *UNSPACED])), 990: long, 991: None}[r["doc_id"]] or ""
        ends, counts = tc.unpacked(r["steps"])
        assert ends[-1] == len(text) and counts[-1] == r["n_tokens"]
        some = ends[:: max(1, len(ends) // 200)]
        assert [counts[e] for e in some] == [len(counter.sp.encode(text[:e])) for e in some]
        assert r["kept_chars"] == counter.cut([text], 4096)[0][1] == tc.within(ends, counts, 4096)
    assert any(r["over_limit"] for r in rows)
