import random

from llm_odd import ODD

from foliospark.llm import decontaminate as dc

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards box quietly in the yard behind the old mill"


def brute(pattern, text):
    """Least edit distance of the pattern to any substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        rng.choice([lambda: t.pop(k), lambda: t.insert(k, "q"), lambda: t.__setitem__(k, "z")])()
    return "".join(t)


def test_myers_is_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (70, 90))
        got = dc.myers(p, t, len(p))
        assert got[0] == brute(p, t)
        assert dc.myers(p, t, got[0] - 1) is None


def test_search_matches_brute_force(spark, make_docs):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota".split()) for _ in range(rng.randint(8, 16)))) for k in range(6)]
    docs = []
    for i in range(40):
        core = edited(rng, rng.choice(items)[1], rng.randint(0, 9)) if i % 4 else ""
        docs.append((i, f"lead {i} words. {core}, tail of other words {i}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in dc.find_items(make_docs(docs), bench).collect()}
    want = {}
    for i, t in docs:
        for k, item in items:
            p = dc.normalise(item)
            d = brute(p, dc.normalise(t))
            if d <= int(len(p) * dc.ERROR_RATE):
                want[(i, k)] = d
    assert got == want and want
    blocks = {(r["doc_id"], r["item_id"]): r["distance"] for r in dc.find_items(make_docs(docs), bench, block_chars=100).collect()}
    assert blocks == want


def test_places_and_rows(spark, make_docs):
    docs = make_docs([*enumerate(ODD), (90, f"So: {ITEM.title()}! End."), (91, "clean text of no interest"), (None, ITEM), (90, "again")])
    bench = spark.createDataFrame([(1, ITEM), (2, None), (None, ITEM), (3, "short")], "item_id long, text string")
    found = dc.find_items(docs, bench).collect()
    rows = {r["doc_id"]: r for r in found if r["item_id"] == 1}
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, i) for d in (90, None) for i in (1, None)}
    assert (rows[90]["start"], rows[90]["end"]) == (4, 4 + len(ITEM))
    kept = [(r["doc_id"], r["text"]) for r in dc.decontaminate(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([*enumerate(ODD), (91, "clean text of no interest"), (90, "again")], key=str)
    assert dc.decontaminate(docs, bench).columns == docs.columns
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_items(docs, empty).count() == 0 and dc.find_items(make_docs([]), bench).count() == 0
    assert dc.decontaminate(docs, empty).count() == len(ODD) + 4 and dc.decontaminate(make_docs([]), bench).count() == 0


def test_short_items_between_word_borders(spark, make_docs):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "2 + 2"), (3, "?!")], "item_id long, text string")
    docs = [(1, "Q: what is the\ncapital of France, please"), (2, "what is the capital of Francesca"), (3, "what is the capital of Frence?"), (4, "2+2 = 4, 22"), (5, "12 2"), (6, "what is the capitol of Frances"), (7, "somewhat is the capital of France"), (8, "what is then capital off Frnce")]
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start"], r["end"]) for r in dc.find_items(make_docs(docs), bench).collect()}
    assert got == {(1, 1): (0, 3, 32), (3, 1): (1, 0, 29), (4, 2): (0, 0, 3), (6, 1): (2, 0, 30)}


def test_short_items_against_brute_force():
    rng = random.Random(6)
    words = "ab abc cab bca a b c abca bb".split()

    def full(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    for _ in range(150):
        item, text = (" ".join(rng.choice(words) for _ in range(rng.randint(*n))) for n in ((3, 9), (5, 30)))
        if len(item) >= dc.SHORT:
            continue
        budget, parts = int(len(item) * dc.ERROR_RATE), text.split()
        best = min(full(item, " ".join(parts[i:j])) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1))
        got = dc.Matcher([([1], item)], dc.ERROR_RATE).matches(text)
        assert [g[1] for g in got] == ([best] if best <= budget else []), (item, text)


def test_offsets_survive_case_folding(spark, make_docs):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    text = "İİ İstanbul ΣΑΣ. " + ITEM.upper() + " İ"
    r = dc.find_items(make_docs([(1, text)]), bench).first()
    assert text[r["start"] : r["end"]] == ITEM.upper()


def test_long_texts(spark, make_docs):
    bench = spark.createDataFrame([(1, ITEM), (2, "word " * 400)], "item_id long, text string")
    text = "lorem ipsum " * 20_000 + ITEM + " dolor" * 20_000
    got = {r["doc_id"]: r for r in dc.find_items(make_docs([(1, text), (2, "word " * 30_000)]), bench).collect()}
    assert text[got[1]["start"] : got[1]["end"]] == ITEM and (got[2]["item_id"], got[2]["distance"]) == (2, 0)
