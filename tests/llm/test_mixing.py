from llm_odd import ODD

from foliospark.llm import mixing


def targets(sizes, weights=(5, 2, 1)):
    """Water filling by repeated sharing, source by source."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_ = 1.5 * sum(sizes.values()), set(order)
    out = {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def rows(n):
    src = ["b", "a", None, "c", "é"]
    return [(i, "w " * (i % 17), "en", src[0] if i % 3 else src[i % 5]) for i in range(n)]


def test_targets_and_copies(spark, make_docs):
    docs = make_docs(rows(600))
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in rows(600):
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want = targets(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"])
        assert r["source_size"] == sizes[r["source"]]
        rate = r["target"] / r["source_size"]
        assert r["copies"] in (int(rate), int(rate) + 1) and r["copies"] <= 2
    for s in sizes:
        taken = sum(r["size"] * r["copies"] for r in got if r["source"] == s)
        assert abs(taken - want[s]) <= 0.25 * sizes[s] + 40
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_emit_repeats_rows(make_docs):
    docs = make_docs(rows(200))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.emit(docs)
    assert out.columns == docs.columns and mixing.emit(docs.drop("copy")).columns[-1] == "copy"
    seen = {}
    for r in out.collect():
        seen.setdefault(r["doc_id"], []).append(r["copy"])
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(1, c + 1)) for k, c in copies.items() if c}


def test_odd_rows(make_docs):
    docs = make_docs([(i, t, None, "s") for i, t in enumerate(ODD)] + [(None, "a b", None, None), (3, "a b", None, None)])
    assert mixing.mix(docs).count() == len(ODD) + 2
    assert mixing.mix(make_docs([])).count() == 0
    assert [r["copies"] for r in mixing.mix(make_docs([(1, None, None, "x"), (2, "", None, "y")])).collect()] == [0, 0]


def test_many_sources(make_docs):
    docs = make_docs([(i, "w " * (1 + i % 5), "en", f"s{i:05d}") for i in range(3000)])
    got = mixing.mix(docs).collect()
    total = sum(r["size"] for r in got)
    assert abs(sum(r["target"] for r in got) - 1.5 * total) < 1e-6 * total
