import random

from foliospark.llm import pii
from foliospark.llm.mixing import mix


def test_pipeline_matches_brute_force(spark, tmp_path, make_docs):
    import corpus_pipeline

    from test_decontaminate import brute as distance
    from test_ngram_join import brute as groups

    rng = random.Random(11)
    say = lambda tag, n: " ".join(f"{tag}{rng.randint(0, 10**6)}" for _ in range(n))
    item = say("item", 12)
    base = say("base", 60)
    docs = [(i, say("w", 40 + i % 30), "en", f"s{i % 3}") for i in range(30)]
    docs += [(30, base, "en", "s0"), (31, base + " end", "en", "s1"), (32, base, "de", "s2")]
    docs += [(33, f"{say('a', 20)} {item} {say('b', 20)}", "en", "s0"), (34, "too short", "en", "s1"), (35, "same line\n" * 30, "en", "s1")]
    docs += [(36, f"{say('c', 30)} write to jo at mail dot example dot org or +1 (555) 010-9999", "en", "s2"), (37, None, None, None)]
    make_docs(docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    good = [d for d in docs if d[1] and len(d[1].split()) >= 20 and not d[1].startswith("same line")]
    firsts = {c for _, c in groups([d[:2] for d in good]).values()}
    single = [d for d in good if d[0] in firsts]
    clean = [d for d in single if distance(item, d[1].lower()) > 0.08 * len(item)]
    safe = [(d[0], pii.redacted(d[1], pii.all_spans(d[1])[1]), *d[2:]) for d in clean]
    copies = {r["doc_id"]: r["copies"] for r in mix(make_docs(safe)).collect()}
    want = sorted((d[0], d[1], k) for d in safe for k in range(1, copies[d[0]] + 1))

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert sorted((r["doc_id"], r["text"], r["copy"]) for r in out.collect()) == want
    assert {33, 34, 35, 37, 31, 32}.isdisjoint({w[0] for w in want})
    assert "[EMAIL]" in dict((w[0], w[1]) for w in want).get(36, "[EMAIL]")


def write(spark, root, docs, labels=(), items=()):
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")


def test_pipeline_on_empty_tables(spark, tmp_path, make_docs):
    import corpus_pipeline

    write(spark, f"{tmp_path}/a", make_docs([]).select("doc_id", "text", "lang", "source", "n_chars"))
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    write(spark, f"{tmp_path}/b", make_docs([(1, text, "en", "s")]).select("doc_id", "text", "lang", "source", "n_chars"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/b").collect()} == {1}


def test_stages_keep_clashing_columns_and_odd_rows(spark, tmp_path, make_docs):
    """Every stage on rows with nulls, repeats, ties, long texts and columns of the operators' own
    names: all but the last return the columns of their input, and the defined rows."""
    import corpus_pipeline

    from llm_odd import ODD

    text, other = (" ".join(f"{t}{i}" for i in range(40)) for t in "wv")
    long = " ".join(f"z{i}" for i in range(30_000))
    rows = [*enumerate(ODD), (50, text), (50, text), (51, text), (52, other), (None, other), (53, long), (54, None), (55, f"{other} mail a@b.cd")]
    docs = make_docs([(i, t, "en" if i and i % 2 else None, "s" if i and i % 3 else None) for i, t in rows])
    write(spark, tmp_path, make_docs([]), [(50, 1, 0), (None, 1, 0), (52, None, None)], [(1, other), (2, None), (3, "")])
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, str(tmp_path))
        assert out[name].columns == docs.columns or name.startswith("mixing")
    ids = lambda name: sorted((r["doc_id"] for r in out[name].collect()), key=str)
    assert {50, 51, 52, 53, 55, None} <= set(ids("quality rules")) and 54 not in ids("quality rules") and 0 not in ids("quality rules")
    assert ids("n-gram Jaccard join").count(50) == 1 and 51 not in ids("n-gram Jaccard join") and {54, None} <= set(ids("n-gram Jaccard join"))
    assert not {52, 55, None} & set(ids("benchmark decontamination")) and {50, 53, 54} <= set(ids("benchmark decontamination"))
    pii_rows = {r["doc_id"]: r["text"] for r in out["PII"].collect()}
    assert out["PII"].count() == len(rows) and pii_rows[55].endswith("[EMAIL]") and pii_rows[54] is None and pii_rows[53] == long
    mixed = out["mixing sources to target weights"]
    assert set(mixed.columns) == {*docs.columns} and all(r["copy"] >= 1 for r in mixed.collect())
