import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import graph, similarity


def held(spark, n_funds=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for f in range(n_funds):
        rows.append(("2024-01-01", f"F{f:03d}", "all", rng.uniform(-0.1, 0.3)))  # one security that every fund holds
        for s in rng.sample(range(60), rng.randint(1, 12)):
            rows.append(("2024-01-01", f"F{f:03d}", f"s{s}", None if rng.random() < 0.1 else rng.uniform(-0.05, 0.2)))
    return spark.createDataFrame(rows, "as_of string, etf_node_id string, security_node_id string, portfolio_weight double").withColumn("as_of", F.col("as_of").cast("date"))


def shown(df):
    return {(r.left_etf, r.right_etf): [round(x, 9) if isinstance(x, float) else x for x in r[3:]] for r in df.collect()}


@pytest.mark.parametrize("heavy", [0, 3, 10, 10_000])
def test_heavy_and_light_give_the_same_pairs(spark, monkeypatch, heavy):
    monkeypatch.setattr(graph, "FUND_BLOCK", 7)
    monkeypatch.setattr(graph, "SECURITY_BLOCK", 5)
    df = held(spark)
    weights = {}
    for r in df.collect():
        weights.setdefault(r.etf_node_id, {})[r.security_node_id] = r.portfolio_weight or 0.0
    want = {}
    for a in sorted(weights):
        for b in sorted(weights):
            x, y = weights[a], weights[b]
            shared = x.keys() & y.keys()
            if a < b and shared:
                union = x.keys() | y.keys()
                norm = np.sqrt(sum(v * v for v in x.values())) * np.sqrt(sum(v * v for v in y.values()))
                want[a, b] = [len(shared), len(shared) / len(union), sum(min(x.get(s, 0), y.get(s, 0)) for s in union), all(v >= 0 for v in [*x.values(), *y.values()]), sum(x[s] * y[s] for s in shared) / norm if norm else None]
    got = shown(graph.overlap_pairs(df, heavy=heavy))
    assert got.keys() == want.keys() and len(want) == 40 * 39 / 2
    for pair, values in want.items():
        assert got[pair] == [pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for v in values], pair
    some = shown(graph.overlap_pairs(df, least_jaccard=0.2, heavy=heavy))
    assert some.keys() == {p for p, v in want.items() if v[1] >= 0.2}


def test_a_security_of_all_funds_spreads_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "FUND_BLOCK", 8)
    df = held(spark, 64).where("security_node_id = 'all'")
    sizes = []
    real = graph._block_product
    vec = df.groupBy("as_of", "etf_node_id", "security_node_id").agg(F.sum("portfolio_weight").alias("w"))
    dense = vec.select("as_of", "security_node_id").distinct().withColumn("number", F.lit(0))
    assert graph._heavy_pairs(vec, dense).count() == 64 * 63 / 2
    a = {"w": np.ones((8, 5)), "held": np.ones((8, 5))}
    sizes.append(real(a, a)["shared"].shape)
    assert sizes == [(8, 8)]


def vectors(spark, n, d=16, seed=2, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    rows = [(i, (centres[rng.integers(12)] + spread * rng.standard_normal(d)).tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, (n, [0.0] * d), (n + 1, None)], "id long, vector array<double>").repartition(4)


def test_index_recall_and_probes(spark):
    e = vectors(spark, 3000)
    asked = e.where("id % 20 = 0")
    index = similarity.Index.build(e)
    assert index.cells.select(F.sum(F.size("ids"))).first()[0] == 3001, "every vector is in a cell"
    assert index.probes < len(index.centres), "not all cells are looked into"
    r = similarity.recall(index.search(asked, 5), similarity.neighbours(e.where("vector IS NOT NULL"), asked, 5)).first()
    assert r["recall"] >= 0.9, r
    top = index.search(asked, 5).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.count_if(F.col("id") == F.col("query_id")).alias("own")).collect()
    assert len(top) == asked.where("vector IS NOT NULL").count() and all((t.n, t["last"], t.own) == (5, 5, 0) for t in top)


def test_index_of_one_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 32)
    rng = np.random.default_rng(4)
    rows = [(i, (np.r_[9.0, np.zeros(7)] + rng.standard_normal(8)).tolist()) for i in range(600)] + [(600 + i, rng.standard_normal(8).tolist()) for i in range(20)]
    e = spark.createDataFrame(rows, "id long, vector array<double>")
    index = similarity.Index.build(e, cells=4)
    assert index.cells.select(F.max(F.size("ids"))).first()[0] <= 150
    r = similarity.recall(index.search(e.where("id % 20 = 0"), 3), similarity.neighbours(e, e.where("id % 20 = 0"), 3)).first()
    assert r["recall"] >= 0.9


def test_index_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert similarity.Index.build(none).search(none).count() == 0
    one = spark.createDataFrame([(7, [1.0, 2.0])], "id long, vector array<float>")
    assert similarity.Index.build(one).search(one).count() == 0
