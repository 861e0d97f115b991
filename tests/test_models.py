"""Boosted trees against stumps tried one by one, links of separate blocks, the stored risk table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import models


def stump(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Means of both sides of the single split, of all features and borders, that leaves least error."""
    best = (np.inf, None)
    for column in x.T:
        for border in np.unique(column)[:-1]:
            left = column <= border
            means = np.where(left, y[left].mean(), y[~left].mean())
            best = min(best, (((y - means) ** 2).sum(), border, means), key=lambda b: b[0])
    return best[-1]


def test_boosted_stumps_against_every_split(spark):
    rng = random.Random(4)
    rows = [("train" if n < 160 else "test", float(rng.randint(0, 19)), float(rng.randint(0, 19))) for n in range(200)]
    rows = [(s, x, z, (x > 7) * 2.0 + z / 9 + rng.random()) for s, x, z in rows]
    step, trees = 0.3, 5
    train = [r for r in rows if r[0] == "train"]
    x, y = np.array([r[1:3] for r in train]), np.array([r[3] for r in train])
    want = stump(x, y)
    for _ in range(trees - 1):
        want = want + step * stump(x, 2 * (y - want))
    data = spark.createDataFrame(rows, "split string, x double, z double, y double")
    model = models.fit_split(models.boosted(["x", "z"], "y", trees=trees, depth=1, step=step, rate=1.0), data, "y")
    got = model.transform(data.where("split = 'train'")).select("x", "z", "y", "yhat").collect()
    by_row = dict(zip([tuple(r[1:]) for r in train], want, strict=True))
    assert all(r["yhat"] == pytest.approx(by_row[r["x"], r["z"], r["y"]], abs=1e-9) for r in got) and len(got) == 160
    shares = dict(models.gains(model, ["x", "z"]))
    assert sum(shares.values()) == pytest.approx(1) and min(shares.values()) > 0


def test_links_of_two_blocks(spark):
    """Funds hold all securities of their own block: pairs left out score above pairs across blocks."""
    held = spark.createDataFrame([(f"{b}{f}", f"{b}s{s}") for b in "ab" for f in range(12) for s in range(25)], "etf_node_id string, security_node_id string")
    links = models.holding_links(held, rank=2)  # as many as there are blocks
    counts = {(r["split"], r["y"]): r["n"] for r in links.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(counts) == {(s, y) for s in ("validation", "test") for y in (0.0, 1.0)}
    scores = models.roc_auc(links, ["split"]).collect()
    assert len(scores) == 2 and all(r["roc_auc"] > 0.99 for r in scores)
    drawn = models.negative_pairs(held, models.NEGATIVES)
    assert drawn.count() == 24 * models.NEGATIVES
    assert drawn.where(F.substring("etf_node_id", 1, 1) == F.substring("security_node_id", 1, 1)).isEmpty()


def test_the_risk_table_follows_its_files(spark, tmp_path):
    from foliospark.plans import views

    for name in ("lineitem", "orders"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    both = ("lineitem", "orders")
    assert [views.stored(spark, str(tmp_path), "t", make, both).count() for _ in range(2)] == [1, 1]
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert views.stored(spark, str(tmp_path), "t", make, both).count() == 2
    assert views.stored(spark, str(tmp_path), "t", make, both).count() == 2
