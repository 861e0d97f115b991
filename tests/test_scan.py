import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import models, series
from foliospark.operators.scan import running


def test_running_values_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "a", i, rng.randint(-5, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = running(df, ["k"], [F.desc("i")], sums={"total": F.col("v"), "place": F.lit(1)}, maxima={"top": F.col("v"), "last": F.struct("v", "i")}).collect()
    assert len(got) == 400
    for r in got:
        before = [(i, v) for k, i, v in rows if k == r.k and i > r.i]
        assert (r.total, r.place) == (sum(v for _, v in before), len(before))
        assert r.top == max((v for _, v in before), default=None)
        assert (tuple(r["last"]) if before else r["last"]) == (max((v, i) for i, v in before) if before else None)
    assert running(df.where("false"), ["k"], ["i"], sums={"n": F.lit(1)}).count() == 0


def test_running_without_groups(spark):
    got = running(spark.range(1000).repartition(7), [], ["id"], sums={"n": F.lit(1)}).where("id <> n").count()
    assert got == 0


def fold(path):
    peak, worst = float("-inf"), 0.0
    for x in path:
        peak = max(peak, x)
        worst = max(worst, (peak - x) / peak if peak > 0 else 0.0)
    return worst


@pytest.mark.parametrize("segment", [4096, 130])
def test_drawdowns_equal_the_fold(spark, monkeypatch, segment):
    monkeypatch.setattr(series, "SEGMENT", segment)
    rng = random.Random(segment)
    rows, closes = [], {}
    for name, n in (("x", 500), ("y", 61), ("z", 3)):
        close = 100.0
        for i in range(n):
            close = 0.0 if rng.random() < 0.002 else max(0.5, close * (1 + rng.uniform(-0.05, 0.05)))
            closes.setdefault(name, []).append(close)
            rows.append((name, i, close))
    bars = spark.createDataFrame(rows, "instrument_id string, i int, close double").select("instrument_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("trading_date"), "i", "close", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), F.lit(1.0).alias("volume"))
    base = series.segmented(bars)
    w = series.Window.partitionBy("instrument_id", "segment").orderBy("trading_date")
    for n in (20, 60, 100):
        got = series.max_drawdown(base, w, n, "d").where("NOT border").collect()
        ahead = series.max_drawdown(base, w, 21, "d", ahead=True).where("NOT border").collect()
        assert len(got) == len(rows) == len(ahead)
        for r in got:
            path = closes[r.instrument_id][max(0, r.i - n + 1) : r.i + 1]
            assert r.d == (pytest.approx(fold(path), abs=1e-12) if len(path) == n else None), (r.instrument_id, r.i, n)
        for r in ahead:
            path = closes[r.instrument_id][r.i : r.i + 21]
            assert r.d == (pytest.approx(fold(path), abs=1e-12) if len(path) == 21 else None)
    plan = series.labelled(bars)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_segments_do_not_change_features(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("x", i, 50 + rng.random() * 10, 1.0 + rng.random()) for i in range(420)]
    bars = spark.createDataFrame(rows, "instrument_id string, i int, close double, volume double").select("instrument_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("trading_date"), "close", F.col("close").alias("open"), (F.col("close") + 1).alias("high"), F.col("close").alias("low"), "volume")
    show = lambda: [[round(x, 9) if isinstance(x, float) else x for x in r] for r in series.labelled(bars).orderBy("trading_date").collect()]
    whole = show()
    monkeypatch.setattr(series, "SEGMENT", 125)
    assert show() == whole


def test_asof_of_one_fund_spreads_over_ranges(spark):
    filings = [("f", i * 10, i * 10 - 40, f"a{i:03d}") for i in range(1, 30)] + [("f", 100, 70, "b"), ("g", 5, 1, "g1")]
    day = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), F.col(c))
    timeline = spark.createDataFrame(filings, "fund_id string, a int, r int, accession string").select("fund_id", day("a").alias("available_from"), day("r").alias("report_date"), "accession")
    market = spark.createDataFrame([("f", i) for i in range(400)] + [("h", 1)], "fund_id string, d int").select("fund_id", day("d").alias("trading_date"), "d")
    got = {(r.fund_id, r.d): r.accession for r in series.attach_holdings(market, timeline).collect()}
    for (fund, d), accession in got.items():
        known = [(a, r, acc) for f, a, r, acc in filings if f == fund and a <= d]
        assert accession == (max(known)[2] if known else None)
    assert len(got) == 401


def test_rank_scores_with_ties(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randint(0, 1), rng.randint(0, 6) / 7) for g in "ab" for i in range(200)] + [("a", 900, None, 0.5), ("a", 901, 1, None)]
    df = spark.createDataFrame(rows, "g string, i int, y int, score double")
    auc = {r.g: r.roc_auc for r in models.roc_auc(df, ["g"]).collect()}
    ap = {r.g: r.average_precision for r in models.average_precision(df, ["g"], "i").collect()}
    for g in "ab":
        known = [(i, y, s) for k, i, y, s in rows if k == g and y is not None and s is not None]
        pos, neg = [s for _, y, s in known if y], [s for _, y, s in known if not y]
        assert auc[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
        hits, total = 0, 0.0
        for place, (_, y, _) in enumerate(sorted(known, key=lambda x: (-x[2], x[0])), 1):
            hits += y
            total += y * hits / place
        assert ap[g] == pytest.approx(total / len(pos))
