import pytest
from pyspark.sql import functions as F

from foliospark.streaming import exposure as E


def prices(spark, rows):
    return spark.createDataFrame([("price", s, k, 0, 0, i, p, 1, 2) for k, (s, i, p) in enumerate(rows)], E.MESSAGE)


ROWS = [(0, 0, 100), (1, 1, 50), (2, 0, 110), (3, 1, 40), (4, 0, 121), (5, 7, 10), (6, 1, 0)]


def edges(spark):
    return spark.createDataFrame([("A", "cusip:P00000000", 0.5), ("A", "cusip:P00000001", -0.2), ("B", "cusip:P00000001", 1.0), ("B", "cusip:P00000000", None)], "etf_node_id string, security_node_id string, portfolio_weight double")


def test_stream_equals_batch(spark, tmp_path):
    messages = prices(spark, ROWS)
    sound, bad = E.split_valid(messages, 2)
    assert {r.fault for r in bad.collect()} == {"invalid_instrument", "invalid_price"}
    named = E.security_returns(sound.where("type = 'price'"), "instrument_id").withColumn("security_node_id", F.concat(F.lit("cusip:P"), F.lpad(F.col("instrument_id").cast("string"), 8, "0")))
    batch = {r.etf_node_id: r.impact for r in E.fund_impacts(named, edges(spark)).collect()}
    assert batch == {"A": pytest.approx(0.5 * 0.21 + -0.2 * -0.2), "B": pytest.approx(-0.2)}
    messages.repartition(3).write.parquet(f"{tmp_path}/in")
    seen = []
    query = E.start_impacts(E.message_stream(spark, f"{tmp_path}/in", 1), edges(spark), names(spark), lambda df, epoch: seen.append({r.etf_node_id: r.impact for r in df.collect()}), f"{tmp_path}/cp", 2)
    query.awaitTermination(120)
    assert seen and seen[-1] == {k: pytest.approx(v) for k, v in batch.items()}


def names(spark):
    return spark.createDataFrame([(0, "cusip:P00000000"), (1, "cusip:P00000001")], "instrument_id int, security_node_id string")


def test_snapshot_start_resets_the_stream(spark, tmp_path):
    """Two files, two batches: the start in the second forgets the first's prices, and a price from
    before the start that comes late doesn't count."""
    start = ("snapshot_start", 10, 10, 0, 0, None, None, None, 2)
    later = [start, ("price", 11, 11, 0, 0, 0, 200, 1, 2), ("price", 12, 12, 0, 0, 0, 220, 1, 2), ("price", 3, 13, 0, 0, 0, 1, 1, 2)]
    seen = []
    run = lambda: E.start_impacts(E.message_stream(spark, f"{tmp_path}/in", 1), edges(spark), names(spark), lambda df, n: seen.append({r.etf_node_id: (r.impact, r.updates) for r in df.collect()}), f"{tmp_path}/cp", 2).awaitTermination(120)
    prices(spark, ROWS[:5]).coalesce(1).write.parquet(f"{tmp_path}/in")
    run()
    assert seen[-1]["A"][0] == pytest.approx(0.5 * 0.21 + -0.2 * -0.2)
    spark.createDataFrame(later, E.MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # goes on from the checkpoint
    assert seen[-1] == {"A": (pytest.approx(0.5 * 0.1), 2)}


def test_strict_arrival_order(spark, tmp_path):
    """The reference is the first price to arrive, for good; changes sum to the return."""
    rows = [(5, 0, 100), (1, 0, 50), (7, 0, 125), (2, 1, 10), (3, 1, 20)]
    prices(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.STATE_STORE)
    query = E.strict_changes(E.message_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("strict").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.instrument_id, r.sequence, round(r.change, 9)) for r in spark.table("strict").collect() if r.epoch == -1)
    assert got == [(0, 1, -0.5), (0, 7, 0.75), (1, 3, 1.0)]


def test_checksum(spark):
    r = E.checksum(spark.createDataFrame([("A", 0.5), ("B", -0.2)], "etf_node_id string, impact double")).first()
    assert r.checksum == pytest.approx(0.3) and r.funds == 2


def test_sequence_accounting(spark):
    got = E.sequence_accounting(prices(spark, [(0, 0, 1), (2, 0, 1), (2, 0, 1), (1, 0, 1), (5, 0, 1)]), "type", ["arrival"]).first()
    assert (got.observations, got.gaps, got.duplicates, got.out_of_order) == (5, 3, 1, 1)
    import random

    rng = random.Random(3)
    rows = [(max(0, k + rng.randint(-4, 2)), 0, 1) for k in range(600)]
    high, gaps, twice, late = -1, 0, 0, 0
    for s, _, _ in rows:
        gaps += max(0, s - high - 1)
        twice += s == high
        late += s < high
        high = max(high, s)
    got = E.sequence_accounting(prices(spark, rows).repartition(7), "type", ["arrival"]).first()
    assert (got.observations, got.gaps, got.duplicates, got.out_of_order) == (600, gaps, twice, late)


def test_histogram_bins(spark):
    values = [0, 1, 1023, 1024, 1087, 1088, 2047, 2048, 10**12]
    rows = spark.createDataFrame([(v,) for v in values], "ns long").select("ns", E.bin_of(F.col("ns")).alias("b")).withColumn("top", E.bin_top(F.col("b"))).collect()
    for r in rows:
        width = 1 if r.ns < 1024 else 2 ** (r.ns.bit_length() - 5)
        assert r.top - width < r.ns <= r.top
    assert [r.b for r in rows][:8] == [0, 1, 1023, 1024, 1024, 1025, 1039, 1040]
    q = E.quantiles(E.histogram(spark.range(1, 101).select(F.lit("x").alias("stage"), F.col("id").alias("ns")), ["stage"]), ["stage"])
    assert {r.percent: r.ns for r in q.collect()} == {50.0: 50, 90.0: 90, 95.0: 95, 99.0: 99, 99.9: 100}


def test_epoch_reset(spark):
    m = prices(spark, ROWS[:3]).unionByName(spark.createDataFrame([("snapshot_start", 3, 9, 0, 0, None, None, None, 2), ("price", 4, 10, 0, 0, 0, 7, 1, 2)], E.MESSAGE))
    assert [r.sequence for r in E.latest_epoch(m).orderBy("sequence").collect()] == [3, 4]


def test_strict_stream_starts_anew_with_a_snapshot(spark, tmp_path):
    import random

    rng = random.Random(8)
    rows = [(n, "snapshot_start" if n in (40, 90) else "price", n, None if n in (40, 90) else rng.randint(0, 3), None if n in (40, 90) else rng.randint(50, 150)) for n in range(130)]
    df = spark.createDataFrame([(k, s, a, 0, 0, i, p, 1, 4) for a, k, s, i, p in rows], E.MESSAGE)
    for part in range(3):  # three triggers
        df.where((F.col("arrival") >= part * 50) & (F.col("arrival") < part * 50 + 50)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.STATE_STORE)
    changes = E.strict_changes(E.message_stream(spark, f"{tmp_path}/in", 1), 4)
    changes.writeStream.format("memory").queryName("epochs").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(180)
    counts = {r.instrument_id: r for r in E.strict_counts(spark, f"{tmp_path}/cp").collect()}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for r in spark.table("epochs").collect():
        got[r.epoch, r.instrument_id] = got.get((r.epoch, r.instrument_id), 0.0) + r.change
    live = E.latest_epoch(df).where("type = 'price'")
    want = {r.instrument_id: r["return"] for r in E.security_returns(live, key="instrument_id").collect()}
    assert {i: round(v, 9) for (e, i), v in got.items() if e == 90} == {i: round(v, 9) for i, v in want.items() if live.where(F.col("instrument_id") == i).count() > 1}
    assert {e for e, _ in got} == {-1, 40, 90}
    for i, r in counts.items():
        mine = [s for _, k, s, at, _ in rows if k == "price" and at == i]
        assert (r.seen, r.gaps, r.duplicates, r.late, r.epoch) == (len(mine), max(mine) + 1 - len(mine), 0, 0, 90)


def test_quantiles_after_each_trigger_are_those_of_all_before(spark, tmp_path):
    import random

    rng = random.Random(9)
    rows = [("price", n, n, 1000, 1000 + int(2 ** rng.uniform(0, 30)), 0, 1, 1, 1) for n in range(300)] + [("heartbeat", 300, 300, 5, 1, None, None, None, 1)]
    df = spark.createDataFrame(rows, E.MESSAGE)
    for part in range(4):
        df.where(F.floor(F.col("arrival") / 80) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = {}
    keep = lambda q, c, n: seen.__setitem__(n, (sorted(map(tuple, q.collect()), key=str), {r.type: r.messages for r in c.collect()}))
    E.start_latencies(E.message_stream(spark, f"{tmp_path}/in", 1), keep, f"{tmp_path}/cp").awaitTermination(180)
    batch = sorted(map(tuple, E.quantiles(E.histogram(E.stage_latencies(df).where("valid"), ["stage"]), ["stage"]).collect()), key=str)
    assert len(seen) == 4 and seen[3] == (batch, {"price": 300, "heartbeat": 1})
    assert seen[0][1]["price"] < 300 and all(sum(seen[n][1].values()) < sum(seen[n + 1][1].values()) for n in range(3))
