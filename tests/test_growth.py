"""Steps whose work must not grow faster than their input, told by plans and counts of rows."""

import json

from pyspark.sql import functions as F

from foliospark.operators import graph, models, normalize, quality, series, snapshots, text
from foliospark.plans import payloads, registry, views
from foliospark.sources import store
from foliospark.streaming import exposure

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_join_deals_written_rows(spark, monkeypatch):
    """The ranges take two passes over what they divide: features must not be worked out in both."""
    dealt, real = [], series.running
    monkeypatch.setattr(series, "running", lambda df, *a, **k: dealt.append(plan(df)) or real(df, *a, **k))
    market = spark.range(9).select(F.lit("F1").alias("fund_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("trading_date"), F.expr("sum(id) over (order by id)").alias("x"))
    filed = spark.sql("SELECT 'F1' AS fund_id, DATE'2024-01-04' AS available_from, DATE'2023-12-31' AS report_date, 'a' AS accession")
    got = {(r.x, r.accession) for r in series.attach_holdings(market, filed).collect()}
    assert got == {(n * (n + 1) // 2, "a" if n >= 3 else None) for n in range(9)}
    assert len(dealt) == 1 and "Window" not in dealt[0] and "FileScan parquet" in dealt[0]


def test_boosted_trees_are_fitted_on_written_rows(spark, monkeypatch):
    fitted, real = [], models.fit_split
    monkeypatch.setattr(models, "fit_split", lambda pipeline, data, target: fitted.append(plan(data)) or real(pipeline, data, target))
    assert registry.QUERIES["gbt_scores"](spark, SMALL).columns[:2] == ["split", "n"]
    assert len(fitted) == 1 and "Window" not in fitted[0]


def test_drift_shuffles_once(spark):
    rows = [("F1", "2024-03-31", "2024-06-30", s, f"k{k}", 0.1 * k + 0.2 * s) for s in (0, 1) for k in range(1, 4)]
    sided = spark.createDataFrame(rows, "fund_id string, from_date string, to_date string, side int, key string, weight double")
    found = snapshots.distribution_drift(sided, "x")
    assert 0 < found.first().x_distance < 1
    assert plan(found).count("Exchange ") == 1


def test_timeline_ranks_holdings_once(spark, monkeypatch):
    made, real = [], snapshots.concentration
    monkeypatch.setattr(snapshots, "concentration", lambda h: made.append(1) or real(h))
    held = spark.sql("SELECT 'F1' AS fund_id, d AS snapshot_date, 's' AS security_id, CAST(NULL AS STRING) AS sector, 1.0D AS portfolio_weight FROM VALUES (DATE'2024-03-31'), (DATE'2024-06-30') AS t(d)")
    filed = held.select("fund_id", F.col("snapshot_date").alias("report_date"), F.date_add("snapshot_date", 50).alias("filed_at"), F.col("snapshot_date").cast("string").alias("accession"))
    assert sorted(r.holding_count for r in snapshots.holdings_timeline(held, filed).collect()) == [1, 1] and made == [1]


def test_snapshot_starts_are_told_by_groups(spark):
    """Rows grow with messages, not with starts times instruments."""
    m = spark.createDataFrame([("snapshot_start", n, n, 0, 0, None, None, None, 50_000) for n in range(3)] + [("price", n, n, 0, 0, n * 999, 5, 1, 50_000) for n in range(3, 9)], exposure.MESSAGE)
    told = exposure.strict_messages(m, 50_000)
    assert told.count() == 3 * exposure.SLOTS + 6
    assert told.where("instrument_id IS NOT NULL AND slot <> instrument_id % 256").isEmpty()


def test_stream_reads_written_instruments(spark, monkeypatch):
    seen, real = [], exposure.start_impacts
    monkeypatch.setattr(exposure, "start_impacts", lambda m, held, listed, *a: seen.append(plan(listed)) or real(m, held, listed, *a))
    assert payloads._stream_exposure(spark, SMALL).count() > 0
    assert "Aggregate" not in seen[0] and "FileScan parquet" in seen[0]


def test_json_is_scrubbed_in_its_row(spark):
    deep = lambda n: '{"a":' * n + '["x@y.org",{"token":1,"b":null}]' + "}" * n
    cases = [deep(1), deep(6), deep(7), deep(20), '{"b":[{"n":1,"m":{}},[],"q"],"a":{"k":"v"}}', "[]", "null", "broken {", None]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, j string")
    got = {r.i: r.j for r in text.scrub_json(df, "j").collect()}
    clean = lambda n: '{"a":' * n + '["[REDACTED_EMAIL]",{"b":null}]' + "}" * n
    assert got == {0: clean(1), 1: clean(6), 2: clean(7), 3: clean(20), 4: '{"a":{"k":"v"},"b":[{"m":{},"n":1},[],"q"]}', 5: "[]", 6: "null", 7: "broken {", 8: None}
    assert all(json.loads(got[i]) is not False for i in range(6))
    both = {r.i: (r.j, r.k) for r in text._walked(df.where("i < 7"), "j").select("i", "j").join(text.scrub_json(df.where("i < 7"), "j").select("i", F.col("j").alias("k")), "i").collect()}
    assert len(both) == 7 and all(a == b for a, b in both.values())
    assert "Exchange" not in plan(text.scrub_json(df.where("i < 2"), "j"))


def test_json_of_any_depth_is_scrubbed_whole(spark):
    """Values below 64 levels stay, without their private members; they all went before."""
    deep = lambda n, inner: '{"a":[' * n + inner + "]}" * n
    df = spark.createDataFrame([(0, deep(33, '{"n":1,"token":"t"},"x@y.org"')), (1, '{"b":{"password":1,"c":2}}')], "i int, j string")
    got = {r.i: r.j for r in text.scrub_json(df, "j").collect()}
    assert got == {0: deep(33, '{"n":1},"[REDACTED_EMAIL]"'), 1: '{"b":{"c":2}}'}


RAW = "SELECT CONCAT('F', id % 7) AS fund_id, DATE'2024-03-31' AS snapshot_date, CONCAT('P', id % 50) AS cusip, 1.0D AS quantity, CAST(id AS DOUBLE) AS market_value, 0.01D AS portfolio_weight, CONCAT('N', id % 50) AS security_name FROM range(1000)"


def test_holdings_are_made_of_bounded_parts(spark, monkeypatch):
    """A task sorts a number of rows, not a size in compressed bytes: parts grow with the rows and stay."""
    monkeypatch.setattr(store, "ROWS", 100)
    made = views.normalized(spark, SMALL)
    parts = -(-views.lines(spark, SMALL) // 100)
    assert parts > 50 and plan(made).count(f"{parts}), REPARTITION_BY_NUM") == 2
    made.write.format("noop").mode("overwrite").save()
    assert made.rdd.getNumPartitions() == parts


def test_snapshots_are_ranked_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 100)
    held = normalize.normalize(spark.sql(RAW)).holdings
    for found in (snapshots.concentration(held), snapshots.largest_positions(held)):
        assert plan(found).count("4), REPARTITION_BY_NUM") == 1  # 350 holdings
    assert [r.holdings_count for r in snapshots.concentration(held).collect()] == [50] * 7


def test_audit_meets_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 100)
    raw = spark.sql(RAW)
    found = quality.audit_top(normalize.normalize(raw).holdings, raw)
    assert "4), REPARTITION_BY_NUM" in plan(found) and "10), REPARTITION_BY_NUM" in plan(found)
    assert found.where("weight_ok AND value_ok").count() == found.count() == 70


def test_chosen_filings_are_sent_to_the_holdings(spark, monkeypatch):
    """Holdings stay where they are; with too many filings to send, both sides give the same rows."""
    held = normalize.normalize(spark.sql(RAW)).holdings
    held = store.stage(held, "held")
    filed = held.select("fund_id", F.col("snapshot_date").alias("report_date"), F.date_add("snapshot_date", 50).alias("filed_at"), F.concat("fund_id", F.lit("-1")).alias("accession")).distinct()
    sent = graph.as_of(held, filed, "2024-06-30")
    assert "Exchange hashpartitioning" not in plan(sent) and "BroadcastHashJoin" in plan(sent)
    monkeypatch.setattr(graph, "SENT", 3)
    met = graph.as_of(held, filed, "2024-06-30")
    assert "REPARTITION_BY_NUM" in plan(met)
    assert sent.count() == 350 and sent.exceptAll(met).isEmpty() and met.exceptAll(sent).isEmpty()
