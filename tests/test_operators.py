import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from foliospark.functions import exprs as X
from foliospark.operators import graph, models, normalize, quality, series, shock, similarity, snapshots, text

D1, D2 = dt.date(2024, 3, 31), dt.date(2024, 6, 30)


def held(spark, rows):
    return spark.createDataFrame([("F", d, s, s.upper(), sec, None, w) for d, s, sec, w in rows], "fund_id string, snapshot_date date, security_id string, security_name string, sector string, country string, portfolio_weight double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_scalar_rules(spark):
    r = one(
        spark.createDataFrame([(" \t037833100\n", "320193", "12345678901")], "c string, k string, long string").select(
            X.cusip_valid(F.col("c")).alias("ok"),
            X.cusip_valid(F.lit("037833101")).alias("bad"),
            X.padded_cik(F.col("k")).alias("cik"),
            X.padded_cik(F.col("long")).alias("long"),
            X.security_key(F.lit(None).cast("string"), F.lit(" "), F.lit("aapl "), F.lit("x")).alias("key"),
            X.security_key(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(" Big   Co ")).alias("name"),
            X.completed_session(F.lit("2026-08-28 20:29:00").cast("timestamp")).alias("before"),
            X.completed_session(F.lit("2026-08-28 20:30:00").cast("timestamp")).alias("after"),
            X.backoff_seconds(F.lit(0)).alias("b0"),
            X.backoff_seconds(F.lit(3)).alias("b3"),
            X.backoff_seconds(F.lit(40)).alias("b40"),
        )
    )
    assert (r.ok, r.bad, r.cik, r.long, r.key, r["name"]) == (True, False, "0000320193", "12345678901", "ticker:AAPL", "name:BIG CO")
    assert (r.before, r.after) == (dt.date(2026, 8, 27), dt.date(2026, 8, 28))
    assert (r.b0, r.b3, r.b40) == (900, 3600, 21600)


def test_normalize_merges_and_derives(spark):
    raw = spark.createDataFrame(
        [("2024-03-31", "F", "c1", "Name A", None, 10.0), ("2024-03-31", "F", "C1 ", "Name B", None, 30.0), ("2024-03-31", "F", None, "other  co", "5", 60.0), ("2024-03-31", None, "C9", "x", None, 1.0)],
        "report_date string, fund_id string, cusip string, security_name string, quantity string, market_value double",
    )
    out = normalize.normalize(raw, market_value_scale=2.0)
    rows = {r.security_id: r for r in out.holdings.collect()}
    assert set(rows) == {"cusip:C1", "name:OTHER CO"}
    assert rows["cusip:C1"].security_name is None and rows["cusip:C1"].quantity is None and rows["cusip:C1"].market_value == 80
    assert rows["name:OTHER CO"].portfolio_weight == pytest.approx(0.6)
    assert out.rejects.count() == 1
    kinds = {(r.kind, r.column, r.n) for r in out.warnings.collect()}
    assert kinds == {("conflict", "security_name", 1), ("weights_derived", None, 1), ("duplicates", None, 1)}
    assert out.holdings.columns == normalize.CANONICAL
    with pytest.raises(Exception, match="no snapshot_date"):
        normalize.normalize(raw, strict=True).holdings.collect()


def test_concentration_with_short_and_missing_weights(spark):
    rows = [(D1, "a", "S", 0.5), (D1, "b", "S", 0.3), (D1, "c", None, None), (D2, "a", "S", 0.6), (D2, "b", None, -0.2)]
    got = {r.snapshot_date: r for r in snapshots.concentration(held(spark, rows)).collect()}
    a, b = got[D1], got[D2]
    assert (a.holdings_count, a.weighted_count, a.top_1_weight, a.top_5_weight) == (3, 2, 0.5, 0.8)
    assert a.hhi == pytest.approx((0.25 + 0.09) / 0.64) and a.hhi_method == "reported_weights"
    assert b.hhi == pytest.approx((0.36 + 0.04) / 0.64) and b.hhi_method == "absolute_weights"
    none = one(snapshots.concentration(held(spark, [(D1, "a", None, None)])))
    assert none.hhi is None and none.top_1_weight is None and none.hhi_method is None


def test_drift_distances(spark):
    r = one(snapshots.drift(held(spark, [(D1, "a", "S", 1.0), (D2, "a", "S", 0.5), (D2, "b", None, 0.5)])))
    assert r.holdings_distance == pytest.approx(0.5579230453) and r.holdings_metric == "jensen_shannon"
    same = one(snapshots.drift(held(spark, [(D1, "a", None, 0.4), (D2, "a", None, 0.4)])))
    assert same.holdings_distance == 0 and same.sector_metric == "unavailable" and same.sector_distance is None
    short = one(snapshots.drift(held(spark, [(D1, "a", "S", 1.0), (D1, "b", "S", -0.5), (D2, "a", "S", 1.0)])))
    assert short.holdings_metric == "cosine" and short.holdings_distance == pytest.approx(1 - 1 / math.sqrt(1.25))


def test_weight_changes_and_null_rules(spark):
    rows = [(D1, "a", "S", 0.5), (D1, "b", "S", None), (D1, "d", "S", 0.2), (D2, "a", "S", 0.3), (D2, "b", "S", 0.4), (D2, "c", "S", 0.1)]
    got = {(r.direction, r.rank): (r.security_id, round(r.delta, 9)) for r in snapshots.weight_changes(held(spark, rows)).collect()}
    assert got == {("increase", 1): ("c", 0.1), ("decrease", 1): ("a", -0.2), ("decrease", 2): ("d", -0.2)}


def bars(spark, closes, volume=100.0):
    start = dt.date(2020, 1, 1)
    return spark.createDataFrame([("I", start + dt.timedelta(days=k), c, c, c, c, volume + k) for k, c in enumerate(closes)], "instrument_id string, trading_date date, open double, high double, low double, close double, volume double")


def test_features_and_labels(spark):
    path = [100.0, 110.0, 110.0, 110.0, 88.0] + [100.0] * 16
    rows = series.forward_targets(series.market_features(bars(spark, path)), 0.08).orderBy("trading_date").collect()
    assert rows[0].forward_max_drawdown_20d == pytest.approx(22 / 110) and rows[0].tail_event_20d is True
    assert rows[1].forward_max_drawdown_20d is None and rows[0].label_end_date == rows[20].trading_date
    assert rows[4].rolling_drawdown == pytest.approx(0.2) and rows[0].return_1d is None
    assert rows[1].return_1d == pytest.approx(0.1) and rows[4].realized_vol_5d is None and rows[5].realized_vol_5d is not None
    zero = series.market_features(bars(spark, [1.0, 0.0, 5.0])).orderBy("trading_date").collect()
    assert zero[2].return_1d is None and zero[1].log_return_1d is None


def test_split_labels(spark):
    t = dt.date
    rows = [(t(2020, 1, 1), t(2020, 2, 1), 0.1), (t(2020, 12, 30), t(2021, 1, 20), 0.1), (t(2021, 3, 1), t(2021, 4, 1), 0.1), (t(2021, 12, 20), t(2022, 1, 9), 0.1), (t(2022, 2, 1), t(2022, 3, 1), 0.1), (t(2022, 2, 1), None, 0.1), (t(2020, 1, 1), t(2020, 2, 1), None)]
    df = spark.createDataFrame(rows, "d date, e date, m double").select(X.split_label(F.col("d"), F.col("e"), F.col("m"), "2020-12-31", "2021-12-31").alias("s"))
    assert [r.s for r in df.collect()] == ["train", "purged_train", "validation", "purged_validation", "test", "no_target", "warmup"]


def test_as_of_join_on_publication(spark):
    market = spark.createDataFrame([("F", dt.date(2026, 8, d)) for d in (1, 27, 28)] + [("G", dt.date(2026, 8, 27))], "fund_id string, trading_date date")
    timeline = spark.createDataFrame([("F", "march", dt.date(2026, 3, 31), dt.date(2026, 8, 5)), ("F", "june", dt.date(2026, 6, 30), dt.date(2026, 8, 28)), ("F", "early", dt.date(2026, 3, 31), dt.date(2026, 8, 28))], "fund_id string, accession string, report_date date, available_from date")
    got = {(r.fund_id, r.trading_date.day): (r.accession, r.days_since_holdings_publication) for r in series.attach_holdings(market, timeline).collect()}
    assert got == {("F", 1): (None, None), ("F", 27): ("march", 22), ("F", 28): ("june", 0), ("G", 27): (None, None)}


def links(spark, rows):
    return spark.createDataFrame([(D1, f, s, t, w) for f, s, t, w in rows], "as_of date, etf_node_id string, security_node_id string, security_ticker string, portfolio_weight double")


def test_overlap(spark):
    r = one(graph.overlap_pairs(links(spark, [("A", "s1", None, 0.5), ("A", "s2", None, 0.5), ("B", "s1", None, 0.2), ("B", "s3", None, 0.8)])))
    assert (r.shared_holding_count, r.weighted_overlap_is_long_only) == (1, True)
    assert r.jaccard == pytest.approx(1 / 3) and r.weighted_overlap == pytest.approx(0.2)
    s = one(graph.overlap_pairs(links(spark, [("A", "s1", None, 0.5), ("A", "s2", None, -0.3), ("B", "s1", None, 0.2)])))
    assert s.weighted_overlap == pytest.approx(-0.1) and s.weighted_overlap_is_long_only is False


def test_fingerprint_depends_on_content_alone(spark):
    rows = [("A", f"s{k}", None, k / 7) for k in range(40)]
    f = [one(graph.fingerprint(links(spark, x).repartition(n))).fingerprint for x, n in ((rows, 1), (rows[::-1], 5))]
    assert f[0] == f[1] != one(graph.fingerprint(links(spark, rows[1:]))).fingerprint


def test_shock(spark):
    e = links(spark, [("A", "LONG", "L", 0.4), ("A", "SHORT", "S", -0.1), ("A", "OTHER", "DUP", 0.7), ("A", "X", "DUP", None), ("B", "OTHER", "DUP", 1.0)])
    keys = spark.createDataFrame([("one", 1, "LONG", -0.9), ("one", 2, "l", -0.2), ("one", 3, "SHORT", -0.5), ("one", 4, "dup", -1.0), ("one", 5, "nope", -1.0)], "scenario_id string, ord int, key string, shock double")
    status = {r.ord: (r.status, r.security_node_id) for r in shock.resolve(keys, e).collect()}
    assert status == {1: ("resolved", "LONG"), 2: ("resolved", "LONG"), 3: ("resolved", "SHORT"), 4: ("ambiguous", None), 5: ("unknown", None)}
    got = {r.etf_node_id: r for r in shock.impacts(e, keys).collect()}
    assert got["A"].direct_shock == pytest.approx(-0.03) and got["A"].covered_weight == pytest.approx(0.3)
    assert (got["B"].direct_shock, got["B"].covered_weight, got["B"].weight_sum) == (0.0, 0.0, 1.0)


def test_scores(spark):
    rows = spark.createDataFrame([("g", 1, 0.9, 1), ("g", 0, 0.8, 2), ("g", 1, 0.8, 3), ("g", 0, 0.1, 4), ("h", 1, 0.5, 5)], "k string, y int, score double, id int")
    auc = {r.k: r.roc_auc for r in models.roc_auc(rows, ["k"]).collect()}
    assert auc["g"] == pytest.approx((1 + 1 + 0.5 + 1) / 4) and auc["h"] is None
    ap = {r.k: r.average_precision for r in models.average_precision(rows, ["k"], "id").collect()}
    assert ap["g"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    c = {r.k: r for r in models.classification_scores(rows, ["k"]).collect()}["g"]
    assert (c.prevalence, c.recall) == (0.5, 1.0) and c.precision == pytest.approx(2 / 3)
    reg = one(models.regression_scores(spark.createDataFrame([("a", 1.0, 1.5), ("a", 3.0, 2.5)], "k string, y double, yhat double"), ["k"]))
    assert (reg.mae, reg.rmse, reg.r2) == (0.5, 0.5, 0.75)


def test_provider_comparison_and_universe(spark):
    mk = lambda rows: spark.createDataFrame([("I", dt.date(2024, 1, d), c, 1.0) for d, c in rows], "instrument_id string, trading_date date, close double, volume double")
    r = one(quality.compare_providers(mk([(1, 10.0), (2, 20.0)]), mk([(2, 21.0), (3, 5.0)])))
    assert (r.common_sessions, r.missing_on_right, r.missing_on_left, r.max_absolute) == (1, 1, 1, 1.0)
    universe = spark.createDataFrame([("A", "x", True), ("B", "x", True), ("C", "x", True), ("D", "x", False)], "ticker string, category string, enabled boolean")
    cat = spark.createDataFrame([("A", "12", "s1", "c1", "Fund A"), ("A", "12", "s1", "c1", None), ("B", "1", "s1", "c1", None), ("B", "2", "s1", "c1", None)], "ticker string, cik string, series_id string, class_id string, fund_name string")
    got = {r.ticker: (r.status, r.cik, r.series_id) for r in quality.resolve_universe(universe, cat).collect()}
    assert got == {"A": ("resolved", "0000000012", "S1"), "B": ("ambiguous", None, None), "C": ("unresolved", None, None)}


def test_redaction(spark):
    cases = {
        "api_key=abc123 next": "api_key=[REDACTED] next",
        'password: "p w d" x': 'password: "[REDACTED]" x',
        "Authorization: Bearer abc.def": "Authorization: Bearer [REDACTED]",
        "token='x'": "token='[REDACTED]'",
        "plain text stays": "plain text stays",
        "https://a.b/?apikey=zzz&symbol=Q": "https://a.b/?apikey=[REDACTED]&symbol=Q",
        "Authorization: Basic dXNlcg== status=401": "Authorization: Basic [REDACTED] status=401",
        '{"refresh-token": "a b", "provider": "x"}': '{"refresh-token": "[REDACTED]", "provider": "x"}',
        "saw hf_" + "k" * 30 + " there": "saw [REDACTED] there",
        "tokens = 12, secretary: Jo": "tokens = 12, secretary: Jo",
        "mail me at someone@mail.org": "mail me at [REDACTED_EMAIL]",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.scrub(F.col("t")).alias("out"), text.scrub(text.scrub(F.col("t"))).alias("again"))
    for r in df.collect():
        assert r.out == cases[r.t] == r.again
    m = one(spark.range(1).select(text.scrub_config(F.create_map(*[F.lit(x) for x in ("api_key", "v", "depth", "3", "to", "a@b.com")])).alias("m"))).m
    assert m == {"depth": "3", "to": "[REDACTED_EMAIL]"}


def test_private_members_go_at_any_depth(spark):
    cases = {
        '{"contact": {"address": {"street": "Main 5"}}, "x": 1}': {"x": 1},
        '{"a": [1, 2.5, {"password": "p", "n": null}], "e": {}, "f": [], "t": true, "s": "he \\"said\\" \\u00e9"}': {"a": [1, 2.5, {"n": None}], "e": {}, "f": [], "t": True, "s": 'he "said" é'},
        '{"d": {"d": {"d": {"d": {"userAgent": "q", "contactName": {"b": [{"c": 1}]}, "ok": ["a@b.com", {"apiKey": 1}]}}}}}': {"d": {"d": {"d": {"d": {"ok": ["[REDACTED_EMAIL]", {}]}}}}},
        "[[[[3]]]]": [[[[3]]]],
        '"a@b.com"': "[REDACTED_EMAIL]",
        "7": 7,
    }
    rows = [(i, t, "x") for i, t in enumerate(cases)] + [(90, None, "n"), (91, "no json: a@b.com", "t"), (92, "", "e"), (0, next(iter(cases)), "again")]
    df = spark.createDataFrame(rows, "i int, j string, doc string")
    got = [(r.i, r.j, r.doc) for r in text.scrub_json(df, "j").collect()]
    assert len(got) == len(rows)
    for i, j, doc in got:
        if doc in ("x", "again"):
            assert json.loads(j) == list(cases.values())[i], j
    assert {(i, j) for i, j, doc in got if doc in "nte"} == {(90, None), (91, "no json: [REDACTED_EMAIL]"), (92, "")}
    none = df.where("false")
    assert text.scrub_json(none, "j").count() == 0


def test_configs_lose_private_fields_inside_json(spark):
    rows = [(1, {"api_key": "v", "depth": "3", "nested": '{"password": "p", "n": 1}', "mail_to": "x"}), (2, {"userAgent": "x", "monkey": "stays", "db-Password": "x", "j": '{"a": {"contactName": {"b": 1}, "c": 2}}', "k": None}), (3, None), (4, {"token": "x"})]
    got = {r.i: r.m for r in text.scrub_configs(spark.createDataFrame(rows, "i int, m map<string,string>"), "m").collect()}
    assert got[1]["depth"] == "3" and got[1]["nested"] == '{"n":1}' and "api_key" not in got[1]
    assert got[2] == {"monkey": "stays", "j": '{"a":{"c":2}}', "k": None} and got[3] is None and got[4] == {}


def test_secret_scan_tells_places_only(spark):
    docs = spark.createDataFrame([(1, "ok\nAKIA" + "A" * 16 + "\nmail a@b.org or x@example.com"), (2, None), (3, "x@example.org")], "id long, t string")
    got = {(r.id, r.line, r.reason) for r in text.secret_scan(docs, "id", "t").collect()}
    assert got == {(1, 2, "AWS key id"), (1, 3, "email address")}
    scanned = lambda t, **k: {(r.line, r.reason) for r in text.secret_scan(spark.createDataFrame([(1, t)], "id long, t string"), "id", "t", **k).collect()}
    hidden = "filler\n" * 400 + "DB_PASSWORD=" + "q7" * 12 + "\npath /home/" + "kim/notes\n\0"
    assert scanned(hidden, large=1000) == {(401, "assigned credential"), (402, "home folder of a person"), (0, "large text"), (0, "zero byte")}
    assert scanned("glpat-" + "x" * 20 + " -----BEGIN EC " + "PRIVATE KEY-----") == {(1, "GitLab token"), (1, "private key block")}
    assert scanned("token: local\nmonkey = " + "b" * 30 + "\nme@box.test") == set()


def test_neighbours(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, vector array<double>")
    got = [(r.id, r["rank"]) for r in similarity.neighbours(v, v.where("id = 1"), 2).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2)]


def test_neighbours_meet_by_blocks_and_not_row_by_row(spark):
    """Blocks of any size give what all pairs give; ties go by id, zeros and nulls have cosine 0."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)] + [(90, None), (91, [0.0] * 4), (92, [1.0, 2.0]), (93, [1.0, None, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    asked = v.where("id % 10 = 0")
    m = np.zeros((94, 4))
    m[:90] = [r for _, r in rows[:90]]
    m /= np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    want = {(q, r): i for q in range(0, 94, 10) for r, i in enumerate(sorted((i for i in range(94) if i != q), key=lambda i: (-round(float(m[q] @ m[i]), 9), i))[:7], 1)}
    for block in (3, 1024):
        found = similarity.neighbours(v, asked, 7, block=block)
        assert {(r.query_id, r["rank"]): r.id for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(zip_with" not in plan.split("Window")[-1]


def risk_rows(spark, n=90):
    """A small risk dataset with a signal: y follows x."""
    import random

    rng = random.Random(1)
    rows = []
    for i in range(n * 3):
        split = ("train", "validation", "test")[i % 3]
        x = rng.random()
        rows.append((f"F{i % 6}", D1 + dt.timedelta(days=i), split, x, rng.random(), 2 * x + 0.01 * rng.random(), x > 0.6, 0.01, 3 if i % 2 else None))
    return spark.createDataFrame(rows, "fund_id string, trading_date date, split string, x double, noise double, y_true double, tail_event_20d boolean, return_1d double, holding_count int")


def test_firewall_fires(spark):
    data = risk_rows(spark, 10)
    assert quality.firewall(quality.tuning_rows(data)).count() == 20
    nulls = quality.tuning_rows(data.withColumn("split", F.when(F.col("split") != "validation", F.col("split"))))
    assert nulls.where("split IS NULL").count() == 10
    with pytest.raises(Exception, match="test row reached tuning"):
        quality.firewall(data).collect()
    with pytest.raises(ValueError, match="needs the split"):
        quality.firewall(data.drop("split"))


def test_models_from_baseline_to_one_test_score(spark):
    data = risk_rows(spark)
    features = ["x", "noise"]
    base = {r.split: r.mae for r in models.mean_scores(data, "y_true").collect()}
    grid = [{"trees": 1, "depth": 1}, {"trees": 8, "depth": 3}]
    best, mae = models.tune(data, features, "y_true", grid)
    assert best == grid[1] and mae < base["validation"] / 2
    model = models.refit_best(quality.tuning_rows(data), features, "y_true", best)
    score = one(models.score_once(model, data, "y_true"))
    assert score.split == "test" and score.mae < base["test"] / 2 and score.r2 > 0.5
    with pytest.raises(Exception, match="test row reached tuning"):
        models.refit_best(data, features, "y_true", best)
    assert [f for f, _ in models.gains(model, features)][0] == "x"
    ridge = models.fit_split(models.ridge(features, "y_true"), data, "y_true")
    assert one(models.score_once(ridge, data, "y_true")).r2 > 0.9
    latest = models.score_latest({"holdings": model, "market": ridge}, data, {"holdings": features, "market": ["x"]}).collect()
    assert len(latest) == 6 and {r.family for r in latest} == {"holdings", "market"}
    with pytest.raises(ValueError, match="lacks"):
        models.score_latest({"market": ridge}, data.drop("noise"), {"market": features})


def test_tail_classifier_is_gated(spark):
    data = risk_rows(spark)
    assert models.fit_tail(data.where("split <> 'test'"), ["x", "noise"]) is None
    assert models.fit_tail(data, ["x", "noise"], trees=3) is not None
    best, ap = models.tune(data, ["x", "noise"], "tail_event_20d", [{"trees": 2}], objective="ap")
    assert best == {"trees": 2} and ap > 0.9
    assert models.enough(data, "y_true") and not models.enough(risk_rows(spark, 10), "y_true")


def test_ignored_aliases_are_named(spark):
    raw = spark.createDataFrame([("2024-03-31", "2024-01-01", "F", "C1", 1.0)], "snapshot_date string, report_date string, fund_id string, cusip string, market_value double")
    got = [(r.kind, r.column) for r in normalize.normalize(raw).warnings.collect() if r.kind == "ignored_alias"]
    assert got == [("ignored_alias", "report_date")]


def test_universe_entries(spark):
    rows = [("a", "x", True), ("b", "x", True), ("B", "y", False)]
    make = lambda r: spark.createDataFrame(r, "ticker string, category string, enabled boolean")
    assert {r.ticker for r in quality.enabled_universe(make(rows)).collect()} == {"A", "B"}
    assert quality.duplicate_tickers(make([*rows, ("b", "z", True)])).count() == 1
    with pytest.raises(Exception, match="enabled twice: B"):
        quality.enabled_universe(make([*rows, ("b", "z", True)])).collect()


def test_newest_needed_counts_stored_filings(spark):
    filings = spark.createDataFrame([(f"a{i}", "F", D1 + dt.timedelta(days=i), "1") for i in range(5)], "accession string, fund_id string, report_date date, parser_version string")
    stored = filings.where("accession IN ('a4', 'a0')")
    assert [r.accession for r in quality.newest_needed(filings, stored, 3).orderBy("accession").collect()] == ["a2", "a3"]


def test_manifest_fingerprint(spark):
    data = risk_rows(spark, 4).withColumn("available_from", F.col("trading_date"))
    timeline = spark.createDataFrame([("a1", D1), ("a2", D2)], "accession string, publication_date date")
    m = quality.manifest(data, timeline)
    assert quality.same_build(m, quality.manifest(data.repartition(5), timeline.orderBy(F.desc("accession"))))
    assert not quality.same_build(m, quality.manifest(data, timeline.where("accession = 'a1'")))
    assert not quality.same_build(m, quality.manifest(data.withColumn("available_from", F.date_add("trading_date", 1)), timeline))


def test_negative_pairs(spark):
    rows = [("d", f"F{f:02d}", f"s{s}", 0.1) for f in range(30) for s in range(60) if (f * 7 + s * 3) % (2 + s % 9) == 0]
    held = spark.createDataFrame(rows, "as_of string, etf_node_id string, security_node_id string, portfolio_weight double")
    got = [(r.etf_node_id, r.security_node_id) for r in models.negative_pairs(held, 6).collect()]
    assert len(got) == len(set(got)) == 30 * 6 and not set(got) & {(f, s) for _, f, s, _ in rows}
    assert sorted(got) == sorted((r.etf_node_id, r.security_node_id) for r in models.negative_pairs(held.repartition(7), 6).collect())
    assert set(got) != {(r.etf_node_id, r.security_node_id) for r in models.negative_pairs(held, 6, seed=8).collect()}
    degree = {s: len({f for _, f, x, _ in rows if x == s}) for _, _, s, _ in rows}
    assert sum(degree[s] for _, s in got) / len(got) > sum(degree.values()) / len(degree) * 0.7, "common securities come up, though they are held more"
    full = spark.createDataFrame([("d", "F0", "s0", 0.1), ("d", "F0", "s1", 0.1), ("d", "F1", "s0", 0.1)], held.schema)
    assert [tuple(r) for r in models.negative_pairs(full, 3).collect()] == [("F1", "s1")]


def test_halving_finds_the_grid_s_best(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["train", "train", "validation", "test"]), x := rng.uniform(-3, 3), rng.random(), x * x + rng.gauss(0, 0.1)) for _ in range(700)]
    data = spark.createDataFrame(rows, "split string, x double, noise double, y double")
    grid = [{"trees": 10, "depth": d, "step": s} for d in (1, 2, 4) for s in (0.02, 0.3)]
    best, mae = models.tune(data, ["x", "noise"], "y", grid)
    fast, least, effort = models.tune_by_halving(data, ["x", "noise"], "y", grid)
    assert fast == best and least == pytest.approx(mae, rel=0.1) and effort < len(grid) / 2 + 1e-9


def test_gates_and_scores_of_all_rows(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(n) for n in range(200)]
    rows = [("F", d, "train" if n < 120 else "validation" if n < 160 else "test", float(n % 7), float(n % 7) * 2, 0.1 if n else None, 5 if n > 100 else None) for n, d in enumerate(days)]
    data = spark.createDataFrame(rows, "fund_id string, trading_date date, split string, x double, y double, return_1d double, holding_count int")
    model = models.fit_gated(models.ridge(["x"], "y"), data, "y")
    assert models.fit_gated(models.ridge(["x"], "y"), data.where("split <> 'test'"), "y") is None
    scored = models.score_rows({"holdings": model, "market": model}, data).collect()
    assert len(scored) == 199 and {r.family for r in scored} == {"holdings", "market"}
    with pytest.raises(ValueError, match="lacks"):
        models.score_rows({"market": model}, data.drop("x"))
    with pytest.raises(ValueError, match="numbers"):
        models.score_rows({"market": model}, data.withColumn("x", F.col("x").cast("string")))


def test_normalize_shuffles_once(spark):
    """Merge and weights share the shuffle by (date, fund) and its order."""
    raw = spark.createDataFrame([("F1", "2024-03-31", f"c{i % 3}", float(i), f"n{i}") for i in range(9)], "fund_id string, snapshot_date string, cusip string, market_value double, security_name string")
    found = normalize.normalize(raw).holdings
    assert found.count() == 3 and abs(found.agg(F.sum("portfolio_weight")).first()[0] - 1) < 1e-12
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" in plan, plan
