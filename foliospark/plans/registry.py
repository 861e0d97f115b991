"""Every query of the library's own operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import exprs as X
from foliospark.operators import graph, models, normalize, quality, series, shock, similarity, snapshots, text
from foliospark.plans import payloads
from foliospark.plans import views as V
from foliospark.sources import store
from foliospark.streaming import exposure


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that the order in which a sum was taken doesn't show; no negative 0."""
    shown = lambda c: F.when(F.round(c, digits) == 0, F.lit(0.0)).otherwise(F.round(c, digits)).alias(c)
    return df.select(*[shown(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _normalize_holdings(spark, sf):
    h = V.normalized(spark, sf)
    return rounded(h.select("fund_id", "snapshot_date", "security_id", "security_name", "security_ticker", "country", "sector", F.round("quantity", 4).alias("quantity"), F.round("market_value", 4).alias("market_value"), "portfolio_weight"))


def _reject_report(spark, sf):
    raw = V.raw_holdings(spark, sf, "none")
    broken = raw.withColumn("fund_id", F.when(F.col("quantity") > 3, F.col("fund_id"))).withColumn("cusip", F.when(F.col("quantity") > 1, F.col("cusip"))).drop("security_ticker").withColumn("security_name", F.when(F.col("quantity") > 1, F.col("security_name")))
    return normalize.normalize(broken).rejects.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("rejected"), F.count_if(F.col("fund_id").isNull()).alias("no_fund"), F.count_if(F.col("security_id").isNull()).alias("no_security"))


def _conflict_warnings(spark, sf):
    return normalize.normalize(V.raw_holdings(spark, sf, "none"), size=V.lines(spark, sf)).warnings


def _derived_weights(spark, sf):
    return rounded(V.holdings(spark, sf, "none").select("fund_id", "snapshot_date", "security_id", "portfolio_weight"))


def _summary_sql(spark, sf):
    V.holdings(spark, sf).createOrReplaceTempView("holdings")
    return rounded(spark.sql("SELECT fund_id, snapshot_date, count(*) AS holdings, sum(portfolio_weight) AS weight_sum FROM holdings GROUP BY fund_id, snapshot_date"))


def _report(spark, sf):
    r = snapshots.snapshot_report(V.holdings(spark, sf))
    first = lambda c: F.element_at(c, 1)
    return rounded(r.select("fund_id", "snapshot_date", "holdings_count", "hhi", first("sector_allocation")["label"].alias("top_sector"), F.size("country_allocation").alias("countries"), first("largest")["security_id"].alias("top_security"), F.size("largest").alias("listed")))


TRAIN_END, VALIDATION_END, TAIL = "1999-12-31", "2000-12-31", 0.97
KEYS = ("instrument_id", "trading_date")


def _timeline(s, d):
    return snapshots.holdings_timeline(V.holdings(s, d), V.filings(s, d))


def _made_risk(s, d):
    return series.risk_dataset(V.bars(s, d), _timeline(s, d), V.instrument_funds(s, d), TRAIN_END, VALIDATION_END, TAIL)


def _risk(s, d):
    """The risk dataset, made once: ``risk_dataset`` itself times the making."""
    return V.stored(s, d, "risk", lambda: _made_risk(s, d), of=("lineitem", "orders"))


def _labelled(s, d):
    return series.labelled(V.bars(s, d), TAIL)


def _binary(s, d):
    return _labelled(s, d).select("instrument_id", "trading_date", F.col("tail_event_20d").cast("int").alias("y"), F.round("rolling_max_drawdown_20d", 9).alias("score")).where("y IS NOT NULL AND score IS NOT NULL")


def _asof(s, d):
    market = V.bars(s, d).join(V.instrument_funds(s, d), "instrument_id")
    out = series.attach_holdings(market, _timeline(s, d))
    return rounded(out.select("fund_id", "trading_date", "accession", "report_date", "available_from", "superseded_by", "holding_count", "days_since_holdings_report_date", "days_since_holdings_publication", "hhi"), 7)


def _upsert(s, d):
    first = V.bars(s, d).withColumn("provider", F.lit("one")).withColumn("seen", F.lit(1))
    stored = first.where("dayofmonth(trading_date) <= 20")
    fresh = V.second_provider(V.bars(s, d)).where("dayofmonth(trading_date) > 10").withColumn("provider", F.lit("two")).withColumn("seen", F.lit(2))
    merged = store.upsert(stored, fresh, list(KEYS), "seen")
    return rounded(merged.groupBy("instrument_id", "provider").agg(F.count(F.lit(1)).alias("bars"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.sum("close").alias("closes")), 4)


def _edges(s, d):
    cols = ("as_of", "etf_node_id", "security_node_id", "portfolio_weight", "missing_weights", "security_ticker", "security_name", "country", "report_date", "available_from", "accession")
    return rounded(V.edges(s, d).select(*cols))


def _universe(s, d):
    supplier = V.table(s, d, "supplier")
    universe = V.table(s, d, "nation").select(F.upper("n_name").alias("ticker"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("category"), (F.col("n_nationkey") % 6 != 5).alias("enabled"))
    names = V.table(s, d, "nation").select("n_nationkey", F.upper("n_name").alias("ticker"))
    listed = supplier.join(names, F.col("s_nationkey") == F.col("n_nationkey"))
    catalogue = listed.select("ticker", F.col("s_nationkey").cast("string").alias("cik"), F.concat(F.lit("s"), (F.col("s_suppkey") % 2 * (F.col("s_nationkey") % 3 == 0).cast("int")).cast("string")).alias("series_id"), F.lit("c1").alias("class_id"), F.lit("Fund").alias("fund_name"))
    return quality.resolve_universe(universe, catalogue)


def _freshness(s, d):
    e = V.table(s, d, "events").groupBy((F.col("user_id") % 50).alias("u")).agg(F.max("ts").alias("t"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))
    state = e.select(
        F.lit("feed").alias("provider"),
        F.col("u").cast("string").alias("entity_id"),
        (F.col("u") % 11 == 0).alias("in_progress"),
        F.when(F.col("u") % 7 == 0, "offline").when(F.col("u") % 5 == 0, "timeout").alias("last_error_class"),
        (F.col("u") % 13 != 0).alias("has_data"),
        F.col("t").cast("timestamp").alias("last_checked_at"),
        (F.col("errors") % 8).cast("int").alias("consecutive_failures"),
    )
    return quality.freshness_of(state, "2024-01-31 00:00:00", 6)


def _exposure(s, d):
    sound, _ = exposure.split_valid(V.ticks(s, d).withColumn("instrument_count", F.lit(V.instrument_count(s, d))), V.instrument_count(s, d))
    return rounded(exposure.fund_impacts(exposure.security_returns(sound), V.edges(s, d)))


def _redact(s, d):
    docs = V.table(s, d, "documents").select("doc_id", "text", text.scrub(F.col("text")).alias("clean"))
    return docs.select("doc_id", (F.col("text") != F.col("clean")).alias("changed"), F.length("clean").alias("chars"), F.size(F.regexp_extract_all("clean", F.lit(r"\[REDACTED"), F.lit(0))).alias("marks"))


def _gbt(s, d):
    data = _labelled(s, d).join(V.instrument_funds(s, d), "instrument_id").withColumn("split", X.split_label(F.col("trading_date"), F.col("label_end_date"), F.col("momentum_120d"), TRAIN_END, VALIDATION_END))
    features, target = ["return_5d", "realized_vol_20d", "rolling_max_drawdown_20d", "volume_zscore_20d"], "forward_realized_vol_20d"
    data = store.stage(data.where(F.col(target).isNotNull()).select("split", target, *features), "boosted")  # a fit passes over it many times
    model = models.fit_split(models.boosted(features, target, trees=10), data, target)
    scored = model.transform(data.where("split IN ('validation', 'test')"))
    return models.regression_scores(scored.select("split", F.col(target).alias("y"), "yhat"), ["split"])


def _neighbours(s, d):
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(similarity.neighbours(e, e.where("id % 20 = 0"), 5))


def _neighbours_index(s, d):
    """The index's answers held against the exact ones, and whether 90 % of these are found."""
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("id % 20 = 0")
    found = similarity.recall(similarity.Index.build(e).search(asked, 5), similarity.neighbours(e, asked, 5))
    return found.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("enough"))


QUERIES = {
    "normalize_holdings": _normalize_holdings,
    "reject_report": _reject_report,
    "conflict_warnings": _conflict_warnings,
    "derived_weights": _derived_weights,
    "summary_sql": _summary_sql,
    "concentration": lambda s, d: rounded(snapshots.concentration(V.holdings(s, d))),
    "sector_allocation": lambda s, d: rounded(snapshots.allocation(V.holdings(s, d), "sector")),
    "country_allocation": lambda s, d: rounded(snapshots.allocation(V.holdings(s, d), "country")),
    "largest_positions": lambda s, d: rounded(snapshots.largest_positions(V.holdings(s, d))),
    "snapshot_report": _report,
    "drift_consecutive": lambda s, d: rounded(snapshots.drift(V.holdings(s, d)).drop("sector_distance", "sector_metric"), 7),
    "sector_drift": lambda s, d: rounded(snapshots.drift(V.holdings(s, d)).select("fund_id", "from_date", "to_date", "sector_distance", "sector_metric"), 7),
    "weight_changes": lambda s, d: rounded(snapshots.weight_changes(V.holdings(s, d))),
    "latest_fund_view": lambda s, d: rounded(snapshots.latest_view(V.holdings(s, d), "2002-03-01").select("fund_id", "snapshot_date", "holdings_count", "top_10_weight", "hhi", "from_date", "holdings_distance", "top_10_delta", "age_days", "stale"), 7),
    "holdings_timeline": lambda s, d: rounded(snapshots.holdings_timeline(V.holdings(s, d), V.filings(s, d)), 7),
    "market_features": lambda s, d: rounded(series.market_features(V.bars(s, d)), 6),
    "forward_targets": lambda s, d: rounded(_labelled(s, d).select(*KEYS, "forward_realized_vol_20d", "forward_max_drawdown_20d", "label_end_date", "tail_event_20d"), 7),
    "asof_holdings": _asof,
    "risk_dataset": lambda s, d: rounded(_made_risk(s, d).select("fund_id", *KEYS, "momentum_120d", "realized_vol_60d", "label_end_date", "accession", "holdings_drift", "split"), 7),
    "split_counts": lambda s, d: _risk(s, d).groupBy("fund_id", "split").agg(F.count(F.lit(1)).alias("row_count")),
    "dataset_profile": lambda s, d: series.dataset_profile(_risk(s, d)),
    "first_use": lambda s, d: series.first_use(_risk(s, d), _timeline(s, d)),
    "leak_gate": lambda s, d: quality.leak_gate(_risk(s, d)),
    "provider_comparison": lambda s, d: rounded(quality.compare_providers(V.bars(s, d), V.second_provider(V.bars(s, d))), 4),
    "bars_upsert": _upsert,
    "graph_edges": _edges,
    "graph_nodes": lambda s, d: graph.nodes(V.edges(s, d)),
    "graph_fingerprint": lambda s, d: graph.fingerprint(V.edges(s, d)),
    "node_index": lambda s, d: graph.node_index(V.edges(s, d), "security_node_id"),
    "overlap_pairs": lambda s, d: rounded(graph.overlap_pairs(V.edges(s, d))),
    "crowding": lambda s, d: rounded(graph.crowding(V.edges(s, d))),
    "fund_degree": lambda s, d: rounded(graph.fund_degree(V.edges(s, d))),
    "graph_quality": lambda s, d: graph.quality_report(V.edges(s, d)),
    "hash_split": lambda s, d: graph.hash_split(V.edges(s, d).select("etf_node_id", "security_node_id"), "etf_node_id", "security_node_id"),
    "shock_resolution": lambda s, d: rounded(shock.resolve(V.shocks(V.edges(s, d)), V.edges(s, d))),
    "shock_impacts": lambda s, d: rounded(shock.impacts(V.edges(s, d), V.shocks(V.edges(s, d)))),
    "shock_replay": lambda s, d: rounded(shock.replay(V.edges(s, d), V.ticks(s, d).where("copy = 0").select("sequence", "security_node_id", ((F.col("sequence") % 201 - 100) * F.lit(0.0001)).alias("shock")))),
    "universe_resolution": _universe,
    "ingest_antijoin": lambda s, d: quality.not_ingested(V.filings(s, d), V.filings(s, d).where("dayofmonth(filed_at) % 2 = 0")).select("accession", "fund_id", "filed_at"),
    "newest_n": lambda s, d: quality.newest(V.filings(s, d), 3).select("fund_id", "accession", "nth"),
    "weight_gate": lambda s, d: rounded(quality.weight_gate(V.holdings(s, d))),
    "coverage_profile": lambda s, d: quality.coverage_profile(V.holdings(s, d).select("security_id", "security_name", "sector", "market_value", "portfolio_weight")),
    "audit_top": lambda s, d: quality.audit_top(V.holdings(s, d), V.raw_holdings(s, d), size=V.lines(s, d)).groupBy("weight_ok", "value_ok").agg(F.count(F.lit(1)).alias("n")),
    "cusip_check": lambda s, d: V.table(s, d, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0").alias("cusip")).withColumn("valid", X.cusip_valid(F.col("cusip"))),
    "freshness": _freshness,
    "price_exposure": _exposure,
    "sequence_accounting": lambda s, d: exposure.sequence_accounting(V.ticks(s, d), "type", ["arrival", "sequence", "copy"]),
    "latency_histogram": lambda s, d: exposure.quantiles(exposure.histogram(exposure.stage_latencies(V.ticks(s, d)).where("valid"), ["stage"]), ["stage"]),
    "feed_counters": lambda s, d: exposure.feed_counters(V.ticks(s, d)),
    "neighbours": _neighbours,
    "neighbours_index": _neighbours_index,
    "naive_scores": lambda s, d: rounded(models.regression_scores(_labelled(s, d).select("instrument_id", F.col("forward_realized_vol_20d").alias("y"), F.col("realized_vol_20d").alias("yhat")), ["instrument_id"]), 7),
    "roc_auc": lambda s, d: rounded(models.roc_auc(_binary(s, d), ["instrument_id"])),
    "average_precision": lambda s, d: rounded(models.average_precision(_binary(s, d), ["instrument_id"], "trading_date")),
    "classification_scores": lambda s, d: rounded(models.classification_scores(_binary(s, d), ["instrument_id"], 0.95)),
    "tail_counts": lambda s, d: models.tail_counts(_risk(s, d)),
    "missingness": lambda s, d: rounded(models.missingness(series.market_features(V.bars(s, d)), series.FEATURES)),
    "redact_text": _redact,
    "secret_scan": lambda s, d: text.secret_scan(V.table(s, d, "documents"), "doc_id", "text"),
    "gbt_scores": _gbt,
    "als_links": lambda s, d: models.roc_auc(models.holding_links(V.edges(s, d)), ["split"]),
}
QUERIES |= payloads.queries(_risk, _timeline, _universe)
