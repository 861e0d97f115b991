"""Gates, profiles, comparisons and ingest rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import exprs as X
from foliospark.sources.store import dealt


def weight_gate(holdings: DataFrame) -> DataFrame:
    """reject a snapshot whose weights sum below 0 or above 5, warn below 0.5 or above 1.5."""
    total = F.col("weight_sum")
    status = F.when(total.isNull(), "no_weights").when((total < 0) | (total > 5), "reject").when((total < 0.5) | (total > 1.5), "warn").otherwise("ok")
    return holdings.groupBy("fund_id", "snapshot_date").agg(F.sum("portfolio_weight").alias("weight_sum")).withColumn("status", status)


def leak_gate(dataset: DataFrame) -> DataFrame:
    """Rows with holdings from after their own day, by fund: all zero in a sound dataset."""
    leaked = F.col("holding_count").isNotNull() & (F.col("available_from") > F.col("trading_date"))
    return dataset.groupBy("fund_id").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.coalesce(leaked, F.lit(False))).alias("leaked"))


def bar_gate(bars: DataFrame) -> DataFrame:
    """Sessions, repeated dates and bars out of ingest order of each series: of an instrument, by
    provider and adjustment mode where the bars have these."""
    series = [c for c in ("provider", "instrument_id", "adjustment_mode") if c in bars.columns]
    w = Window.partitionBy(*series).orderBy("ingest_order")
    back = F.col("trading_date") < F.lag("trading_date").over(w)
    return bars.withColumn("back", F.coalesce(back, F.lit(False))).groupBy(*series).agg(F.count(F.lit(1)).alias("bars"), (F.count(F.lit(1)) - F.count_distinct("trading_date")).alias("repeated"), F.count_if("back").alias("out_of_order"))


def provenance_gate(bars: DataFrame, authority: str) -> DataFrame:
    """Series with bars of any other provider."""
    return bars.groupBy("instrument_id").agg(F.array_sort(F.collect_set("provider")).alias("providers")).where(F.col("providers") != F.array(F.lit(authority)))


def compare_providers(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sessions in common and missing on each side, differences of close and volume, and the
    range of common sessions, of each instrument."""
    a = left.select("instrument_id", "trading_date", F.col("close").alias("a"), F.col("volume").alias("va"))
    b = right.select("instrument_id", "trading_date", F.col("close").alias("b"), F.col("volume").alias("vb"))
    j = a.join(b, ["instrument_id", "trading_date"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    gap = F.when(both, F.abs(F.col("a") - F.col("b")))
    rel = X.ratio(gap, F.col("a"))
    vol = F.when(both, F.abs(F.col("va") - F.col("vb")))
    return j.groupBy("instrument_id").agg(
        F.count_if(both).alias("common_sessions"),
        F.count_if(F.col("b").isNull()).alias("missing_on_right"),
        F.count_if(F.col("a").isNull()).alias("missing_on_left"),
        F.median(gap).alias("median_absolute"),
        F.max(gap).alias("max_absolute"),
        F.median(rel).alias("median_relative"),
        F.max(rel).alias("max_relative"),
        F.max(vol).alias("max_volume"),
        F.min(F.when(both, F.col("trading_date"))).alias("overlap_start"),
        F.max(F.when(both, F.col("trading_date"))).alias("overlap_end"),
    )


def resolve_universe(universe: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Enabled tickers (ticker, category, enabled) by the catalogue: resolved by one (cik, series,
    class), ambiguous by more, else unresolved."""
    key = F.struct("cik", "series_id", "class_id")
    found = catalogue.groupBy("ticker").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.min("fund_name").alias("fund_name"))
    out = universe.where("enabled").join(found, "ticker", "left")
    one = F.col("low") == F.col("high")
    pick = lambda c: F.when(one, F.upper(F.col("low")[c]))
    return out.select(
        "ticker",
        "category",
        F.when(F.col("low").isNull(), "unresolved").when(one, "resolved").otherwise("ambiguous").alias("status"),
        X.zfill(pick("cik"), 10).alias("cik"),
        pick("series_id").alias("series_id"),
        pick("class_id").alias("class_id"),
        F.when(one, F.coalesce("fund_name", "ticker")).alias("fund_name"),
    )


def enabled_universe(entries: DataFrame) -> DataFrame:
    """Enabled entries (ticker, category, enabled) with tickers in capitals; an enabled ticker that
    stands twice stops the job."""
    clean = entries.where("enabled").withColumn("ticker", X.upper_clean(F.col("ticker"))).where("ticker IS NOT NULL")
    once = clean.groupBy("ticker").agg(F.min("category").alias("category"), F.count(F.lit(1)).alias("n"))
    fine = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("enabled twice: "), F.col("ticker"))).cast("boolean")).otherwise(True)
    return once.where(fine).drop("n").withColumn("enabled", F.lit(True))


def duplicate_tickers(universe: DataFrame) -> DataFrame:
    """Enabled tickers that stand more than once, for a report where ``enabled_universe`` would stop."""
    return universe.where("enabled").groupBy("ticker").count().where("count > 1")


def universe_manifest(resolved: DataFrame) -> DataFrame:
    """Tickers by status, the gate, and a fingerprint of every ticker with its outcome, whatever
    the order of rows: a hash of a sum of hashes, so no task holds the universe."""
    shown = [c for c in ("ticker", "status", "cik", "series_id", "class_id") if c in resolved.columns]
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shown]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    counts = resolved.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("digest"))
    every = Window.partitionBy(F.lit(1))  # a row a status
    gate = F.when(F.max((F.col("status") != "resolved").cast("int")).over(every) == 0, "PASSED").otherwise("INCOMPLETE")
    whole = F.sha2(F.concat_ws("|", F.sum("n").over(every).cast("string"), F.sum("digest").over(every).cast("string")), 256)
    return counts.select("status", "n", gate.alias("gate"), whole.alias("fingerprint"))


def not_ingested(filings: DataFrame, stored: DataFrame) -> DataFrame:
    """Filings without a stored row of the same accession, parser version and fund."""
    return filings.join(stored, ["accession", "parser_version", "fund_id"], "left_anti")


def newest(filings: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("fund_id").orderBy(F.desc("report_date"), F.desc("accession"))
    return filings.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def newest_needed(filings: DataFrame, stored: DataFrame, n: int) -> DataFrame:
    """The filings to fetch so that each fund has its newest ``n``; stored ones (accession,
    parser_version) count towards them."""
    have = stored.select("accession", "parser_version").distinct()
    return newest(filings, n).join(have, ["accession", "parser_version"], "left_anti")


def ingest(filings: DataFrame, stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """The filings of a run with what becomes of each and why: 'skipped' if ``stored`` has it already,
    'failed' if its payload (``fetched``, as ``validate_payloads`` takes them) breaks a rule or isn't
    there, else 'ingested'. One bad filing doesn't stop the others."""
    new = not_ingested(filings, stored).select("accession").withColumn("__new", F.lit(True))
    checked = validate_payloads(fetched.join(new.drop("__new"), "accession", "left_semi"))
    rules = ("html", "cik_mismatch", "series_mismatch", "no_holdings")
    reason = F.coalesce(*[F.when(F.col(r), r) for r in rules])
    verdict = checked.select("accession", "clean", reason.alias("reason"))
    rows = filings.join(new, "accession", "left").join(verdict, "accession", "left")
    status = F.when(F.col("__new").isNull(), "skipped").when(F.coalesce("clean", F.lit(False)), "ingested").otherwise("failed")
    why = F.when(status == "failed", F.coalesce("reason", F.lit("no payload")))
    return rows.select(*filings.columns, status.alias("status"), why.alias("reason"))


def ingest_summary(rows: DataFrame) -> DataFrame:
    """Counts by outcome and reason of a run (``ingest``)."""
    return rows.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("filings"))


def validate_payloads(payloads: DataFrame) -> DataFrame:
    """Rule columns of filing payloads (accession, payload, cik, expected_cik, series_id,
    expected_series_id, holding_count) and the verdict; only clean ones are written on."""
    html = F.lower(F.substring(X.strip(F.col("payload")), 1, 200)).rlike(r"^<!doctype html|^<html")
    rules = {
        "html": html,
        "cik_mismatch": F.coalesce(X.padded_cik(F.col("cik")) != X.padded_cik(F.col("expected_cik")), F.lit(True)),
        "series_mismatch": F.coalesce(F.upper("series_id") != F.upper("expected_series_id"), F.lit(True)),
        "no_holdings": F.coalesce(F.col("holding_count"), F.lit(0)) == 0,
    }
    out = payloads.withColumns(rules)
    return out.withColumn("clean", ~(F.col("html") | F.col("cik_mismatch") | F.col("series_mismatch") | F.col("no_holdings"))).withColumn("content_hash", X.content_hash(F.col("payload")))


def load_range(latest: DataFrame, payload: DataFrame, now: str) -> DataFrame:
    """New bars of each series: after its newest stored date, up to the last completed session."""
    end = X.completed_session(F.lit(now).cast("timestamp"))
    j = payload.join(latest, "instrument_id", "left")
    return j.where((F.col("latest").isNull() | (F.col("trading_date") > F.col("latest"))) & (F.col("trading_date") <= end)).drop("latest")


def coverage_profile(holdings: DataFrame) -> DataFrame:
    """Filled cells by column, and rows by kind of security key."""
    filled = holdings.agg(*[F.count(c).alias(c) for c in holdings.columns])
    cells = filled.select(F.inline(F.array(*[F.struct(F.lit(f"filled:{c}").alias("item"), F.col(c).alias("n")) for c in holdings.columns])))
    kinds = holdings.groupBy(F.concat(F.lit("key:"), F.element_at(F.split("security_id", ":"), 1)).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return cells.unionByName(kinds)


def audit_top(stored: DataFrame, parsed: DataFrame, limit: int = 10, size: int | None = None) -> DataFrame:
    """The largest stored positions of each snapshot beside their source rows, by CUSIP, with the
    verdict at 1e-8 of weight and 0.01 of value. Both are dealt by their number of rows; that of the
    source is ``size`` or counted."""
    keys = ["fund_id", "snapshot_date", "cusip"]
    rank = F.row_number().over(Window.partitionBy("fund_id", "snapshot_date").orderBy(F.desc_nulls_last("portfolio_weight"), "security_id"))
    top = dealt(stored, stored.count(), "fund_id", "snapshot_date").withColumn("rank", rank).where(F.col("rank") <= limit)
    source = dealt(parsed, parsed.count() if size is None else size, *keys).groupBy(*keys).agg(F.sum("portfolio_weight").alias("source_weight"), F.sum("market_value").alias("source_value"))
    j = top.join(source, keys, "left")
    near = lambda a, b, by: F.coalesce(F.abs(F.col(a) - F.col(b)) <= by, F.col(a).isNull() & F.col(b).isNull())
    return j.select("fund_id", "snapshot_date", "rank", "security_id", near("portfolio_weight", "source_weight", 1e-8).alias("weight_ok"), near("market_value", "source_value", 0.01).alias("value_ok"))


def manifest(dataset: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row of facts of a dataset: dates, rows, filings, the gate's outcome, and a fingerprint of
    the counts by split and of the accessions, whatever their order; no list comes to one task."""
    leaked = F.coalesce(F.col("available_from") > F.col("trading_date"), F.lit(False)) & F.col("holding_count").isNotNull()
    splits = ("train", "validation", "test", "purged_train", "purged_validation", "warmup", "no_target")
    facts = dataset.groupBy(F.lit(1).alias("one")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("holding_count").alias("holdings_rows"),
        F.min("trading_date").alias("market_from"),
        F.max("trading_date").alias("market_through"),
        F.count_if(leaked).alias("leaked"),
        F.concat_ws(",", *[F.count_if(F.col("split") == s).cast("string") for s in splits]).alias("splits"),
    )
    digest = F.conv(F.substring(F.sha2("accession", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    through = timeline.groupBy(F.lit(1).alias("one")).agg(F.max("publication_date").alias("holdings_through"), F.count("accession").alias("filings"), F.sum(digest).cast("string").alias("accessions"))
    out = facts.join(through, "one", "left").drop("one").withColumn("validation_status", F.when(F.col("leaked") == 0, "PASSED").otherwise("FAILED"))
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("|", "row_count", "splits", "market_from", "market_through", "filings", "accessions"), 256)).drop("splits", "accessions")


def same_build(left: DataFrame, right: DataFrame) -> bool:
    """Whether two manifests tell of the same passed build."""
    a, b = left.first(), right.first()
    return a["validation_status"] == b["validation_status"] == "PASSED" and a["fingerprint"] == b["fingerprint"]


def tuning_rows(dataset: DataFrame) -> DataFrame:
    """All but test rows; rows without a split stay."""
    return dataset.where(F.coalesce(F.col("split") != "test", F.lit(True)))


def firewall(rows: DataFrame) -> DataFrame:
    """``rows``, which stop the job if a test row is among them: for what is given to tuning."""
    if "split" not in rows.columns:
        raise ValueError("tuning needs the split of its rows")
    return rows.where(F.when(F.col("split") == "test", F.raise_error(F.lit("a test row reached tuning")).cast("boolean")).otherwise(True))


def freshness_of(state: DataFrame, now: str, stale_after_hours: int = 24) -> DataFrame:
    """State, delay after failures, and whether a check is due, of each provider and entity."""
    t = F.lit(now).cast("timestamp")
    status = X.freshness(F.col("in_progress"), F.col("last_error_class"), F.col("has_data"), F.col("last_checked_at"), t, stale_after_hours)
    delay = X.backoff_seconds(F.col("consecutive_failures"))
    due = (F.col("consecutive_failures") == 0) | (F.col("last_checked_at") + F.make_dt_interval(secs=delay) <= t)
    return state.select("provider", "entity_id", status.alias("status"), delay.alias("delay_seconds"), F.coalesce(due, F.lit(True)).alias("due"))
