"""Raw holdings rows to the canonical table, with warnings and rejects as tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import exprs as X
from foliospark.sources.store import dealt

#: The canonical columns in order.
TEXTS = ("fund_name", "ticker", "cik", "series_id", "class_id", "security_name", "security_ticker", "cusip", "isin", "asset_type", "sector", "industry", "country", "currency", "source")
MEASURES = ("quantity", "market_value", "portfolio_weight")
CANONICAL = (
    "snapshot_date fund_id fund_name ticker cik series_id class_id security_id security_name security_ticker cusip isin "
    "asset_type sector industry country quantity market_value portfolio_weight currency source source_timestamp"
).split()
KEYS = ("snapshot_date", "fund_id", "security_id")
SNAPSHOT = KEYS[:2]
#: Other names of canonical columns.
ALIASES = {
    "report_date": "snapshot_date",
    "period_of_report": "snapshot_date",
    "series_name": "fund_name",
    "name_of_issuer": "security_name",
    "holding_ticker": "security_ticker",
    "pct_val": "portfolio_weight",
    "pctval": "portfolio_weight",
    "balance": "quantity",
    "market_value_usd": "market_value",
    "asset_cat": "asset_type",
    "inv_country": "country",
    "issuer_country": "country",
}


class Normalized(NamedTuple):
    holdings: DataFrame
    warnings: DataFrame
    rejects: DataFrame


def rename_aliases(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """Canonical names; an alias beside its canonical column is dropped and named."""
    ignored = []
    for alias, name in ALIASES.items():
        if alias in raw.columns:
            if name in raw.columns:
                ignored.append(alias)
                raw = raw.drop(alias)
            else:
                raw = raw.withColumnRenamed(alias, name)
    return raw, ignored


def typed(raw: DataFrame, weight_unit: str = "fraction", market_value_scale: float = 1.0) -> DataFrame:
    """Keys, measures and the text columns that the input has, cleaned and cast; bad values raise
    (ANSI casts). Texts are stripped once, in a projection of their own."""
    have = set(raw.columns)
    none = F.lit(None).cast("string")
    texts = [c for c in ("fund_id", *TEXTS, *MEASURES) if c in have]
    day = F.col("snapshot_date")
    day = day.cast("date") if dict(raw.dtypes)["snapshot_date"] != "string" else X.blank_to_null(day).cast("date")
    stamp = F.col("source_timestamp").cast("timestamp") if "source_timestamp" in have else F.lit(None).cast("timestamp")
    numbers = [c for c, t in raw.dtypes if c in MEASURES and t != "string"]
    clean = raw.select(day.alias("snapshot_date"), stamp.alias("source_timestamp"), *[F.col(c) if c in numbers else X.blank_to_null(F.col(c)).alias(c) for c in texts])
    text = lambda c: F.col(c) if c in have else none
    measure = {m: text(m).cast("double") for m in MEASURES}
    measure["market_value"] = measure["market_value"] * F.lit(float(market_value_scale))
    if weight_unit == "percent":
        measure["portfolio_weight"] = measure["portfolio_weight"] / 100
    upper = ("ticker", "series_id", "class_id", "security_ticker", "cusip", "isin", "currency")
    shown = {c: X.padded_cik(text(c)) if c == "cik" else F.upper(text(c)) if c in upper else text(c) for c in TEXTS if c in have}
    return clean.select(
        "snapshot_date",
        X.fund_key(text("fund_id"), text("cik"), text("series_id"), F.upper).alias("fund_id"),
        X.security_key(text("cusip"), text("isin"), text("security_ticker"), text("security_name"), F.upper).alias("security_id"),
        *[c.alias(n) for n, c in shown.items()],
        *[measure[m].alias(m) for m in MEASURES],
        "source_timestamp",
    )


def merge_duplicates(rows: DataFrame, size: int | None = None) -> DataFrame:
    """One row a (date, fund, security), with n_rows and, for each text column, whether its values
    disagree. Sums are null only where all values are; a text stays only if all given values agree.

    min = max tells agreement without a distinct count; columns that the input lacks are added as
    nulls afterwards. Rows are dealt by (date, fund), which the merge and the weights of a snapshot
    share: they cross the network once, before texts are doubled to least and greatest. ``size`` is
    how many rows there are, about, if it is known.
    """
    rows = rows.repartition(*SNAPSHOT) if size is None else dealt(rows, size, *SNAPSHOT)
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.sum(m).alias(m) for m in MEASURES], F.max("source_timestamp").alias("source_timestamp")]
    there = [c for c in TEXTS if c in rows.columns]
    for c in there:
        aggs += [F.min(c).alias(f"{c}_least"), F.max(c).alias(f"{c}_most")]
    same = lambda c: F.col(f"{c}_least") == F.col(f"{c}_most")
    shown = {c: F.when(same(c), F.col(f"{c}_least")) if c in there else F.lit(None).cast("string") for c in TEXTS}
    conflict = {f"{c}_conflict": F.coalesce(~same(c), F.lit(False)) if c in there else F.lit(False) for c in TEXTS}
    return rows.groupBy(*KEYS).agg(*aggs).select(*KEYS, "n_rows", *MEASURES, "source_timestamp", *[v.alias(c) for c, v in (shown | conflict).items()])


def derive_weights(holdings: DataFrame) -> DataFrame:
    """Weights from values where a snapshot has no weight, all values, and a sum that isn't 0.
    Adds ``derivation``: derived, blocked or reported."""
    snap = Window.partitionBy(*SNAPSHOT)  # in the order that merged rows are sorted in
    missing = F.max(F.col("portfolio_weight").isNotNull()).over(snap) == F.lit(False)
    complete = F.min(F.col("market_value").isNotNull()).over(snap)
    total = F.sum("market_value").over(snap)
    ready = complete & (total != 0)
    out = holdings.withColumn("derivation", F.when(~missing, "reported").when(ready, "derived").otherwise("blocked"))
    made = F.try_divide(F.col("market_value"), total)
    return out.withColumn("portfolio_weight", F.when(F.col("derivation") == "derived", made).otherwise(F.col("portfolio_weight")))


def warnings_of(merged: DataFrame, weighted: DataFrame, ignored: list[str] = ()) -> DataFrame:
    """(kind, fund_id, snapshot_date, column, n): conflicts by column, merged duplicates, derived
    and blocked snapshots, weight sums outside [0, 1.5], holdings without a weight, and input
    columns that were ``ignored`` beside their canonical name."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_conflict").cast("long").alias("n")) for c in TEXTS])
    conflicts = merged.select(F.inline(pairs)).groupBy("column").agg(F.sum("n").alias("n")).where("n > 0")
    none = F.lit(None).cast("string")
    conflicts = conflicts.select(F.lit("conflict").alias("kind"), none.alias("fund_id"), F.lit(None).cast("date").alias("snapshot_date"), "column", "n")
    snaps = weighted.groupBy("fund_id", "snapshot_date").agg(F.min("derivation").alias("how"), F.sum("portfolio_weight").alias("total"), F.count(F.when(F.col("portfolio_weight").isNull(), 1)).alias("missing"), F.sum(F.col("n_rows") - 1).alias("merged"))
    kinds = F.array(
        F.struct(F.concat(F.lit("weights_"), F.col("how")).alias("kind"), F.when(F.col("how") != "reported", 1).alias("n")),
        F.struct(F.lit("weight_sum").alias("kind"), F.when((F.col("total") > 1.5) | (F.col("total") < 0), 1).alias("n")),
        F.struct(F.lit("missing_weight").alias("kind"), F.when(F.col("missing") > 0, F.col("missing")).alias("n")),
        F.struct(F.lit("duplicates").alias("kind"), F.when(F.col("merged") > 0, F.col("merged")).alias("n")),
    )
    of_snaps = snaps.select("fund_id", "snapshot_date", F.inline(kinds)).where("n IS NOT NULL").select("kind", "fund_id", "snapshot_date", none.alias("column"), F.col("n").cast("long").alias("n"))
    out = conflicts.unionByName(of_snaps)
    if ignored:
        names = merged.sparkSession.createDataFrame([("ignored_alias", None, None, c, 1) for c in ignored], "kind string, fund_id string, snapshot_date date, `column` string, n long")
        out = out.unionByName(names)
    return out


def normalize(raw: DataFrame, weight_unit: str = "fraction", market_value_scale: float = 1.0, strict: bool = False, size: int | None = None) -> Normalized:
    """Canonical holdings, warnings, and rows without a date, fund or security.

    One shuffle by (date, fund) for the merge and the weights; with ``size``, how many raw rows there
    are, a task sorts no more of them when there are more.
    ``strict`` raises at run time on the first row that would be rejected.
    """
    raw, ignored = rename_aliases(raw)
    rows = typed(raw, weight_unit, market_value_scale)
    known = F.col("snapshot_date").isNotNull() & F.col("fund_id").isNotNull() & F.col("security_id").isNotNull()
    if strict:
        rows = rows.where(F.when(~known, F.raise_error(F.lit("a row has no snapshot_date, fund or security identifier")).cast("boolean")).otherwise(True))
    lacking = {c: F.lit(None).cast("string") for c in TEXTS if c not in rows.columns}
    rejects = rows.where(~known).withColumns(lacking).select("snapshot_date", "fund_id", "security_id", *TEXTS, *MEASURES, "source_timestamp")
    merged = merge_duplicates(rows.where(known), size)
    weighted = derive_weights(merged)
    return Normalized(weighted.select(*CANONICAL), warnings_of(merged, weighted, ignored), rejects)


def from_filing_rows(parsed: DataFrame, context: DataFrame) -> DataFrame:
    """Parsed filing rows (accession, ...) with the fund, dates and source of their filing."""
    fields = [c for c in context.columns if c != "accession" and c not in parsed.columns]
    return parsed.join(context.select("accession", *fields), "accession")


def adapt_filing_fields(parsed: DataFrame) -> DataFrame:
    """Filing-like fields under canonical names: values in thousands, weights in percent."""
    have = set(parsed.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    return parsed.select(
        *[c for c in ("fund_id", "cik", "series_id", "snapshot_date") if c in have],
        pick("name", "issuer", "title").cast("string").alias("security_name"),
        pick("cusip").cast("string").alias("cusip"),
        pick("isin").cast("string").alias("isin"),
        pick("ticker", "symbol").cast("string").alias("security_ticker"),
        pick("balance", "shares").cast("double").alias("quantity"),
        (pick("value", "valUSD").cast("double") * 1000).alias("market_value"),
        (pick("pctVal", "pct").cast("double") / 100).alias("portfolio_weight"),
    )
