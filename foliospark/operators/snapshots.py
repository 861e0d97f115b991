"""Concentration, allocation, ranked positions, drift and timelines of all funds at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.exprs import UNCLASSIFIED
from foliospark.sources.store import dealt, stage

SNAP = ("fund_id", "snapshot_date")


def weight() -> Column:
    return F.col("portfolio_weight")


def concentration(holdings: DataFrame, size: int | None = None) -> DataFrame:
    """Counts, weight sum, sums of the 1, 5 and 10 largest weights (not rescaled) and the
    Herfindahl index of each snapshot.

    The index is the sum of squares over the squared sum, of absolute weights if one is negative;
    nulls without weights. One window over (fund, date) and an aggregate on the same partitioning.
    Holdings are dealt by their number, which is ``size`` or counted.
    """
    ranked = dealt(holdings, holdings.count() if size is None else size, *SNAP).withColumn("rank", F.row_number().over(Window.partitionBy(*SNAP).orderBy(weight().desc_nulls_last(), "security_id")))
    top = lambda k: F.sum(F.when(F.col("rank") <= k, weight())).alias(f"top_{k}_weight")
    sums = ranked.groupBy(*SNAP).agg(
        F.count(F.lit(1)).alias("holdings_count"),
        F.count(weight()).alias("weighted_count"),
        F.sum(weight()).alias("weight_sum"),
        top(1),
        top(5),
        top(10),
        F.min(weight()).alias("least"),
        F.sum(weight() * weight()).alias("squares"),
        F.sum(F.abs(weight())).alias("gross"),
    )
    base = F.when(F.col("least") < 0, F.col("gross")).otherwise(F.col("weight_sum"))
    method = F.when(F.col("least") < 0, "absolute_weights").when(F.col("least").isNotNull(), "reported_weights")
    return sums.withColumn("hhi", F.try_divide(F.col("squares"), base * base)).withColumn("hhi_method", method).drop("least", "squares", "gross")


def allocation(holdings: DataFrame, label: str) -> DataFrame:
    """Weight and count by label of each snapshot; no label is UNCLASSIFIED."""
    return holdings.groupBy(*SNAP, F.coalesce(F.col(label), F.lit(UNCLASSIFIED)).alias("label")).agg(F.sum(weight()).alias("weight"), F.count(F.lit(1)).alias("holdings_count"))


def largest_positions(holdings: DataFrame, limit: int = 10) -> DataFrame:
    ranked = dealt(holdings, holdings.count(), *SNAP).withColumn("rank", F.row_number().over(Window.partitionBy(*SNAP).orderBy(weight().desc_nulls_last(), "security_id")))
    return ranked.where(F.col("rank") <= limit).select(*SNAP, "rank", "security_id", "security_name", "portfolio_weight")


def snapshot_report(holdings: DataFrame, limit: int = 10) -> DataFrame:
    """One nested row a snapshot: concentration, allocations and largest positions."""

    def listed(df: DataFrame, name: str, order: tuple[Column, ...], fields: tuple[str, ...]) -> DataFrame:
        item = F.struct(*order, F.struct(*fields).alias("item"))
        return df.groupBy(*SNAP).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(name))

    by_weight = (F.when(F.col("weight").isNull(), 1).otherwise(0).alias("o1"), (-F.col("weight")).alias("o2"), F.col("label").alias("o3"))
    out = concentration(holdings)
    for label in ("sector", "country"):
        out = out.join(listed(allocation(holdings, label), f"{label}_allocation", by_weight, ("label", "weight", "holdings_count")), list(SNAP))
    top = listed(largest_positions(holdings, limit), "largest", (F.col("rank").alias("o1"),), ("rank", "security_id", "security_name", "portfolio_weight"))
    return out.join(top, list(SNAP))


def consecutive(holdings: DataFrame) -> DataFrame:
    """(fund_id, from_date, to_date) of each snapshot and the one before it."""
    days = holdings.select(*SNAP).distinct()
    before = F.lag("snapshot_date").over(Window.partitionBy("fund_id").orderBy("snapshot_date"))
    return days.select("fund_id", before.alias("from_date"), F.col("snapshot_date").alias("to_date")).where("from_date IS NOT NULL")


def _sided(holdings: DataFrame, pairs: DataFrame, *fields: Column) -> DataFrame:
    """Holdings once for each side of each pair they are in: side 0 earlier, 1 later.

    Pairs list a fund's snapshots only, so the join is on (fund, date) twice, in one pass.
    """
    roles = pairs.select("fund_id", F.inline(F.array(F.struct(F.col("from_date").alias("snapshot_date"), F.lit(0).alias("side"), "from_date", "to_date"), F.struct(F.col("to_date").alias("snapshot_date"), F.lit(1).alias("side"), "from_date", "to_date"))))
    return holdings.join(roles, list(SNAP)).select("fund_id", "from_date", "to_date", "side", *fields)


def distribution_drift(sided: DataFrame, prefix: str) -> DataFrame:
    """Distance of two weight distributions (fund_id, from_date, to_date, side, key, weight): the
    Jensen-Shannon distance (base 2), or cosine distance if a weight is negative.

    Null weights are left out on their own side; a key absent on a side has 0. Null if a total is
    0 or a vector has no length. Grouping by key instead of an outer join; rows are dealt by pair, which
    the sums by key, the totals and the distance share: they cross the network once.
    """
    pair = ["fund_id", "from_date", "to_date"]
    both = sided.repartition(*pair).groupBy(*pair, "key").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("weight"))), F.lit(0.0)).alias(n) for s, n in ((0, "p"), (1, "q"))])
    totals = Window.partitionBy(*pair)
    p, q = F.col("p"), F.col("q")
    a, b = F.try_divide(p, F.sum(p).over(totals)), F.try_divide(q, F.sum(q).over(totals))
    shares = both.select(*pair, "p", "q", a.alias("a"), b.alias("b"))
    m = (F.col("a") + F.col("b")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.try_divide(F.col(x), m))).otherwise(F.when(F.col(x).isNotNull(), F.lit(0.0)))
    out = shares.groupBy(*pair).agg(
        F.min(F.least(p, q)).alias("least"),
        (F.count(F.lit(1)) == F.count(F.col("a") + F.col("b"))).alias("whole"),
        F.sum((part("a") + part("b")) / 2).alias("js"),
        F.sum(p * q).alias("pq"),
        F.sum(p * p).alias("pp"),
        F.sum(q * q).alias("qq"),
    )
    cosine = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("pq"), F.sqrt("pp") * F.sqrt("qq"))))
    negative = F.col("least") < 0
    value = F.when(negative, F.when((F.col("pp") > 0) & (F.col("qq") > 0), cosine)).when(F.col("whole"), F.sqrt(F.greatest(F.lit(0.0), F.col("js"))))
    return out.select(*pair, value.alias(f"{prefix}_distance"), F.when(negative, "cosine").otherwise("jensen_shannon").alias(f"{prefix}_metric"))


def drift(holdings: DataFrame, pairs: DataFrame | None = None, conc: DataFrame | None = None) -> DataFrame:
    """Holdings and sector distances and changes of concentration, of consecutive snapshots or of
    the pairs given (fund_id, from_date, to_date with from < to); ``conc`` is their concentration, if
    it is there already."""
    pairs = consecutive(holdings) if pairs is None else pairs
    keys = ["fund_id", "from_date", "to_date"]
    held = distribution_drift(_sided(holdings, pairs, F.col("security_id").alias("key"), weight().alias("weight")).where("weight IS NOT NULL"), "holdings")
    labels = _sided(allocation(holdings, "sector"), pairs, F.col("label").alias("key"), "weight").where("weight IS NOT NULL")
    known = labels.groupBy(*keys).agg(F.max(F.col("key") != UNCLASSIFIED).alias("classified"))
    sector = distribution_drift(labels, "sector").join(known, keys)
    sector = sector.select(*keys, F.when(F.col("classified"), F.col("sector_distance")).alias("sector_distance"), F.when(F.col("classified"), F.col("sector_metric")).otherwise("unavailable").alias("sector_metric"))
    conc = (concentration(holdings) if conc is None else conc).select(*SNAP, "top_10_weight", "hhi", "holdings_count")
    sides = _sided(conc, pairs, "top_10_weight", "hhi", "holdings_count")
    at = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    deltas = sides.groupBy(*keys).agg(*[(at(c, 1) - at(c, 0)).alias(n) for c, n in (("top_10_weight", "top_10_delta"), ("hhi", "hhi_delta"), ("holdings_count", "holdings_count_delta"))])
    return deltas.join(held, keys, "left").join(sector, keys, "left").withColumn("sector_metric", F.coalesce("sector_metric", F.lit("unavailable")))


def weight_changes(holdings: DataFrame, pairs: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """The largest increases and decreases of each pair. A security absent on a side has 0; one
    held without a weight on a side is left out; its name is the later one if there is one."""
    pairs = consecutive(holdings) if pairs is None else pairs
    keys = ["fund_id", "from_date", "to_date"]
    sided = _sided(holdings, pairs, "security_id", "security_name", "portfolio_weight")
    at = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    rows = sided.groupBy(*keys, "security_id").agg(
        F.coalesce(at("security_name", 1), at("security_name", 0)).alias("security_name"),
        F.coalesce(at("portfolio_weight", 0), F.lit(0.0)).alias("from_weight"),
        F.coalesce(at("portfolio_weight", 1), F.lit(0.0)).alias("to_weight"),
        F.count(F.when(weight().isNull(), 1)).alias("unknown"),
    )
    moved = rows.where("unknown = 0").withColumn("delta", F.col("to_weight") - F.col("from_weight")).where("delta <> 0").withColumn("direction", F.when(F.col("delta") > 0, "increase").otherwise("decrease"))
    # ties are told at nine digits, so that the order of a sum doesn't decide a rank
    rank = F.row_number().over(Window.partitionBy(*keys, "direction").orderBy(F.desc(F.round(F.abs("delta"), 9)), "security_id"))
    return moved.withColumn("rank", rank).where(F.col("rank") <= limit).select(*keys, "direction", "rank", "security_id", "security_name", "from_weight", "to_weight", "delta")


def latest_view(holdings: DataFrame, today: str | None = None, stale_after_days: int = 120) -> DataFrame:
    """The newest snapshot of each fund with its concentration and the drift to it from the one
    before, if any; with ``today`` also its age in days and whether it is stale. Only the two
    newest snapshots of a fund are read beyond their dates."""
    order = Window.partitionBy("fund_id").orderBy(F.desc("snapshot_date"))
    days = holdings.select(*SNAP).distinct().withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    pairs = days.groupBy("fund_id").agg(F.min(F.when(F.col("nth") == 2, F.col("snapshot_date"))).alias("from_date"), F.max("snapshot_date").alias("to_date"))
    near = holdings.join(days.select(*SNAP), list(SNAP), "left_semi")
    newest = days.where("nth = 1").select(*SNAP)
    conc = concentration(near, holdings.count())
    current = conc.join(newest, list(SNAP), "left_semi")
    moved = drift(near, pairs.where("from_date IS NOT NULL"), conc).withColumnRenamed("to_date", "snapshot_date")
    out = current.join(moved, list(SNAP), "left")
    if today is None:
        return out
    age = F.datediff(F.lit(today).cast("date"), F.col("snapshot_date"))
    return out.withColumns({"age_days": age, "stale": age > stale_after_days})


def holdings_timeline(holdings: DataFrame, filings: DataFrame) -> DataFrame:
    """One row a public filing (accession, fund_id, report_date, filed_at) in filing order, with
    its snapshot's concentration, the drift from the filing before it if that reports an earlier
    date, and the day on which the next filing supersedes it."""
    order = Window.partitionBy("fund_id").orderBy("filed_at", "report_date", "accession")
    public = filings.where("report_date IS NOT NULL AND filed_at IS NOT NULL").withColumn("superseded_by", F.lead("filed_at").over(order))
    conc = stage(concentration(holdings), "concentration")
    known = conc.where("weighted_count > 0").withColumnRenamed("snapshot_date", "report_date")
    usable = public.join(known, ["fund_id", "report_date"]).withColumn("previous", F.lag("report_date").over(order))
    pairs = usable.where("previous < report_date").select("fund_id", F.col("previous").alias("from_date"), F.col("report_date").alias("to_date")).distinct()
    moved = drift(holdings, pairs, conc).select("fund_id", F.col("from_date").alias("previous"), F.col("to_date").alias("report_date"), F.col("holdings_distance").alias("holdings_drift"), "top_10_delta", "hhi_delta", F.col("holdings_count_delta").alias("holding_count_delta"))
    out = usable.join(moved, ["fund_id", "previous", "report_date"], "left")
    return out.select(
        "fund_id",
        "report_date",
        F.col("filed_at").alias("publication_date"),
        F.col("filed_at").alias("available_from"),
        "superseded_by",
        "accession",
        F.col("holdings_count").alias("holding_count"),
        F.col("weight_sum").alias("reported_weight_sum"),
        "top_1_weight",
        F.col("top_5_weight").alias("top_5_concentration"),
        F.col("top_10_weight").alias("top_10_concentration"),
        "hhi",
        "holdings_drift",
        "top_10_delta",
        "hhi_delta",
        "holding_count_delta",
    )
