"""Shock scenarios on the fund-security graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that funds are dealt to when each of them meets every scenario.
SPREAD = 64


def resolve(shocks: DataFrame, held: DataFrame) -> DataFrame:
    """Shock keys (scenario_id, ord, key, shock) with status resolved, ambiguous or unknown and the
    security they mean: one with that id, else the only one with that ticker, in any case."""
    ids = held.select(F.col("security_node_id").alias("id")).distinct()
    tickers = held.where("security_ticker IS NOT NULL").groupBy(F.upper("security_ticker").alias("symbol")).agg(F.min("security_node_id").alias("low"), F.max("security_node_id").alias("high"))
    joined = shocks.join(ids, F.col("key") == F.col("id"), "left").join(tickers, F.upper("key") == F.col("symbol"), "left")
    one = F.col("low") == F.col("high")
    status = F.when(F.col("id").isNotNull() | one, "resolved").when(F.col("low").isNotNull(), "ambiguous").otherwise("unknown")
    security = F.coalesce(F.col("id"), F.when(one, F.col("low")))
    return joined.select("scenario_id", "ord", "key", "shock", status.alias("status"), security.alias("security_node_id"))


def effective(resolved: DataFrame) -> DataFrame:
    """One shock a (scenario, security): the last in order, whether named by id or ticker."""
    return resolved.where("status = 'resolved'").groupBy("scenario_id", "security_node_id").agg(F.max_by("shock", "ord").alias("shock"))


def impacts(held: DataFrame, shocks: DataFrame, hits_only: bool = False) -> DataFrame:
    """Direct shock, covered weight, weight sum and missing weights of each fund in each scenario;
    funds without a hit have 0, or are left out with ``hits_only``. Only hits are joined; totals
    come from the funds alone. All funds meet all scenarios in the full form, which is its result."""
    w = F.col("portfolio_weight")
    known = F.col("missing_weights") == 0 if "missing_weights" in held.columns else w.isNotNull()
    hits = held.join(effective(resolve(shocks, held)), "security_node_id")
    hit = hits.groupBy("scenario_id", "etf_node_id").agg(
        F.sum(F.when(known, w * F.col("shock"))).alias("direct_shock"),
        F.sum(F.when(known, w)).alias("covered_weight"),
        F.count(F.when(~known, 1)).alias("missing_weight_count"),
    )
    totals = held.groupBy("etf_node_id").agg(F.sum(F.when(known, w)).alias("weight_sum"))
    if hits_only:
        out = hit.join(totals, "etf_node_id")
    else:
        # funds are dealt to SPREAD parts, each of which meets every scenario once
        parts = F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))
        names = shocks.select("scenario_id").distinct().select("scenario_id", F.explode(parts).alias("part"))
        every = totals.withColumn("part", F.pmod(F.xxhash64("etf_node_id"), F.lit(SPREAD).cast("long"))).join(names, "part").drop("part")
        out = every.join(hit, ["scenario_id", "etf_node_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select("scenario_id", "etf_node_id", zero("direct_shock"), zero("covered_weight"), zero("weight_sum"), F.coalesce("missing_weight_count", F.lit(0)).alias("missing_weight_count"))


def replay(held: DataFrame, events: DataFrame) -> DataFrame:
    """Each event (sequence, security_node_id, shock) evaluated alone: funds hit and the sum of
    their impacts. Link weights are summed by security before the join."""
    weights = held.groupBy("security_node_id").agg(F.sum("portfolio_weight").alias("weight"), F.count("portfolio_weight").alias("funds"))
    out = events.join(weights, "security_node_id", "left")
    return out.select("sequence", "security_node_id", F.coalesce("funds", F.lit(0)).alias("funds"), (F.col("shock") * F.coalesce("weight", F.lit(0.0))).alias("impact"))


def replay_summary(replayed: DataFrame) -> DataFrame:
    """Events, checksum, and whether sequences are dense from 0."""
    dense = (F.min("sequence") == 0) & (F.max("sequence") == F.count(F.lit(1)) - 1) & (F.count_distinct("sequence") == F.count(F.lit(1)))
    return replayed.agg(F.count(F.lit(1)).alias("events"), F.sum("impact").alias("checksum"), dense.alias("dense"))
