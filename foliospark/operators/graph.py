"""The bipartite fund-security graph: edges known on a day, nodes, overlap, crowding, degree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import exprs as X
from foliospark.operators.scan import running
from foliospark.sources import store
from foliospark.sources.store import dealt, stage


#: Chosen filings that are sent to every task.
SENT = 100_000


def weight() -> Column:
    return F.col("portfolio_weight")


def as_of(holdings: DataFrame, filings: DataFrame, *days: str) -> DataFrame:
    """Holdings of the newest filing of each fund public on each day, with the filing's accession
    and publication day: the greatest by publication, report date and accession. The choice is
    made on the filings of snapshots that are there and written; up to SENT chosen filings are sent to the
    holdings, which then stay where they are, beyond it both cross the network."""
    public = filings.where("report_date IS NOT NULL AND filed_at IS NOT NULL").select("fund_id", F.col("report_date").alias("snapshot_date"), "accession", F.col("filed_at").alias("available_from"))
    known = public.join(holdings.select("fund_id", "snapshot_date").distinct(), ["fund_id", "snapshot_date"], "left_semi")
    reached = F.filter(F.array(*[F.lit(d).cast("date") for d in days]), lambda d: F.col("available_from") <= d)
    seen = known.select("*", F.explode(reached).alias("as_of"))
    best = seen.groupBy("as_of", "fund_id").agg(F.max(F.struct("available_from", "snapshot_date", "accession")).alias("b")).select("as_of", "fund_id", "b.*")
    best = stage(best, "chosen")
    few = best.limit(SENT + 1).count() <= SENT
    return (holdings if few else dealt(holdings, holdings.count(), "fund_id", "snapshot_date")).join(F.broadcast(best) if few else best, ["fund_id", "snapshot_date"])


def edges(chosen: DataFrame) -> DataFrame:
    """One edge a (as_of, fund, security) with sums and the filing's facts. Weight sums of nothing
    are 0, as missing_weights tells how many were null; holdings without a key are left out."""
    clean = X.without_placeholder
    keyed = chosen.withColumn("security_node_id", X.security_key(F.col("cusip"), F.col("isin"), F.col("security_ticker"), F.col("security_name"), clean)).where("security_node_id IS NOT NULL")
    some = lambda c: F.min(c).alias(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    return keyed.groupBy("as_of", F.col("fund_id").alias("etf_node_id"), "security_node_id").agg(
        total("portfolio_weight"),
        total("market_value"),
        total("quantity"),
        F.count(F.when(weight().isNull(), 1)).alias("missing_weights"),
        *[some(c) for c in ("currency", "asset_type", "country", "security_ticker", "security_name", "accession")],
        F.max("snapshot_date").alias("report_date"),
        F.max("available_from").alias("available_from"),
    )


def nodes(held: DataFrame) -> DataFrame:
    """Fund and security nodes of the edges."""
    funds = held.groupBy("as_of", F.col("etf_node_id").alias("node_id")).agg(F.max("report_date").alias("report_date"), F.max("available_from").alias("available_from"), F.max("accession").alias("accession"))
    securities = held.groupBy("as_of", F.col("security_node_id").alias("node_id")).agg(F.min("security_ticker").alias("ticker"), F.min("security_name").alias("name"), F.min("country").alias("country"))
    return funds.withColumn("node_type", F.lit("ETF")).unionByName(securities.withColumn("node_type", F.lit("SECURITY")), allowMissingColumns=True)


#: Holders above which a security is heavy; funds and securities of one block of the product.
HEAVY, FUND_BLOCK, SECURITY_BLOCK = 500, 256, 64
_SUMS = ("shared", "least_sum", "neg_a", "neg_b", "dot")


def _light_pairs(vec: DataFrame) -> DataFrame:
    """Sums over the shared securities of fund pairs, by a self join on the security: at most
    HEAVY^2 pairs a security."""
    left = vec.select("as_of", "security_node_id", F.col("etf_node_id").alias("left_etf"), F.col("w").alias("a"))
    right = vec.select("as_of", "security_node_id", F.col("etf_node_id").alias("right_etf"), F.col("w").alias("b"))
    a, b, zero = F.col("a"), F.col("b"), F.lit(0.0)
    met = left.join(right, ["as_of", "security_node_id"]).where("left_etf < right_etf")
    return met.groupBy("as_of", "left_etf", "right_etf").agg(
        F.count(F.lit(1)).alias("shared"), F.sum(F.least(a, b)).alias("least_sum"), F.sum(F.least(a, zero)).alias("neg_a"), F.sum(F.least(b, zero)).alias("neg_b"), F.sum(a * b).alias("dot")
    )


def _block_product(left: dict, right: dict) -> dict[str, np.ndarray]:
    """The sums of all pairs of two blocks: held and weights as matrices funds x securities, whose
    products are all but the sum of smaller weights, which goes security by security."""
    a, held_a, b, held_b = left["w"], left["held"], right["w"], right["held"]
    least = np.zeros((len(a), len(b)))
    for s in range(a.shape[1]):
        least += np.minimum(a[:, s, None], b[None, :, s]) * (held_a[:, s, None] * held_b[None, :, s])
    return {"shared": held_a @ held_b.T, "least_sum": least, "neg_a": np.minimum(a, 0) @ held_b.T, "neg_b": held_a @ np.minimum(b, 0).T, "dot": a @ b.T}


def _heavy_pairs(vec: DataFrame, heavy: DataFrame) -> DataFrame:
    """The same sums over heavy securities by a blocked sparse matrix product.

    Funds are dealt to blocks of about FUND_BLOCK and heavy securities, which are numbered, to
    blocks of SECURITY_BLOCK; two fund blocks meet once for each block of securities, in a task that
    holds these two blocks and no more. A security that all funds hold takes as many blocks as
    there are funds, spread over tasks.
    """
    slot = heavy.select("as_of", "security_node_id", (F.col("number") / SECURITY_BLOCK).cast("long").alias("s_block"), (F.col("number") % SECURITY_BLOCK).cast("int").alias("s"))
    entries = vec.join(slot, ["as_of", "security_node_id"])
    blocks = max(1, -(-vec.select("etf_node_id").distinct().count() // FUND_BLOCK))
    entries = entries.withColumn("f_block", F.pmod(F.xxhash64("etf_node_id"), F.lit(blocks)).cast("int"))
    rows = entries.groupBy("as_of", "s_block", "f_block").agg(F.collect_list(F.struct(F.col("etf_node_id").alias("fund"), "s", "w")).alias("cells"))
    rows = stage(rows, "blocks")
    left = rows.select("as_of", "s_block", F.col("f_block").alias("i"), F.col("cells").alias("left"))
    right = rows.select("as_of", "s_block", F.col("f_block").alias("j"), F.col("cells").alias("right"))
    met = left.join(right, ["as_of", "s_block"]).where("i <= j").select("as_of", "left", "right")

    def side(cells: list[dict]) -> dict:
        funds = sorted({c["fund"] for c in cells})
        at = {f: i for i, f in enumerate(funds)}
        w, held = np.zeros((len(funds), SECURITY_BLOCK)), np.zeros((len(funds), SECURITY_BLOCK))
        for c in cells:
            w[at[c["fund"]], c["s"]], held[at[c["fund"]], c["s"]] = c["w"], 1.0
        return {"funds": np.array(funds, object), "w": w, "held": held}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row is two whole blocks
                a, b = side(batch.column(1)[k].as_py()), side(batch.column(2)[k].as_py())
                sums = _block_product(a, b)
                i, j = np.nonzero(sums["shared"])
                x, y = a["funds"][i], b["funds"][j]
                keep = x != y if batch.column(1)[k] != batch.column(2)[k] else x < y
                i, j, x, y = i[keep], j[keep], x[keep], y[keep]
                turn = x > y
                cols = {n: m[i, j] for n, m in sums.items()}
                neg_a, neg_b = np.where(turn, cols["neg_b"], cols["neg_a"]), np.where(turn, cols["neg_a"], cols["neg_b"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k] * len(i), pa.int32())), pa.array(np.where(turn, y, x), pa.string()), pa.array(np.where(turn, x, y), pa.string()), *map(pa.array, (cols["shared"], cols["least_sum"], neg_a, neg_b, cols["dot"]))],
                    ["as_of", "left_etf", "right_etf", *_SUMS],
                )

    kind = vec.schema["as_of"].dataType.simpleString()
    return met.repartition(F.xxhash64("left"), F.xxhash64("right")).mapInArrow(run, f"as_of {kind}, left_etf string, right_etf string, " + ", ".join(f"{c} double" for c in _SUMS))


def overlap_pairs(held: DataFrame, min_shared: int = 1, least_jaccard: float = 0.0, heavy: int = HEAVY) -> DataFrame:
    """Shared count, Jaccard, weighted overlap and cosine of fund pairs that share a security.

    A heavy-light join: both sides are summed to one weight an edge before; securities of at most
    ``heavy`` holders go through a sparse self join, the others through a blocked matrix product.
    Weighted overlap sums the smaller weight over the union, where an absent one is 0: a negative
    weight of one side counts even unshared. With ``least_jaccard``, pairs below it go, and pairs whose sizes
    alone rule it out (smaller / larger) before their facts are joined.
    """
    key = ["as_of", "etf_node_id"]
    vec = stage(held.groupBy(*key, "security_node_id").agg(F.coalesce(F.sum(weight()), F.lit(0.0)).alias("w")), "weights")
    v = F.col("w")
    facts = vec.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(v, F.lit(0.0))).alias("negative"), F.sum(v * v).alias("square"), F.min(v).alias("least"))
    dense = vec.groupBy("as_of", "security_node_id").count().where(F.col("count") > heavy).select("as_of", "security_node_id")
    dense = running(dense, ["as_of"], ["security_node_id"], sums={"number": F.lit(1)})
    sums = _light_pairs(vec.join(dense, ["as_of", "security_node_id"], "left_anti"))
    if not dense.isEmpty():
        both = sums.unionByName(_heavy_pairs(vec, dense))
        sums = both.groupBy("as_of", "left_etf", "right_etf").agg(*[F.sum(c).alias(c) for c in _SUMS])
    side = lambda s: facts.select("as_of", F.col("etf_node_id").alias(f"{s}_etf"), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "negative", "square", "least")])
    shared, left_n, right_n = F.col("shared").cast("long"), F.col("left_n"), F.col("right_n")
    jaccard = shared / (left_n + right_n - shared)
    out = sums.where(F.col("shared") >= min_shared).join(side("left"), ["as_of", "left_etf"]).join(side("right"), ["as_of", "right_etf"])
    out = out.where((F.least(left_n, right_n) >= least_jaccard * F.greatest(left_n, right_n)) & (jaccard >= least_jaccard)) if least_jaccard > 0 else out
    return out.select(
        "as_of",
        "left_etf",
        "right_etf",
        shared.alias("shared_holding_count"),
        jaccard.alias("jaccard"),
        (F.col("least_sum") + F.col("left_negative") - F.col("neg_a") + F.col("right_negative") - F.col("neg_b")).alias("weighted_overlap"),
        ((F.col("left_least") >= 0) & (F.col("right_least") >= 0)).alias("weighted_overlap_is_long_only"),
        F.when((F.col("left_square") > 0) & (F.col("right_square") > 0), F.try_divide(F.col("dot"), F.sqrt("left_square") * F.sqrt("right_square"))).alias("cosine_similarity"),
    )


def crowding(held: DataFrame) -> DataFrame:
    universe = held.groupBy("as_of").agg(F.count_distinct("etf_node_id").alias("universe_etf_count"))
    per = held.groupBy("as_of", "security_node_id").agg(
        F.count_distinct("etf_node_id").alias("etf_count"),
        F.coalesce(F.sum(weight()), F.lit(0.0)).alias("total_reported_weight"),
        F.avg(weight()).alias("average_holding_weight"),
        F.max(weight()).alias("maximum_holding_weight"),
        F.min("security_ticker").alias("security_ticker"),
        F.min("security_name").alias("security_name"),
    )
    return per.join(F.broadcast(universe), "as_of")


def fund_degree(held: DataFrame) -> DataFrame:
    return held.groupBy("as_of", "etf_node_id").agg(F.count(F.lit(1)).alias("holding_count"), F.coalesce(F.sum(weight()), F.lit(0.0)).alias("weight_sum"), F.coalesce(F.sum(F.abs(weight())), F.lit(0.0)).alias("absolute_weighted_degree"))


def quality_report(held: DataFrame) -> DataFrame:
    """Edges by kind of security key, negative and missing weights, node counts of each day."""
    kind = lambda k: F.count_if(F.col("security_node_id").startswith(f"{k}:")).alias(f"{k}_edges")
    return held.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("edges"),
        *[kind(k) for k in ("cusip", "isin", "ticker", "name")],
        F.count_if(weight() < 0).alias("negative_edges"),
        F.count_if(F.col("missing_weights") > 0).alias("missing_weight_edges"),
        F.count_distinct("etf_node_id").alias("funds"),
        F.count_distinct("security_node_id").alias("securities"),
    )


def fingerprint(held: DataFrame) -> DataFrame:
    """A digest of the edges of each day that depends on their content alone: a hash of the count
    and of four sums over slices of each edge's SHA-256. Sums add up in any order and before the
    shuffle, so no task holds or orders the edges."""
    row = F.sha2(F.concat_ws("|", "etf_node_id", "security_node_id", F.coalesce(F.round(weight(), 8).cast("decimal(20,8)").cast("string"), F.lit("null"))), 256)
    slices = [F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    sums = held.select("as_of", row.alias("h")).groupBy("as_of").agg(F.count(F.lit(1)).alias("edges"), *slices)
    return sums.select("as_of", F.sha2(F.concat_ws("|", F.col("edges").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("fingerprint"))


def manifest(held: DataFrame) -> DataFrame:
    """Counts and fingerprint of each day's graph."""
    return quality_report(held).join(fingerprint(held), "as_of")


#: Tables of a published graph.
TABLES = ("edges", "nodes", "overlap", "crowding", "degree", "manifest")


def publish(held: DataFrame, root: str, min_shared: int = 1) -> str:
    """The graph of the edges as one version: edges, nodes, overlapping pairs, crowding, degree
    and manifest, behind a gate for weights that aren't numbers; the version's folder."""
    bad = held.where(F.isnan(weight()) | (F.abs(weight()) == float("inf")))
    tables = {"edges": held, "nodes": nodes(held), "overlap": overlap_pairs(held, min_shared), "crowding": crowding(held), "degree": fund_degree(held), "manifest": manifest(held)}
    return store.publish({name: tables[name] for name in TABLES}, root, {"weights": bad})


def hash_split(pairs: DataFrame, left: str, right: str, seed: str = "7") -> DataFrame:
    """Train, validation or test by a hash of seed and pair, about 7 : 2 : 1."""
    byte = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(left), F.col(right)), 256), 1, 2), 16, 10).cast("int") % 10
    return pairs.withColumn("split", F.when(byte < 7, "train").when(byte < 9, "validation").otherwise("test"))


def node_index(held: DataFrame, column: str) -> DataFrame:
    """Dense 0-based numbers of the distinct ids in order: a running count over ranges of them, so
    no task orders all ids."""
    return running(held.select(F.col(column).alias("node_id")).distinct(), [], ["node_id"], sums={"index": F.lit(1)})
