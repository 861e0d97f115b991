"""The driver's tables seen as holdings, filings, bars, edges, ticks and shocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators import graph, normalize
from foliospark.sources.store import dealt, stage

AS_OF = "2000-01-15"
#: Canonical tables written in this session, by application, input folder, input files and kind.
_STORED: dict[tuple, DataFrame] = {}


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many files a table has, and a digest of their names, lengths and times of change.
    Only the listing is read, neither rows nor contents."""
    listed = spark.read.format("binaryFile").load(path).select(F.xxhash64("path", "length", "modificationTime").alias("digest"))
    return listed.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("digest").alias("digest"))


def stored(spark: SparkSession, sf_dir: str, kind: str, make, of: tuple[str, ...] = ("lineitem",)) -> DataFrame:
    """The table that ``make`` derives from ``sf_dir``, written once a session as Parquet in the
    shared folder and read, pruned, by every query on it; made anew if a file of the tables ``of`` has
    another length or time of change."""
    files = tuple(tuple(_files(spark, f"{sf_dir}/{name}.parquet").first()) for name in of)
    key = (spark.sparkContext.applicationId, sf_dir, files, kind)
    if key not in _STORED:
        _STORED[key] = stage(make(), kind)
    return _STORED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sizes(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Funds, a fifth of the suppliers, and securities, a tenth of the parts; 20 and 200 at least."""
    n = lambda name: table(spark, sf_dir, name).count()
    return max(20, n("supplier") // 5), max(200, n("part") // 10)


def fund_name(number, funds: int):
    return F.concat(F.lit("F"), F.lpad(number.cast("string"), 2 if funds <= 100 else 9, "0"))


def fund_id(spark: SparkSession, sf_dir: str, number: int) -> str:
    return f"F{number:0{2 if sizes(spark, sf_dir)[0] <= 100 else 9}}"


def instrument_count(spark: SparkSession, sf_dir: str) -> int:
    """Instruments of the price messages: eight for every 25 securities."""
    return sizes(spark, sf_dir)[1] * 8 // 25


def bar_groups(spark: SparkSession, sf_dir: str) -> int:
    """Groups of customers that have bars of their own: one for every 1,500."""
    return max(1, table(spark, sf_dir, "customer").count() // 1500)


def instrument_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fund that each instrument of the bars stands for."""
    groups, funds = bar_groups(spark, sf_dir), sizes(spark, sf_dir)[0]
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for n, k in enumerate("FOP")]))
    rows = spark.range(groups).select("id", kinds)
    name = F.concat("kind", F.col("id").cast("string")) if groups > 1 else F.col("kind")
    return rows.select(name.alias("instrument_id"), fund_name((F.col("id") * 3 + F.col("n")) % funds, funds).alias("fund_id"))


def lines(spark: SparkSession, sf_dir: str) -> int:
    """Line items, by the files' footers."""
    return table(spark, sf_dir, "lineitem").count()


def raw_holdings(spark: SparkSession, sf_dir: str, weights: str = "reported") -> DataFrame:
    """Line items as raw holdings: fund from the supplier, security from the part, quarter end of
    the ship date; some values negative or null, some names in conflict."""
    funds, securities = sizes(spark, sf_dir)
    date, line, n = F.col("snapshot_date"), F.col("line"), F.col("n")
    sign = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 6), F.lit(None)).when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), -1).otherwise(1)
    raw = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % funds).alias("fund"),
        F.last_day(F.add_months(F.trunc(F.col("l_shipdate").cast("date"), "quarter"), 2)).alias("snapshot_date"),
        (F.col("l_partkey") % securities).alias("n"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        (sign * F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("market_value"),
    )
    weight = []
    if weights != "none":  # the totals are taken over numbers, before texts make the rows wide
        total = F.sum("market_value").over(Window.partitionBy("fund", "snapshot_date"))
        raw = dealt(raw, lines(spark, sf_dir), "fund", "snapshot_date").withColumn("portfolio_weight", F.try_divide(F.col("market_value"), total))
        weight = ["portfolio_weight"]
    return raw.select(
        fund_name(F.col("fund"), funds).alias("fund_id"),
        date,
        F.concat(F.lit("P"), F.lpad(n.cast("string"), 8, "0")).alias("cusip"),
        F.concat(F.lit("T"), (n % 150).cast("string")).alias("security_ticker"),
        "quantity",
        "market_value",
        F.concat(F.lit("N"), F.when(n < 20, line).otherwise(n).cast("string")).alias("security_name"),
        F.concat(F.lit("C"), (n % 25).cast("string")).alias("country"),
        F.when(n % 10 != 0, F.concat(F.lit("Sector"), (n % 8).cast("string"))).alias("sector"),
        *weight,
    )


def normalized(spark: SparkSession, sf_dir: str, weights: str = "reported") -> DataFrame:
    return normalize.normalize(raw_holdings(spark, sf_dir, weights), size=lines(spark, sf_dir)).holdings


def holdings(spark: SparkSession, sf_dir: str, weights: str = "reported") -> DataFrame:
    """The canonical holdings, normalised once."""
    return stored(spark, sf_dir, f"holdings-{weights}", lambda: normalized(spark, sf_dir, weights))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filing a snapshot, 45 to 64 days later, and an amendment ten days after it for every
    fifth fund."""
    snaps = holdings(spark, sf_dir).select("fund_id", "snapshot_date").distinct()
    fund = F.substring("fund_id", 2, 9).cast("int")
    delay = 45 + (fund * 7 + F.month("snapshot_date") * 3) % 20
    first = F.date_add("snapshot_date", delay.cast("int"))
    both = F.when(fund % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = snaps.select("*", first.alias("first"), F.explode(both).alias("n"))
    return rows.select(
        F.concat_ws("-", "fund_id", F.col("snapshot_date").cast("string"), F.col("n").cast("string")).alias("accession"),
        "fund_id",
        F.col("snapshot_date").alias("report_date"),
        F.date_add("first", (F.col("n") - 1) * 10).alias("filed_at"),
        F.lit("NPORT-P").alias("form_type"),
        F.lit("1").alias("parser_version"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily bars of three instruments for every 1,500 customers."""
    o = table(spark, sf_dir, "orders")
    price, key, groups = "o_totalprice", "o_orderkey", bar_groups(spark, sf_dir)
    name = F.concat(F.col("o_orderstatus"), (F.col("o_custkey") % groups).cast("string")) if groups > 1 else F.col("o_orderstatus")
    return o.groupBy(name.alias("instrument_id"), F.col("o_orderdate").cast("date").alias("trading_date")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def second_provider(first: DataFrame) -> DataFrame:
    """The same bars from another provider: closes a little off, every eleventh session missing."""
    nth = F.row_number().over(Window.partitionBy("instrument_id").orderBy("trading_date"))
    off = 1 + (F.dayofmonth("trading_date") % 7 - 3) / F.lit(1000.0)
    return first.withColumn("nth", nth).where("nth % 11 <> 0").withColumn("close", F.col("close") * off).drop("nth")


def edges(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """The edges known on a day, built once."""
    return stored(spark, sf_dir, f"edges-{as_of}", lambda: graph.edges(graph.as_of(holdings(spark, sf_dir), filings(spark, sf_dir), as_of)))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price messages in arrival order: shuffled within five, every 97th repeated."""
    e = table(spark, sf_dir, "events")
    instrument = F.col("user_id") % instrument_count(spark, sf_dir)
    copies = F.when(F.col("event_id") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return e.select(
        F.lit("price").alias("type"),
        F.col("event_id").alias("sequence"),
        (F.col("event_id") + (F.col("event_id") * 7) % 5).alias("arrival"),
        F.explode(copies).alias("copy"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("send_timestamp_ns"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + (F.col("event_id") * 7919) % 100_003 - 50).alias("decoded_timestamp_ns"),
        instrument.cast("int").alias("instrument_id"),
        F.round(F.col("value") * 100).cast("long").alias("price_ticks"),
        F.concat(F.lit("cusip:P"), F.lpad(instrument.cast("string"), 8, "0")).alias("security_node_id"),
    )


def shocks(held: DataFrame) -> DataFrame:
    """Seven scenarios over the securities of the edges, with ticker keys: one of one security,
    one of two, one unknown."""
    n = F.substring("security_node_id", 8, 8).cast("int")
    by_id = held.select("security_node_id").distinct().select((n % 7).alias("k"), (n * 10).alias("ord"), F.col("security_node_id").alias("key"))
    by_id = by_id.withColumn("shock", F.lit(-0.05) * (F.col("k") + 1))
    spark = held.sparkSession
    more = spark.range(7).select(F.col("id").cast("int").alias("k"), F.inline(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(t).alias("key"), F.lit(s).alias("shock")) for o, t, s in ((5001, "t100", -0.2), (5002, "T7", -0.3), (5003, "T9999", -0.4))])))
    return by_id.unionByName(more).select(F.concat(F.lit("scenario-"), F.col("k").cast("string")).alias("scenario_id"), "ord", "key", "shock")
