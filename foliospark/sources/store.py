"""Snapshot, bar and graph tables on disk: pruned reads, partition overwrites, staged publishing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.sources.commits import Log

SUMMARY_SQL = "SELECT fund_id, snapshot_date, count(*) AS holdings, sum(portfolio_weight) AS weight_sum FROM holdings GROUP BY fund_id, snapshot_date"


#: Partitions of a snapshot date: funds are dealt to them by hash.
BUCKETS = 16
#: Rows that a task sorts, about.
ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``keys`` to a partition for every ROWS of them, one a core at
    least. The number is given, so it stays: the planner would merge partitions up to a size that it tells
    by compressed bytes, a few a row, and what a task sorts would grow with the input."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)


def work_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the session's ``spark.checkpoint.dir``. Only a local
    master (tests) may go without one; it then gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read again, so that later plans start there."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fund_dirname(fund_id: Column) -> Column:
    """A fund id as a safe folder name; ids without a safe character give null."""
    safe = F.regexp_replace(F.regexp_replace(fund_id, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|\.{2,}", "")
    return F.nullif(safe, F.lit(""))


def fund_bucket(fund_id: Column) -> Column:
    return F.pmod(F.xxhash64(fund_id), F.lit(BUCKETS)).cast("int")


def write_snapshots(holdings: DataFrame, root: str) -> None:
    """Replace the snapshots (fund, date) of ``holdings``; every other one stays, those of other
    funds on the same dates too. The table is partitioned by date and fund bucket, so a write
    touches the buckets of its own funds and a date never goes to one task; rows are sorted by
    fund within files, so a fund's read touches few row groups."""
    spark = holdings.sparkSession
    fresh = stage(holdings.withColumns({"snapshot_key": F.col("snapshot_date").cast("string"), "fund_bucket": fund_bucket(F.col("fund_id"))}))
    if not fresh.where(fund_dirname(F.col("fund_id")).isNull()).isEmpty():
        raise ValueError("a fund id is null or has no character that a name may have")
    names = [c for c in holdings.columns]
    rows = fresh
    if exists(spark, root):
        touched = fresh.select("snapshot_key", "fund_bucket").distinct()
        keys = fresh.select("fund_id", "snapshot_date").distinct()
        stored = spark.read.schema(fresh.schema).parquet(root).join(F.broadcast(touched) if touched.count() <= 100_000 else touched, ["snapshot_key", "fund_bucket"], "left_semi")
        rows = stage(fresh.unionByName(stored.join(keys, ["fund_id", "snapshot_date"], "left_anti")))
    dealt = rows.repartition("snapshot_key", "fund_bucket").sortWithinPartitions("snapshot_key", "fund_bucket", "fund_id", "security_id")
    dealt.select(*names, "snapshot_key", "fund_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_key", "fund_bucket").parquet(root)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_snapshot(spark: SparkSession, root: str, fund_id: str, snapshot_date: str) -> DataFrame:
    """One snapshot by partition pruning and a pushed fund filter; an error if there is none."""
    mine = (F.col("snapshot_key") == snapshot_date) & (F.col("fund_bucket") == fund_bucket(F.lit(fund_id))) & (F.col("fund_id") == fund_id)
    rows = spark.read.parquet(root).where(mine).drop("snapshot_key", "fund_bucket")
    if rows.isEmpty():
        raise FileNotFoundError(f"no snapshot of {fund_id} on {snapshot_date}")
    return rows


def query_holdings(holdings: DataFrame, sql: str) -> DataFrame:
    """Any SQL over the relation ``holdings``."""
    holdings.createOrReplaceTempView("holdings")
    return holdings.sparkSession.sql(sql)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of both with the last row by ``order`` of each key; fresh rows win ties."""
    both = stored.withColumn("__side", F.lit(0)).unionByName(fresh.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__side"), F.desc(order)))
    return both.withColumn("__nth", nth).where("__nth = 1").drop("__nth", "__side")


def new_keys(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return fresh.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")


def series_meta(bars: DataFrame) -> DataFrame:
    """First and last date and bars of each stored series."""
    keys = [c for c in ("provider", "instrument_id", "adjustment_mode") if c in bars.columns]
    return bars.groupBy(*keys).agg(F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count(F.lit(1)).alias("bars"))


def authoritative_closes(bars: DataFrame, provider: str) -> DataFrame:
    return bars.where(F.col("provider") == provider).select("instrument_id", "trading_date", "close", "provider", "adjustment_mode")


def publish(tables: dict[str, DataFrame], root: str, gates: dict[str, DataFrame] | None = None) -> str:
    """Check the gates (no rows may be in them), write all tables to a new version folder, and
    then name the version in the manifest with the rows of each table.

    A gate that fails leaves nothing behind. The manifest is one small file a version, made only if
    no other publisher has its number, and added, never replaced: of two at once one gets the next
    number and the other the one after it, and a reader sees a version whole or not at all.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, bad in (gates or {}).items():
        if not bad.isEmpty():
            raise ValueError(f"gate {name} failed; the version before stays current")
    version = f"{root}/version-{uuid.uuid4().hex}"
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
        counts[name] = spark.read.parquet(f"{version}/{name}").count()
    Log(spark, root).commit({"operation": "publish", "version": version, "row_counts": counts})
    return version


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All published versions, the current one with the greatest number."""
    return Log(spark, root).entries().select("number", "version", "row_counts")


def current(spark: SparkSession, root: str) -> str:
    return manifest(spark, root).orderBy(F.desc("number")).first()["version"]


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{current(spark, root)}/{name}")


def upsert_columns(stored: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``stored`` with ``columns`` taken from the fresh row of each key (one a key), null ones too,
    and the fresh rows of new keys; the other columns of stored rows stay."""
    new = fresh.select(*keys, F.struct(*fresh.columns).alias("__new"))
    joined = stored.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")
    pick = lambda c: F.when(F.col("__old").isNull(), F.col(f"__new.{c}") if c in fresh.columns else F.lit(None)).otherwise(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) if c in columns else F.col(c))
    return joined.select(*[c if c in keys else pick(c).alias(c) for c in stored.columns])
