"""A log of commits with optimistic concurrency, and keyed tables whose rows are merged when read."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of keys that a commit names as touched.
BUCKETS = 1024
ENTRY = "number long, version string, row_counts map<string,long>, operation string, path string, buckets array<int>, replaces long, columns string"


class Conflict(RuntimeError):
    """Another commit touched the same keys after the version that this one was made from."""


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless one of that name is there: False then, and the other stays.

    The text goes to a hidden file, which then gets its name in one step that fails if the name is
    taken: a hard link on a local or mounted folder, a rename elsewhere (HDFS refuses taken names;
    a store whose rename replaces needs a lock of its own).
    """
    fs, where = _place(spark, path)
    parent, hidden = where.getParent(), f".{uuid.uuid4().hex}"
    fs.mkdirs(parent)
    if fs.getScheme() == "file":
        folder = parent.toUri().getPath()
        with open(f"{folder}/{hidden}", "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f"{folder}/{hidden}", f"{folder}/{where.getName()}")
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{folder}/{hidden}")
        return True
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent, hidden)
    out = fs.create(aside, False)
    out.write(text.encode())
    out.close()
    if not fs.exists(where) and fs.rename(aside, where):
        return True
    fs.delete(aside, False)
    return False


@dataclass
class Log:
    """Commits 1, 2, ... of a root, one small JSON file each in ``_manifest``; added, never replaced, so
    a reader of version n sees the same whenever it reads."""

    spark: SparkSession
    root: str

    @property
    def folder(self) -> str:
        return f"{self.root}/_manifest"

    def latest(self) -> int:
        fs, where = _place(self.spark, self.folder)
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return max((int(n.removesuffix(".json")) for n in names if n[:1].isdigit()), default=0)

    def entries(self, version: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(ENTRY).json(self.folder)
        return rows if version is None else rows.where(F.col("number") <= version)

    def commit(self, entry: dict, read_version: int | None = None) -> int:
        """Add an entry under the next number; retried under later ones while others take it.

        With ``read_version``, the version that the change was made from, a commit since then that
        touched one of the entry's buckets (all, without any named) is a Conflict.
        """
        checked = read_version
        while True:
            last = self.latest()
            if checked is not None and last > checked:
                mine = set(entry.get("buckets") or range(BUCKETS))
                for r in self.entries().where((F.col("number") > checked) & (F.col("number") <= last)).select("number", "buckets", "operation").collect():
                    if r["operation"] != "rewrite" and not mine.isdisjoint(r["buckets"] if r["buckets"] is not None else range(BUCKETS)):
                        raise Conflict(f"commit {r['number']} touched the same keys after version {read_version}")
                checked = last
            number = last + 1
            if create_if_absent(self.spark, f"{self.folder}/{number:020}.json", json.dumps({"number": number, **entry})):
                return number


@dataclass
class KeyedTable:
    """Rows by key under a root. Writers add files and never change one; a reader merges: of a key,
    the rows of the last upsert, or those appended, unless a later commit deleted it."""

    spark: SparkSession
    root: str
    keys: list[str]

    @property
    def log(self) -> Log:
        return Log(self.spark, self.root)

    def write(self, rows: DataFrame, operation: str = "upsert", read_version: int | None = None) -> int:
        """Commit ``rows`` as an 'upsert' (one row a key), an 'append', or a 'delete' of their keys;
        the new version. ``read_version``: fail with Conflict if their keys changed since then."""
        rows = rows.select(*self.keys) if operation == "delete" else rows
        path = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}")
        touched = stored.select(F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()
        entry = {"operation": operation, "path": path, "buckets": sorted(r["b"] for r in touched), "row_counts": {"rows": stored.count()}}
        return self.log.commit(entry | ({} if operation == "delete" else {"columns": rows.schema.json()}), read_version)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows at a version, the latest by default. One scan of all live files: each row gets its
        commit from its file's folder, and the last touch of its key by one aggregation; rows
        appended together stay together."""
        entries = self.log.entries(version)
        base = entries.where("operation = 'rewrite'").orderBy(F.desc("number")).limit(1)
        since = base.select(F.col("replaces").alias("since"), F.col("number").alias("by"))
        live = entries.crossJoin(since) if not since.isEmpty() else entries.withColumns({"since": F.lit(0).cast("long"), "by": F.lit(-1).cast("long")})
        # a rewrite stands where what it replaces ended
        live = live.where((F.col("number") == F.col("by")) | ((F.col("number") > F.col("since")) & (F.col("operation") != "rewrite")))
        files = live.select("path", "operation", "columns", F.when(F.col("number") == F.col("by"), F.col("since")).otherwise(F.col("number")).alias("__at"), "number").orderBy("number").collect()
        schema = StructType.fromJson(json.loads([f["columns"] for f in files if f["columns"]][-1]))
        paths = self.spark.createDataFrame([(f["path"], f["operation"], f["__at"]) for f in files], "__path string, __operation string, __at long")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f['path']}" for f in files])
        rows = rows.withColumn("__path", F.regexp_extract(F.col("_metadata.file_path"), r"/(data-[0-9a-f]{32})/[^/]*$", 1)).join(F.broadcast(paths), "__path")
        touch = F.max(F.when(F.col("__operation").isin("upsert", "delete"), F.col("__at"))).over(Window.partitionBy(*self.keys))
        held = rows.withColumn("__touch", touch).where((F.col("__operation") != "delete") & (F.col("__touch").isNull() | (F.col("__at") >= F.col("__touch"))))
        return held.select(*schema.names)

    def rewrite(self) -> int:
        """Merge all files into one set, for shorter reads. Commits made meanwhile stay beside it."""
        version = self.log.latest()
        path = f"data-{uuid.uuid4().hex}"
        rows = self.read(version)
        rows.write.parquet(f"{self.root}/{path}")
        return self.log.commit({"operation": "rewrite", "path": path, "replaces": version, "columns": rows.schema.json()})
