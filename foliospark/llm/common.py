"""Helpers shared by the corpus operators: table access, lineage cuts, native text pieces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.store import stage, work_folder

#: The white space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
NO_WORD = rf"[{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share."""
    return work_folder(spark)


#: Whether the shuffle files of a query go at its end.
RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and cut its lineage.

    A written table, unlike checkpoint(), also has its true size for later plans: estimates of
    joins are products, and grow beyond bounds when each round starts from the one before. The
    shuffle files go with the write, not when the driver happens to collect its garbage.
    """
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(RELEASED)
    conf.set(RELEASED, "true")
    try:
        return stage(df, "cut")
    finally:
        conf.set(RELEASED, before)


#: Bytes of a batch that a task turns into Python objects at once.
SLICE = 4 << 20


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE bytes, one row at least: Spark bounds a batch by its
    bytes, and Python objects of it take several times as much."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space. Null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NO_WORD), "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def long(value: Column) -> Column:
    return value.cast("long")


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows; as it is otherwise,
    for a shuffled join whose hot keys the adaptive planner splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
