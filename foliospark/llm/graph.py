"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import cut


def _smallest(edges: DataFrame) -> DataFrame:
    """Of each u (``of``), the smallest of it and its neighbours."""
    return edges.groupBy(F.col("u").alias("of")).agg(F.min(F.least("u", "v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v); a component is its smallest node.

    Large-star and small-star steps in turn: each node's neighbours are tied to the smallest of
    them until nothing changes. A step is a minimum a node, combined before the shuffle, and a
    join that the adaptive planner splits at hot nodes; no task needs a node's neighbours whole.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = cut(pairs)
    sign = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _smallest(both)
        large = both.join(least, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = _smallest(large)
        joined = large.join(least, F.col("u") == F.col("of"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    found = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
