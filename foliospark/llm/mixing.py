"""Mixing sources to target weights: repetition rates per source, copies per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import broadcast_if_small, cut, long, table, unused, words

#: Source weights by place in code point order, and the shares of the mix.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def unit_hash(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and keys alone (52 bits of SHA-256)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def ranked_sources(sized: DataFrame) -> DataFrame:
    """One row per source with its size and its 0-based place in code point order, nulls last.

    Places come from a range partitioning, so no task holds all sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    dealt = cut(totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("place", place).join(F.broadcast(starts), "part").select("source", "source_size", (F.col("place") + F.col("start")).alias("place"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target words of each source: ``share`` of all words dealt by weight, at most ``most`` times
    the source's own words, the excess dealt again by weight until no source is above.

    Each round is one small aggregate over sources; only two sums come to the driver.
    """
    pick = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        pick = F.when(F.col("place") % len(weights) == i, float(w)).otherwise(pick)
    sources = cut(ranked_sources(sized).withColumn("weight", pick).withColumn("most", F.col("source_size") * float(most)))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * float(share)
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") >= F.col("most")
        taken, open_weight, n = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if n == capped or open_weight == 0:
            break
        capped, level = n, (total - taken) / open_weight
    target = F.least(F.col("most"), F.lit(level or 0.0) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def _copies(sized: DataFrame, targets: DataFrame, seed: str, names: list[str]) -> DataFrame:
    """``sized`` with source, source_size, target and copies of its source and row, under ``names``."""
    of, size, target, copies = names
    rate = F.coalesce(F.try_divide(F.col(target), F.col(size)), F.lit(0.0))
    extra = (unit_hash(seed, F.col("source"), F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    targets = broadcast_if_small(targets.toDF(of, size, target))
    return sized.join(targets, F.col("source").eqNullSafe(F.col(of))).withColumn(copies, F.floor(rate) + extra)


def mix(docs: DataFrame, seed: str = "mix", **limits) -> DataFrame:
    """Copies of each document in the mix: doc_id, source, size, source_size, target, copies.

    A source's rate is target / size. A document gets floor(rate) copies and one more with the
    probability of the fraction, by a hash of seed, source and doc_id, so reruns agree. Null text
    has size 0, texts are counted whole however long; null sources form one source, last in order;
    rows with one doc_id are treated alike; no rows give no rows. Other columns of ``docs`` are ignored. Sources of no words get
    a rate of 0.
    """
    sized = cut(docs.select("doc_id", "source", long(F.size(words(F.col("text")))).alias("size")))
    names = ["of", "source_size", "target", "copies"]
    return _copies(sized, source_targets(sized, **limits), seed, names).select("doc_id", "source", "size", *names[1:])


def emit(docs: DataFrame, seed: str = "mix", **limits) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as mix() says, with all its columns, whatever
    their names, and copy, counted from 1 (a column ``copy`` of ``docs`` is replaced). Null and empty
    texts of a source with words are emitted at its rate; a source without words and an empty
    table give no rows; rows of one doc_id and source are emitted alike; ties don't arise."""
    sized = cut(docs.select("source", long(F.size(words(F.col("text")))).alias("size")))
    names = unused(docs, "of", "source_size", "target", "copies")
    out = _copies(docs, source_targets(sized, **limits), seed, names).where(F.col(names[3]) > 0)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(names[3]).cast("int")))).drop(*names)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: The targets by another way: sources in order of how soon they fill up, with running sums.
OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
w AS (SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM src),
r AS (
  SELECT *, coalesce(sum(most) OVER o, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight,
         sum(source_size) OVER () * 1.5::DOUBLE AS total, row_number() OVER (ORDER BY most / weight, place) AS nth
  FROM w WINDOW o AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT coalesce(arg_min((total - filled) / open_weight, nth), 0) AS level FROM r WHERE (total - filled) / open_weight * weight < most),
t AS (SELECT source, source_size, least(most, level * weight) AS target FROM w, lv),
m AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
         CAST('0x' || substr(sha256('mix:' || coalesce(s.source, 'null') || ':' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM m
"""
