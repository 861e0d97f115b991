"""Running sums and maxima over an order that no single task holds: range partitions with what
came before each of them carried in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources.store import stage

#: Rows of the table of carried values that are sent to every task; beyond it they are joined.
CARRIED = 100_000


def running(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums`` and ``maxima``: the sum (0 before the first row)
    or the maximum (null before) of the expression over the rows before, of the same ``by`` columns
    and in the given order, which has to tell all rows of a group apart.

    Rows are dealt to ranges of (by, order) and written once, so that every later step sees the same
    ranges, a lost executor or not. A range takes its own running values on top of the total of
    the ranges before it; there are at most as many totals as ranges and groups together. A maximum of
    a struct is its first field's, then the next ones': the newest of dated rows, for one.
    """
    sums, maxima = sums or {}, maxima or {}
    values = {**{n: (c, F.sum) for n, c in sums.items()}, **{n: (c, F.max) for n, c in maxima.items()}}
    dealt = df.withColumns({f"__{n}": c for n, (c, _) in values.items()}).repartitionByRange(*by, *order)
    dealt = stage(dealt.withColumn("__range", F.spark_partition_id()), "scan")
    totals = dealt.groupBy(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__in")).agg(*[f(f"__{n}").alias(f"__{n}_in") for n, (_, f) in values.items()])
    earlier = Window.partitionBy(*[f"__by_{c}" for c in by]).orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    totals = stage(totals.select("*", *[f(f"__{n}_in").over(earlier).alias(f"__{n}_carried") for n, (_, f) in values.items()]).drop(*[f"__{n}_in" for n in values]), "carried")
    totals = F.broadcast(totals) if totals.limit(CARRIED + 1).count() <= CARRIED else totals
    own = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.select("*", *[f(f"__{n}").over(own).alias(f"__{n}_own") for n, (_, f) in values.items()])
    same = F.col("__range") == F.col("__in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    added = {n: F.coalesce(F.col(f"__{n}_own") + F.col(f"__{n}_carried"), f"__{n}_own", f"__{n}_carried", F.lit(0)) for n in sums}
    most = {n: F.coalesce(F.greatest(f"__{n}_own", f"__{n}_carried"), f"__{n}_own", f"__{n}_carried") if _plain(dealt, n) else _later(n) for n in maxima}
    return rows.join(totals, same).select(*df.columns, *[c.alias(n) for n, c in {**added, **most}.items()])


def _plain(df: DataFrame, name: str) -> bool:
    return df.schema[f"__{name}"].dataType.typeName() != "struct"


def _later(n: str) -> Column:
    """The greater of two structs; null only if both are."""
    a, b = F.col(f"__{n}_own"), F.col(f"__{n}_carried")
    return F.when(a.isNull(), b).when(b.isNull(), a).when(a >= b, a).otherwise(b)
