"""Daily bars: trailing features, forward labels, the as-of join to holdings, splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import exprs as X
from foliospark.operators.scan import running
from foliospark.sources.store import stage

ANNUAL = math.sqrt(252)
HORIZON = 20
FEATURES = (
    "return_1d return_5d return_20d return_60d log_return_1d momentum_20d momentum_60d momentum_120d high_low_range close_open_range "
    "volume_change realized_vol_5d realized_vol_20d realized_vol_60d volume_zscore_20d volume_zscore_60d rolling_drawdown "
    "rolling_max_drawdown_20d rolling_max_drawdown_60d"
).split()


#: Sessions that are worked on together, and those before and after them that windows reach.
SEGMENT, BEHIND, AHEAD = 4096, 120, HORIZON


def segmented(bars: DataFrame) -> DataFrame:
    """``bars`` in segments of SEGMENT sessions of an instrument: columns ``place`` (from 0, in
    session order), ``segment``, ``border`` and ``peak`` (the highest close so far).

    A segment also holds the sessions that windows reach over its ends, marked ``border``, so a
    window over (instrument, segment) has all it needs and a long series isn't one task's. Places and
    peaks are running values over ranges of sessions. Segments are dealt to as many tasks as the
    session's shuffles have: few bytes, but many window steps a row, so they aren't merged by size.
    """
    rows = running(bars, ["instrument_id"], ["trading_date"], sums={"place": F.lit(1)}, maxima={"peak": F.col("close")})
    rows = rows.withColumn("peak", F.greatest("peak", "close"))
    mine, at = F.floor(F.col("place") / SEGMENT), F.col("place") % SEGMENT
    copy = lambda segment, border: F.struct(segment.cast("long").alias("segment"), F.lit(border).alias("border"))
    places = F.array(copy(mine, False), F.when(at >= SEGMENT - BEHIND, copy(mine + 1, True)), F.when((at < AHEAD) & (mine > 0), copy(mine - 1, True)))
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("*", F.inline(F.array_compact(places))).repartition(tasks, "instrument_id", "segment")


def _spans(frame: DataFrame, w, n: int) -> DataFrame:
    """Largest fall before the lowest and after the highest close of the parts that blocks of ``n``
    sessions cut windows into: from each block's start up to a row, and from a row to its end."""
    block = Window.partitionBy("instrument_id", "segment", F.floor(F.col("place") / n)).orderBy("trading_date")
    upto, on = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
    c = F.col("close")
    fall = lambda peak, price: F.when(peak > 0, (peak - price) / peak).otherwise(0.0)
    frame = frame.withColumns({"__head": F.max("close").over(upto), "__foot": F.min("close").over(on)})
    frame = frame.withColumns({"__down": fall(F.col("__head"), c), "__fell": fall(c, F.col("__foot"))})
    first = F.struct(F.max("__fell").over(on).alias("worst"), F.max("close").over(on).alias("peak"))
    last = F.struct(F.max("__down").over(upto).alias("worst"), F.min("close").over(upto).alias("trough"))
    return frame.withColumns({f"__first_{n}": first, f"__last_{n}": last}).drop("__head", "__foot", "__down", "__fell")


def _joined(n: int, first: Column, last: Column, alone: Column) -> Column:
    """The largest fall of a window from its two parts; ``alone``: it is one whole block."""
    across = F.when(first["peak"] > 0, (first["peak"] - last["trough"]) / first["peak"]).otherwise(0.0)
    return F.when(alone, last["worst"]).otherwise(F.greatest(first["worst"], last["worst"], across, F.lit(0.0)))


def max_drawdown(frame: DataFrame, w, n: int, name: str, ahead: bool = False) -> DataFrame:
    """``frame``, in segments, with the largest peak-to-trough fall (a share of the peak) of the
    ``n`` closes up to each row, or from it on, as ``name``; null if one of them is missing.

    Falls are a monoid: of two stretches in a row, the larger of both falls and of that from the
    first's peak to the second's trough. Windows are cut at the borders of blocks of ``n``, whose
    parts are running values, so a row takes the same few steps for any ``n``. Closes are at least 0.
    """
    frame = _spans(frame, w, n)
    first, last = F.col(f"__first_{n}"), F.col(f"__last_{n}")
    if ahead:
        window, alone = w.rowsBetween(0, n - 1), F.col("place") % n == 0
        value = _joined(n, first, F.lead(f"__last_{n}", n - 1).over(w), alone)
        value = F.when(alone, F.lead(f"__last_{n}", n - 1).over(w)["worst"]).otherwise(value)
    else:
        window, alone = w.rowsBetween(-(n - 1), 0), F.col("place") % n == n - 1
        value = _joined(n, F.lag(f"__first_{n}", n - 1).over(w), last, alone)
    return frame.withColumn(name, F.when(F.count("close").over(window) == n, value)).drop(f"__first_{n}", f"__last_{n}")


def market_features(bars: DataFrame) -> DataFrame:
    """Trailing features of each instrument in session order; null until a window is full, and
    where a ratio isn't finite. Windows run inside segments of a series (see ``segmented``)."""
    return _features(segmented(bars)).where("NOT border").select(*bars.columns, *FEATURES)


def _features(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("instrument_id", "segment").orderBy("trading_date")
    c = F.col("close")
    back = lambda n: F.lag("close", n).over(w)
    ret = lambda n: X.growth(c, back(n))

    def full(value: Column, of: str, n: int) -> Column:
        return F.when(F.count(of).over(w.rowsBetween(-(n - 1), 0)) == n, value.over(w.rowsBetween(-(n - 1), 0)))

    def zscore(of: str, n: int) -> Column:
        return X.ratio(F.col(of) - full(F.avg(of), of, n), full(F.stddev_samp(of), of, n))

    frame = rows.select(
        "*",
        *[ret(n).alias(f"return_{n}d") for n in (1, 5, 20, 60)],
        (F.ln(c) - F.ln(back(1))).alias("log_return_1d"),
        *[ret(n).alias(f"momentum_{n}d") for n in (20, 60, 120)],
        X.ratio(F.col("high") - F.col("low"), c).alias("high_low_range"),
        X.ratio(c - F.col("open"), F.col("open")).alias("close_open_range"),
        X.growth(F.col("volume"), F.lag("volume").over(w)).alias("volume_change"),
    )
    peak = F.col("peak")
    out = frame.select(
        "*",
        *[(full(F.stddev_samp("log_return_1d"), "log_return_1d", n) * ANNUAL).alias(f"realized_vol_{n}d") for n in (5, 20, 60)],
        *[zscore("volume", n).alias(f"volume_zscore_{n}d") for n in (20, 60)],
        F.when(peak > 0, (peak - c) / peak).when(c.isNotNull(), 0.0).alias("rolling_drawdown"),
    )
    for n in (20, 60):
        out = max_drawdown(out, w, n, f"rolling_max_drawdown_{n}d")
    return out.withColumns({f: X.finite_or_null(F.col(f)) for f in FEATURES})


TARGETS = ("forward_realized_vol_20d", "forward_max_drawdown_20d", "label_end_date", "tail_event_20d")


def forward_targets(frame: DataFrame, tail_threshold: float = 0.08) -> DataFrame:
    """Labels of the next HORIZON stored sessions: volatility, drawdown from t on, tail flag and
    the last session's date; null where one is missing or its return isn't finite."""
    return _targets(segmented(frame), tail_threshold).where("NOT border").select(*frame.columns, *TARGETS)


def _targets(rows: DataFrame, tail_threshold: float) -> DataFrame:
    w = Window.partitionBy("instrument_id", "segment").orderBy("trading_date")
    log_return = F.ln("close") - F.ln(F.lag("close").over(w))
    ahead = w.rowsBetween(1, HORIZON)
    base = max_drawdown(rows.withColumn("log_step", X.finite_or_null(log_return)), w, HORIZON + 1, "forward_max_drawdown_20d", ahead=True)
    whole = F.count("log_step").over(ahead) == HORIZON
    out = base.withColumns(
        {
            "forward_realized_vol_20d": F.when(whole, F.stddev_samp("log_step").over(ahead) * ANNUAL),
            "forward_max_drawdown_20d": F.when(whole, F.col("forward_max_drawdown_20d")),
            "label_end_date": F.when(whole, F.lead("trading_date", HORIZON).over(w)),
        }
    ).drop("log_step")
    return out.withColumn("tail_event_20d", F.col("forward_max_drawdown_20d") >= tail_threshold)


def labelled(bars: DataFrame, tail_threshold: float = 0.08) -> DataFrame:
    """market_features and forward_targets together, over the same segments."""
    return _targets(_features(segmented(bars)), tail_threshold).where("NOT border").select(*bars.columns, *FEATURES, *TARGETS)


def attach_holdings(market: DataFrame, timeline: DataFrame, key: str = "fund_id") -> DataFrame:
    """Each session with the newest filing public on it: a backward as-of join on available_from.

    Filings of one day keep the last by report date and accession. Filings and sessions are
    merged in order of the day and dealt to ranges of (fund, day); the newest filing so far is a
    running maximum over them, carried into each range. So sessions of one fund spread over
    tasks, and the join needs no broadcast and no range condition. Both are written before they are dealt,
    as the ranges take a pass of their own over what they divide. ``available_from``,
    ``report_date`` and ``accession`` must be among the timeline's columns.
    """
    first = ["available_from", "report_date", "accession"]
    fields = [c for c in timeline.columns if c != key]
    newest = F.struct(*first, *[c for c in fields if c not in first])
    filings = timeline.where("available_from IS NOT NULL").select(key, F.col("available_from").alias("on"), F.lit(0).alias("side"), F.monotonically_increasing_id().alias("nth"), newest.alias("filing"))
    sessions = market.select(key, F.col("trading_date").alias("on"), F.lit(1).alias("side"), F.monotonically_increasing_id().alias("nth"), F.struct(*[c for c in market.columns if c != key]).alias("session"))
    both = stage(filings.unionByName(sessions, allowMissingColumns=True), "asof")
    filled = running(both, [key], ["on", "side", "nth"], maxima={"known": F.col("filing")}).where("side = 1")
    out = filled.select(key, "session.*", *[F.col(f"known.{c}").alias(c) for c in fields])
    return out.withColumns({"days_since_holdings_report_date": F.datediff("trading_date", "report_date"), "days_since_holdings_publication": F.datediff("trading_date", "available_from")})


def risk_dataset(bars: DataFrame, timeline: DataFrame, funds: DataFrame, train_end: str, validation_end: str, tail_threshold: float = 0.08) -> DataFrame:
    """Features, labels, holdings known on the day and the chronological split of each session of
    the instruments that stand for funds (instrument_id, fund_id)."""
    market = labelled(bars, tail_threshold).join(funds, "instrument_id")
    joined = attach_holdings(market, timeline)
    return joined.withColumn("split", X.split_label(F.col("trading_date"), F.col("label_end_date"), F.col("momentum_120d"), train_end, validation_end))


def dataset_profile(dataset: DataFrame) -> DataFrame:
    """Rows, rows with features and with holdings, date range, and rows of each split."""
    parts = ("train", "validation", "test", "purged_train", "purged_validation", "warmup", "no_target")
    return dataset.groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("return_1d").alias("market_rows"),
        F.count("holding_count").alias("holdings_rows"),
        F.min("trading_date").alias("first_date"),
        F.max("trading_date").alias("last_date"),
        F.count_distinct("accession").alias("filings_used"),
        *[F.count_if(F.col("split") == p).alias(f"{p}_rows") for p in parts],
    )


def first_use(dataset: DataFrame, timeline: DataFrame) -> DataFrame:
    """The first session on which each filing was in use, null if never."""
    used = dataset.where("accession IS NOT NULL").groupBy("accession").agg(F.min("trading_date").alias("first_session"))
    return timeline.select("fund_id", "accession", "available_from").join(used, "accession", "left")
