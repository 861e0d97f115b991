"""Price messages to fund impacts, sequence accounting and latency quantiles, batch and stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark.operators.scan import running

MESSAGE = "type string, sequence long, arrival long, send_timestamp_ns long, decoded_timestamp_ns long, instrument_id int, price_ticks long, quantity int, instrument_count int"
#: The state store that transformWithState needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TYPES = ("heartbeat", "price", "trade", "snapshot_start", "snapshot_end")
STAGES = {"transport": ("send_timestamp_ns", "decoded_timestamp_ns"), "queue": ("decoded_timestamp_ns", "started_timestamp_ns"), "processing": ("started_timestamp_ns", "ended_timestamp_ns"), "end_to_end": ("send_timestamp_ns", "ended_timestamp_ns")}


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fault(instruments: int) -> Column:
    """What is wrong with a message, or null."""
    price = F.col("type") == "price"
    known = F.coalesce((F.col("instrument_id") >= 0) & (F.col("instrument_id") < instruments), F.lit(False))
    count = F.coalesce(F.col("instrument_count") == instruments, F.lit(False))
    return (
        F.when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "unknown_type")
        .when((F.col("type") == "snapshot_start") & ~count, "snapshot_mismatch")
        .when(price & ~known, "invalid_instrument")
        .when(price & ~F.coalesce(F.col("price_ticks") > 0, F.lit(False)), "invalid_price")
    )


def split_valid(messages: DataFrame, instruments: int) -> tuple[DataFrame, DataFrame]:
    """Sound messages, and the others with their fault, for a quarantine."""
    marked = messages.withColumn("fault", fault(instruments))
    return marked.where("fault IS NULL").drop("fault"), marked.where("fault IS NOT NULL")


def latest_epoch(messages: DataFrame, order: str = "sequence") -> DataFrame:
    """Messages since the last snapshot start: an earlier epoch's references and impacts are gone."""
    start = messages.where("type = 'snapshot_start'").agg(F.max(order).alias("since"))
    return messages.join(F.broadcast(start), F.coalesce(F.col(order) >= F.col("since"), F.lit(True))).drop("since")


def security_returns(prices: DataFrame, key: str = "security_node_id", order: str = "sequence") -> DataFrame:
    """First and last price of each security by order, and the return between them. Both are
    mergeable aggregates, so this is one shuffle in a batch and one state row a security in a
    stream."""
    sums = prices.groupBy(key).agg(F.min_by("price_ticks", order).alias("first"), F.max_by("price_ticks", order).alias("last"), F.count(F.lit(1)).alias("updates"))
    return sums.withColumn("return", F.col("last") / F.col("first") - 1)


def fund_impacts(returns: DataFrame, held: DataFrame) -> DataFrame:
    """Sum of weight x return of each fund, links without a weight left out."""
    known = held.where("portfolio_weight IS NOT NULL")
    return known.join(returns, "security_node_id").groupBy("etf_node_id").agg(F.sum(F.col("portfolio_weight") * F.col("return")).alias("impact"), F.count(F.lit(1)).alias("links"), F.sum("updates").alias("updates"))


def checksum(impacts: DataFrame) -> DataFrame:
    return impacts.agg(F.sum("impact").alias("checksum"), F.count(F.lit(1)).alias("funds"))


STATE = "instrument_id int, since long, first_at long, first long, last_at long, last long, updates long"


def advance(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a batch of sound messages: first and last price of each instrument since the
    newest snapshot start, one row an instrument, and one without an instrument that keeps that
    start (``since``, -1 without one). Prices before it don't count, whenever they arrive."""
    starts = batch.where("type = 'snapshot_start'").agg(F.max("sequence").alias("since")).unionByName(state.agg(F.max("since").alias("since")))
    since = starts.agg(F.coalesce(F.max("since"), F.lit(-1)).alias("now"))
    p, at = F.col("price_ticks"), F.col("sequence")
    fresh = batch.where("type = 'price'").select("instrument_id", at.alias("first_at"), p.alias("first"), at.alias("last_at"), p.alias("last"), F.lit(1).cast("long").alias("updates"))
    both = state.where("instrument_id IS NOT NULL").unionByName(fresh, allowMissingColumns=True).join(F.broadcast(since), F.coalesce(F.col("since") == F.col("now"), F.col("first_at") > F.col("now")))
    merged = both.groupBy("instrument_id").agg(F.max("now").alias("since"), F.min("first_at").alias("first_at"), F.min_by("first", "first_at").alias("first"), F.max("last_at").alias("last_at"), F.max_by("last", "last_at").alias("last"), F.sum("updates").alias("updates"))
    return merged.unionByName(since.select(F.col("now").alias("since")), allowMissingColumns=True)


def start_impacts(messages: DataFrame, held: DataFrame, instruments: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, count: int):
    """A stream of messages to ``write(impacts, batch)``, the whole impact table every trigger.

    The state, one row an instrument, is a table beside the checkpoint, one version a batch: a
    batch that runs again reads the version before its own and writes the same. The join with
    ``instruments`` (instrument_id, security_node_id) and edges and the sum by fund run on each
    version. A late first price changes the reference, as in the batch form; a snapshot start
    forgets all prices before it.
    """
    sound, _ = split_valid(messages, count)
    spark = messages.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(STATE).parquet(f"{checkpoint}/state/{number - 1}") if number else spark.createDataFrame([], STATE)
        advance(before, batch).write.mode("overwrite").parquet(f"{checkpoint}/state/{number}")
        state = spark.read.schema(STATE).parquet(f"{checkpoint}/state/{number}").where("instrument_id IS NOT NULL")
        returns = state.withColumn("return", F.col("last") / F.col("first") - 1).join(instruments, "instrument_id")
        write(fund_impacts(returns, held), number)

    return sound.writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(step).trigger(availableNow=True).start()


#: Groups that the instruments of a strict stream are dealt to; a snapshot start is told to each group.
SLOTS = 256
NEW = (0, 0.0, -1, 0, 0, 0, -1, 0)


class ArrivalOrder(StatefulProcessor):
    """Strict arrival order of each instrument of a group: the first price since the last snapshot start
    is the reference; every later one gives the change of the return. A snapshot start (a row without an
    instrument, for all of the group) opens a new epoch; prices of a sequence before it don't count,
    whenever they arrive. Also counts missing, repeated and late sequences. An instrument's state goes
    after ``ttl`` milliseconds without a message."""

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("state", "instrument_id int", STRICT_STATE, self.ttl)
        self.opened = handle.getValueState("opened", "epoch long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        known = {k[0]: tuple(v) for k, v in self.state.iterator()}
        opened = before = self.opened.get()[0] if self.opened.exists() else -1
        told, out = set(), []
        for kind, instrument, sequence, ticks in zip(frame["type"], frame["instrument_id"], frame["sequence"], frame["price_ticks"], strict=True):
            sequence = int(sequence)
            if pd.isna(instrument):
                opened = max(opened, sequence)
                continue
            instrument = int(instrument)
            reference, last, high, gaps, duplicates, late, epoch, seen = known.get(instrument, NEW)
            start = max(opened, sequence) if kind == "snapshot_start" else opened
            if start > epoch:
                epoch, reference, last = start, 0, 0.0
            if kind != "snapshot_start":
                seen += 1
                if sequence == high:
                    duplicates += 1
                elif sequence < high:
                    late += 1
                else:
                    gaps, high = gaps + sequence - high - 1, sequence
                if sequence >= epoch:
                    if reference == 0:
                        reference = int(ticks)
                    else:
                        now = ticks / reference - 1
                        out.append((instrument, epoch, sequence, now - last))
                        last = now
            known[instrument] = (reference, last, high, gaps, duplicates, late, epoch, seen)
            told.add(instrument)
        if opened > before:
            self.opened.update((opened,))
            for instrument, (_, _, high, gaps, duplicates, late, epoch, seen) in list(known.items()):
                if opened > epoch:
                    known[instrument] = (0, 0.0, high, gaps, duplicates, late, opened, seen)
                told.add(instrument)
        for instrument in told:
            reference, last, high, gaps, duplicates, late, epoch, seen = known[instrument]
            self.state.updateValue((instrument,), (int(reference), float(last), int(high), int(gaps), int(duplicates), int(late), int(epoch), int(seen)))
        yield pd.DataFrame(out, columns=["instrument_id", "epoch", "sequence", "change"])

    def close(self) -> None:
        pass


STRICT_STATE = "reference long, last double, high long, gaps long, duplicates long, late long, epoch long, seen long"


def strict_messages(messages: DataFrame, count: int | None = None) -> DataFrame:
    """Prices and snapshot starts with the group (``slot``) of their instrument. With ``count`` instruments a
    start is a row for each group, so there are no more of them than SLOTS times the starts, however many
    instruments there are; without, starts that name no instrument are left out."""
    slots = min(count or SLOTS, SLOTS)
    mine = F.array(F.pmod(F.col("instrument_id"), F.lit(slots)))
    told = messages.where(F.col("type").isin("price", "snapshot_start"))
    if not count:
        return told.where("instrument_id IS NOT NULL").withColumn("slot", F.explode(mine))
    start = F.col("type") == "snapshot_start"
    told = told.where(start | F.col("instrument_id").isNotNull()).withColumn("slot", F.explode(F.when(start, F.sequence(F.lit(0), F.lit(slots - 1))).otherwise(mine)))
    return told.withColumn("instrument_id", F.when(~start, F.col("instrument_id")))


def strict_changes(messages: DataFrame, count: int | None = None, ttl: int | None = None) -> DataFrame:
    """Return changes in arrival order, one row a price after an instrument's first of its epoch
    (the sequence of the snapshot start, -1 before any); their sum by instrument and epoch is the closed
    form's return where prices arrive in order. With ``count`` instruments a snapshot start is
    told to all of them, by groups. The session's
    ``spark.sql.streaming.stateStore.providerClass`` has to be STATE_STORE."""
    told = strict_messages(messages, count)
    return told.groupBy("slot").transformWithStateInPandas(ArrivalOrder(ttl), "instrument_id int, epoch long, sequence long, change double", "append", "processingTime" if ttl else "none")


def strict_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sequence accounting of each instrument as the strict stream's state has it, read from its
    checkpoint by the state data source."""
    state = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    held = "user_map_value.value" if "ttlExpirationMs" in state.schema["user_map_value"].dataType.names else "user_map_value"  # with a time to live
    v = lambda c: F.col(f"{held}.{c}").alias(c)
    return state.select(F.col("user_map_key.instrument_id").alias("instrument_id"), v("seen"), v("gaps"), v("duplicates"), v("late"), v("epoch"))


def start_latencies(messages: DataFrame, write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
    """A stream of messages to ``write(quantiles, counters, batch)`` every trigger: of all messages so
    far, latency quantiles by stage, and messages by type.

    The state is what merges: histogram bins and counts, a table beside the checkpoint, one version
    a batch; a batch that runs again reads the version before its own and writes the same.
    """
    spark = messages.sparkSession
    kinds = {"bins": "stage string, bin long, n long, least long, most long", "types": "type string, messages long"}

    def step(batch: DataFrame, number: int) -> None:
        old = {k: spark.read.schema(v).parquet(f"{checkpoint}/{k}/{number - 1}") if number else spark.createDataFrame([], v) for k, v in kinds.items()}
        fresh = histogram(stage_latencies(batch).where("valid"), ["stage"]).select("stage", F.col("bin").cast("long").alias("bin"), "n", "least", "most")
        merged = {
            "bins": old["bins"].unionByName(fresh).groupBy("stage", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")),
            "types": old["types"].unionByName(feed_counters(batch)).groupBy("type").agg(F.sum("messages").alias("messages")),
        }
        now = {}
        for k, v in kinds.items():
            merged[k].write.mode("overwrite").parquet(f"{checkpoint}/{k}/{number}")
            now[k] = spark.read.schema(v).parquet(f"{checkpoint}/{k}/{number}")
        write(quantiles(now["bins"], ["stage"]), now["types"], number)

    return messages.writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(step).trigger(availableNow=True).start()


def sequence_accounting(messages: DataFrame, channel: str, order: list[str]) -> DataFrame:
    """Observations, missing values, repeats of the highest value so far and late ones of each
    channel, in arrival order; the first value expected is 0.

    The highest value so far is a running maximum over ranges of arrival, so no task holds a
    channel, or all of them, whole.
    """
    by = [channel, *order]
    rows = messages.select(*by, *(["sequence"] if "sequence" not in by else []))
    seen = running(rows, [channel], order, maxima={"before": F.col("sequence")}).withColumn("high", F.coalesce("before", F.lit(-1)))
    s, h = F.col("sequence"), F.col("high")
    return seen.groupBy(channel).agg(F.count(F.lit(1)).alias("observations"), F.sum(F.when(s > h, s - h - 1).otherwise(0)).alias("gaps"), F.count_if(s == h).alias("duplicates"), F.count_if(s < h).alias("out_of_order"))


def bin_of(value: Column) -> Column:
    """Histogram bin of a count of nanoseconds: itself below 1024, then 16 a power of two."""
    exponent = F.length(F.bin(value)) - 1
    base = F.call_function("shiftleft", F.lit(1).cast("long"), exponent)
    sub = F.call_function("shiftright", value - base, exponent - 4)
    return F.when(value < 1024, value).otherwise(1024 + (exponent - 10) * 16 + sub)


def bin_top(index: Column) -> Column:
    """The largest value of a bin."""
    exponent = F.floor((index - 1024) / 16).cast("int") + 10
    width = F.call_function("shiftleft", F.lit(1).cast("long"), exponent - 4)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), exponent)
    return F.when(index < 1024, index).otherwise(one + ((index - 1024) % 16) * width + width - 1)


def histogram(values: DataFrame, by: list[str], value: str = "ns") -> DataFrame:
    """Counts by bin, mergeable by adding: an append of two histograms sums to one of all."""
    return values.groupBy(*by, bin_of(F.col(value)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def quantiles(bins: DataFrame, by: list[str], percents: tuple[float, ...] = (50.0, 90.0, 95.0, 99.0, 99.9)) -> DataFrame:
    """Nearest-rank quantiles: the top of the bin that holds the rank, at most the largest value."""
    w = Window.partitionBy(*by)
    run = bins.withColumns({"total": F.sum("n").over(w), "top": F.max("most").over(w), "upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))})
    ranks = F.array(*[F.struct(F.lit(p).alias("percent"), F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p) / 100)).alias("rank")) for p in percents])
    hit = run.select(*by, "bin", "n", "upto", "total", "top", F.inline(ranks)).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    value = F.when(F.col("rank") >= F.col("total"), F.col("top")).otherwise(F.least(bin_top(F.col("bin")), F.col("top")))
    return hit.select(*by, "percent", value.cast("long").alias("ns"), F.col("total").alias("samples"))


def stage_latencies(messages: DataFrame) -> DataFrame:
    """(stage, ns, valid) of every message for the stamps it has; a falling stamp isn't valid."""
    stages = {k: v for k, v in STAGES.items() if v[0] in messages.columns and v[1] in messages.columns}
    return messages.select(F.inline(F.array(*[F.struct(F.lit(k).alias("stage"), (F.col(b) - F.col(a)).alias("ns"), (F.col(b) >= F.col(a)).alias("valid")) for k, (a, b) in stages.items()])))


def feed_counters(messages: DataFrame) -> DataFrame:
    return messages.groupBy("type").agg(F.count(F.lit(1)).alias("messages"))


