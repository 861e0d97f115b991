"""Vendor payload tables to daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import exprs as X

#: Where each vendor's JSON keeps its bars and what it calls their fields, the
#: currency and the exchange.
VENDORS = {
    "twelvedata": {"bars": "values", "date": "datetime", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "currency": "$.meta.currency", "exchange": "$.meta.exchange"},
    "tiingo": {"bars": "[]", "date": "date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "adjusted_open": "adjOpen", "adjusted_high": "adjHigh", "adjusted_low": "adjLow", "adjusted_close": "adjClose"},
    "massive": {"bars": "results", "date": "t", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"},
    "alphavantage": {"bars": "Time Series (Daily)", "date": "key", "open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"},
    "yahoo": {"bars": "chart", "date": "timestamp", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "adjusted_close": "adjclose", "currency": "$.chart.result[0].meta.currency", "exchange": "$.chart.result[0].meta.exchangeName"},
}
PRICES = ("open", "high", "low", "close", "volume", "adjusted_open", "adjusted_high", "adjusted_low", "adjusted_close")
#: A bad bar fails its payload, except at these, where it is left out.
SKIP_BAD = ("yahoo",)
#: Members of a body that say why a call with a good status code gave no bars.
LIMITS = {"alphavantage": ("$.Note", "$.Information")}
FAILURES = {"alphavantage": ("$['Error Message']",), "yahoo": ("$.chart.error.code", "$.chart.error.description")}


def _items(vendor: str, body: Column) -> Column:
    """The bars of a payload as an array of string maps."""
    where = VENDORS[vendor]["bars"]
    if where == "[]":
        return F.from_json(body, "array<map<string,string>>")
    if vendor == "alphavantage":
        series = F.from_json(F.get_json_object(body, f"$['{where}']"), "map<string,map<string,string>>")
        return F.transform(F.map_entries(series), lambda e: F.map_concat(e["value"], F.create_map(F.lit("key"), e["key"])))
    if vendor == "yahoo":
        lists = ("open", "high", "low", "close", "volume")
        quote = ",".join(f"{n}:array<string>" for n in lists)
        r = F.from_json(body, f"struct<chart:struct<result:array<struct<timestamp:array<string>,indicators:struct<quote:array<struct<{quote}>>,adjclose:array<struct<adjclose:array<string>>>>>>>>")["chart"]["result"][0]

        def bars(r: Column) -> Column:
            q, adjusted = r["indicators"]["quote"][0], F.get(r["indicators"]["adjclose"], 0)["adjclose"]
            return F.transform(r["timestamp"], lambda t, i: F.create_map(F.lit("timestamp"), t, F.lit("adjclose"), F.get(adjusted, i), *[x for n in lists for x in (F.lit(n), F.get(q[n], i))]))

        return F.element_at(F.transform(F.array(r), bars), 1)  # the body is parsed once, not once a bar
    found = F.from_json(F.get_json_object(body, f"$.{where}"), "array<map<string,string>>")
    return F.when(F.get_json_object(body, "$.results").isNull(), F.array().cast("array<map<string,string>>")).otherwise(found) if vendor == "massive" else found


def _reader(vendor: str):
    """A function from an item's string map to the bar it stands for, with nulls for bad fields."""
    fields = VENDORS[vendor]
    get = lambda m, f: F.try_element_at(m, F.lit(fields[f])) if f in fields else F.lit(None).cast("string")

    def bar(m: Column) -> Column:
        text = get(m, "date")
        moment = lambda per: F.timestamp_seconds((text.try_cast("double") / per).cast("long"))
        day = {"massive": lambda: F.to_date(F.from_utc_timestamp(moment(1000), "America/New_York")), "yahoo": lambda: F.to_date(moment(1))}.get(vendor, lambda: F.substring(text, 1, 10).try_cast("date"))()
        told = F.lit(True)  # a number that is there can be read
        for f in PRICES:
            told = told & (get(m, f).isNull() | (get(m, f) == "") | get(m, f).try_cast("double").isNotNull())
        return F.struct(day.alias("trading_date"), *[get(m, f).try_cast("double").alias(f) for f in PRICES], told.alias("told"))

    return bar


def _good(b: Column) -> Column:
    prices = [b[f] for f in ("open", "high", "low", "close")]
    there = b["trading_date"].isNotNull() & b["told"]
    for p in prices:
        there = there & p.isNotNull()
    return F.coalesce(there & (b["high"] >= b["low"]) & (b["open"] >= 0) & (b["close"] >= 0), F.lit(False))


def _status(vendor: str, broken: Column) -> Column:
    """What became of a payload, by its status code and by what its body says."""
    body, code = F.col("body"), F.col("status_code")
    says = lambda paths: F.coalesce(*[F.get_json_object(body, p) for p in paths]).isNotNull() if paths else F.lit(False)
    inner = F.get_json_object(body, "$.code").try_cast("int") if vendor == "twelvedata" else F.lit(None).cast("int")
    word = F.upper(F.get_json_object(body, "$.status")) if vendor in ("twelvedata", "massive") else F.lit("")
    refused = F.lit(vendor not in ("alphavantage", "yahoo"))
    limited = (code == 429) | F.coalesce(inner == 429, F.lit(False)) | says(LIMITS.get(vendor))
    return (
        F.when(limited, "rate_limit")
        .when(refused & (code.isin(401, 403) | F.coalesce(inner.isin(401, 403), F.lit(False))), "rejected")
        .when(says(FAILURES.get(vendor)) | F.coalesce(word == "ERROR", F.lit(False)), "error")
        .when(code >= 500, "error" if vendor == "massive" else "server")
        .when((code != 200) | F.col("items").isNull() | broken, "error")
        .otherwise("ok")
    )


def bars_from_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, status) of payload rows (provider, instrument_id, status_code, body, downloaded_at, and
    currency and exchange of the instrument, where known).

    The first bar of a date wins. A bar needs a date and four prices, high not below low, open and
    close not negative, and numbers that can be read; one bad bar fails its payload unless the
    vendor is in SKIP_BAD. Bars carry adjusted prices where the vendor gives them, for
    ``continuity_price``, and the payload's currency and exchange, else the instrument's. Status is
    rate_limit, rejected, server, error or ok; a limit or failure may stand in a body whose status
    code is good.
    """
    for c in ("currency", "exchange"):
        payloads = payloads if c in payloads.columns else payloads.withColumn(c, F.lit(None).cast("string"))
    each = lambda of: F.coalesce(*[F.when(F.col("provider") == v, of(v)) for v in VENDORS])
    known = X.once(payloads.where(F.col("provider").isin(*VENDORS)), text=F.col("body")).drop("body").withColumnRenamed("text", "body")
    named = {c: F.coalesce(*[F.when(F.col("provider") == v, F.get_json_object("body", x[c])) for v, x in VENDORS.items() if c in x], c) for c in ("currency", "exchange")}
    read = X.once(known.withColumns(named), read=each(lambda v: _items(v, F.col("body"))))
    read = X.once(read, items=each(lambda v: F.transform("read", _reader(v)))).drop("read")
    broken = ~F.col("provider").isin(*SKIP_BAD) & F.exists("items", lambda b: ~_good(b))
    parts = X.once(read, status=each(lambda v: _status(v, broken)))
    flat = parts.where("status = 'ok'").select("provider", "instrument_id", "currency", "exchange", "downloaded_at", F.posexplode_outer(F.filter("items", _good)).alias("at", "b")).where("b IS NOT NULL")
    kept = F.struct(*[F.col(f"b.{f}") for f in PRICES], "currency", "exchange", "downloaded_at")
    bars = flat.groupBy("provider", "instrument_id", F.col("b.trading_date").alias("trading_date")).agg(F.min_by(kept, F.struct("downloaded_at", "at")).alias("x")).select("provider", "instrument_id", "trading_date", "x.*")
    return bars, parts.select("provider", "instrument_id", "status", F.coalesce(F.size("items"), F.lit(0)).alias("items"))
