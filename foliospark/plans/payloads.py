"""The driver's tables rendered as filings, indexes, vendor payloads and files, and read back: queries
of the sources, each with SQL over the table that the payloads came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import exprs as X
from foliospark.operators import graph, models, normalize, quality, shock
from foliospark.operators import text as text_ops
from foliospark.plans import views as V
from foliospark.sources import commits, exchange, filings, market, store
from foliospark.streaming import exposure


#: Target of the risk models, and the feature of each family's ridge regression.
TARGET = "forward_realized_vol_20d"
FAMILIES = {"holdings": "realized_vol_60d", "market": "realized_vol_20d"}


def folder(spark) -> str:
    return f"{store.work_folder(spark)}/files-{uuid.uuid4().hex}"


def _element(tag: str, value) -> F.Column:
    return F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))


def xml_payloads(s, d) -> DataFrame:
    """One filing an order; ISINs in the element, in identifiers or in an attribute, by line."""
    n = F.col("l_linenumber")
    isin = F.concat(F.lit("US"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    places = F.when(n % 3 == 0, _element("isin", isin)).when(n % 3 == 1, F.concat(F.lit("<identifiers><isin value='"), isin, F.lit("'/></identifiers>"))).otherwise(F.lit("<identifiers><ticker> </ticker></identifiers>"))
    fields = [
        _element("name", F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))),
        _element("cusip", F.when(n == 7, "N/A").otherwise(F.lpad(F.col("l_partkey").cast("string"), 9, "0"))),
        _element("balance", F.format_number(F.col("l_quantity") * 1000, 1)),
        _element("valUSD", F.col("l_extendedprice").cast("decimal(20,2)").cast("string")),
        _element("pctVal", (F.col("l_discount") * 100).cast("decimal(10,2)").cast("string")),
    ]
    item = F.concat(F.lit("<n:invstOrSec>"), *fields, places, F.lit("</n:invstOrSec>"))
    body = F.concat(F.lit("<edgarSubmission xmlns:n='x'><invstOrSecs>"), F.array_join(F.collect_list(item), "\n"), F.lit("</invstOrSecs></edgarSubmission>"))
    return V.table(s, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("accession")).agg(body.alias("payload"))


def _xml_holdings(s, d):
    h = filings.holdings_from_xml(xml_payloads(s, d))
    return h.groupBy("accession").agg(F.count(F.lit(1)).alias("holdings"), F.count("cusip").alias("cusips"), F.count("isin").alias("isins"), F.max("isin").alias("last_isin"), F.round(F.sum("quantity"), 1).alias("quantity"), F.round(F.sum("market_value"), 2).alias("market_value"), F.round(F.sum("portfolio_weight"), 6).alias("weight"))


def archive(s, d) -> DataFrame:
    """The filings of xml_payloads with a report date, every eighth broken in one of seven ways."""
    n = F.col("accession").cast("long") % 8
    head = "<edgarSubmission xmlns:n='x'>"
    dated = F.replace("payload", F.lit(head), F.lit(f"{head}<submissionType>NPORT-P</submissionType><repPdDate>2024-03-31</repPdDate><!-- <invstOrSec> -->"))
    ways = [
        F.lit("  "),
        F.substring(dated, F.lit(1), F.length(dated) - 20),
        F.replace(F.replace(dated, F.lit("<edgarSubmission"), F.lit("<html")), F.lit("</edgarSubmission"), F.lit("</html")),
        F.replace(dated, F.lit("NPORT-P"), F.lit("NPORT-EX")),
        F.col("payload"),
        F.replace(dated, F.lit("2024-03-31"), F.lit("March 2024")),
        F.regexp_replace(dated, r"(?s)<invstOrSecs>.*</invstOrSecs>", ""),
    ]
    broken = F.when(F.col("accession").cast("long") % 64 >= 8, dated)
    for i, way in enumerate(ways):
        broken = broken.when(n == i, way)
    return xml_payloads(s, d).select("accession", broken.otherwise(dated).alias("payload"))


def _quarantine(s, d):
    """Reasons of the filings that are rejected, and the holdings of the others."""
    rows, bad = filings.read_filings(archive(s, d))
    sound = rows.groupBy(F.lit("sound").alias("reason")).agg(F.count_distinct("accession").alias("filings"), F.count(F.lit(1)).alias("holdings"))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("filings"), F.lit(0).cast("long").alias("holdings")).unionByName(sound)


def _scrubbed(s, d):
    """Orders as nested JSON with private members at several depths, and without them."""
    o = V.table(s, d, "orders")
    text = lambda c: F.col(c).cast("string")
    parts = ['{"order":', text("o_orderkey"), ',"contact":{"address":{"street":"', text("o_orderpriority"), '","nested":[{"deep":1}]}},"lines":[{"status":"', text("o_orderstatus"), '","password":"p"},{"deep":{"userAgent":"x","cents":', (F.col("o_totalprice") * 100).cast("decimal(20,0)").cast("string"), ',"note":"mail a@b.org"}}]}']
    made = o.select("o_orderkey", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("config"))
    return text_ops.scrub_json(made, "config")


def _keyed_table(s, d):
    """Orders appended, a quarter upserted, a tenth deleted, the files rewritten in between: the
    table at its first version and at the last."""
    o = V.table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    t = commits.KeyedTable(s, folder(s), ["o_orderkey"])
    first = t.write(o, "append")
    t.write(o.where("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("new")), read_version=first)
    t.rewrite()
    t.write(o.where("o_orderkey % 10 = 0"), "delete")
    count = lambda v, name: t.read(v).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders")).select(F.lit(name).alias("version"), "o_orderstatus", "orders")
    return count(first, "first").unionByName(count(None, "last"))


def submission_payloads(s, d) -> DataFrame:
    """One columnar JSON index a customer."""
    o = V.table(s, d, "orders")
    row = F.struct(F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("NPORT-P").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    column = lambda f: F.transform("rows", f)
    recent = F.struct(
        column(lambda r: r["form"]).alias("form"),
        column(lambda r: r["o_orderkey"].cast("string")).alias("accessionNumber"),
        column(lambda r: r["day"]).alias("filingDate"),
        column(lambda r: r["day"]).alias("reportDate"),
        column(lambda r: F.when(r["o_orderkey"] % 10 == 0, "../up.xml").otherwise("primary_doc.xml")).alias("primaryDocument"),
    )
    return rows.select(F.col("o_custkey").cast("string").alias("cik"), F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("body"))


def _primary(s, d):
    p = V.table(s, d, "part")
    k = F.col("p_partkey")
    names = F.array(F.concat(F.lit("r"), k.cast("string"), F.lit(".htm")), F.when(k % 3 == 0, "primary_doc.xml").otherwise("a.XML"), F.when(k % 3 == 1, "my_primary.xml").otherwise("xsl_primary.xml"))
    return filings.primary_document(p.select(k.cast("string").alias("accession"), F.when(k % 7 == 0, F.array(F.lit("only.htm"))).otherwise(names).alias("names")))


VENDOR_NAMES = ("twelvedata", "tiingo", "massive", "alphavantage", "yahoo")


def vendor_payloads(s, d) -> DataFrame:
    """Bars as JSON of five vendors, a year of an instrument a payload; some answers refused by
    their status code or, with a good one, in their body."""
    vendor = F.element_at(F.array(*map(F.lit, VENDOR_NAMES)), (F.year("trading_date") % 5 + 1).cast("int"))
    b = V.bars(s, d).withColumns({"provider": vendor, "year": F.year("trading_date")})
    prices = ("open", "high", "low", "close", "volume")
    text = lambda c: c.cast("string")

    def rendered(item) -> F.Column:
        """The bars of a payload, each as ``item`` of the bar, its day as text and its second."""
        return F.transform("rows", lambda r: item(r, F.date_format(r["trading_date"], "yyyy-MM-dd"), F.unix_timestamp(r["trading_date"].cast("timestamp")) + 18 * 3600))

    items = {
        "twelvedata": lambda r, day, _: F.struct(day.alias("datetime"), *[text(r[c]).alias(c) for c in prices]),
        "tiingo": lambda r, day, _: F.struct(day.alias("date"), *[text(r[c]).alias(c) for c in prices], *[(r[c] / 2).alias(f"adj{c.title()}") for c in prices[:4]]),
        "massive": lambda r, _, second: F.struct((second * 1000).alias("t"), *[r[c].alias(c[0]) for c in prices]),
        "alphavantage": lambda r, day, _: F.struct(day.alias("key"), F.struct(*[text(r[c]).alias(f"{n}. {c}") for n, c in enumerate(prices, 1)]).alias("value")),
    }
    listed = {v: rendered(item) for v, item in items.items()}
    g = b.groupBy("provider", "instrument_id", "year").agg(F.array_sort(F.collect_list(F.struct("trading_date", *prices))).alias("rows"))
    yahoo = {"timestamp": lambda r, _, second: second, **{c: lambda r, *_, c=c: r[c] for c in prices}, "adjclose": lambda r, *_: r["close"] / 4}
    column = lambda f: rendered(yahoo[f]).alias(f)
    meta = lambda name: F.struct(F.lit("EUR").alias("currency"), F.lit("XETR").alias(name)).alias("meta")
    chart = F.struct(meta("exchangeName"), column("timestamp"), F.struct(F.array(F.struct(*[column(c) for c in prices])).alias("quote"), F.array(F.struct(column("adjclose"))).alias("adjclose")).alias("indicators"))
    bodies = {
        "twelvedata": F.to_json(F.struct(meta("exchange"), listed["twelvedata"].alias("values"))),
        "tiingo": F.to_json(listed["tiingo"]),
        "massive": F.to_json(F.struct(listed["massive"].alias("results"))),
        "alphavantage": F.to_json(F.struct(F.map_from_entries(listed["alphavantage"]).alias("Time Series (Daily)"))),
        "yahoo": F.to_json(F.struct(F.struct(F.array(chart).alias("result")).alias("chart"))),
    }
    body = F.coalesce(*[F.when(F.col("provider") == v, x) for v, x in bodies.items()])
    refused = F.col("instrument_id").startswith("O")
    limit = F.when((F.col("year") == 1993) & refused, '{"Note": "call frequency"}').when((F.col("year") == 1995) & refused, '{"code": 429, "status": "error"}').when((F.col("year") == 1994) & refused, '{"chart": {"result": null, "error": {"code": "Not Found"}}}')
    code = F.when((F.col("year") == 1996) & refused, 429).when((F.col("year") == 1997) & refused, 503).otherwise(200)
    return g.select("provider", "instrument_id", code.alias("status_code"), F.coalesce(limit, body).alias("body"), F.lit("2024-01-05").cast("timestamp").alias("downloaded_at"), F.lit("USD").alias("currency"), F.lit("XNYS").alias("exchange"))


def _vendor_bars(s, d):
    bars, _ = market.bars_from_payloads(vendor_payloads(s, d))
    shown = bars.withColumn("continuity", X.continuity_price(F.col("adjusted_close"), F.col("close")))
    return shown.select("provider", "instrument_id", "trading_date", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close", "volume", "adjusted_open", "continuity")], "currency", "exchange")


def _catalogue(s, d):
    sup = V.table(s, d, "supplier")
    k = F.col("s_suppkey")
    m = sup.select(F.struct(F.when(k % 9 == 0, "N/A").otherwise(F.col("s_name")).alias("ticker"), F.col("s_nationkey").cast("string").alias("cik"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("seriesId"), F.lit("c1").alias("classId")).alias("m"), "s_nationkey")
    bodies = m.groupBy("s_nationkey").agg(F.to_json(F.collect_list("m")).alias("body"))
    return filings.catalogue_from_json(bodies).select("ticker", "cik", "series_id", "class_id")


def _fixture(s, d):
    o = V.table(s, d, "lineitem").where("l_partkey IS NOT NULL")
    holding = F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("cusip"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") == 1, "EUR").alias("currency"))
    snap = o.groupBy("l_suppkey").agg(F.collect_list(holding).alias("holdings"))
    snap = snap.select(F.lit("2024-03-31").alias("snapshot_date"), F.concat(F.lit("F"), F.col("l_suppkey").cast("string")).alias("fund_id"), F.lit("USD").alias("currency"), "holdings")
    path = folder(s)
    snap.select(F.to_json(F.struct(F.array(F.struct("*")).alias("snapshots"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = filings.snapshots_from_json(s, path)
    return rows.groupBy("fund_id", "snapshot_date", "currency").agg(F.count(F.lit(1)).alias("holdings"), F.round(F.sum("quantity"), 2).alias("quantity"))


def _snapshot_store(s, d):
    """All snapshots written, then one fund's alone with doubled weights: the others stay."""
    root, h = folder(s), V.holdings(s, d).select("fund_id", "snapshot_date", "security_id", "portfolio_weight")
    store.write_snapshots(h, root)
    store.write_snapshots(h.where(F.col("fund_id") == V.fund_id(s, d, 3)).withColumn("portfolio_weight", F.col("portfolio_weight") * 2), root)
    rows = s.read.parquet(root)
    return rows.groupBy("fund_id").agg(F.count(F.lit(1)).alias("holdings"), F.count_distinct("snapshot_date").alias("snapshots"), F.round(F.sum("portfolio_weight"), 6).alias("weight"))


def _point_read(s, d):
    root, h = folder(s), V.holdings(s, d)
    store.write_snapshots(h, root)
    fund = V.fund_id(s, d, 7)
    day = str(h.where(F.col("fund_id") == fund).agg(F.max("snapshot_date")).first()[0])
    return store.read_snapshot(s, root, fund, day).select("security_id", "snapshot_date", F.round("portfolio_weight", 8).alias("portfolio_weight"))


def _graph_files(s, d):
    """Edges and shocks exported as CSV and read by the strict reader."""
    root, e = folder(s), V.edges(s, d)
    keys = V.shocks(e).where("scenario_id = 'scenario-1'").groupBy("key").agg(F.max("shock").alias("shock"))
    exchange.export_graph(e, keys, root)
    back = exchange.read_edges(s, f"{root}/edges").join(exchange.read_shocks(s, f"{root}/shocks"), F.col("security_node_id") == F.col("key"), "left")
    return back.groupBy("etf_node_id").agg(F.count(F.lit(1)).alias("edges"), F.count("shock").alias("shocked"), F.round(F.sum("portfolio_weight"), 6).alias("weight"), F.min("security_ticker").alias("first_ticker"))


def _impact_file(s, d):
    path, e = folder(s), V.edges(s, d)
    exchange.write_impacts(shock.impacts(e, V.shocks(e), hits_only=True), path)
    back = exchange.read_impacts(s, path)
    return back.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("funds"), F.round(F.sum("direct_shock"), 6).alias("direct_shock"), F.round(F.sum("covered_weight"), 6).alias("covered_weight"))


def _scenario_file(s, d):
    path, keys = folder(s), V.shocks(V.edges(s, d)).where("scenario_id = 'scenario-2' AND ord < 5000")
    exchange.write_scenario(keys.select("key", F.round("shock", 6).alias("shock")), path)
    back = exchange.read_scenario_lines(s, path, "from-file")
    return back.select("scenario_id", F.col("ord").cast("long").alias("ord"), "key", F.round("shock", 6).alias("shock"))


def _safe_names(s, d):
    """Folder names of ids with unsafe characters, some of nothing else."""
    o = V.table(s, d, "orders")
    name = F.when(F.col("o_orderkey") % 11 == 0, "../").otherwise(F.concat(F.lit(".."), "o_orderpriority", F.lit("/"), "o_orderstatus", F.lit(" é"), F.col("o_custkey").cast("string")))
    return o.select("o_orderkey", store.fund_dirname(name).alias("folder"))


def _tuning_splits(s, d, risk):
    """Rows of each split that tuning may see."""
    rows = quality.firewall(quality.tuning_rows(risk))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("row_count"))


def _vectors(s, d):
    path = folder(s)
    exchange.write_vectors(V.table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("node_id"), F.col("embedding").alias("vector")), path)
    return exchange.read_vectors(s, path).select("node_id", F.size("vector").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def _published(s, d):
    """Nodes and edges as one published version behind a gate, its manifest beside what is read."""
    root, e = folder(s), V.edges(s, d)
    store.publish({"edges": e, "nodes": graph.nodes(e)}, root, {"weights": e.where("portfolio_weight = double('NaN')")})
    listed = store.manifest(s, root).select(F.explode("row_counts").alias("name", "in_manifest"))
    read = store.read_published(s, root, "edges").select(F.lit("edges").alias("name")).unionByName(store.read_published(s, root, "nodes").select(F.lit("nodes").alias("name")))
    return listed.join(read.groupBy("name").agg(F.count(F.lit(1)).alias("row_count")), "name")


def _providers(s, d) -> DataFrame:
    one = V.bars(s, d)
    two = V.second_provider(one)
    mode = lambda p: {"provider": F.lit(p), "adjustment_mode": F.lit("raw")}
    return one.withColumns(mode("one")).unionByName(two.withColumns(mode("two")).where("instrument_id LIKE 'O%'"))


def _ingested(s, d):
    """Filings through the rules of an ingest run: those stored are skipped, the others' payloads
    checked, the sound ones written as snapshots. Every fourth day's filings are stored before. A
    wrong CIK is the right one with a 1 in front, which no fund has, however many there are."""
    f = V.filings(s, d)
    day = F.dayofmonth("filed_at")
    stored = f.where(day % 4 == 0).select("accession", "parser_version", "fund_id")
    cik = F.regexp_extract("fund_id", r"([0-9]+)$", 1)
    payload = F.when(day % 7 == 0, "<html>gone</html>").otherwise(F.concat(F.lit("<xml>"), "accession"))
    fetched = f.select("accession", "fund_id", payload.alias("payload"), F.when(day % 5 == 0, F.concat(F.lit("1"), cik)).otherwise(cik).alias("cik"), cik.alias("expected_cik"), F.lit("S1").alias("series_id"), F.lit("s1").alias("expected_series_id"), F.when(day % 6 == 0, 0).otherwise(3).alias("holding_count"))
    return quality.ingest(f, stored, fetched)


def _whole_graph(s, d):
    """The whole graph published: edges, nodes, overlap, crowding, degree and manifest, and the rows
    that each table has in the log and on disk."""
    root, e = folder(s), V.edges(s, d)
    graph.publish(e, root)
    listed = store.manifest(s, root).select(F.explode("row_counts").alias("name", "in_manifest"))
    read = None
    for name in graph.TABLES:
        one = store.read_published(s, root, name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("name"), "row_count")
        read = one if read is None else read.unionByName(one)
    return listed.join(read, "name")


def _bar_gate(s, d):
    order = F.dayofmonth("trading_date") * 100_000 + F.datediff("trading_date", F.lit("1990-01-01").cast("date"))
    return quality.bar_gate(_providers(s, d).withColumn("ingest_order", order))


def _filing_payloads(s, d) -> DataFrame:
    o, k = V.table(s, d, "orders"), F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("accession"),
        F.concat(F.when(k % 10 == 0, " <!DOCTYPE html>").otherwise("<xml>"), k.cast("string")).alias("payload"),
        (F.col("o_custkey") % 50).cast("string").alias("cik"),
        (F.col("o_custkey") % 50 + (k % 6 == 0).cast("long")).cast("string").alias("expected_cik"),
        F.concat(F.lit("s"), (k % 3).cast("string")).alias("series_id"),
        F.concat(F.lit("S"), (k % 3 + (k % 8 == 0).cast("long")).cast("string")).alias("expected_series_id"),
        (k % 5).cast("int").alias("holding_count"),
    )


def _load_range(s, d):
    bars = V.bars(s, d)
    latest = bars.where("dayofmonth(trading_date) < 10 AND instrument_id <> 'P' AND trading_date < DATE '1998-06-01'").groupBy("instrument_id").agg(F.max("trading_date").alias("latest"))
    return quality.load_range(latest, bars, "1998-11-02 21:29:00").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("bars"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"))


def _ingest_summary(s, d):
    return quality.ingest_summary(_ingested(s, d))


def _filing_fields(s, d):
    li = V.table(s, d, "lineitem")
    parsed = li.select(F.concat(F.lit("F"), (F.col("l_suppkey") % 20).cast("string")).alias("fund_id"), F.col("l_shipdate").cast("date").cast("string").alias("snapshot_date"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("title"), F.col("l_partkey").cast("string").alias("cusip"), F.lit("T").alias("symbol"), F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("pct"))
    out = normalize.adapt_filing_fields(parsed)
    return out.groupBy("fund_id").agg(F.count("security_name").alias("names"), F.count("security_ticker").alias("tickers"), F.round(F.sum("quantity"), 2).alias("quantity"), F.round(F.sum("market_value") / 1000, 2).alias("thousands"), F.round(F.sum("portfolio_weight"), 8).alias("weight"))


def _filing_context(s, d):
    parsed = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_partkey").cast("string").alias("cusip"), F.col("l_quantity").alias("quantity"))
    context = V.table(s, d, "orders").select(F.col("o_orderkey").alias("accession"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("fund_id"), F.col("o_orderdate").cast("date").alias("snapshot_date"), F.lit("filing").alias("source"), F.lit(0.0).alias("quantity"))
    return normalize.from_filing_rows(parsed, context).groupBy("fund_id", "snapshot_date", "source").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("quantity"), 2).alias("quantity"))


def _manifest(s, d, risk, timeline):
    return quality.manifest(risk, timeline)


def _node_keys(s, d):
    """Keys of parts whose identifiers are partly placeholders."""
    k = F.col("p_partkey")
    word = lambda n, value: F.when(k % n == 0, "unknown").when(k % n == 1, " n/a ").when(k % n == 2, "NaN").when(k % n == 3, "").otherwise(value)
    p = V.table(s, d, "part").select("p_partkey", word(5, F.concat(F.lit("c"), k.cast("string"))).alias("cusip"), word(6, F.concat(F.lit("i"), k.cast("string"))).alias("isin"), word(7, F.col("p_brand")).alias("ticker"), F.concat(F.col("p_name"), F.lit("  "), k.cast("string")).alias("name"))
    return p.select("p_partkey", X.security_key(F.col("cusip"), F.col("isin"), F.col("ticker"), F.col("name"), X.without_placeholder).alias("node"))


def _sessions(s, d):
    """The session completed at each event's hour, and a price to go on with."""
    e = V.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("adjusted"), (F.col("value") + 1).alias("close"))
    return e.select("event_id", X.completed_session(F.col("t")).alias("session"), F.round(X.continuity_price(F.col("adjusted"), F.col("close")), 4).alias("price"))


def epoch_messages(s, d) -> DataFrame:
    """Price messages with a snapshot start in place of every 3,001st event."""
    t = V.ticks(s, d).where("copy = 0").withColumn("instrument_count", F.lit(V.instrument_count(s, d)))
    start = F.col("sequence") % 3001 == 3000
    return t.withColumn("type", F.when(start, "snapshot_start").otherwise(F.col("type"))).withColumn("instrument_id", F.when(~start, F.col("instrument_id")))


def _epoch_exposure(s, d):
    sound, _ = exposure.split_valid(epoch_messages(s, d), V.instrument_count(s, d))
    live = exposure.latest_epoch(sound).where("type = 'price'")
    impacts = exposure.fund_impacts(exposure.security_returns(live), V.edges(s, d))
    return impacts.select("etf_node_id", F.round("impact", 8).alias("impact"), "links", "updates")


def instruments(s, d) -> DataFrame:
    return V.ticks(s, d).select("instrument_id", "security_node_id").distinct()


def _stream_exposure(s, d):
    """The same by a stream: messages as files, three a trigger, the state a table beside the
    checkpoint; the impacts of the last trigger."""
    root, out = folder(s), folder(s)
    cols = [c.split()[0] for c in exposure.MESSAGE.split(", ")]
    m = epoch_messages(s, d).withColumn("quantity", F.lit(1))
    m.select(*cols).repartitionByRange(12, "arrival").write.parquet(root)
    held, listed = V.edges(s, d), store.stage(instruments(s, d), "instruments")  # not found anew every trigger
    exposure.start_impacts(exposure.message_stream(s, root, 3), held, listed, lambda df, n: df.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n:06}"), f"{root}-check", V.instrument_count(s, d)).awaitTermination()
    rows = s.read.option("recursiveFileLookup", True).schema("etf_node_id string, impact double, links long, updates long, n long").parquet(out)
    last = rows.agg(F.max("n").alias("last"))
    done = rows.join(F.broadcast(last), F.col("n") == F.col("last"))
    return done.select("etf_node_id", F.round("impact", 8).alias("impact"), "links", "updates")


def _message_files(s, d) -> str:
    """The messages of epoch_messages as files in arrival order."""
    root = folder(s)
    cols = [c.split()[0] for c in exposure.MESSAGE.split(", ")]
    epoch_messages(s, d).withColumn("quantity", F.lit(1)).select(*cols).repartitionByRange(12, "arrival").write.parquet(root)
    return root


def _strict_stream(s, d):
    """Strict changes and sequence counts by a stream: of each instrument, updates and return of the
    last epoch, and its accounting from the state."""
    root, count = _message_files(s, d), V.instrument_count(s, d)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(name, None)
    s.conf.set(name, exposure.STATE_STORE)
    try:
        sound, _ = exposure.split_valid(exposure.message_stream(s, root, 64), count)
        changes = exposure.strict_changes(sound, count)
        changes.writeStream.format("parquet").option("path", f"{root}-out").option("checkpointLocation", f"{root}-check").trigger(availableNow=True).start().awaitTermination()
        rows = s.read.schema("instrument_id int, epoch long, sequence long, change double").parquet(f"{root}-out")
        counts = store.stage(exposure.strict_counts(s, f"{root}-check"), "counts")
    finally:
        s.conf.unset(name) if before is None else s.conf.set(name, before)
    last = rows.join(F.broadcast(counts.select(F.col("instrument_id").alias("i"), F.col("epoch").alias("e"))), (F.col("instrument_id") == F.col("i")) & (F.col("epoch") == F.col("e")))
    sums = last.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("changes"))
    return counts.join(sums, "instrument_id", "left").select("instrument_id", "seen", "gaps", "duplicates", "late", F.coalesce("changes", F.lit(0)).alias("changes"))


def _stream_latencies(s, d):
    """Latency quantiles and counters by a stream, as they are after its last trigger."""
    root, out = folder(s), folder(s)
    cols = [c.split()[0] for c in exposure.MESSAGE.split(", ")]
    V.ticks(s, d).withColumns({"quantity": F.lit(1), "instrument_count": F.lit(1)}).select(*cols).repartitionByRange(12, "arrival").write.parquet(root)

    def write(found: DataFrame, types: DataFrame, number: int) -> None:
        total = types.agg(F.sum("messages").alias("messages"))
        found.join(F.broadcast(total)).withColumn("trigger", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number:06}")

    exposure.start_latencies(exposure.message_stream(s, root, 3), write, f"{root}-check").awaitTermination()
    rows = s.read.option("recursiveFileLookup", True).schema("stage string, percent double, ns long, samples long, messages long, trigger int").parquet(out)
    last = rows.agg(F.max("trigger").alias("last"))
    return rows.join(F.broadcast(last), F.col("trigger") == F.col("last")).drop("trigger", "last")


def _negatives(s, d):
    """Ten pairs a fund that no holding joins, drawn by the securities' degree."""
    return models.negative_pairs(V.edges(s, d), 10)


def _replay_summary(s, d):
    events = V.ticks(s, d).where("copy = 0").select("sequence", "security_node_id", ((F.col("sequence") % 201 - 100) * F.lit(0.0001)).alias("shock"))
    r = shock.replay_summary(shock.replay(V.edges(s, d), events))
    return r.select("events", F.round("checksum", 6).alias("checksum"), "dense")


def _checksum(s, d):
    sound, _ = exposure.split_valid(V.ticks(s, d).withColumn("instrument_count", F.lit(V.instrument_count(s, d))), V.instrument_count(s, d))
    c = exposure.checksum(exposure.fund_impacts(exposure.security_returns(sound), V.edges(s, d)))
    return c.select(F.round("checksum", 6).alias("checksum"), "funds")


def _alias_warnings(s, d):
    raw = V.raw_holdings(s, d, "none").withColumn("report_date", F.col("snapshot_date")).withColumn("holding_ticker", F.col("security_ticker")).withColumnRenamed("quantity", "balance")
    return normalize.normalize(raw).warnings.where("kind = 'ignored_alias'").select("kind", "column", "n")


def _upsert_columns(s, d):
    o = V.table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored = o.where("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.lit(0.0))
    fresh = o.where("o_orderkey % 4 < 2").withColumn("o_orderstatus", F.lit("new"))
    out = store.upsert_columns(stored, fresh, ["o_orderkey"], ["o_totalprice"])
    return out.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _new_keys(s, d):
    b = V.bars(s, d)
    return store.new_keys(b.where("dayofmonth(trading_date) <= 20"), V.second_provider(b).where("dayofmonth(trading_date) > 10"), ["instrument_id", "trading_date"])


def _newest_needed(s, d):
    f = V.filings(s, d)
    return quality.newest_needed(f, f.where("dayofmonth(filed_at) % 2 = 0"), 3).select("fund_id", "accession")


def _enabled(s, d):
    n = V.table(s, d, "nation")
    return quality.enabled_universe(n.select(F.lower("n_name").alias("ticker"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("category"), (F.col("n_nationkey") % 6 != 5).alias("enabled")))


def _node_counts(s, d):
    return graph.manifest(V.edges(s, d))


def _mean_scores(s, d, risk):
    out = models.mean_scores(risk, "forward_realized_vol_20d")
    return out.select("split", "n", *[F.round(c, 7).alias(c) for c in ("mae", "rmse", "r2")])


def _ridges(risk):
    """The rows whose features are known, and the ridge model of each family on the train rows: None
    where a split has too few rows."""
    known = store.stage(risk.where("realized_vol_20d IS NOT NULL AND realized_vol_60d IS NOT NULL").select("fund_id", "trading_date", "split", "return_1d", "holding_count", "realized_vol_20d", "realized_vol_60d", TARGET), "ridge")
    return known, {family: models.fit_gated(models.ridge([x], TARGET), known, TARGET) for family, x in FAMILIES.items()}


def _scored(s, d, risk):
    known, fitted = _ridges(risk)
    if None in fitted.values():
        return known.select("fund_id", "trading_date", F.lit("").alias("family"), F.lit(0.0).alias("yhat")).limit(0)
    return models.score_rows(fitted, known).withColumn("yhat", F.round("yhat", 7))


def _ridge_scores(s, d, risk):
    known, fitted = _ridges(risk)
    model = fitted["market"]
    rows = known.where("split IN ('validation', 'test')")
    rows = model.transform(rows) if model else rows.withColumn("yhat", F.lit(None).cast("double"))
    out = models.regression_scores(rows.select("split", F.col(TARGET).alias("y"), "yhat"), ["split"])
    return out.select("split", "n", *[F.round(c, 7).alias(c) for c in ("mae", "rmse", "r2")])


def _target_profile(s, d, risk):
    out = models.target_profile(risk, "forward_realized_vol_20d")
    return out.select("split", "row_count", "labelled", *[F.round(c, 7).alias(c) for c in ("mean", "least", "most")])


def queries(risk, timeline, resolved) -> dict:
    """The queries, given the risk dataset, the timeline and the resolved universe as functions of
    session and folder."""
    return {
        "xml_holdings": _xml_holdings,
        "filing_quarantine": _quarantine,
        "scrub_json": _scrubbed,
        "keyed_table": _keyed_table,
        "submission_index": lambda s, d: filings.filings_from_submissions(submission_payloads(s, d)),
        "primary_documents": _primary,
        "vendor_bars": _vendor_bars,
        "vendor_status": lambda s, d: market.bars_from_payloads(vendor_payloads(s, d))[1].groupBy("provider", "status").agg(F.count(F.lit(1)).alias("payloads"), F.sum("items").cast("long").alias("items")),
        "fund_catalogue": _catalogue,
        "fixture_snapshots": _fixture,
        "snapshot_store": _snapshot_store,
        "snapshot_read": _point_read,
        "graph_files": _graph_files,
        "impact_file": _impact_file,
        "scenario_file": _scenario_file,
        "safe_names": _safe_names,
        "tuning_splits": lambda s, d: _tuning_splits(s, d, risk(s, d)),
        "vector_table": _vectors,
        "published_graph": _published,
        "whole_graph": _whole_graph,
        "series_meta": lambda s, d: store.series_meta(_providers(s, d)),
        "authoritative_closes": lambda s, d: store.authoritative_closes(_providers(s, d), "two").select("instrument_id", "trading_date", F.round("close", 2).alias("close"), "provider", "adjustment_mode"),
        "bar_gate": _bar_gate,
        "provenance_gate": lambda s, d: quality.provenance_gate(_providers(s, d), "one").select("instrument_id", F.array_join("providers", ",").alias("providers")),
        "filing_validation": lambda s, d: quality.validate_payloads(_filing_payloads(s, d)).select("accession", "html", "cik_mismatch", "series_mismatch", "no_holdings", "clean", "content_hash"),
        "load_range": _load_range,
        "ingest_summary": _ingest_summary,
        "filing_fields": _filing_fields,
        "filing_context": _filing_context,
        "universe_manifest": lambda s, d: quality.universe_manifest(resolved(s, d)),
        "enabled_universe": _enabled,
        "dataset_manifest": lambda s, d: _manifest(s, d, risk(s, d), timeline(s, d)),
        "node_keys": _node_keys,
        "completed_sessions": _sessions,
        "epoch_exposure": _epoch_exposure,
        "stream_exposure": _stream_exposure,
        "strict_stream": _strict_stream,
        "stream_latencies": _stream_latencies,
        "negative_pairs": _negatives,
        "replay_summary": _replay_summary,
        "impact_checksum": _checksum,
        "alias_warnings": _alias_warnings,
        "upsert_columns": _upsert_columns,
        "new_keys": _new_keys,
        "newest_needed": _newest_needed,
        "graph_manifest": _node_counts,
        "mean_scores": lambda s, d: _mean_scores(s, d, risk(s, d)),
        "ridge_scores": lambda s, d: _ridge_scores(s, d, risk(s, d)),
        "scored_rows": lambda s, d: _scored(s, d, risk(s, d)),
        "target_profile": lambda s, d: _target_profile(s, d, risk(s, d)),
    }
