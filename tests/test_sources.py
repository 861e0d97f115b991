import datetime as dt
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from foliospark.sources import commits, exchange, filings, market, store

XML = """<edgar:edgarSubmission xmlns:edgar="x"><genInfo><regName>Trust</regName><cik>320193</cik><seriesId>S1</seriesId><repPdDate>2024-03-31</repPdDate></genInfo>
<invstOrSecs><nport:invstOrSec><name>Alpha &amp; Co</name><cusip>037833100</cusip><balance>1,000.5</balance><curCd>usd</curCd><valUSD>2000</valUSD><pctVal>12.5</pctVal></nport:invstOrSec>
<invstOrSec><name>Beta</name><cusip>N/A</cusip><balance> </balance><pctVal>-1</pctVal></invstOrSec></invstOrSecs></edgar:edgarSubmission>"""


def test_filing_xml(spark):
    rows = {r.security_name: r for r in filings.holdings_from_xml(spark.createDataFrame([("a1", XML)], "accession string, payload string")).collect()}
    a, b = rows["Alpha & Co"], rows["Beta"]
    assert (a.cusip, a.quantity, a.currency, a.market_value, a.portfolio_weight) == ("037833100", 1000.5, "USD", 2000.0, 0.125)
    assert (b.cusip, b.quantity, b.market_value, b.portfolio_weight) == (None, None, None, -0.01)
    f = filings.filing_facts(spark.createDataFrame([("a1", XML)], "accession string, payload string")).first()
    assert (f.cik, f.series_id, f.fund_name, f.report_date) == ("320193", "S1", "Trust", dt.date(2024, 3, 31))


def test_filing_identifiers(spark):
    """ISIN and ticker in the identifiers or in a value attribute; a nested position's don't count."""
    inner = "<derivativeInfo><identifiers><isin value='XX9999999999'/></identifiers></derivativeInfo>"
    bodies = [
        "<name>A</name><identifiers><isin value='us0378331005'/><ticker>aapl</ticker></identifiers>" + inner,
        f"<title>B title</title><isin>US1</isin>{inner}",
        "<name>N/A</name><cusip value='111111111'/><valUSD value='7.5'/>",
    ]
    xml = "<r>" + "".join(f"<n:invstOrSec>{b}</n:invstOrSec>" for b in bodies) + "</r>"
    parse = lambda x: filings.holdings_from_xml(spark.createDataFrame([("a", x)], "accession string, payload string"))
    got = {(r.security_name, r.cusip, r.isin, r.security_ticker, r.market_value) for r in parse(xml).collect()}
    assert got == {("A", None, "US0378331005", "AAPL", None), ("B title", None, "US1", None, None), (None, "111111111", None, None, 7.5)}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        parse("<invstOrSec><name>x</name><balance>many</balance></invstOrSec>").collect()
    with pytest.raises(Exception, match="no name, CUSIP"):
        parse("<invstOrSec><name>N/A</name><balance>1</balance></invstOrSec>").collect()


def submissions(**recent):
    return json.dumps({"filings": {"recent": recent}})


def test_submission_index(spark):
    body = submissions(form=["NPORT-P", "10-K", "NPORT-P"], accessionNumber=["1-1", "1-2", "1-3"], filingDate=["2024-05-01"] * 3, reportDate=["2024-03-31"] * 3, primaryDocument=["primary_doc.xml", "a.htm", "../x.xml"])
    df = spark.createDataFrame([("320193", body)], "cik string, body string")
    assert [(r.cik, r.accession) for r in filings.filings_from_submissions(df).collect()] == [("0000320193", "1-1")]
    uneven = submissions(form=["NPORT-P"], accessionNumber=[], filingDate=[], reportDate=[], primaryDocument=[])
    with pytest.raises(Exception, match="differ in length"):
        filings.filings_from_submissions(spark.createDataFrame([("1", uneven)], "cik string, body string")).collect()


def test_primary_document(spark):
    df = spark.createDataFrame([("a", ["x.xml", "primary_doc.xml"]), ("b", ["xslPrimary.xml", "my_primary.xml", "z.xml"]), ("c", ["r.htm", "z.xml", "y.xml"])], "accession string, names array<string>")
    assert {r.accession: r.primary_document for r in filings.primary_document(df).collect()} == {"a": "primary_doc.xml", "b": "my_primary.xml", "c": "z.xml"}


def test_catalogue_shapes(spark):
    bodies = [
        json.dumps({"fields": ["cik", "seriesId", "classId", "symbol"], "data": [["12", "s1", "c1", "aaa"], ["12", "s1", "c1", "AAA"], ["1", "s", "c", "N/A"]]}),
        json.dumps({"0": {"ticker": "bbb", "cik_str": "7", "title": "B"}}),
        json.dumps([{"ticker": "ccc", "cik": "9", "series": "s9", "class": "c9"}]),
    ]
    got = {(r.ticker, r.cik, r.series_id) for r in filings.catalogue_from_json(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()}
    assert got == {("AAA", "0000000012", "S1"), ("BBB", "0000000007", None), ("CCC", "0000000009", "S9")}


def test_vendor_payloads(spark):
    bar = lambda d, h=3: {"datetime": d, "open": "2", "high": str(h), "low": "1", "close": "2.5", "volume": "10"}
    rows = [
        ("twelvedata", "a", 200, json.dumps({"values": [bar("2024-01-02"), bar("2024-01-02", 9), bar("2024-01-01")]})),
        ("twelvedata", "b", 200, json.dumps({"values": [bar("2024-01-02", 0.5)]})),
        ("tiingo", "c", 200, json.dumps([{"date": "2024-01-02T00:00:00Z", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 5}])),
        ("massive", "d", 200, json.dumps({"results": [{"t": 1704153600000, "o": 1, "h": 2, "l": 1, "c": 2, "v": 5}]})),
        ("alphavantage", "e", 200, json.dumps({"Time Series (Daily)": {"2024-01-02": {"1. open": "1", "2. high": "2", "3. low": "1", "4. close": "2", "5. volume": "5"}}})),
        ("yahoo", "f", 200, json.dumps({"chart": {"result": [{"timestamp": [1704153600, 1704240000], "indicators": {"quote": [{"open": [1, None], "high": [2, 2], "low": [1, 1], "close": [2, 2], "volume": [5, 5]}]}}]}})),
        ("tiingo", "g", 429, "{}"),
    ]
    df = spark.createDataFrame([(*r, dt.datetime(2024, 1, 5)) for r in rows], "provider string, instrument_id string, status_code int, body string, downloaded_at timestamp")
    bars, status = market.bars_from_payloads(df)
    got = {(r.instrument_id, r.trading_date.day): r.high for r in bars.collect()}
    assert got == {("a", 2): 3.0, ("a", 1): 3.0, ("c", 2): 2.0, ("d", 1): 2.0, ("e", 2): 2.0, ("f", 2): 2.0}
    assert {r.instrument_id: r.status for r in status.collect()} == {"a": "ok", "b": "error", "c": "ok", "d": "ok", "e": "ok", "f": "ok", "g": "rate_limit"}


def test_snapshot_store(spark, tmp_path):
    root = f"{tmp_path}/h"
    mk = lambda rows: spark.createDataFrame(rows, "fund_id string, snapshot_date date, security_id string, portfolio_weight double")
    d1, d2 = dt.date(2024, 3, 31), dt.date(2024, 6, 30)
    store.write_snapshots(mk([("A", d1, "x", 0.1), ("B", d1, "x", 0.2), ("A", d2, "x", 0.3)]), root)
    store.write_snapshots(mk([("A", d1, "y", 0.9)]), root)  # fund A's date alone; fund B's stays
    assert [r.security_id for r in store.read_snapshot(spark, root, "A", "2024-03-31").collect()] == ["y"]
    assert store.read_snapshot(spark, root, "B", "2024-03-31").count() == store.read_snapshot(spark, root, "A", "2024-06-30").count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_snapshot(spark, root, "Z", "2024-03-31")
    assert store.query_holdings(spark.read.parquet(root), store.SUMMARY_SQL).count() == 3


def test_publish_keeps_the_version_before(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    store.publish({"t": a}, str(tmp_path), {"empty": a.where("id > 9")})
    with pytest.raises(ValueError, match="stays current"):
        store.publish({"t": b}, str(tmp_path), {"bad": b.where("id > 3")})
    assert store.read_published(spark, str(tmp_path), "t").count() == 3
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("version-")]) == 1  # nothing is left of the refused one
    store.publish({"t": b}, str(tmp_path))
    assert store.read_published(spark, str(tmp_path), "t").count() == 5
    assert {(r.number, r.row_counts["t"]) for r in store.manifest(spark, str(tmp_path)).collect()} == {(1, 3), (2, 5)}


def test_snapshots_of_many_funds_of_one_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKETS", 1)
    root, d = f"{tmp_path}/h", dt.date(2024, 3, 31)
    mk = lambda rows: spark.createDataFrame(rows, "fund_id string, snapshot_date date, security_id string, portfolio_weight double")
    store.write_snapshots(mk([(f"F{i}", d, "x", 0.1) for i in range(20)]), root)
    store.write_snapshots(mk([(f"F{i}", d, "y", 0.2) for i in range(5)]), root)
    got = {r.fund_id: r.security_id for r in spark.read.parquet(root).collect()}
    assert got == {f"F{i}": "y" if i < 5 else "x" for i in range(20)}


def test_upsert_of_selected_columns(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, seen int")
    new = spark.createDataFrame([(2, "c", 21), (3, "d", 30)], "id int, name string, seen int")
    got = {tuple(r) for r in store.upsert_columns(old, new, ["id"], ["seen"]).collect()}
    assert got == {(1, "a", 10), (2, "b", 21), (3, "d", 30)}
    assert [r.id for r in store.new_keys(old, new, ["id"]).collect()] == [3]


def test_fund_dirname(spark):
    names = ["cik:1|series:S 2", "../etc", "..", "A.B-c_9"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", store.fund_dirname(F.col("n")).alias("d"))
    got = {r.n: r.d for r in df.collect()}
    assert got == {"cik:1|series:S 2": "cik_1_series_S_2", "../etc": "etc", "..": None, "A.B-c_9": "A.B-c_9"} or all(d is None or ("/" not in d and ".." not in d and not d.startswith(".")) for d in got.values())


def test_exchange_files(spark, tmp_path):
    edges = spark.createDataFrame([("A", "s1", "T", 0.25), ("A", "s,2", None, None)], exchange.EDGES)
    shocks = spark.createDataFrame([("s1", -0.5)], exchange.SHOCKS)
    exchange.export_graph(edges, shocks, str(tmp_path / "g"))
    assert sorted(map(tuple, exchange.read_edges(spark, str(tmp_path / "g/edges")).collect())) == sorted(map(tuple, edges.collect()))
    assert [tuple(r) for r in exchange.read_shocks(spark, str(tmp_path / "g/shocks")).collect()] == [("s1", -0.5)]
    with pytest.raises(ValueError, match="control character"):
        exchange.export_graph(spark.createDataFrame([("A\n", "s", None, 0.1)], exchange.EDGES), shocks, str(tmp_path / "x"))
    (tmp_path / "s.json").write_text('{"s1": -0.2, "T": 0.1}')
    assert [(r.ord, r.key, r.shock) for r in exchange.read_scenario(spark, str(tmp_path / "s.json"), "one").orderBy("ord").collect()] == [(0, "s1", -0.2), (1, "T", 0.1)]
    (tmp_path / "bad.json").write_text('{"s1": true}')
    with pytest.raises(Exception, match="isn't a number"):
        exchange.read_scenario(spark, str(tmp_path / "bad.json"), "one").collect()


@pytest.mark.parametrize(
    ("payload", "reason"),
    [
        (None, "empty"),
        (" ", "empty"),
        ("<edgarSubmission><repPdDate>2024-03-31</repPdDate><invstOrSec><name>A</name></invstOrSec>", "not XML"),
        ("<html><invstOrSec/></html>", "root"),
        ("<edgarSubmission><submissionType>NPORT-EX</submissionType><repPdDate>2024-03-31</repPdDate><invstOrSec/></edgarSubmission>", "submission type"),
        ("<edgarSubmission><invstOrSec/></edgarSubmission>", "no report date"),
        ("<edgarSubmission><repPdDate>soon</repPdDate><invstOrSec/></edgarSubmission>", "report date"),
        ("<edgarSubmission><repPdDate>2024-03-31</repPdDate><!-- <invstOrSec/> --></edgarSubmission>", "no records"),
        ("<!DOCTYPE a [<!ENTITY b 'c'>]><edgarSubmission><repPdDate>2024-03-31</repPdDate><invstOrSec/></edgarSubmission>", "document type"),
        ("<n:edgarSubmission xmlns:n='x'><n:repPdDate> 2024-03-31T00:00</n:repPdDate><n:invstOrSec/></n:edgarSubmission>", None),
    ],
)
def test_faults_of_filings(payload, reason):
    assert filings.filing_fault(payload)[0] == reason


def test_quarantine(spark):
    sound = XML.replace("<genInfo>", "<genInfo><!-- <invstOrSec><name>no</name></invstOrSec> -->")
    rows = [("good", sound), ("cut", sound[:-30]), ("none", None)]
    held, bad = filings.read_filings(spark.createDataFrame(rows, "accession string, payload string"))
    assert {(r.accession, r.reason) for r in bad.collect()} == {("cut", "not XML"), ("none", "empty")}
    got = held.collect()
    assert {r.accession for r in got} == {"good"} and len(got) == filings.holdings_from_xml(spark.createDataFrame([("a", XML)], "accession string, payload string")).count()
    assert {str(r.report_date) for r in got} == {"2024-03-31"}


def test_two_publishers_get_two_numbers(spark, tmp_path):
    root = str(tmp_path / "t")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda n: store.publish({"t": spark.range(n)}, root), range(1, 13)))
    rows = store.manifest(spark, root).collect()
    assert sorted(r.number for r in rows) == list(range(1, 13)) and {r.row_counts["t"] for r in rows} == set(range(1, 13))
    assert store.read_published(spark, root, "t").count() == next(r.row_counts["t"] for r in rows if r.number == 12)


def test_a_taken_name_stays(spark, tmp_path):
    path = f"{tmp_path}/log/1.json"
    assert commits.create_if_absent(spark, path, "one") and not commits.create_if_absent(spark, path, "two")
    assert open(path).read() == "one" and os.listdir(tmp_path / "log") == ["1.json"]


def test_keyed_table_versions_and_conflicts(spark, tmp_path):
    t = commits.KeyedTable(spark, str(tmp_path), ["k"])
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    seen = lambda v=None: sorted((r.k, r.v) for r in t.read(v).collect())
    assert t.write(rows((1, "a"), (1, "aa"), (2, "b"), (3, "c")), "append") == 1
    assert t.write(rows((1, "A"))) == 2
    assert t.write(rows((2, None)), "delete") == 3
    assert t.write(rows((2, "again")), "append") == 4
    assert seen() == [(1, "A"), (2, "again"), (3, "c")]
    assert seen(1) == [(1, "a"), (1, "aa"), (2, "b"), (3, "c")] and seen(3) == [(1, "A"), (3, "c")]
    # two writers that read version 4: disjoint keys both pass, the same key fails for the second
    assert t.write(rows((3, "C")), read_version=4) == 5
    assert t.write(rows((7, "new")), read_version=4) == 6
    with pytest.raises(commits.Conflict):
        t.write(rows((3, "lost")), read_version=4)
    assert t.write(rows((3, "kept")), read_version=6) == 7
    before = seen()
    t.rewrite()
    assert seen() == before and seen(4) == [(1, "A"), (2, "again"), (3, "c")]
    t.write(rows((1, "z")))
    t.write(rows((3, None)), "delete")
    assert seen() == [(1, "z"), (2, "again"), (7, "new")]


def test_concurrent_writers_of_one_key(spark, tmp_path):
    t = commits.KeyedTable(spark, str(tmp_path), ["k"])
    first = t.write(spark.createDataFrame([(1, "start")], "k int, v string"), "append")

    def attempt(n):
        try:
            return t.write(spark.createDataFrame([(1, f"w{n}")], "k int, v string"), read_version=first)
        except commits.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(attempt, range(4)))
    assert sum(x is not None for x in got) == 1, "one wins, the others have to read again"
    assert [r.v for r in t.read().collect()] == [f"w{next(n for n, x in enumerate(got) if x)}"]


def test_vendor_bodies_that_refuse_or_adjust(spark):
    day, bar = "2024-01-02", {"open": "2", "high": "3", "low": "1", "close": "2.5", "volume": "10"}
    alpha = {"1. open": "1", "2. high": "2", "3. low": "1", "4. close": "2", "5. volume": "5"}
    chart = {"meta": {"currency": "EUR", "exchangeName": "GER"}, "timestamp": [1704153600], "indicators": {"quote": [{k: [float(v)] for k, v in bar.items()}], "adjclose": [{"adjclose": [1.25]}]}}
    rows = [
        ("alphavantage", "note", 200, {"Note": "5 calls a minute"}),
        ("alphavantage", "info", 200, {"Information": "daily limit"}),
        ("alphavantage", "wrong", 200, {"Error Message": "no such symbol"}),
        ("alphavantage", "denied", 403, {}),
        ("alphavantage", "fine", 200, {"Time Series (Daily)": {day: alpha}}),
        ("twelvedata", "code", 200, {"code": 429, "status": "error"}),
        ("twelvedata", "key", 200, {"code": "401"}),
        ("twelvedata", "bad", 200, {"status": "error"}),
        ("twelvedata", "meta", 200, {"meta": {"currency": "GBP", "exchange": "LSE"}, "values": [{"datetime": day, **bar}]}),
        ("massive", "none", 200, {"status": "OK"}),
        ("massive", "down", 500, {}),
        ("massive", "late", 200, {"results": [{"t": 1704254400000, "o": 1, "h": 2, "l": 1, "c": 2, "v": 5}]}),
        ("yahoo", "split", 200, {"chart": {"result": [chart]}}),
        ("yahoo", "gone", 200, {"chart": {"result": None, "error": {"code": "Not Found"}}}),
        ("yahoo", "shut", 401, {}),
        ("tiingo", "adj", 200, [{"date": day, **bar, "adjOpen": 1.0, "adjHigh": 1.5, "adjLow": 0.5, "adjClose": 1.25}]),
        ("tiingo", "text", 200, [{"date": day, **bar, "adjClose": "many"}]),
    ]
    df = spark.createDataFrame([(p, i, c, json.dumps(b), dt.datetime(2024, 1, 5), "USD", None) for p, i, c, b in rows], "provider string, instrument_id string, status_code int, body string, downloaded_at timestamp, currency string, exchange string")
    bars, status = market.bars_from_payloads(df)
    assert {r.instrument_id: r.status for r in status.collect()} == {
        "note": "rate_limit", "info": "rate_limit", "wrong": "error", "denied": "error", "fine": "ok", "code": "rate_limit", "key": "rejected", "bad": "error", "meta": "ok",
        "none": "ok", "down": "error", "late": "ok", "split": "ok", "gone": "error", "shut": "error", "adj": "ok", "text": "error",
    }
    got = {r.instrument_id: r for r in bars.collect()}
    assert got.keys() == {"fine", "meta", "late", "split", "adj"}
    assert (got["split"].adjusted_close, got["split"].currency, got["split"].exchange) == (1.25, "EUR", "GER")
    assert (got["adj"].adjusted_open, got["adj"].adjusted_close, got["adj"].currency) == (1.0, 1.25, "USD")
    assert (got["meta"].currency, got["meta"].exchange) == ("GBP", "LSE")
    assert str(got["late"].trading_date) == "2024-01-02", "23:00 in New York"


def test_scenario_lines(spark, tmp_path):
    shocks = spark.range(500).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("key"), (F.col("id") / 1000).alias("shock")).repartition(6)
    exchange.write_scenario(shocks, f"{tmp_path}/s")
    back = exchange.read_scenario_lines(spark, f"{tmp_path}/s", "x").orderBy("ord").collect()
    assert [(r.ord, r.key, r.shock) for r in back] == [(n, f"k{n:04}", n / 1000) for n in range(500)]
    for n, bad in enumerate(['{"a": "1"}', '{"a": true}', "no json", '{"a": 1}\n{"a": 2}']):
        (tmp_path / f"bad{n}").write_text(bad)
        with pytest.raises(Exception, match="isn.t a number|twice"):
            exchange.read_scenario_lines(spark, f"{tmp_path}/bad{n}", "x").collect()


def test_unsafe_fund_ids_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("../", dt.date(2024, 3, 31), "s", 0.1)], "fund_id string, snapshot_date date, security_id string, portfolio_weight double")
    with pytest.raises(ValueError, match="fund id"):
        store.write_snapshots(rows, f"{tmp_path}/h")


def test_a_wrong_cik_is_no_fund_s_own(spark, monkeypatch):
    from foliospark.plans import payloads

    rows = [(f"F{n:09}-{n}", f"F{n:09}", dt.date(2024, 3, 5), "1") for n in (7, 999, 1999)]
    f = spark.createDataFrame(rows, "accession string, fund_id string, filed_at date, parser_version string")
    monkeypatch.setattr(payloads.V, "filings", lambda s, d: f)
    got = [tuple(r) for r in payloads._ingest_summary(spark, "").collect()]
    assert got == [("failed", "cik_mismatch", 3)]


def test_payloads_are_parsed_once(spark):
    """Neither filters nor projections copy the parsing of a filing or of a vendor's body."""
    def parsings(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return len([1 for line in plan.splitlines() for _ in range(line.lower().count(name))])

    xml = spark.createDataFrame([("a", "<x/>")], "accession string, payload string").repartition(2)
    held = filings.holdings_from_xml(xml).groupBy("accession").agg(F.count("cusip").alias("n"), F.max("isin").alias("isin"))
    assert parsings(held, "xml") == 1
    bodies = spark.createDataFrame([("yahoo", "a", 200, "{}", dt.datetime(2024, 1, 5))], "provider string, instrument_id string, status_code int, body string, downloaded_at timestamp").repartition(2)
    bars, status = market.bars_from_payloads(bodies)
    for found in (bars, status):
        assert parsings(found, "from_json(") <= len(market.VENDORS)
