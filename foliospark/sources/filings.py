"""Filing payload tables to rows: XML holdings, submission indexes, directory listings, fixtures."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import exprs as X
from foliospark.sources.store import stage

#: Fields of a holding; a field's value is its text or its attribute ``value``.
FIELDS = ("name", "title", "cusip", "isin", "ticker", "balance", "curCd", "valUSD", "pctVal", "assetCat", "invCountry")
_VALUE = "struct<body: string, _value: string>"
HOLDING = ", ".join([f"{f} {_VALUE}" for f in FIELDS] + [f"identifiers struct<isin: {_VALUE}, ticker: {_VALUE}>"])


def _text(field: str) -> Column:
    """A field's text, else its attribute ``value``; null if both are blank."""
    return F.coalesce(X.blank_to_null(F.col(f"h.{field}.body")), X.blank_to_null(F.col(f"h.{field}._value")))


def _number(field: str, divisor: float = 1.0) -> Column:
    """A number, its thousands' commas left out; other text stops the job."""
    return F.regexp_replace(_text(field), ",", "").cast("double") / divisor


#: Longest filing that is read, in characters, and the roots that one may have.
LONGEST, ROOTS = 50_000_000, ("edgarSubmission", "nport")


def filing_fault(payload: str | None) -> tuple[str | None, str | None, int]:
    """(reason to reject a filing, its report date, its investment records). The document is read
    once as a stream of events, without building it; entities and document types are refused."""
    if payload is None or not payload.strip():
        return "empty", None, 0
    if len(payload) > LONGEST:
        return "too long", None, 0
    seen: dict[str, list[str]] = {}
    state = {"root": None, "records": 0, "open": None, "doctype": False}
    parser = expat.ParserCreate()
    local = lambda tag: tag.rpartition(":")[2]

    def start(tag: str, _) -> None:
        name = local(tag)
        state["root"] = state["root"] or name
        state["records"] += name == "invstOrSec"
        state["open"] = name if name in ("submissionType", "repPdDate") and name not in seen else None
        if state["open"]:
            seen[name] = []

    def text(data: str) -> None:
        if state["open"]:
            seen[state["open"]].append(data)

    def end(tag: str) -> None:
        state["open"] = None

    def doctype(*_) -> None:
        state["doctype"] = True

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, text, doctype
    try:
        parser.Parse(payload.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError:
        return "not XML", None, state["records"]
    value = {k: "".join(v).strip() for k, v in seen.items()}
    day = value.get("repPdDate", "")[:10]
    if state["doctype"]:
        return "document type", None, state["records"]
    if state["root"] not in ROOTS:
        return "root", None, state["records"]
    if value.get("submissionType", "NPORT-P").upper() != "NPORT-P":
        return "submission type", None, state["records"]
    if not day:
        return "no report date", None, state["records"]
    try:
        date.fromisoformat(day)
    except ValueError:
        return "report date", None, state["records"]
    return (None if state["records"] else "no records"), day, state["records"]


def check_filings(payloads: DataFrame) -> DataFrame:
    """accession, reason (null if sound), report_date and records of each payload: whether it is
    well-formed XML with the root, submission type, report date and records of a holdings filing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [filing_fault(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]], ["accession", "reason", "report_date", "records"])

    checked = payloads.select("accession", "payload").mapInArrow(run, "accession string, reason string, report_date string, records long")
    return checked.withColumn("report_date", F.col("report_date").cast("date"))


def read_filings(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw holdings of the sound filings, quarantine: accession and reason of the others). The checks
    run once and are written to the shared folder; nothing is read of a filing that fails them."""
    checked = stage(check_filings(payloads), "checked")
    sound = checked.where("reason IS NULL").select("accession", "report_date")
    return holdings_from_xml(payloads.join(sound, "accession")).join(sound, "accession"), checked.where("reason IS NOT NULL").select("accession", "reason")


def holdings_from_xml(payloads: DataFrame) -> DataFrame:
    """Rows (accession, payload) to raw holdings: each invstOrSec element of the payload parsed on
    its own, prefixes of namespaces removed, placeholders null, percent as fractions. ISIN and
    ticker may stand in the element or in its ``identifiers``, not in a nested position. A holding
    without any name or identifier and a number that is none stop the job. The payloads are taken as
    sound: ``read_filings`` checks them first."""
    plain = F.regexp_replace(F.regexp_replace(F.col("payload"), r"(?s)<!--.*?-->", ""), r"(</?)[A-Za-z0-9_.-]+:", "$1")
    blocks = F.regexp_extract_all(plain, F.lit(r"(?s)<invstOrSec\b[^>]*>.*?</invstOrSec>"), F.lit(0))
    rows = payloads.select("accession", F.explode_outer(blocks).alias("x")).where("x IS NOT NULL")  # the outer form: no filter that cuts the text once more
    rows = X.once(rows, h=F.from_xml("x", HOLDING, {"valueTag": "body"}))
    real = lambda *fields: F.coalesce(*[X.without_placeholder(_text(f)) for f in fields])
    kept = lambda f: F.when(X.without_placeholder(_text(f)).isNotNull(), _text(f))
    out = rows.select(
        "accession",
        F.coalesce(kept("name"), kept("title")).alias("security_name"),
        real("cusip").alias("cusip"),
        real("isin", "identifiers.isin").alias("isin"),
        real("ticker", "identifiers.ticker").alias("security_ticker"),
        _number("balance").alias("quantity"),
        real("curCd").alias("currency"),
        _number("valUSD").alias("market_value"),
        _number("pctVal", 100.0).alias("portfolio_weight"),
        real("assetCat").alias("asset_type"),
        real("invCountry").alias("country"),
    )
    none = F.coalesce("security_name", "cusip", "isin", "security_ticker").isNull()
    return out.where(F.when(none, F.raise_error(F.lit("a holding has no name, CUSIP, ISIN or ticker")).cast("boolean")).otherwise(True))


def filing_facts(payloads: DataFrame) -> DataFrame:
    """CIK, series, class, name and report date of each payload, by their first element."""
    first = lambda tag: F.nullif(X.strip(F.regexp_extract("payload", rf"(?s)<(?:[A-Za-z0-9_.-]+:)?{tag}\b[^>]*>([^<]*)<", 1)), F.lit(""))
    return payloads.select("accession", *[first(t).alias(n) for t, n in (("cik", "cik"), ("seriesId", "series_id"), ("classId", "class_id"), ("regName", "fund_name"))], first("repPdDate").try_cast("date").alias("report_date"), X.content_hash(F.col("payload")).alias("content_hash"))


SUBMISSIONS = "struct<filings:struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>>>"


def filings_from_submissions(payloads: DataFrame, form: str = "NPORT-P") -> DataFrame:
    """Columnar JSON indexes (cik, body) to filing rows of one form, newest first within a CIK.
    Arrays of unequal length stop the job; names with a path are dropped."""
    r = F.from_json("body", SUBMISSIONS)["filings"]["recent"]
    parsed = payloads.select("cik", r.alias("r"))
    fields = ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument")
    even = F.lit(True)
    for f in fields[1:]:
        even = even & (F.size(F.col(f"r.{f}")) == F.size("r.form"))
    checked = parsed.where(F.when(even, True).otherwise(F.raise_error(F.lit("index arrays differ in length")).cast("boolean")))
    rows = checked.select("cik", F.inline(F.arrays_zip(*[F.col(f"r.{f}").alias(f) for f in fields])))
    safe = F.col("primaryDocument").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & F.col("accessionNumber").rlike(r"^[0-9-]+$")
    return rows.where((F.col("form") == form) & safe).select(X.padded_cik(F.col("cik")).alias("cik"), F.col("accessionNumber").alias("accession"), F.col("filingDate").try_cast("date").alias("filed_at"), F.col("reportDate").try_cast("date").alias("report_date"), F.col("primaryDocument").alias("primary_document"))


def primary_document(listings: DataFrame) -> DataFrame:
    """The XML file to read of each filing's listing (accession, names): primary_doc.xml, else one
    with primary in its name that is no style sheet, else the first XML."""
    names = listings.select("accession", F.posexplode("names").alias("at", "name")).where(F.lower("name").endswith(".xml"))
    low = F.lower("name")
    rank = F.when(low == "primary_doc.xml", 0).when(low.contains("primary") & ~low.contains("xsl"), 1).otherwise(2)
    return names.groupBy("accession").agg(F.min_by("name", F.struct(rank.alias("r"), "at")).alias("primary_document"))


SNAPSHOT_FIELDS = ("fund_id", "fund_name", "ticker", "cik", "series_id", "class_id", "source", "source_timestamp", "currency")
HOLDING_COLUMNS = ("security_name", "security_ticker", "cusip", "isin", "asset_type", "sector", "industry", "country")


def snapshots_from_json(spark: SparkSession, path: str) -> DataFrame:
    """{snapshots: [{..., holdings: [...]}]} to raw rows; a holding's own field comes first."""
    inner = ", ".join([f"{c}: string" for c in (*SNAPSHOT_FIELDS, *HOLDING_COLUMNS)] + [f"{m}: double" for m in ("quantity", "market_value", "portfolio_weight")])
    outer = ", ".join([f"{c}: string" for c in ("snapshot_date", "weight_unit", *SNAPSHOT_FIELDS)])
    rows = spark.read.schema(f"snapshots array<struct<{outer}, holdings: array<struct<{inner}>>>>").option("multiLine", True).json(path)
    flat = rows.select(F.explode("snapshots").alias("s")).select("s", F.explode("s.holdings").alias("h"))
    return flat.select(F.col("s.snapshot_date").alias("snapshot_date"), F.col("s.weight_unit").alias("weight_unit"), *[F.coalesce(f"h.{c}", f"s.{c}").alias(c) for c in SNAPSHOT_FIELDS], *[F.col(f"h.{c}").alias(c) for c in (*HOLDING_COLUMNS, "quantity", "market_value", "portfolio_weight")])


def catalogue_from_json(payloads: DataFrame) -> DataFrame:
    """Series and class catalogues (body) of {fields, data}, of {key: {...}} or of a list of
    objects, to distinct (ticker, cik, series_id, class_id, fund_name) without placeholders."""
    table = F.from_json("body", "struct<fields:array<string>,data:array<array<string>>>")
    keyed = F.from_json("body", "map<string,map<string,string>>")
    listed = F.from_json("body", "array<map<string,string>>")
    rows = F.when(F.col("t.data").isNotNull(), F.transform("t.data", lambda d: F.map_from_arrays(F.col("t.fields"), d))).when(F.ltrim("body").startswith("["), F.col("l")).otherwise(F.map_values("k"))
    one = payloads.select("body", table.alias("t"), F.when(~F.ltrim("body").startswith("[") & table["data"].isNull(), keyed).alias("k"), listed.alias("l")).select(F.explode(rows).alias("m"))
    pick = lambda *names: F.coalesce(*[F.try_element_at("m", F.lit(n)) for n in names])
    out = one.select(
        X.without_placeholder(pick("ticker", "symbol", "classTicker")).alias("ticker"),
        X.padded_cik(pick("cik", "cik_str", "cikNumber")).alias("cik"),
        X.without_placeholder(pick("series_id", "seriesId", "series")).alias("series_id"),
        X.without_placeholder(pick("class_id", "classId", "class")).alias("class_id"),
        X.blank_to_null(pick("fund_name", "seriesName", "name", "title")).alias("fund_name"),
    )
    return out.where("ticker IS NOT NULL").dropDuplicates(["ticker", "cik", "series_id", "class_id"])
