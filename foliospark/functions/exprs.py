"""Column expressions shared by the operators: cleaning, identifiers, labels, safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "not given".
PLACEHOLDERS = ("", "N/A", "NA", "NAN", "NONE", "NULL", "UNKNOWN", "-", "--", "000000000")
UNCLASSIFIED = "UNCLASSIFIED"


def strip(c: Column) -> Column:
    """Without white space at both ends: spaces, tabs, line and form feeds."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


def upper_clean(c: Column) -> Column:
    return F.upper(blank_to_null(c))


def without_placeholder(c: Column) -> Column:
    """Upper-cased text, null where it is a placeholder."""
    clean = upper_clean(c)
    return F.when(~clean.isin(*PLACEHOLDERS), clean)


def zfill(c: Column, width: int) -> Column:
    """Zeros in front up to ``width``; longer texts stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def padded_cik(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) > 0, zfill(digits, 10))


def fund_key(fund_id: Column, cik: Column, series_id: Column, clean=upper_clean) -> Column:
    """The explicit id, or one from CIK and series; never a ticker. Ids that are stripped already
    come with ``clean`` upper."""
    made = F.concat(F.lit("cik:"), padded_cik(cik), F.lit("|series:"), clean(series_id))
    return F.coalesce(blank_to_null(fund_id) if clean is upper_clean else fund_id, made)


def security_key(cusip: Column, isin: Column, ticker: Column, name: Column, clean=upper_clean) -> Column:
    """cusip:, isin:, ticker: or name:, the first that is given."""
    named = F.regexp_replace(clean(name), r"\s+", " ")
    kinds = (("cusip:", clean(cusip)), ("isin:", clean(isin)), ("ticker:", clean(ticker)), ("name:", named))
    return F.coalesce(*[F.concat(F.lit(kind), value) for kind, value in kinds])


def cusip_valid(c: Column) -> Column:
    """Whether nine characters end in the check digit of the first eight: values 0-9, A=10 to
    Z=35, * 36, @ 37, # 38; every second one doubled; digit sums; modulo 10."""
    text = upper_clean(c)
    letter = lambda i: F.substring(text, i, 1)

    def value(i: Column) -> Column:
        x = letter(i)
        base = F.when(x.rlike("[0-9]"), F.ascii(x) - 48).when(x.rlike("[A-Z]"), F.ascii(x) - 55).when(x == "*", 36).when(x == "@", 37).when(x == "#", 38)
        twice = F.when(i % 2 == 0, base * 2).otherwise(base)
        return F.floor(twice / 10) + twice % 10

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(8)), value), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    ok = text.rlike(r"^[0-9A-Z*@#]{8}[0-9]$")
    return F.when(text.isNull(), F.lit(None)).when(~ok, False).otherwise((10 - total % 10) % 10 == letter(F.lit(9)).try_cast("long"))


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or the result isn't finite."""
    return finite_or_null(F.try_divide(a, b))


def growth(a: Column, b: Column) -> Column:
    return ratio(a, b) - 1


def continuity_price(adjusted: Column, close: Column) -> Column:
    return F.coalesce(adjusted, close)


def completed_session(now: Column) -> Column:
    """Date of the last session closed by 16:30 in New York, for a UTC time."""
    local = F.from_utc_timestamp(now, "America/New_York")
    minutes = F.hour(local) * 60 + F.minute(local)
    return F.when(minutes < 990, F.date_sub(F.to_date(local), 1)).otherwise(F.to_date(local))


def split_label(day: Column, label_end: Column, warm: Column, train_end: str, validation_end: str) -> Column:
    """Chronological split of a row; labels that reach over a border are purged."""
    t, v = F.lit(train_end).cast("date"), F.lit(validation_end).cast("date")
    return (
        F.when(day.isNull() | warm.isNull(), "warmup")
        .when(label_end.isNull(), "no_target")
        .when((day <= t) & (label_end > t), "purged_train")
        .when(day <= t, "train")
        .when((day <= v) & (label_end > v), "purged_validation")
        .when(day <= v, "validation")
        .otherwise("test")
    )


def freshness(in_progress: Column, error_class: Column, has_data: Column, last_checked: Column, now: Column, stale_after_hours: int) -> Column:
    """State of local data; current means a good check inside the interval."""
    stale = last_checked.isNull() | (last_checked < now - F.expr(f"INTERVAL {stale_after_hours} HOURS"))
    return (
        F.when(F.coalesce(in_progress, F.lit(False)), "CHECKING")
        .when(error_class == "offline", "OFFLINE")
        .when(error_class.isNotNull() & (error_class != ""), "ERROR")
        .when(~F.coalesce(has_data, F.lit(False)), "NO_DATA")
        .when(stale, "STALE")
        .otherwise("CURRENT")
    )


def backoff_seconds(failures: Column) -> Column:
    """15 minutes, doubled with every failure after the first, six hours at most."""
    return F.least(F.lit(21600.0), 900 * F.pow(F.lit(2.0), F.greatest(failures, F.lit(1)) - 1)).cast("long")


def content_hash(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def once(df, **columns: Column):
    """``df`` with ``columns`` worked out once a row, however often later steps name them: a generator
    of one row keeps the planner from copying their expressions into filters and projections."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
