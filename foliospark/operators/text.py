"""Redaction of credentials, scrubbing of private fields, secret scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.exprs import once
from foliospark.sources.store import stage

MARK = "[REDACTED]"
#: Token formats that issuers document: name, literal prefixes, characters, least length.
ISSUED = (
    ("AWS key id", ("AKIA", "ASIA", "AIDA", "AROA"), "A-Z0-9", 16),
    ("GitHub token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "A-Za-z0-9", 36),
    ("GitHub fine-grained token", ("github_pat_",), "A-Za-z0-9_", 40),
    ("GitLab token", ("glpat-",), "A-Za-z0-9_-", 20),
    ("Google API key", ("AIza",), "A-Za-z0-9_-", 35),
    ("Hugging Face token", ("hf_",), "A-Za-z0-9", 30),
    ("npm token", ("npm_",), "A-Za-z0-9", 36),
    ("PyPI token", ("pypi-",), "A-Za-z0-9_-", 50),
    ("Slack token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), "A-Za-z0-9-", 20),
    ("Stripe key", ("sk_live_", "rk_live_"), "A-Za-z0-9", 24),
    ("secret key with sk- prefix", ("sk-",), "A-Za-z0-9_-", 20),
)
#: Nouns that end the name of a credential, and authorization schemes.
NOUNS = ("password", "passwd", "passphrase", "secret", "token", "credential", "authorization", "api_key", "access_key", "secret_key", "private_key")
SCHEMES = ("Basic", "Bearer", "Digest", "Token")
#: Words that make a field private, whatever else its name holds.
PRIVATE = (*NOUNS, "cookie", "email", "mail", "contact", "phone", "user_agent")
#: Top-level and second-level domains reserved for examples.
RESERVED = ("example", "invalid", "localhost", "test", "example.com", "example.net", "example.org")


def _any(words: tuple[str, ...]) -> str:
    """One of some words, whose parts may be joined by _, -, or nothing."""
    return "(?:" + "|".join(w.replace("_", "[_-]?") for w in words) + ")"


_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = rf"[A-Za-z0-9](?:[A-Za-z0-9._+%-]*[A-Za-z0-9_+-])?@(?:{_LABEL}\.)+[A-Za-z]{{2,}}"
#: A name, its closing quote, and the sign that assigns; then a value in quotes of one kind, or bare.
_ASSIGNED = rf"(?i)\b((?:[A-Za-z0-9]+[_.-])*{_any(NOUNS)}[\"']?\s{{0,4}}[:=]\s{{0,4}})"
_SCHEME = rf"((?:{'|'.join(SCHEMES)})\s+)?"
QUOTED = rf"{_ASSIGNED}([\"']){_SCHEME}(?:\\.|(?!\2)[^\\])+\2"
UNQUOTED = rf"{_ASSIGNED}(?!(?:{'|'.join(SCHEMES)})?\s*\[REDACTED){_SCHEME}[^\s\"',;&)}}\]]+"
#: RFC 6750: a bearer token is a run of these, = at its end.
BEARER = r"(?i)\b(Bearer\s+)[A-Za-z0-9._~+/-]+=*"


def issued_pattern(prefixes: tuple[str, ...], chars: str, least: int) -> str:
    return rf"\b(?:{'|'.join(prefixes)})[{chars}]{{{least},}}"


#: What the scan looks for on each line. All patterns also hold for engines without look-around.
RULES = (
    ("private key block", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    *((name, issued_pattern(*form)) for name, *form in ISSUED),
    ("assigned credential", rf"(?i)\b(?:[a-z0-9]+[_.-])*{_any(NOUNS)}[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_+/.-]{{20,}}"),
    ("home folder of a person", r"(?:/home/|/Users/|(?i:[a-z]:[\\/]Users[\\/]))[A-Za-z0-9][A-Za-z0-9._-]*[\\/]"),
)
RESERVED_MAIL = rf"[@.](?:{'|'.join(d.replace('.', '[.]') for d in RESERVED)})$"
#: Texts from this length on are named as large, besides being scanned.
LARGE = 2_000_000


def redact(text: Column) -> Column:
    """Values assigned to credentials, bearer tokens and issued tokens become [REDACTED]; names,
    quotes and schemes stay. Doing it again changes nothing."""
    out = F.regexp_replace(text, QUOTED, f"$1$2$3{MARK}$2")
    out = F.regexp_replace(out, UNQUOTED, f"$1$2{MARK}")
    out = F.regexp_replace(out, BEARER, f"$1{MARK}")
    return F.regexp_replace(out, "|".join(issued_pattern(*form) for _, *form in ISSUED), MARK)


def scrub(text: Column) -> Column:
    return F.regexp_replace(redact(text), EMAIL, "[REDACTED_EMAIL]")


def is_private(name: Column) -> Column:
    """Whether a field's name has a private word in it, in snake, kebab or camel case."""
    snake = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    return snake.rlike(rf"(?:^|[^a-z0-9]){_any(PRIVATE)}s?(?:$|[^a-z0-9])") | (snake == "key") | name.rlike(EMAIL)


def scrub_config(config: Column) -> Column:
    """A flat string map without private fields, its values scrubbed as texts. Values that are
    JSON go through ``scrub_json`` (by ``scrub_configs``), which reads them."""
    return F.transform_values(F.map_filter(config, lambda k, v: ~is_private(k)), lambda k, v: scrub(v))


#: Nesting of JSON that is scrubbed within a row, without the walk, and levels of the walk that one plan puts together.
SHALLOW, JOINED = 8, 16


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def _let(value: Column, then) -> Column:
    """``then`` of a value that it may name often, though the expression holds it once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _within(value: Column, depth: int) -> Column:
    """A variant as JSON without private members, its strings scrubbed: null if it nests over ``depth``
    levels. Members and items are made the same entries first, so a level holds the next one once."""
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    leaf = F.coalesce(F.when(F.schema_of_variant(value) == "STRING", _quoted(scrub(F.try_variant_get(value, "$", "string")))).otherwise(F.to_json(value)), F.lit("null"))
    if not depth:
        return F.when(fields.isNull() & items.isNull(), leaf)

    def member(m: Column) -> Column:
        name = F.when(m["key"].isNull(), "").otherwise(F.concat(_quoted(m["key"]), F.lit(":")))
        return F.concat(name, _within(m["value"], depth - 1))

    def shown(parts: Column) -> Column:
        kept = F.filter(F.coalesce(parts["fields"], parts["items"]), lambda m: m["key"].isNull() | ~is_private(m["key"]))
        inside = _let(F.transform(kept, member), lambda w: F.when(~F.exists(w, lambda m: m.isNull()), F.array_join(w, ",")))
        ends = F.when(parts["fields"].isNotNull(), F.array(F.lit("{"), F.lit("}"))).otherwise(F.array(F.lit("["), F.lit("]")))
        whole = F.concat(ends[0], inside, ends[1])
        return F.when(parts["fields"].isNotNull() | parts["items"].isNotNull(), whole).otherwise(leaf)

    return _let(F.struct(fields.alias("fields"), items.alias("items")), shown)


def scrub_json(texts: DataFrame, column: str) -> DataFrame:
    """``texts`` with the JSON of ``column`` without private members at any depth, and its strings
    scrubbed; a text that isn't JSON, or nests over the 1,000 levels that Spark's parser takes, is scrubbed as
    text, null stays.

    JSON of up to SHALLOW levels is done within its row, with no shuffle but the one that deals texts to
    all tasks; what nests deeper is walked (``_walked``).
    """
    done = stage(_scrubbed_rows(texts, column), "scrubbed")
    shallow = done.where(F.col(column).isNull() | F.col("__whole").isNotNull()).select(*[F.col("__whole").alias(c) if c == column else F.col(c) for c in texts.columns])
    deep = done.where(F.col(column).isNotNull() & F.col("__whole").isNull()).select(*texts.columns)
    return shallow if deep.isEmpty() else shallow.unionByName(_walked(deep, column))


def _scrubbed_rows(texts: DataFrame, column: str) -> DataFrame:
    """``texts`` with ``__whole``: the scrubbed text of ``column``, null where it is null or nests too deep."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but many steps a row
    parsed = once(texts.repartition(tasks), __value=F.try_parse_json(column))
    whole = F.when(F.col("__value").isNull(), scrub(F.col(column))).otherwise(_within(F.col("__value"), SHALLOW))
    return parsed.withColumn("__whole", whole).drop("__value")


def _walked(texts: DataFrame, column: str) -> DataFrame:
    """What ``scrub_json`` gives, of JSON of any nesting.

    A walk over the distinct texts as variants: a level of the tree becomes rows (text, place of
    the parent, place, name, value), private names are filtered there, and the next level comes from
    ``variant_explode`` of the objects and arrays that are left. Then the texts are put together
    again from the deepest level up, and written after some levels, which keeps plans small. A level is
    one step for all texts, down to the deepest value of any; a task's group is the members of one object or array. Members come in order of their names, as a variant keeps them.
    """
    spark = texts.sparkSession
    key = F.sha2(F.col(column), 256)
    root = texts.where(F.col(column).isNotNull()).select(key.alias("doc"), F.col(column).alias("raw"), F.try_parse_json(column).alias("value")).dropDuplicates(["doc"])
    root = root.where(F.col("value").isNotNull()).select("doc", F.lit("").alias("at"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("pos"), F.lit("").alias("parent"), F.schema_of_variant("value").alias("kind"), "value")
    levels, now = [], stage(_told(root), "level")
    while not now.isEmpty():
        levels.append(now)
        inner = now.where("holds").select("doc", F.col("at").alias("parent"), "value")
        members = inner.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "name", "member")).select("doc", "parent", "pos", "name", F.col("member").alias("value"))
        kept = members.where(F.col("name").isNull() | ~is_private(F.col("name")))
        place = F.concat_ws(".", "parent", F.col("pos").cast("string"))
        now = stage(_told(kept.select("doc", place.alias("at"), "name", "pos", "parent", F.schema_of_variant("value").alias("kind"), "value")), "level")
    done = None
    for k, level in enumerate(reversed(levels)):
        leaf = F.when(F.col("scalar") == "string", _quoted(scrub(F.col("text")))).otherwise(F.col("json"))
        rows = level.select("doc", "at", "name", "pos", "parent", "holds", "object", leaf.alias("leaf"))
        if done is not None:
            rows = rows.join(done, ["doc", "at"], "left")
        inside = F.coalesce("inside", F.lit("")) if done is not None else F.lit("")
        whole = F.when(~F.col("holds"), F.col("leaf")).when(F.col("object"), F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.concat(F.lit("["), inside, F.lit("]")))
        rows = rows.select("doc", "at", "parent", "pos", F.when(F.col("name").isNotNull(), F.concat(_quoted(F.col("name")), F.lit(":"), whole)).otherwise(whole).alias("whole"))
        members = F.array_sort(F.collect_list(F.struct("pos", "whole")))
        done = rows.where("at <> ''").groupBy("doc", F.col("parent").alias("at")).agg(F.array_join(F.transform(members, lambda m: m["whole"]), ",").alias("inside")) if level is not levels[0] else rows.select("doc", "whole")
        if k % JOINED == JOINED - 1:
            done = stage(done, "inside")
    if done is None:
        return texts.withColumn(column, scrub(F.col(column)))
    named = done.select(F.col("doc").alias("__doc"), F.col("whole").alias("__whole"))
    return texts.join(named, key == F.col("__doc"), "left").select(*[F.coalesce("__whole", scrub(F.col(c))).alias(c) if c == column else F.col(c) for c in texts.columns])


def _told(rows: DataFrame) -> DataFrame:
    """Of each value whether it holds members, whether it is an object, and a scalar's kind and text."""
    object_, array = F.col("kind").startswith("OBJECT"), F.col("kind").startswith("ARRAY")
    scalar = F.when(F.col("kind") == "STRING", "string").otherwise("other")
    return rows.withColumns({"object": object_, "holds": object_ | array, "scalar": scalar, "text": F.when(scalar == "string", F.try_variant_get("value", "$", "string")), "json": F.when(~(object_ | array), F.to_json("value"))}).drop("kind")


def scrub_configs(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the string map of ``column`` without private fields; values that are JSON
    objects or arrays lose theirs at any depth, other values are scrubbed as texts."""
    texts = rows.select(F.explode(F.map_values(F.map_filter(column, lambda k, v: ~is_private(k)))).alias("value")).where("value IS NOT NULL").distinct()
    holds = F.col("value").rlike(r"^\s*[{\[]")
    clean = scrub_json(texts.where(holds).withColumn("clean", F.col("value")), "clean")
    known = rows.select(F.monotonically_increasing_id().alias("__row"), "*")
    known = stage(known, "configs")
    parts = known.select("__row", F.explode(F.map_filter(column, lambda k, v: ~is_private(k))).alias("name", "value")).join(clean, "value", "left")
    whole = parts.select("__row", F.struct("name", F.coalesce("clean", scrub(F.col("value")))).alias("m")).groupBy("__row").agg(F.map_from_entries(F.collect_list("m")).alias("__map"))
    none = F.when(F.col(column).isNotNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return known.join(whole, "__row", "left").select(*[F.coalesce("__map", none).alias(c) if c == column else F.col(c) for c in rows.columns])


def secret_scan(texts: DataFrame, id_column: str, text_column: str, large: int = LARGE) -> DataFrame:
    """(id, line, reason) of what the rules find on each line, never the value.

    Every line of every text is scanned, whatever its size; a text of ``large`` characters or more,
    or with a zero byte, has one more finding on line 0. Emails at reserved domains pass. Null
    texts have no findings.
    """
    t = F.col(text_column)
    rows = texts.where(t.isNotNull()).select(F.col(id_column).alias("id"), t.alias("text"))
    lines = rows.select("id", F.posexplode(F.split("text", r"\R")).alias("at", "text"))
    hits = [F.when(F.col("text").rlike(p), F.lit(reason)) for reason, p in RULES]
    mails = F.regexp_extract_all("text", F.lit(f"({EMAIL})"), F.lit(1))
    hits.append(F.when(F.exists(mails, lambda m: ~F.lower(m).rlike(RESERVED_MAIL)), F.lit("email address")))
    found = lines.select("id", (F.col("at") + 1).alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("reason"))
    whole = F.array_compact(F.array(F.when(F.length("text") >= large, F.lit("large text")), F.when(F.instr("text", "\0") > 0, F.lit("zero byte"))))
    return found.unionByName(rows.select("id", F.lit(0).alias("line"), F.explode(whole).alias("reason")))
