"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import NO_WORD, SPACE, broadcast_if_small, cut, let, long, table, unused, words

#: Rules: a share or density of each document and its cutoffs, from loose to strict. Step i of the
#: ladder holds every rule at its cutoff i (at its last one beyond); a document breaks a step if a
#: value of its is above the cutoff there, and then breaks all stricter ones too.
RULES = {
    "symbol_share": (0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "dup_line_share": (0.8, 0.7, 0.6, 0.5, 0.4),
    "repeat_share": (0.9, 0.7, 0.5, 0.3, 0.2),
    "shout_share": (2.0, 1.5, 1.0, 0.7, 0.5),
    "word_length": (12.0, 10.0, 9.0, 8.5, 8.0),
}
STEPS = max(map(len, RULES.values()))
WINDOW = 8


def _repeated(w: Column) -> Column:
    """Words inside a window of WINDOW words that occurs twice or more, first ones included."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    def covered(starts: Column) -> Column:
        begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.aggregate(starts, begin, step, lambda a: a["n"])

    def counted(v: Column) -> Column:
        pairs = F.array_sort(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        found = let(pairs, lambda s: F.transform(twice(s), lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(covered(F.array_sort(found)))

    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows, counted))


def features(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, lang, columns asked for, the base counts, the value of every rule, and step: the
    first step of the ladder that the row breaks (STEPS if none). Null text counts as empty.

    Everything is computed in one pass over the whole text, without a shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
        return let(
            lines,
            lambda rows: F.struct(
                long(F.size(w)).alias("n_words"),
                long(F.size(rows)).alias("n_lines"),
                long(F.size(rows) - F.size(F.array_distinct(rows))).alias("n_dup_lines"),
                long(_repeated(w)).alias("n_repeat_words"),
            ),
        )

    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    counted = docs.select(
        "doc_id",
        "lang",
        *more,
        let(words(F.col("text")), counts).alias("c"),
        long(F.length(F.regexp_replace(text, NO_WORD, ""))).alias("word_chars"),
        long(F.length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.length(F.regexp_replace(text, "[^!]+", ""))).alias("n_shouts"),
    )
    valued = counted.select("*", "c.*").drop("c").select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "word_chars").alias("symbol_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_shouts", "n_words").alias("shout_share"),
        per("word_chars", "n_words").alias("word_length"),
    )
    held = lambda rule, cutoffs: sum((F.col(rule) <= cutoffs[min(i, len(cutoffs) - 1)]).cast("int") for i in range(STEPS))
    return valued.withColumn("step", F.least(*[held(rule, cutoffs) for rule, cutoffs in RULES.items()]))


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0: Stirling's series at x + 8 and the recurrence back to x."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    steps = x
    for i in range(1, 8):
        steps = steps * (x + float(i))
    return series - F.log(steps)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from its largest term down; 1 where k is not below n p.

    Terms fall geometrically below the mean, so those beyond 12 standard deviations are left
    out: they are under 1e-30 of the sum.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    last = F.least(k, F.ceil(12 * F.sqrt(nd * p)) + 60).cast("int")
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a, i):
        j = kd - i + 1.0
        term = a["term"] * j / (nd - j + 1.0) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    ratio = F.when(last < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), one, step, lambda a: a["sum"]))
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(top) * ratio)


def fit_cutoffs(feats: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The strictest step of the ladder that every stratum's holdout allows: lang, limit.

    A stratum is a language, null one of its own. Holdout: documents of quality 1 (any label of 1
    counts; null labels and ids don't) that pass the base rule. With probability 1 - ``delta``
    over the holdout, no stratum loses more than ``risk`` of such documents to all rules together.
    A step passes if the exact binomial tail of the losses seen is at most the stratum's share of
    delta. Steps are tried from loose to strict up to the first that fails (fixed-sequence
    testing), so they need no correction among themselves; strata share delta (Bonferroni) in
    proportion to the square roots of their holdout sizes, which don't depend on the losses. A
    stratum in which no step passes isn't listed, and the rules reject nothing there.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("good_id")).agg(F.max("quality").alias("q")).where("q = 1")
    held = feats.where("NOT base_failed").join(good, F.col("doc_id") == F.col("good_id"), "left_semi")
    lost = [F.count(F.when(F.col("step") <= i, 1)).alias(f"lost_{i}") for i in range(STEPS)]
    strata = cut(held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *lost))
    whole = strata.agg(F.coalesce(F.sum(F.sqrt("n")), F.lit(1.0))).first()[0]
    tried = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"lost_{i}").alias("lost")) for i in range(STEPS)])
    level = delta * F.sqrt("n") / F.lit(whole)
    tails = strata.select("lang", "n", F.inline(tried)).withColumn("passed", binomial_tail(F.col("lost"), F.col("n"), risk) <= level)
    so_far = F.min("passed").over(Window.partitionBy("lang").orderBy("i"))
    return tails.withColumn("passed", so_far).where("passed").groupBy("lang").agg(F.max("i").alias("limit"))


def verdicts(feats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``feats`` with kept: false if base_failed or if the row breaks a step within its stratum's
    limit. Limits are joined by language: broadcast if a count shows that they are few."""
    limits = broadcast_if_small(cutoffs.select(F.col("lang").alias("stratum"), "limit"))
    joined = feats.join(limits, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    return joined.withColumn("kept", ~(F.col("base_failed") | F.coalesce(F.col("step") <= F.col("limit"), F.lit(False)))).drop("stratum", "limit")


def quality(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """Base counts, rule values, step and verdict of each row of ``docs`` (doc_id, text, lang).

    Null text counts as empty and fails the base rule; texts are read whole, however long; a
    null language is a stratum of its own; a language without enough good labels keeps all that
    pass the base rule, as do no labels at all; equal rows get equal verdicts; no documents give
    no rows. Other columns are ignored.
    """
    feats = cut(features(docs))
    return verdicts(feats, fit_cutoffs(feats, labels, **risk))


def row_key(docs: DataFrame) -> Column:
    """A key of a row's id, language and text."""
    return F.xxhash64(docs["doc_id"], docs["lang"], docs["text"])


def passed(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """The rows of ``docs`` that quality() keeps, with all columns whatever their names.

    Rejected rows are found by a key of id, language and text, so rows that share an id are
    judged apart and repeated rows alike. Null and empty texts go (they fail the base rule); no
    documents give no rows; no labels keep all that pass the base rule.
    """
    (key,) = unused(docs, "key")
    feats = cut(features(docs.select("doc_id", "lang", "text", row_key(docs).alias(key)), F.col(key)))
    bad = cut(verdicts(feats, fit_cutoffs(feats, labels, **risk)).where(~F.col("kept")).select(key).distinct())
    return docs.join(broadcast_if_small(bad, 500_000), row_key(docs) == bad[key], "left_anti")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _cutoff_rows() -> str:
    return ", ".join(f"('{rule}', {i}, {cutoffs[min(i, len(cutoffs) - 1)]}::DOUBLE)" for rule, cutoffs in RULES.items() for i in range(STEPS))


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {WINDOW} + 2)) AS u(i) WHERE len(w) > {WINDOW}),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, {WINDOW}) AS r(j) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ln) AS BIGINT) AS n_lines, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(text, '!')) AS n_shouts
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d) d LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
         coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(n_shouts / nullif(n_words, 0), 0) AS shout_share,
         coalesce(word_chars / nullif(n_words, 0), 0) AS word_length FROM f),
v AS (UNPIVOT (SELECT doc_id, lang, base_failed, {", ".join(f"{r}::DOUBLE AS {r}" for r in RULES)} FROM b) ON {", ".join(RULES)} INTO NAME rule VALUE value),
c AS (SELECT * FROM (VALUES {_cutoff_rows()}) AS x(rule, i, cutoff)),
x AS (SELECT DISTINCT doc_id, i FROM v JOIN c USING (rule) WHERE value > cutoff),
held AS (SELECT doc_id, lang FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
st AS (SELECT lang, count(*) AS n FROM held GROUP BY lang),
lv AS (SELECT lang, n, 0.05 * sqrt(n) / sum(sqrt(n)) OVER () AS level FROM st),
k AS (
  SELECT lv.lang, any_value(n) AS n, any_value(level) AS level, r.i, count(x.doc_id) AS k
  FROM lv CROSS JOIN range(0, {STEPS}) AS r(i) JOIN held ON held.lang IS NOT DISTINCT FROM lv.lang LEFT JOIN x ON x.doc_id = held.doc_id AND x.i = r.i
  GROUP BY lv.lang, r.i),
t AS (
  SELECT k.*, k < n * 0.02 AND (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02) + (n - j) * ln(0.98))) FROM range(0, k + 1) AS r(j)) <= level AS passed
  FROM k),
s AS (
  SELECT lang, i FROM (SELECT *, bool_and(passed) OVER (PARTITION BY lang ORDER BY i) AS so_far FROM t) WHERE so_far),
broken AS (SELECT DISTINCT x.doc_id FROM x JOIN b USING (doc_id) JOIN s ON s.lang IS NOT DISTINCT FROM b.lang AND s.i = x.i)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept
FROM b
"""
