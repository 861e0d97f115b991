"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import cut, sliced, table

#: n-grams in a profile, languages whose profiles a task holds at once (others follow in further
#: passes), and n-grams counted at once.
TOP = 300
AT_ONCE = 1024
CHUNK = 1 << 21
_NONE = (1 << 21) - 1
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of the lower-cased letters; other runs are one border."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[a]
    if not is_letter.any():
        return np.empty(0, np.int64)
    a = np.where(is_letter, a, 0).astype(np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    a = np.concatenate(([0], a[keep], [0]))
    one = a[a > 0] | (_NONE << 42) | (_NONE << 21)
    two = ((a[:-1] << 21) | a[1:] | (_NONE << 42))[(a[:-1] | a[1:]) > 0]
    three = ((a[:-2] << 42) | (a[1:-1] << 21) | a[2:])[a[1:-1] > 0]
    return np.concatenate((one, two, three))


def ranked(codes: np.ndarray) -> np.ndarray:
    """The TOP most frequent codes, most frequent first, ties by code."""
    distinct, counts = np.unique(codes, return_counts=True)
    order = np.lexsort((distinct, -counts))[:TOP]
    return distinct[order]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each chunk of a language's texts."""

    def flush(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    for batch in sliced(batches):
        held: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(grams(text or ""))
            if sum(map(len, held[lang])) > CHUNK:
                yield flush(lang, held.pop(lang))
        for lang, parts in held.items():
            if sum(map(len, parts)):
                yield flush(lang, parts)


def fit(train: DataFrame) -> DataFrame:
    """Profiles (lang, gram, place) of all rows of ``train`` (text, lang), every language; null
    texts and languages are left out. Counts add up over all whole texts, repeated rows too; each
    language keeps its TOP most frequent n-grams, ties by code, places from 0. The ranking drops
    what can't be among the TOP of a language before its shuffle. No rows give no profiles."""
    known = train.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.select("lang", "text").mapInArrow(counted, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return total.withColumn("rank", rank).where(F.col("rank") <= TOP).select("lang", "gram", (F.col("rank") - 1).alias("place"))


class Profiles:
    """Places of n-grams in some languages' profiles, looked up by n-gram."""

    def __init__(self, rows: list):
        self.langs = sorted({r["lang"] for r in rows})
        number = {x: i for i, x in enumerate(self.langs)}
        gram = np.array([r["gram"] for r in rows], np.int64)
        order = np.argsort(gram, kind="stable")
        self.codes, first = np.unique(gram[order], return_index=True)
        self.first = np.append(first, len(gram))
        self.lang = np.array([number[r["lang"]] for r in rows], np.int64)[order]
        self.place = np.array([r["place"] for r in rows], np.int64)[order]

    def best(self, top: np.ndarray) -> tuple[int, str]:
        """(cost, language) of least cost, then least name, for a document's ranked n-grams."""
        at = np.searchsorted(self.codes, top)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == top
        at, ranks = at[known], np.flatnonzero(known)
        size = self.first[at + 1] - self.first[at]
        hits = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(at) else np.empty(0, np.int64)
        gain = TOP - np.abs(self.place[hits] - np.repeat(ranks, size))
        cost = TOP * len(top) - np.bincount(self.lang[hits], gain, len(self.langs)).astype(np.int64)
        i = int(cost.argmin())
        return int(cost[i]), self.langs[i]


def predict(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs`` (doc_id, text).

    A document's n-grams, most frequent first, are compared with each profile: a gram costs the
    distance of its two places, or TOP if the profile lacks it. The language of least cost wins,
    ties by code point; score is 1 - cost / largest cost. Null texts, texts without a letter and
    an empty profile table give ``und`` and 0. Whole texts are read, however long; rows are
    independent, so repeated rows give repeated results and no rows none; other columns are
    ignored. Profiles come to the tasks in blocks of about AT_ONCE languages; with several
    blocks, each pass keeps the best language so far.
    """
    profiles = cut(profiles)
    blocks = -(-profiles.select("lang").distinct().count() // AT_ONCE)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("lang_pred", "string"), ("cost", "long"), ("most", "long"))]
    out = docs.select(F.col("doc_id").cast("long"), "text", *none)
    for block in range(blocks):
        rows = profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        mine = Profiles(rows)

        def run(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                got = []
                for text, lang, cost in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                    found = grams(text) if text else ()
                    if len(found):
                        top = ranked(found)
                        least = min(mine.best(top), (cost, lang)) if lang is not None else mine.best(top)
                        got.append((least[1], least[0], TOP * len(top)))
                    else:
                        got.append((None, None, None))
                cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "text", "lang_pred", "cost", "most"])

        out = out.mapInArrow(run, "doc_id long, text string, lang_pred string, cost long, most long")
        out = cut(out) if blocks > 1 else out
    score = F.coalesce(1 - F.col("cost") / F.col("most"), F.lit(0.0))
    return out.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
