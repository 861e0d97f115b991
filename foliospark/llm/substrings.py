"""Removal of repeated lines and passages: the earliest place of a unit stays."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import broadcast_if_small, cut, sliced, table, unused

#: Passages of fewer words stay wherever they are: greetings, menus and other short lines recur in
#: sound texts. units() with fewer words, or 1, takes them too.
MIN_WORDS = 25
#: Words from which units() takes runs of sentences.
SHORT = 8
#: Share of all repeated places from which a digest's places are dealt to several tasks.
HOT = 1 / 1000
WORD = re.compile(r"[^\W_]+")
#: Thai, Lao, Burmese, Khmer, kana and Han, written without spaces between words.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNSPACED_SQL = "".join(c if c == "-" else rf"\x{{{ord(c):x}}}" for c in _UNSPACED)
#: Words, and single characters of scripts without spaces.
TOKEN = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W_])+")
UNSPACED = re.compile(rf"[{_UNSPACED}]")
PIECE = re.compile(r"[^\n.!?。！？]+[.!?。！？]*")
LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"[^.!?。！？]+[.!?。！？]*")


def _runs(sums: list[int], least: int) -> set[tuple[int, int]]:
    """(first, last + 1) of the shortest runs of ``least`` words or more from each piece on and up
    to each piece; ``sums`` are the running word counts, from 0."""
    runs = {(i, j) for i, c in enumerate(sums) if (j := bisect.bisect_left(sums, c + least)) < len(sums)}
    return runs | {(i, j) for j, c in enumerate(sums) if (i := bisect.bisect_right(sums, c - least) - 1) >= 0}


def passages(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, n_words, normal form) of each line of ``min_words`` words or more, and of the
    shortest runs of sentences, over line ends too, that have as many, from each sentence on and
    up to each. A passage whose whole sentences have as many together is covered by such runs,
    wherever it stands; a character of a script without spaces counts as a word."""
    find = (TOKEN if UNSPACED.search(text) else WORD).findall
    parts = [(m.start(), m.end(), w) for m in PIECE.finditer(text) if (w := find(m[0].lower()))]
    sums = [0, *accumulate(len(w) for _, _, w in parts)]
    if sums[-1] < min_words:
        return
    runs = _runs(sums, min_words)
    first = 0
    for k in range(1, len(parts) + 1):
        if k == len(parts) or "\n" in text[parts[k - 1][1] : parts[k][0]]:
            if sums[k] - sums[first] >= min_words:
                runs.add((first, k))
            first = k
    every = [x for _, _, w in parts for x in w]
    for i, j in sorted(runs):
        yield parts[i][0], parts[j - 1][1], sums[j] - sums[i], " ".join(every[sums[i] : sums[j]])


def units(text: str, min_words: int = SHORT) -> Iterator[tuple[int, int, int, str]]:
    """As passages(), of each non-blank line, whole and of any length, and within it of the
    shortest runs of sentences of ``min_words`` words or more. Any whole sentences that are long
    enough together are covered by such runs, whatever stands around them in the line."""
    for line in LINE.finditer(text):
        body, at = line[0], line.start()
        find = (TOKEN if UNSPACED.search(body) else WORD).findall
        parts = [(m.start(), m.end(), w) for m in SENTENCE.finditer(body) if (w := find(m[0].lower()))]
        n = sum(len(w) for _, _, w in parts)
        if n:
            yield at, line.end(), n, " ".join([x for _, _, w in parts for x in w])
        elif body.strip():
            yield at, line.end(), 0, "\n" + body.strip()
        if n < min_words or len(parts) < 2:
            continue
        sums = [0, *accumulate(len(w) for _, _, w in parts)]
        for i, j in sorted(_runs(sums, min_words) - {(0, len(parts))}):
            run = [x for _, _, w in parts[i:j] for x in w]
            yield at + parts[i][0], at + parts[j - 1][1], len(run), " ".join(run)


def digests(docs: DataFrame, min_words: int = MIN_WORDS, pieces: Callable = passages) -> DataFrame:
    """doc_id, start, end, n_words, h1, h2 of each unit that ``pieces`` gives.

    Offsets are source code points, end exclusive. (h1, h2) is a 128-bit digest of the unit's
    lower-cased words, so case, punctuation and spacing don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, starts, ends, counts, high, low = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, end, n_words, norm in pieces(text or "", min_words):
                    d = blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    ids.append(doc_id)
                    starts.append(start)
                    ends.append(end)
                    counts.append(n_words)
                    high.append(int.from_bytes(d[:8], "little", signed=True))
                    low.append(int.from_bytes(d[8:], "little", signed=True))
            cols = [pa.array(ids, pa.int64()), *[pa.array(x, pa.int32()) for x in (starts, ends, counts)], *[pa.array(x, pa.int64()) for x in (high, low)]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "end", "n_words", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start int, end int, n_words int, h1 long, h2 long")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, pieces: Callable = passages) -> DataFrame:
    """doc_id, start, end, n_words, kept_doc_id, kept_start: every unit that repeats an earlier one.

    The earliest place by (doc_id, start, end) of each digest stays; a null doc_id comes last. A
    place that overlaps the one that stays is no repeat. Repeated rows with one doc_id count as one
    text. Null and empty texts have no units, texts are read whole however long; no rows give
    none; other columns are ignored.

    The first grouping is a count and a minimum a digest, combined before the shuffle. Only places
    of digests seen twice or more are kept, by a join in which a digest with more than HOT of them
    is dealt by doc_id to several tasks; the kept place is again a minimum a digest.
    """
    places = digests(docs, min_words, pieces)
    seen = places.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("kept_doc_id"))
    twice = cut(seen.where("n > 1"))
    most = int((twice.agg(F.sum("n")).first()[0] or 0) * HOT) + 1000
    hot = twice.where(F.col("n") > most).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.ceil(F.col("n") / most).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    with_salts = lambda rows: rows.join(F.broadcast(hot), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").drop("g1", "g2")  # noqa: E731 - at most 1 / HOT rows
    dealt = with_salts(places).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), salts).cast("int")).drop("salts")
    asked = with_salts(twice).select("h1", "h2", "kept_doc_id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    again = cut(dealt.join(asked, ["h1", "h2", "salt"]).drop("salt"))
    first = F.min(F.shiftleft(F.col("start").cast("long"), 31).bitwiseOR(F.col("end").cast("long")))
    kept = again.where(F.col("doc_id").eqNullSafe(F.col("kept_doc_id"))).groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(first.alias("at"))
    kept = kept.select("g1", "g2", F.shiftright("at", 31).cast("int").alias("kept_start"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("kept_end"))
    joined = again.join(broadcast_if_small(kept, 500_000), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    later = ~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") < F.col("kept_end")))
    return joined.where(later).select("doc_id", "start", "end", "n_words", "kept_doc_id", "kept_start")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, pieces: Callable = passages) -> DataFrame:
    """``docs`` (distinct, non-null doc_id) with repeats() cut out of the text; the column
    ``removed`` (one of ``docs`` is replaced) keeps their source offsets, in order, null where
    nothing went. What overlapping units leave of a text stands earlier, so its words are never
    lost. Null and empty texts stay; a row with a null doc_id stays whole; rows that share an id
    lose the same offsets; no rows give none; other columns stay, whatever their names."""
    docs = docs.drop("removed")
    (of,) = unused(docs, "of")
    spans = repeats(docs, min_words, pieces).groupBy(F.col("doc_id").alias(of)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    joined = docs.join(spans, F.col("doc_id") == F.col(of), "left").drop(of)
    cut_out = F.aggregate("removed", F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")), lambda a, s: F.struct(F.concat(a["kept"], F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))).alias("kept"), F.greatest(a["at"], s["end"]).alias("at")), lambda a: F.concat(a["kept"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(cut_out))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of any length too, and shorter runs of sentences."""
    return repeats(table(spark, sf_dir, "documents"), SHORT, units)


#: Same units with running sums and nearest-value joins; equal ones by their normal forms.
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\n.!?。！？]+[.!?。！？]*|[\n.!?。！？]') AS p FROM documents),
l AS (SELECT doc_id, p, list_transform(p, lambda x: length(x)) AS n FROM d),
u AS (SELECT doc_id, i, p[i] AS piece, n[i] AS n FROM l, unnest(range(1, len(p) + 1)) AS r(i)),
o AS (
  SELECT *, sum(n) OVER e - n AS start, sum(CASE WHEN piece = chr(10) THEN 1 ELSE 0 END) OVER e AS line,
         regexp_extract_all(regexp_replace(lower(piece), '([{_UNSPACED_SQL}])', ' \1 ', 'g'), '[\pL\pN]+') AS w
  FROM u WINDOW e AS (PARTITION BY doc_id ORDER BY i)),
k AS (
  SELECT doc_id, line, start, start + n AS "end", w, row_number() OVER e AS k, sum(len(w)) OVER e - len(w) AS lo, sum(len(w)) OVER e AS hi
  FROM o WHERE len(w) > 0 WINDOW e AS (PARTITION BY doc_id ORDER BY i)),
runs AS (
  SELECT a.doc_id, a.k AS i, b.k AS j FROM k a ASOF JOIN k b ON a.doc_id = b.doc_id AND b.hi >= a.lo + {MIN_WORDS}
  UNION SELECT a.doc_id, b.k, a.k FROM k a ASOF JOIN k b ON a.doc_id = b.doc_id AND b.lo <= a.hi - {MIN_WORDS}
  UNION SELECT doc_id, min(k), max(k) FROM k GROUP BY doc_id, line HAVING max(hi) - min(lo) >= {MIN_WORDS}),
m AS (SELECT doc_id, i, j, unnest(range(i, j + 1)) AS k FROM runs),
n AS (
  SELECT m.doc_id, min(k.start) AS start, max(k."end") AS "end", sum(len(k.w)) AS n_words, string_agg(array_to_string(k.w, ' '), ' ' ORDER BY k.k) AS norm
  FROM m JOIN k ON k.doc_id = m.doc_id AND k.k = m.k GROUP BY m.doc_id, m.i, m.j),
f AS (
  SELECT *, first_value(doc_id) OVER e AS kept_doc_id, first_value(start) OVER e AS kept_start, first_value("end") OVER e AS kept_end
  FROM n WINDOW e AS (PARTITION BY norm ORDER BY doc_id, start, "end"))
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CAST(n_words AS INTEGER) AS n_words, kept_doc_id, CAST(kept_start AS INTEGER) AS kept_start
FROM f WHERE doc_id <> kept_doc_id OR start >= kept_end
"""
