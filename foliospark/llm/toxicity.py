"""Toxicity scores by non-negative positive-unlabelled learning over word and letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import SLICE, cut, sliced, table, unused
from foliospark.llm.shingles import mix

#: Buckets that n-grams are hashed to, their lengths in letters (inside words), and the most
#: buckets that a classifier looks at.
BUCKETS, GRAMS, KEPT = 1 << 18, (4, 6, 8), 2000
#: Classifiers, and the sample that each is fitted on: the most confirmed toxic texts, the most
#: unlabelled texts, and the longest text in it, in characters. Scores read whole texts of any length.
MODELS, POSITIVES, UNLABELLED, SAMPLE_CHARS = 3, 2000, 6000, 20_000
#: Gradient steps, their size, momentum and weight decay.
STEPS, RATE, MOMENTUM, DECAY = 200, 0.3, 0.9, 1e-3
#: Least score of a text that is called toxic, and least confirmed toxic texts to learn from.
THRESHOLD, LEAST = 0.7, 3
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _letters(codes: np.ndarray) -> np.ndarray:
    """Whether code points are letters: a-z, and all from U+00C0 on but the two signs there."""
    return ((codes >= 97) & (codes <= 122)) | ((codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7))


def _grams(codes: np.ndarray, letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, place) of every word and of every n-gram inside a word."""
    n = len(codes)
    h = mix(codes.astype(_U) + _U(12345))
    edge = np.diff(np.concatenate(([False], letter, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power = np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(n, _U(_BASE)))))
    inverse = np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(n, _U(pow(_BASE, -1, 1 << 64))))))
    total = np.concatenate((np.zeros(1, _U), np.cumsum(h * power[:n], dtype=_U)))
    buckets = lambda x, kind: (mix(x + _U(kind)) % _U(BUCKETS)).astype(np.int64)
    yield buckets((total[ends] - total[starts]) * inverse[starts], 77), starts
    left = np.repeat(ends - starts, ends - starts) - (np.flatnonzero(letter) - np.repeat(starts, ends - starts))
    at = np.flatnonzero(letter)
    for k in GRAMS:
        p = at[left >= k]
        yield buckets((total[p + k] - total[p]) * inverse[p], k), p


def text_grams(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of the n-grams of all texts, case folded, and the number of n-grams of each
    text; ``keep``: only buckets that it marks. Texts are hashed many at a time, a long one alone."""
    at, found, totals = [], [], np.zeros(len(texts), np.int64)
    held: list[str] = []
    first = size = 0

    def flush() -> None:
        if not held:
            return
        codes = np.frombuffer("\n".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        borders = np.cumsum([0, *(len(t) + 1 for t in held)])
        for b, p in _grams(codes, _letters(codes)):
            doc = np.searchsorted(borders, p, "right") - 1
            totals[first : first + len(held)] += np.bincount(doc, minlength=len(held))
            if keep is not None:
                chosen = keep[b]
                doc, b = doc[chosen], b[chosen]
            at.append(doc + first)
            found.append(b)

    for text in texts:
        text = (text or "").lower()
        if held and size + len(text) > SLICE // 8:
            flush()
            first, size, held = first + len(held), 0, []
        held.append(text)
        size += len(text) + 1
    flush()
    none = np.empty(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *found]), totals


def features(texts: list[str | None], buckets: np.ndarray) -> np.ndarray:
    """A row a text, a column a bucket: the log of one more than its count, over the same of the
    text's n-grams in hundreds, so that a long text counts for no more than a short one."""
    column = np.full(BUCKETS, -1)
    column[buckets] = np.arange(len(buckets))
    doc, bucket, totals = text_grams(texts, column >= 0)
    counts = np.bincount(doc * len(buckets) + column[bucket], minlength=len(texts) * len(buckets)).reshape(len(texts), -1)
    return (np.log1p(counts) / np.log1p(np.maximum(totals, 1) / 100)[:, None]).astype(np.float32)


@dataclass
class Classifier:
    """A linear score of the features of some buckets; through a logistic curve, the chance that a
    text is toxic."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def risks(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the logistic risk of scores of toxic and unlabelled texts: of toxic texts,
    and of clean ones, the latter as the unlabelled texts' less the toxic share of it."""
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return float(positive), float(negative)


def fit(positive: list[str], unlabelled: list[str], prior: float) -> Classifier:
    """A classifier from toxic and unlabelled texts by the non-negative risk estimator.

    The buckets are those whose share of toxic texts differs most from that of unlabelled ones, in
    standard errors. Gradient steps follow the whole risk; where the clean part falls below 0,
    which no true risk does, the step goes back up that part alone.
    """

    def present(texts: list[str]) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for a in range(0, len(texts), 256):
            doc, bucket, _ = text_grams(texts[a : a + 256])
            pair = np.unique(doc * BUCKETS + bucket)
            out += np.bincount(pair % BUCKETS, minlength=BUCKETS)
        return out

    dp, du = present(positive), present(unlabelled)
    p, u = dp / len(positive), du / len(unlabelled)
    z = np.abs(p - u) / np.sqrt((u * (1 - u) + 1 / len(unlabelled)) / len(positive))
    known = np.flatnonzero(dp >= LEAST)
    buckets = np.sort(known[np.argsort(-z[known], kind="stable")[:KEPT]])
    if not len(buckets):
        return Classifier(buckets, np.empty(0), float(np.log(prior / (1 - prior))))
    made = lambda texts: np.concatenate([features(texts[a : a + 256], buckets) for a in range(0, len(texts), 256)])
    xp, xu = made(positive), made(unlabelled)
    mean, spread = xu.mean(0), xu.std(0) + 0.02
    xp, xu = (xp - mean) / spread, (xu - mean) / spread
    w, b = np.zeros(len(buckets)), float(np.log(prior / (1 - prior)))
    mw, mb = np.zeros(len(buckets)), 0.0
    curve = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for _ in range(STEPS):
        zp, zu = xp @ w.astype(np.float32) + b, xu @ w.astype(np.float32) + b
        up, down = -prior / len(zp) * curve(-zp), -prior / len(zp) * curve(zp)
        gp, gu = (up + down, curve(zu) / len(zu)) if risks(zp, zu, prior)[1] >= 0 else (-down, -curve(zu) / len(zu))
        mw = MOMENTUM * mw + (1 - MOMENTUM) * (xp.T @ gp + xu.T @ gu + DECAY * w)
        mb = MOMENTUM * mb + (1 - MOMENTUM) * (gp.sum() + gu.sum())
        w, b = w - RATE * mw, b - RATE * mb
    return Classifier(buckets, w / spread, b - float((w * mean / spread).sum()))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[Classifier], float]:
    """The classifiers, and the toxic share of the labelled documents outside the held-out fold.

    Each classifier has a sample of its own, fitted in a task: ids by smallest hash, POSITIVES
    of toxic and UNLABELLED of all documents outside the fold, texts of at most SAMPLE_CHARS
    characters. Of rows that share an id one text is taken; an id with contradicting labels isn't
    confirmed.
    """
    toxic = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    outside = docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1) & F.col("text").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    known = cut(outside.select("doc_id").distinct().join(toxic, "doc_id", "left").select(F.col("doc_id"), "toxic"))
    share = known.agg(F.avg(F.when(F.col("toxic").isNotNull(), (F.col("toxic") == 1).cast("double")))).first()[0]
    n = known.where("toxic = 1").limit(LEAST).count()
    if n < LEAST or not 0 < share < 1:
        return [], share or 0.0
    picks = None
    for m in range(MODELS):
        dealt = known.withColumn("__h", F.xxhash64("doc_id", F.lit(m)))
        for kind, rows, most in ((True, dealt.where("toxic = 1"), POSITIVES), (False, dealt, UNLABELLED)):
            some = rows.orderBy("__h", "doc_id").limit(most).select("doc_id", F.lit(m).alias("model"), F.lit(kind).alias("toxic"))
            picks = some if picks is None else picks.unionByName(some)
    picked = cut(picks)
    sample = outside.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "model", "toxic").agg(F.min("text").alias("text"))

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("doc_id")
        c = fit(batch.text[batch.toxic].tolist(), batch.text[~batch.toxic].tolist(), share)
        return pd.DataFrame({"buckets": [c.buckets.astype(np.int64)], "weights": [c.weights], "bias": [c.bias]})

    found = sample.groupBy("model").applyInPandas(one, "buckets array<long>, weights array<double>, bias double").collect()
    return [Classifier(np.array(r["buckets"], np.int64), np.array(r["weights"]), r["bias"]) for r in sorted(found, key=lambda r: r["bias"])], share


def score(texts: list[str | None], models: list[Classifier], otherwise: float = 0.0) -> np.ndarray:
    """The mean chance over the classifiers that each text is toxic; ``otherwise`` without any."""
    if not models:
        return np.full(len(texts), otherwise)
    buckets = np.unique(np.concatenate([m.buckets for m in models]))
    weights = np.zeros((len(buckets), len(models)))
    for k, m in enumerate(models):
        weights[np.searchsorted(buckets, m.buckets), k] = m.weights
    column = np.full(BUCKETS, -1)
    column[buckets] = np.arange(len(buckets))
    doc, bucket, totals = text_grams(texts, column >= 0)
    pair, counts = np.unique(doc * max(len(buckets), 1) + column[bucket], return_counts=True)
    doc, hit = np.divmod(pair, max(len(buckets), 1))
    z = np.zeros((len(texts), len(models)))
    for k, m in enumerate(models):
        z[:, k] = np.bincount(doc, weights=np.log1p(counts) * weights[hit, k], minlength=len(texts)) / np.log1p(np.maximum(totals, 1) / 100) + m.bias
    return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).mean(1)


def scored(docs: DataFrame, models: list[Classifier], otherwise: float = 0.0) -> DataFrame:
    """doc_id, score of each row. Texts are read whole; a null one counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist(), models, otherwise))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``.

    Learns from the ids whose CRC-32 leaves 0 or 2 modulo 3, by ``learn``. Null and empty texts get
    the score of a text without words; a null id is scored, isn't held out and isn't learned from;
    rows that repeat an id are scored each by its own text. Null labels are none; with fewer than
    LEAST toxic documents or without clean ones every score is the labelled toxic share, 0 without
    labels, at most just below THRESHOLD. An empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    models, share = learn(docs, labels)
    found = scored(docs, models, min(share, THRESHOLD - 0.01))
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    models, share = learn(docs, labels)
    (mark,) = unused(docs, "toxic_score")
    at, names = docs.columns.index("text"), docs.columns
    schema = docs.withColumn(mark, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                found = score(batch.column(at).to_pylist(), models, min(share, THRESHOLD - 0.01))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*names, mark])

    return docs.mapInArrow(run, schema).where(F.col(f"`{mark}`") < THRESHOLD).drop(mark)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
