"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import broadcast_if_small, cut, sliced, table

#: A word's letters and least length, every how many-th hash loses a letter, the least
#: occurrences of a word, and how many times as frequent its form is.
LETTERS = r"[A-Za-zÀ-ÿ]"
LENGTH, LOSES, OCCURS, TIMES = 7, 31, 2, 10
#: Words of a key above which it is split, and rows of one Gram block.
HOT, BLOCK = 1024, 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the runs of letters, some of them less one letter by the hash of row and run, that
    have LENGTH letters and occur OCCURS times. Shorter runs can't become words and are skipped."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"({LETTERS}{{{LENGTH},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.char_length("run")
    at = (h % size).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    kept = runs.select(F.when(h % LOSES == 0, less).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LENGTH)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURS)


def _node(base: Column, lo: Column, r: Column) -> list[Column]:
    """Columns of a row in a node of the splitting tree: an edit of a word of ``base`` letters is
    among the letters lo to lo + r; what lies before and behind them stands as it is."""
    word = F.col("word")
    behind = base - lo - r
    key = F.xxhash64(base, lo, F.substring(word, F.lit(1), lo), F.substring(word, F.char_length("word") - behind + 1, behind))
    return [word, F.col("n"), base.alias("base"), lo.alias("lo"), r.alias("r"), key.alias("key")]


def split(rows: DataFrame) -> DataFrame:
    """Both halves of every node: the edit lies in the second, so the first half stands as it is,
    or in the first, and the second stands."""
    half = F.floor(F.col("r") / 2).cast("int")
    parts = F.explode(F.array(F.struct((F.col("lo") + half).alias("lo"), (F.col("r") - half).alias("r")), F.struct(F.col("lo"), half.alias("r"))))
    found = rows.select("word", "n", "base", parts.alias("p"))
    return found.select(*_node(F.col("base"), F.col("p.lo"), F.col("p.r")))


def keyed(words: DataFrame, hot: int = HOT) -> DataFrame:
    """word, n, base, lo, r, key: two words one edit apart, of ``base`` letters and as many or one
    more, share the key of one node that holds the place of their edit.

    Nodes start as halves of the word (a pair with one edit has one of them in common) and are
    halved again where more than ``hot`` words share a key, down to one letter, where they are at
    most as many as there are letters and pairs of letters. So no key grows with the vocabulary.
    """
    size = F.char_length("word").cast("int")
    both = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("base")).withColumns({"lo": F.lit(0), "r": F.col("base")})
    todo, done = split(both), None
    while True:
        large = cut(todo.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("r").alias("r")).where((F.col("c") > hot) & (F.col("r") > 1)).select("key"))
        few = broadcast_if_small(large)
        rest = todo.join(few, "key", "left_anti").select(*todo.columns)
        done = rest if done is None else done.unionByName(rest)
        if large.isEmpty():
            return done
        todo = cut(split(todo.join(few, "key", "left_semi")))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one row a word, 0 behind its end, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    m = np.zeros((len(words), int(sizes.max()) + 1), np.uint16)
    m[np.arange(m.shape[1]) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
    return m, sizes


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each letter that occurs at all stands in each row."""
    kinds, at = np.unique(codes, return_inverse=True)
    flat = np.bincount((np.arange(len(codes))[:, None] * len(kinds) + at.reshape(codes.shape)).ravel(), minlength=len(codes) * len(kinds))
    return flat.reshape(len(codes), -1)[:, kinds != 0].astype(np.float32)


def near_pairs(words: list[str], keys: np.ndarray, base: np.ndarray, lo: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the words one edit apart, each once, of rows sorted by key.

    Blocks of BLOCK rows are multiplied with themselves and with the blocks behind that begin
    with the same key: |a|^2 + |b|^2 - 2 ab is the squared distance of letter counts, at most two
    where one letter is replaced and one where it is inserted. What is left is compared letter by
    letter; of the nodes that two words share, the one that holds the edit's first place has them.
    """
    codes, sizes = _codes(words)
    counts = _letter_counts(codes)
    norms = (counts * counts).sum(1)
    out_i, out_j = [], []
    for a in range(0, len(words), BLOCK):
        x = slice(a, a + BLOCK)
        last = int(np.searchsorted(keys, keys[min(a + BLOCK, len(words)) - 1], "right"))
        for b in range(a, last, BLOCK):
            y = slice(b, min(b + BLOCK, last) if b > a else b + BLOCK)
            far = norms[x, None] + norms[None, y] - 2 * (counts[x] @ counts[y].T)
            i, j = np.nonzero(far <= 2)
            i, j = i + a, j + b
            ok = (i < j) & (keys[i] == keys[j]) & (base[i] == base[j]) & (lo[i] == lo[j])
            i, j = i[ok], j[ok]
            i, j = np.where(sizes[i] <= sizes[j], i, j), np.where(sizes[i] <= sizes[j], j, i)
            ok = (sizes[i] == base[i]) & (sizes[j] - sizes[i] <= 1)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            p, q = codes[i], codes[j]
            first = np.argmax(p != q, axis=1)
            one_more = sizes[j] > sizes[i]
            spread = np.arange(codes.shape[1])
            # behind the first difference, letter k of the one stands at k + 1 of the other, or at k
            moved = np.take_along_axis(q, np.minimum(spread + one_more[:, None], codes.shape[1] - 1), axis=1)
            behind = spread >= first[:, None] + np.where(one_more, 0, 1)[:, None]
            same = ((p == moved) | ~behind | (spread >= sizes[i][:, None])).all(1)
            end = lo[i] + r[i]
            mine = (first >= lo[i]) & ((first < end) | (one_more & (first == end) & (end == base[i])))
            ok = same & mine & (p != q).any(1)
            out_i.append(i[ok])
            out_j.append(j[ok])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def links(words: DataFrame, hot: int = HOT) -> DataFrame:
    """word, near, near_n: every word with every word one edit apart, both ways."""
    rows = keyed(words, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(batch: pa.Table) -> pa.RecordBatch:
            column = lambda c: batch.column(c).to_numpy()
            names = batch.column("word").to_pylist()
            i, j = near_pairs(names, column("key"), column("base"), column("lo"), column("r"))
            left, right = np.concatenate((i, j)), np.concatenate((j, i))
            text = batch.column("word").combine_chunks()
            return pa.RecordBatch.from_arrays([text.take(left), text.take(right), batch.column("n").combine_chunks().take(right)], ["word", "near", "near_n"])

        for batch in sliced(batches):
            held.append(batch)
            whole = pa.Table.from_batches(held)
            keys = whole.column("key").to_numpy()
            ready = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on in the next batch
            if ready:
                yield pairs(whole.slice(0, ready).combine_chunks())
                held = whole.slice(ready).to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def forms(words: DataFrame, near: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of every word: the number of its near words, and the most
    frequent of them (the first in code-point order of several) if it is TIMES as frequent."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(found, "word", "left")
    n = -F.col("best.less")
    takes = n >= TIMES * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.form")).alias("form"), F.when(takes, n).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: the last of the chain of forms.

    Each round doubles the chain's step. A form is TIMES as frequent as its word, so chains are as
    long as a count has digits and rounds are few.
    """
    at = cut(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("__via"), F.col("root").alias("__next"))
        after = cut(at.join(step, F.col("root") == F.col("__via"), "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    Null and empty texts have no words; a null id counts as an empty one in the hash; rows that are
    repeated count again; texts and words are taken whole, however long; an empty table gives no
    rows; ties of frequency go to the first word in code-point order; other columns, whatever their
    names, are ignored.

    Words are counted with a combine before the shuffle. The rest works on distinct words: keys
    of at most ``hot`` of them (see ``keyed``), pairs that are true links only, and one row a word.
    """
    words = cut(word_counts(docs))
    formed = cut(forms(words, links(words, hot)))
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: Another algorithm: every word less one letter, joined with words and with each other. CRC-32 by
#: its table, made from the reversed polynomial 0xEDB88320.
OP11_SQL = r"""
WITH RECURSIVE
crc(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
run0 AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(u.run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS u(run)),
run AS (SELECT id, run, count(*) AS m, hex(encode(id || ':' || run)) AS x FROM run0 GROUP BY id, run),
hashed AS (
  SELECT run, m, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
                     lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM run, tab),
kept AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, m FROM hashed),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
less AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS short FROM w, unnest(range(1, length(word) + 1)) AS u(p)),
pair AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.short = b.short AND a.p = b.p AND a.word <> b.word
  UNION SELECT w.word, less.word, less.n FROM w JOIN less ON less.short = w.word
  UNION SELECT less.word, w.word, w.n FROM w JOIN less ON less.short = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM pair GROUP BY word),
f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word),
chain(word, form, k) AS (
  SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN f ON c.form = f.word WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(form, k) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN last ON f.word = last.word
"""
