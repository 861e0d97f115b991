"""Benchmark passages in documents by pigeonhole pieces and bit-parallel edit distance."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import broadcast_if_small, cut, sliced, table, unused

#: Edits allowed as a share of an item's length, the length (in normalised characters) under which
#: what is found has to lie between word borders, and the characters of items in one pass: the
#: automaton takes about 48 bytes a character in each worker, 200 MB in all.
ERROR_RATE = 0.08
SHORT = 40
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, character by character: the capital I with a dot, the one character that
    becomes two, becomes i."""
    return text.replace("İ", "i").lower()


def normalise(text: str) -> str:
    """Lower-case words with single spaces."""
    return " ".join(WORD.findall(fold(text)))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of nearly equal length with their offsets. ``budget`` edits leave
    at least one of them as it is."""
    n, m = budget + 1, len(item)
    bounds = [m * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(least edit distance of ``pattern`` to a substring of ``text``, its end), or None if above
    ``most``: Myers' bit-parallel scan, one machine step a character."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    top, mask = 1 << (m - 1), (1 << m) - 1
    vp, vn, score, best, end = mask, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp) & mask
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & mask
        vp = (hn << 1 & mask) | ~(xv | hp) & mask
        vn = hp & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


def between_words(item: str, text: str, a: int, b: int, most: int) -> tuple[int, int, int] | None:
    """(least edit distance of ``item`` to whole words of text[a:b], their start and end), the first
    of equal ones, or None if above ``most``."""
    found = None
    for s in range(a, b):
        if text[s] == " " or (s > 0 and text[s - 1] != " "):
            continue
        part = text[s : min(len(text), s + len(item) + most)]
        row = list(range(len(part) + 1))
        for i, c in enumerate(item, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(part, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        for n in range(1, len(part) + 1):
            if row[n] <= most and text[s + n : s + n + 1] in ("", " ") and part[n - 1] != " ":
                found = min(found or (row[n], s, s + n), (row[n], s, s + n))
    return found


class Matcher:
    """Items (ids, normalised text) ready to be looked for; built once a task."""

    def __init__(self, items: list[tuple[list, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        self.find = ahocorasick.Automaton()
        for n, (_, item, budget) in enumerate(self.items):
            for at, piece in pieces(item, budget):
                self.find.add_word(piece, [*self.find.get(piece, ()), (n, at, len(piece))])
        if self.items:
            self.find.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item, merged stretches of ``text`` where a piece says that it may lie."""
        found: dict[int, set[int]] = {}
        for last, hits in self.find.iter(text):
            for n, at, size in hits:
                found.setdefault(n, set()).add(last + 1 - size - at)
        out: dict[int, list[list[int]]] = {}
        for n, starts in found.items():
            _, item, budget = self.items[n]
            spans: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - budget), min(len(text), s + len(item) + budget)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            out[n] = spans
        return out

    def matches(self, text: str) -> list[tuple]:
        """(item_id, distance, start, end) of the best place of each item found, the first of
        equal ones, in ``text``'s own code points; the start is where the last words of the
        item's length begin."""
        if not self.items:
            return []
        plain, out = normalise(text), []
        for n, spans in self.windows(plain).items():
            ids, item, budget = self.items[n]
            places = [(got[0], a + got[1]) for a, b in spans if (got := myers(item, plain[a:b], budget))]
            if places and len(item) < SHORT:  # the scan finds it inside words too
                whole = [got for a, b in spans if (got := between_words(item, plain, a, b, budget))]
                out += [(ids, *min(whole))] if whole else []
            elif places:
                distance, end = min(places)
                out.append((ids, distance, max(0, end - len(item)), end))
        if not out:
            return []
        where = [m.span() for m in WORD.finditer(fold(text))]
        ends = list(accumulate(b - a + (n > 0) for n, (a, b) in enumerate(where)))
        at = lambda x: where[bisect.bisect_left(ends, x)]  # noqa: E731 - the word that the normalised place x falls into
        return [(i, d, at(s + 1)[0], at(e)[1]) for ids, d, s, e in out for i in ids]


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, key: str | None = None) -> DataFrame:
    """doc_id, item_id, distance, start, end: every benchmark item that a document holds with at
    most ``rate`` x its length edits, at its best place (the first of equal ones); with ``key``
    also that column (a long) of the document.

    Both texts are compared as lower-case words with single spaces. Items under SHORT characters
    there are found between word borders only, with the same share of edits; items without a word
    and null ones never; a null item_id is kept as such. Items of one text are looked for once. Items
    go to the tasks in blocks of about ``block_chars`` characters, dealt by their texts; with
    several blocks each one's finds are written before the next block comes to the driver. Null
    texts hold nothing; whole texts are read, however long; repeated rows give repeated results;
    no rows on either side give none; other columns are ignored.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = int(size // block_chars) + 1
    schema = "doc_id long, item_id long, distance int, start int, end int" + (f", `{key}` long" if key else "")
    texts = docs.select(F.col("doc_id").cast("long"), "text", *([key] if key else []))
    out = None
    for block in range(blocks):
        mine = benchmark.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)).select(F.col("item_id").cast("long"), "text").distinct()
        ids: dict[str, list] = {}
        for r in mine.toLocalIterator():
            if t := normalise(r["text"]):
                ids.setdefault(t, []).append(r["item_id"])
        items = [(sorted(set(i), key=lambda x: (x is None, x or 0)), t) for t, i in sorted(ids.items())]

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for batch in sliced(batches):
                rows = [(n, *x) for n, t in enumerate(batch.column(1).to_pylist()) if t for x in matcher.matches(t)]
                at = pa.array([r[0] for r in rows], pa.int64())
                cols = [batch.column(0).take(at), *[pa.array([r[i] for r in rows], pa.int64() if i == 1 else pa.int32()) for i in range(1, 5)]]
                cols += [batch.column(2).take(at)] if key else []
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "distance", "start", "end", *([key] if key else [])])

        found = texts.mapInArrow(run, schema)
        found = cut(found) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all columns, whatever their names.

    Rows are told apart by a hash of id and text, so rows that share an id are judged alone, and
    those with a null id too; repeated rows go or stay together; null and empty texts stay; no
    documents give no rows, no benchmark keeps all."""
    (key,) = unused(docs, "key")
    own = F.xxhash64(docs["doc_id"], docs["text"])
    bad = cut(find_items(docs.select("doc_id", "text", own.alias(key)), benchmark, rate, key=key).select(key).distinct())
    return docs.join(broadcast_if_small(bad, 500_000), own == bad[key], "left_anti")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
