"""Jaccard join of word-shingle sets by signature trees, and the groups that its links make.

1. Equal sets fall into one class by a fingerprint. Tokens that many sets hold are noted.
2. Sets meet where they share a token of their prefix, that is, of the first n - ceil(0.75 n) + k
   tokens in one global order (noted tokens last), with k = 1 + n // SHARED: two sets of similarity 0.75
   share as many as the smaller k of both. A set with fewer tokens in lists with others than any partner
   of its size would need has no link, and leaves the lists.
3. Sets that meet most often form clusters. A task gets a block of a cluster, builds the signature
   tree of its sets and traverses it against itself; surviving pairs are verified on the sets.
4. Where sets of different groups still meet, the trees of those meetings are traversed with the
   groups as classes, so that node pairs inside one group are cut; surviving pairs are verified.
   After that every pair that meets is in one group, or cut by its bound, or verified.

The order of tokens and the clusters only steer the work; the result is exact for any choice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import sigtree
from foliospark.llm.common import broadcast_if_small, cut, sliced, table, unused
from foliospark.llm.graph import components
from foliospark.llm.shingles import fingerprint, mix, shingle_sets

#: A token is noted as frequent from this share of the sets on; at most so many are noted, those
#: beyond are found when their lists are made.
FREQUENT = 1 / 512
MOST_FREQUENT = 200_000
#: Postings of a frequent token that meet in one list, and sets of a block of a cluster.
LIST = 1024
SETS = 64
#: Tokens of a set for each further token that its prefix has, and that near sets share.
SHARED = 12
#: Rows of ids that are sent to the documents; beyond it the texts go to the ids.
SENT = 1_500_000
#: Tokens counted together when frequent ones are looked for; they take twice their 8 bytes.
TOGETHER = 1 << 21
#: Fingerprints that a task remembers to leave out equal sets.
SEEN = 500_000
#: Lists that a task puts together before it passes them on, and the bytes of their ids.
HELD = 50_000
HELD_BYTES = 16 << 20


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _often(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that occur ``least`` (2 or more) times at least, and their times; sorts ``tokens`` in place."""
    tokens.sort()
    ahead = tokens[least - 1 :]
    found = np.unique(ahead[tokens[: len(ahead)] == ahead])
    return found, np.searchsorted(tokens, found, "right") - np.searchsorted(tokens, found)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(0, doc_id, n, f1, f2) of each row and (1, token, times, 0, 0) of locally frequent tokens."""
    held: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0

    def frequent() -> pa.RecordBatch:
        least = max(4, math.ceil(len(held) * FREQUENT))
        together = np.concatenate([*held, np.empty(0, np.uint64)])
        held.clear()
        tokens, times = _often(together, least)
        n = len(tokens)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), _signed(tokens), pa.array(times.astype(np.int64)), *[pa.array(np.zeros(n, np.int64))] * 2], ["kind", "key", "n", "f1", "f2"])

    for batch in sliced(batches):
        n, f1, f2 = [], [], []
        for tokens in shingle_sets(batch.column(1).to_pylist()):
            one, two = fingerprint(tokens)
            n.append(len(tokens))
            f1.append(one)
            f2.append(two)
            if one not in seen:
                seen.add(one)
                held.append(tokens)
                size += len(tokens)
                if size > TOGETHER:
                    yield frequent()
                    seen, size = set(), 0
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), *[pa.array(x, pa.int64()) for x in (n, f1, f2)]], ["kind", "key", "n", "f1", "f2"])
    yield frequent()


def _postings(docs: DataFrame, tokens: np.ndarray, lists: np.ndarray) -> DataFrame:
    """(token, part, doc_id) of every prefix token, about once a task for equal sets. A frequent token's
    postings are dealt to its number of lists, counted from 0; others have part -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in sliced(batches):
            if len(seen) > SEEN:
                seen.clear()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for doc_id, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True):
                key = fingerprint(own)
                if doc_id is None or not len(own) or key in seen:
                    continue
                seen.add(key)
                at = np.searchsorted(tokens, own)
                common = np.zeros(len(own), bool)
                if len(tokens):
                    common = tokens[np.minimum(at, len(tokens) - 1)] == own
                size = len(own) - (3 * len(own) + 3) // 4 + 1 + len(own) // SHARED
                rare = own[~common][:size]
                part = np.full(size, -1, np.int32)
                if len(rare) < size:
                    own_common = own[common][: size - len(rare)]
                    of = lists[np.searchsorted(tokens, own_common)].astype(np.uint64)
                    part[len(rare) :] = mix(own_common ^ np.uint64(doc_id & (1 << 64) - 1)) % of
                    rare = np.concatenate((rare, own_common))
                out.append((rare, part, np.full(size, doc_id, np.int64)))
            if out:
                token, part, ids = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([_signed(token), pa.array(part), pa.array(ids)], ["token", "part", "doc_id"])

    return docs.mapInArrow(run, "token long, part int, doc_id long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The sorted rows again, in tables that never part rows with equal values in the first
    ``keys`` columns (integers)."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in sliced(batches):
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        cols = [now.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(len(now), bool)
        change[0] = last is not None and last != tuple(c[0] for c in cols)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in cols)
        if change.any():
            at = int(np.flatnonzero(change)[-1])
            yield pa.concat_tables([*held, now.slice(0, at)])
            held = []
            now = now.slice(at)
        held.append(now)
    if held:
        yield pa.concat_tables(held)


def _bounds(cols: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(len(cols[0]) - 1, bool)
    for c in cols:
        change |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(cols[0])]))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, part, ids, votes) of tokens in two sets or more. Rare tokens with the same sets
    become one row with a null token, as far as a task sees them; a token that wasn't noted and yet
    has more than LIST sets is dealt like a noted one."""
    held: dict[bytes, int] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        ids = [np.frombuffer(k, np.int64) for k in held]
        return pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array([-1] * len(ids), pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(list(held.values()), pa.int64())], ["token", "part", "ids", "votes"])

    for rows in _runs(batches, 2):
        token, part, ids = (rows.column(k).to_numpy() for k in range(3))
        edge = _bounds([token, part])
        many = np.flatnonzero((np.diff(edge) > 1) | (part[edge[:-1]] >= 0))
        hot = []
        for lo, hi in zip(edge[many].tolist(), edge[many + 1].tolist(), strict=True):
            own = ids[lo:hi]
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            if part[lo] >= 0:
                hot.append((int(token[lo]), int(part[lo]), own))
            elif len(own) > LIST:
                hot += [(int(token[lo]), k // LIST, own[k : k + LIST]) for k in range(0, len(own), LIST)]
            elif len(own) > 1:
                key = own.tobytes()
                size += 0 if key in held else len(key)
                held[key] = held.get(key, 0) + 1
                if len(held) > HELD or size > HELD_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if hot:
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hot], pa.int64()), pa.array([h[1] for h in hot], pa.int32()), pa.array([h[2] for h in hot], pa.list_(pa.int64())), pa.array([1] * len(hot), pa.int64())], ["token", "part", "ids", "votes"])
    yield flush()


def _near_enough(lists: DataFrame, rows: DataFrame) -> DataFrame:
    """``lists`` (token, part, ids, votes) without the sets that share too few tokens to link.

    Near sets u and v share 1 + min(|u|, |v|) // SHARED prefix tokens at least, and |v| >= 0.75 |u|, so u has
    1 + ceil(0.75 |u|) // SHARED tokens in lists with others. What stays is looked at once more, as
    sets that left no longer count; both sets of a link stay each time.
    """
    need = rows.where("n > 0").groupBy("doc_id").agg((F.expr(f"(3 * min(n) + 3) div 4 div {SHARED}") + 1).alias("need")).select(F.col("doc_id").alias("of"), "need")
    for _ in range(2):
        numbered = lists.select(F.monotonically_increasing_id().alias("list"), "*")
        members = numbered.select("list", "token", "part", "votes", F.explode("ids").alias("id"))
        stay = cut(members.groupBy("id").agg(F.sum("votes").alias("votes")).join(need, F.col("id") == F.col("of")).where("votes >= need").select(F.col("id").alias("stays")))
        kept = members.join(broadcast_if_small(stay, SENT), F.col("id") == F.col("stays")).groupBy("list", "token", "part", "votes").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        lists = cut(kept.where((F.size("ids") > 1) | (F.col("part") >= 0)).groupBy("token", "part", "ids").agg(F.sum("votes").alias("votes")))
    return lists


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (one column, distinct)."""
    return docs.join(broadcast_if_small(ids.toDF("wanted"), SENT), F.col("doc_id") == F.col("wanted"), "left_semi")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the documents in ``ids``, tokens sorted as unsigned numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [t.view(np.int64) for t in shingle_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "tokens"])

    return _only(docs, ids).mapInArrow(run, "doc_id long, tokens array<long>")


def _bitmaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, n, bits) of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = list(shingle_sets(batch.column(1).to_pylist()))
            bits = [sigtree.bitmap(t, sigtree.width_of(len(t))).view(np.int64) for t in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in sets], pa.int64()), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n", "bits"])

    return _only(docs, ids).mapInArrow(run, "doc_id long, n long, bits array<long>")


def _lists_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.75 or more."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that join the sets of each block (cluster, block, doc_id, tokens)."""
    for rows in _runs(batches, 2):
        cluster, block, ids = (rows.column(k).to_numpy() for k in range(3))
        sets = _lists_of(rows.column(3))
        out = []
        edge = _bounds([cluster, block])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = sets[lo:hi]
            n = np.array([len(s) for s in own])
            i, j = sigtree.candidates([sigtree.bitmap(s, sigtree.width_of(len(s))) for s in own], n, np.arange(hi - lo))
            root = list(range(hi - lo))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q and linked(own[x], own[y]):
                    root[q] = p
                    out.append((ids[lo + x], ids[lo + y]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["u", "v"])


def _meeting_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (u, v, cu, cv) of all meetings (meeting, side, doc_id, class, n, bits) of a
    task, each once, with their classes."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(held, axis=1), axis=1) if held else np.empty((4, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["u", "v", "cu", "cv"])

    for rows in _runs(batches, 1):
        meeting, side, ids, klass, n = (rows.column(k).to_numpy() for k in range(5))
        bits = _lists_of(rows.column(5))
        edge = _bounds([meeting])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = klass[lo:hi]
            part = side[lo:hi] > 0
            i, j = sigtree.candidates(bits[lo:hi], n[lo:hi], np.unique(own, return_inverse=True)[1], part if part.any() else None)
            u, v, cu, cv = ids[lo:hi][i], ids[lo:hi][j], own[i], own[j]
            swap = u > v
            held.append(np.stack((np.where(swap, v, u), np.where(swap, u, v), np.where(swap, cv, cu), np.where(swap, cu, cv))))
            size += len(i)
        if size > 500_000:
            yield flush()
            held, size = [], 0
    yield flush()


def _clusters(lists: DataFrame) -> DataFrame:
    """(doc_id, cluster, block): every set that meets others, with the smallest set that it meets
    most often, followed twice; the cluster's own smallest set is in each of its blocks."""
    votes = lists.select(F.explode("ids").alias("doc_id"), F.element_at("ids", 1).alias("to"), "votes").where("doc_id <> to").groupBy("doc_id", "to").agg(F.sum("votes").alias("votes"))
    up = cut(votes.groupBy("doc_id").agg(F.max_by("to", F.struct("votes", -F.col("to"))).alias("to")))
    for _ in range(2):
        further = up.select(F.col("doc_id").alias("from"), F.col("to").alias("next"))
        up = cut(up.join(further, F.col("to") == F.col("from"), "left").select("doc_id", F.coalesce("next", "to").alias("to")))
    sizes = cut(up.groupBy(F.col("to").alias("cluster")).agg(F.ceil(F.count(F.lit(1)) / (SETS - 1)).cast("int").alias("blocks")))
    members = up.join(sizes, F.col("to") == F.col("cluster")).select("doc_id", "cluster", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"))
    heads = sizes.select(F.col("cluster").alias("doc_id"), "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return cut(members.unionByName(heads))


def _meetings(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """(meeting, side, doc_id, class) that bring together all sets of different groups that share
    a prefix token.

    Lists of rare tokens with the same first set are one meeting, the union of their sets, or a
    meeting each if that has more than 4 x LIST. Of frequent tokens whose largest group is the same, the sets outside that group (side 0), in
    lists of LIST by hash, meet all sets (side 1), in lists of LIST by hash.
    """
    named = lambda rows: rows.join(groups, F.col("doc_id") == F.col("node"), "left").select(*rows.columns, F.coalesce("component", "doc_id").alias("class"))
    rare = lists.where("part < 0").select(F.element_at("ids", 1).alias("meeting"), F.explode("ids").alias("doc_id")).distinct()
    rare = cut(named(rare))
    large = cut(rare.groupBy("meeting").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * LIST).select(F.col("meeting").alias("large")))
    if not large.isEmpty():
        own = lists.where("part < 0").join(broadcast_if_small(large), F.element_at("ids", 1) == F.col("large")).select(F.xxhash64("ids").alias("meeting"), F.explode("ids").alias("doc_id"))
        rare = cut(rare.join(broadcast_if_small(large), F.col("meeting") == F.col("large"), "left_anti").unionByName(named(own)))
    mixed = rare.groupBy("meeting").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select(F.col("meeting").alias("of"))
    inside = rare.join(mixed, F.col("meeting") == F.col("of")).select(F.xxhash64("meeting").alias("meeting"), F.lit(0).alias("side"), "doc_id", "class")

    hot = cut(named(lists.where("part >= 0").select("token", F.explode("ids").alias("doc_id"))))
    by_class = hot.groupBy("token", "class").agg(F.count(F.lit(1)).alias("n"))
    main = by_class.groupBy("token").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select(F.col("token").alias("of"), "main")
    there = cut(hot.join(main, F.col("token") == F.col("of")).select("main", "doc_id", "class").distinct())
    outer = F.col("class") != F.col("main")
    sizes = cut(there.groupBy(F.col("main").alias("of")).agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("parts"), F.ceil(F.count_if(outer) / LIST).cast("int").alias("lists")))
    dealt = there.join(sizes, F.col("main") == F.col("of"))
    part, here = (F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int") for n in ("parts", "lists"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    name = F.xxhash64("main", "part", "list", F.lit("across")).alias("meeting")
    one = dealt.where(outer).select("main", "doc_id", "class", here.alias("list"), every("parts").alias("part")).select(name, F.lit(0).alias("side"), "doc_id", "class")
    two = dealt.select("main", "doc_id", "class", part.alias("part"), every("lists").alias("list")).select(name, F.lit(1).alias("side"), "doc_id", "class")
    return cut(inside.unionByName(one).unionByName(two))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of 0.75 or more."""
    pairs = cut(pairs.select("u", "v").distinct())
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = _sets(docs, cut(ids))
    a, b = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, F.col("u") == F.col("a")).join(b, F.col("v") == F.col("b")).where(100 * both >= 75 * (F.size("x") + F.size("y") - both)).select("u", "v")


def ngram_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text).

    A set is the distinct five-word shingles of the text, A-Z lower-cased; a shorter text is one
    shingle; null texts and those without words have an empty set and link with nothing; texts are
    read whole, however long. Rows link
    if 100 x overlap >= 75 x union. component_id is the smallest doc_id that links reach, the own
    one for a row alone. Rows of one doc_id count as one node; a row with a null doc_id links only
    with equal sets. No rows give none; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(docs.mapInArrow(_classes, "kind int, key long, n long, f1 long, f2 long"))
    rows = found.where("kind = 0").select(F.col("key").alias("doc_id"), "n", "f1", "f2")
    least = max(LIST // 4, rows.count() * FREQUENT)
    frequent = found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toPandas()
    tokens = frequent["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    lists_of = -(-frequent["n"].to_numpy(np.int64) // LIST)

    posted = _postings(docs, tokens[order], lists_of[order])
    lists = posted.repartition("token", "part").sortWithinPartitions("token", "part", "doc_id").mapInArrow(_lists, "token long, part int, ids array<long>, votes long")
    lists = _near_enough(cut(lists.groupBy("token", "part", "ids").agg(F.sum("votes").alias("votes"))), rows)

    blocks = _clusters(lists)
    sets = _sets(docs, cut(blocks.select("doc_id").distinct()))
    dealt = sets.join(broadcast_if_small(blocks.withColumnRenamed("doc_id", "of"), SENT), F.col("doc_id") == F.col("of")).select("cluster", "block", "doc_id", "tokens")
    links = cut(dealt.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(_block_links, "u long, v long"))

    classes = cut(rows.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first")).select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), "first"))
    rows = cut(rows.join(classes, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m"))).select("doc_id", "n", F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("first")))
    met = lists.select(F.explode("ids").alias("node")).distinct()
    equal = cut(rows.where("doc_id <> first").join(met, F.col("doc_id") == F.col("node")).select(F.col("doc_id").alias("u"), F.col("first").alias("v")))
    links = links.unionByName(equal)
    groups = cut(components(links))
    meetings = _meetings(lists, groups)
    if not meetings.isEmpty():
        ids = cut(meetings.select("doc_id").distinct())
        signed = _bitmaps(docs, ids).select(F.col("doc_id").alias("of"), "n", "bits")
        dealt = meetings.join(signed, F.col("doc_id") == F.col("of")).select("meeting", "side", "doc_id", "class", "n", "bits")
        pairs = dealt.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(_meeting_pairs, "u long, v long, cu long, cv long")
        pairs = cut(pairs.distinct())
        # two pairs of each two groups first: what they link needs no other pair of theirs
        ends = pairs.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.min(F.struct("u", "v")).alias("x"), F.max(F.struct("u", "v")).alias("y"))
        more = cut(_verified(docs, ends.select(F.inline(F.array("x", "y")))))
        if not more.isEmpty():
            links = links.unionByName(more)
            merged = cut(components(more.unionByName(pairs.select(F.col("u"), F.col("cu").alias("v"))).unionByName(pairs.select(F.col("v").alias("u"), F.col("cv").alias("v")))))
            left, right = merged.toDF("nu", "gu"), merged.toDF("nv", "gv")
            joined = pairs.join(left, F.col("u") == F.col("nu"), "left").join(right, F.col("v") == F.col("nv"), "left")
            pairs = joined.where(F.coalesce("gu", "u") != F.coalesce("gv", "v")).select("u", "v")
        links = links.unionByName(cut(_verified(docs, pairs)))
        groups = cut(components(links))
    joined = rows.join(groups, F.col("first") == F.col("node"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group: those whose doc_id is its component_id,
    and rows with a null doc_id. Of rows with equal id and text one stays. Rows of one id and
    different texts stay or go together; null and empty texts are groups of their own; no rows give
    none. All columns stay, whatever their names."""
    key, other = unused(docs, "key", "other")
    own = F.xxhash64("doc_id", "text")
    twice = cut(docs.groupBy(own.alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key)))
    if not twice.isEmpty():
        again = broadcast_if_small(twice, SENT)
        first = docs.withColumn(other, own).join(again, F.col(other) == F.col(key), "left_semi").dropDuplicates([other]).drop(other)
        docs = docs.join(again, own == F.col(key), "left_anti").unionByName(first)
    others = cut(ngram_groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct())
    return docs.join(broadcast_if_small(others, SENT), F.col("doc_id") == F.col(other), "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"))


#: By brute force over all pairs that share a shingle, and the transitive closure of the links.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN ['short ' || len(w) || ' ' || array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p WHERE 100 * shared >= 75 * (n + m - shared)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(reach) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(g)
"""
