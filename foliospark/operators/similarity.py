"""Nearest neighbours of vectors by cosine: exact, and through an inverted-file index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources.store import stage

#: Bytes of queries that are broadcast; more are joined by block.
QUERY_BYTES = 32 << 20
#: Vectors of a block of a cell, and of queries that meet it together.
BLOCK, QUERY_BLOCK = 1024, 256
#: Vectors, and queries, of a block of the exact product.
EXACT_BLOCK = 1024
#: The most vectors that the cells are fitted on, and queries that the probes are set by.
SAMPLE, CALIBRATION = 50_000, 200
#: Share of true neighbours that the probes have to reach on those queries, above what is promised.
TARGET = 0.97
#: Candidates by code for each neighbour asked for, before vectors are compared.
CANDIDATES = 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """``v`` at length one; a zero vector stays. The square of its length is taken once a vector."""
    scaled = lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / F.sqrt(n)).otherwise(F.when(n.isNotNull(), F.lit(0.0))))
    return F.element_at(F.transform(F.array(dot(v, v)), scaled), 1)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = EXACT_BLOCK) -> DataFrame:
    """The ``k`` nearest other vectors (id, vector) of each query by cosine, 0 for a zero or missing
    vector and for one of another length; ties by id, cosines told apart at nine digits.

    Exact: every vector meets every query, block by block as a product of two matrices, and a
    pair of blocks keeps only the best of each query before the shuffle. A task holds one pair of blocks at a
    time. ``Index`` does without the product.
    """
    kind, asked_kind = vectors.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    n, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks, sc = max(1, -(-n // block)), vectors.sparkSession.sparkContext
    q = _packed(queries, asked_kind, block, blocks).withColumnsRenamed({"ids": "query_ids", "rows": "queries"})
    tasks = max(4 * sc.defaultParallelism, -(-vectors.count() // block))
    v = _packed(vectors, kind, block, tasks)
    if n * (size + 2) * 8 <= QUERY_BYTES:
        met = v.crossJoin(F.broadcast(q))
    else:  # every block of queries goes to every part of the vectors
        parts = max(1, tasks // 4)
        met = v.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts))).join(q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), "part")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a row is two whole blocks
                ids, query_ids = batch.column(0)[at].values, batch.column(2)[at].values
                a, b = _unpacked(batch.column(3)[at], len(query_ids)), _unpacked(batch.column(1)[at], len(ids))
                cosine = a @ b.T if a.shape[1] == b.shape[1] else np.zeros((len(a), len(b)))
                mine, own = np.asarray(ids.to_numpy(zero_copy_only=False)), np.asarray(query_ids.to_numpy(zero_copy_only=False))
                i, j = _leading(cosine, mine, own, k)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(cosine[i, j])], ["query_id", "id", "cosine"])

    scored = met.select("ids", "rows", "query_ids", "queries").mapInArrow(best, f"query_id {asked_kind}, id {kind}, cosine double")
    return _best(scored, k)


def _packed(rows: DataFrame, kind: str, block: int, tasks: int) -> DataFrame:
    """Rows (id, vector) in blocks of at most ``block`` unit vectors of one length: ids and the
    vectors as doubles. A missing vector, or one with a missing entry, counts as one of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            widths = np.asarray(column.value_lengths().fill_null(0))
            for width in np.unique(widths):
                same = np.flatnonzero(widths == width)
                for first in range(0, len(same), block):
                    at = pa.array(same[first : first + block])
                    part = column.take(at)
                    flat = part.flatten().cast(pa.float64())
                    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
                    missing = np.asarray(flat.is_null()).reshape(len(at), width).any(1)
                    with np.errstate(all="ignore"):
                        length = np.sqrt((m * m).sum(1))
                        m = m / length[:, None]
                    m[(length == 0) | missing] = 0.0
                    ids = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), batch.column(0).take(at))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([m.tobytes()], pa.binary())], ["ids", "rows"])

    dealt = rows.where("id IS NOT NULL").select("id", "vector").repartition(tasks, F.xxhash64("id"))
    return dealt.mapInArrow(run, f"ids array<{kind}>, rows binary")


def _unpacked(rows: pa.Scalar, n: int) -> np.ndarray:
    data = np.frombuffer(rows.as_py(), np.float64)
    return data.reshape(n, len(data) // n)


def _leading(cosine: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest cosines of each row, those of its own id left out; ties,
    at nine digits, by id, and what is no number first, as Spark sorts it."""
    shown = np.round(cosine, 9)
    shown[np.isnan(shown)] = np.inf
    shown[own[:, None] == ids[None]] = -np.inf
    m = min(k, shown.shape[1])
    least = np.partition(shown, shown.shape[1] - m, axis=1)[:, shown.shape[1] - m]
    i, j = np.nonzero((shown >= least[:, None]) & (shown > -np.inf))
    _, order = np.unique(ids, return_inverse=True)
    turn = np.lexsort((order[j], -shown[i, j], i))
    i, j = i[turn], j[turn]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < m], j[place < m]


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.empty((0, 0))


@dataclass
class Index:
    """Cells of vectors by their nearest centre, in blocks; see ``build``.

    ``cells``: cell, ids, codes (residuals from the centre in 8 bits an entry), scale, vectors (32-bit).
    ``probes``: how many cells, from the nearest centre on, a query looks into.
    """

    centres: np.ndarray
    cells: DataFrame
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, k: int = 5, cells: int | None = None, sample: int = SAMPLE, calibration: int = CALIBRATION, target: float = TARGET) -> Index:
        """An index of every row of ``vectors`` (id, vector); ids are longs, null vectors are left out.

        The centres come from k-means over at most about ``sample`` vectors, about the root of all
        of them in number (``cells``). Each vector goes to the nearest centre's cell, in blocks of
        about BLOCK, so that a cell of any size spreads over tasks. The probes are the fewest with which
        ``calibration`` vectors, drawn by hash, find ``target`` of their true neighbours: those come from
        one exact pass, so recall is measured on the data at hand and not assumed.
        """
        rows = stage(vectors.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).select(F.col("id").cast("long"), unit(F.col("vector")).alias("v")), "vectors")
        n = rows.count()
        if n == 0:
            return cls(np.zeros((1, 1)), rows.select(F.lit(0).alias("cell"), F.array("id").alias("ids"), F.lit(b"").alias("codes"), F.lit(1.0).alias("scale"), F.lit(b"").alias("vectors")), 1)
        cells = cells or max(1, min(4096, round(n**0.5 / 2)))
        some = rows.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) < int(min(1.0, sample / n) * 1_000_000)) if n > sample else rows
        if cells > 1:
            fitted = KMeans(k=cells, maxIter=15, seed=17, initSteps=2).fit(some.select(array_to_vector("v").alias("features")))
            centres = np.array(fitted.clusterCenters())
        else:
            centres = np.zeros((1, rows.select(F.max(F.size("v"))).first()[0]))
        blocks = max(1, -(-n // (BLOCK * len(centres))))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            norms = (centres**2).sum(1)
            for batch in batches:
                if batch.num_rows:
                    near = np.argmin(norms - 2 * _matrix(batch.column(1)) @ centres.T, axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["id", "v", "cell"])

        dealt = rows.mapInArrow(assign, "id long, v array<double>, cell int").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        # cells far above the mean are cut further, by their own size
        sizes = dealt.groupBy("cell").count().select("cell", (F.col("count") / (BLOCK * blocks)).cast("int").alias("more"))
        dealt = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks) * (F.col("more") + 1)))
        packed = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    cell, held = batch.column(0)[at].as_py(), batch.column(1)[at].values
                    v = _matrix(held.field("v"))
                    rest = v - centres[cell]
                    scale = max(float(np.abs(rest).max()) / 127, 1e-12)
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "ids": [held.field("id").to_pylist()], "codes": [np.round(rest / scale).astype(np.int8).tobytes()], "scale": [scale], "vectors": [v.astype(np.float32).tobytes()]})

        stored = stage(packed.select("cell", "rows").mapInArrow(code, "cell int, ids array<long>, codes binary, scale double, vectors binary"), "cells")
        index = cls(centres, stored, len(centres))
        index.probes = index._calibrated(rows, n, k, calibration, target)
        return index

    def _calibrated(self, rows: DataFrame, n: int, k: int, calibration: int, target: float) -> int:
        asked = rows.where(F.pmod(F.xxhash64("id", F.lit("ask")), F.lit(1_000_000)) < max(1, int(min(1.0, calibration / n) * 1_000_000)))
        asked = stage(asked.select("id", F.col("v").alias("vector")), "asked")
        true = neighbours(rows.select("id", F.col("v").alias("vector")), asked, k).select("query_id", "id")
        cell_of = self.cells.select(F.explode("ids").alias("id"), "cell")
        found = true.join(cell_of, "id").join(asked.select(F.col("id").alias("query_id"), "vector"), "query_id").select("cell", "vector")
        centres = self.centres

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    order = _nearest(_matrix(batch.column(1)), centres)
                    at = np.argmax(order == np.asarray(batch.column(0))[:, None], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["at"])

        counts = found.mapInArrow(place, "at long").groupBy("at").count().orderBy("at").collect()
        total, seen = sum(r["count"] for r in counts), 0
        for r in counts:
            seen += r["count"]
            if seen >= target * total:
                return r["at"] + 1
        return len(centres)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, id, cosine, rank: the ``k`` nearest other vectors among the cells that each query
        (id, vector) looks into. Codes choose the candidates of a block, vectors rank them.

        Queries go to the cells they look into, in blocks; a block of queries and one of a cell
        are what a task holds. Hot cells are split by the adaptive planner, as many blocks as they are.
        """
        centres, probes = self.centres, self.probes

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = _nearest(_matrix(batch.column(1)), centres)[:, :probes]
                    each = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(each), batch.column(1).take(each)], ["cell", "query_id", "q"])

        asked = queries.where(F.col("vector").isNotNull()).select(F.col("id").cast("long"), unit(F.col("vector")).alias("q"))
        looks = asked.mapInArrow(look, "cell int, query_id long, q array<double>")
        parts = max(1, -(-asked.count() * probes // (QUERY_BLOCK * len(centres))))
        asks = looks.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("query_id", "q")).alias("asks"))
        met = self.cells.join(asks.select("cell", "asks"), "cell")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {c: batch.column(c)[at] for c in ("cell", "ids", "codes", "scale", "vectors", "asks")}
                    asks = row["asks"].values
                    q, query = _matrix(asks.field("q")), np.asarray(asks.field("query_id"))
                    ids = np.asarray(row["ids"].values)
                    codes = np.frombuffer(row["codes"].as_py(), np.int8).reshape(len(ids), -1)
                    near = (q @ centres[row["cell"].as_py()])[:, None] + row["scale"].as_py() * (q @ codes.T.astype(np.float64))
                    near[query[:, None] == ids[None]] = -np.inf
                    m = min(len(ids), k * CANDIDATES)
                    chosen = np.argpartition(-near, m - 1, axis=1)[:, :m]
                    v = np.frombuffer(row["vectors"].as_py(), np.float32).reshape(len(ids), -1).astype(np.float64)
                    exact = np.einsum("qd,qmd->qm", q, v[chosen])
                    exact[query[:, None] == ids[chosen]] = -np.inf
                    m = min(m, k)
                    top = np.argpartition(-exact, m - 1, axis=1)[:, :m]
                    cosine, hit = np.take_along_axis(exact, top, 1).ravel(), ids[np.take_along_axis(chosen, top, 1)].ravel()
                    real = np.isfinite(cosine)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, m)[real]), pa.array(hit[real]), pa.array(cosine[real])], ["query_id", "id", "cosine"])

        scored = met.select("cell", "ids", "codes", "scale", "vectors", "asks").mapInArrow(compare, "query_id long, id long, cosine double")
        return _best(scored, k)


def _nearest(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cells of each row from the nearest centre on."""
    return np.argsort((centres**2).sum(1) - 2 * q @ centres.T, axis=1, kind="stable")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """queries, neighbours, found and recall of an index's answers against the exact ones."""
    hits = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("neighbours"))
