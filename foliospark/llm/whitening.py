"""Whitening of embeddings: leading components of their covariance by a block Jacobi-Davidson
method. The covariance is never formed; every product with it is a Spark job over the vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import cut, table

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries must be smaller, so that the whole numbers made of them are exact as doubles.
LARGEST = 2.0**42
#: Steps of the inner solver, largest subspace, and Ritz vectors kept when it is full.
INNER, SUBSPACE, KEPT = 3, 56, 24
#: Tasks that add up what the others found; the driver gets as many small matrices.
ADDERS = 8
MOST_ROUNDS = 300


def minres(op: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for the columns of ``b`` side by side, each with its own symmetric operator:
    ``op(v)`` applies all of them in one product. Columns that are solved stay as they are."""
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(b), b / np.where(live, beta, 1)
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    eta, c_old, c, s_old, s = beta.copy(), *(np.full_like(beta, k) for k in (1, 1, 0, 0))
    for n in range(steps):
        before = beta if n else 0
        if not live.any():
            break
        p = op(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - before * v_old
        after = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * before
        r1 = np.hypot(delta, after)
        r2 = s * alpha + c_old * c * before
        r3 = s_old * before
        live &= r1 > 1e-300
        safe = np.where(live, r1, 1)
        c_old, s_old, c, s = c, s, delta / safe, after / safe
        w_old, w = w, (v - r3 * w_old - r2 * w) / safe
        x += np.where(live, c * eta, 0) * w
        eta = -s * eta
        live &= after > 1e-14 * beta.max()
        v_old, v, beta = v, p / np.where(after > 0, after, 1), after
    return x


def orthonormal(new: np.ndarray, *to: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to those of ``to`` and to each other; what lies in
    their span already goes."""
    basis = np.concatenate([x for x in to], axis=1)
    out: list[np.ndarray] = []
    for t in new.T:
        size = np.linalg.norm(t)
        if not size > 0:
            continue
        t = t / size
        for _ in range(3):
            t = t - basis @ (basis.T @ t)
            for q in out:
                t = t - q * (q @ t)
            if (left := np.linalg.norm(t)) < 1e-10:
                break
            t = t / left
        else:
            out.append(t)
    return np.stack(out, axis=1) if out else np.empty((len(new), 0))


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, inner: int = INNER, subspace: int = SUBSPACE, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors.

    A block Jacobi-Davidson iteration: Rayleigh-Ritz in a subspace; pairs from the largest on whose
    residual is down to rounding are locked and deflated; the others' correction equations,
    projected against the locked and the current vectors, are solved by a few steps of MINRES, all
    at once, and widen the subspace, which restarts from its best vectors when full. Ends when all
    residuals are within rounding of the product: 1e-14 of the largest eigenvalue, or below 1e-12
    of it and no longer falling.
    """
    rng = np.random.default_rng(13)
    locked, values = np.empty((d, 0)), []
    v = orthonormal(rng.standard_normal((d, min(d, k + 4))), locked)
    av = product(v)
    best, stuck = np.inf, 0
    for _ in range(MOST_ROUNDS):
        h = v.T @ av
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        v, av = v @ s, av @ s
        need = k - len(values)
        residual = av[:, :need] - v[:, :need] * theta[:need]
        sizes = np.linalg.norm(residual - locked @ (locked.T @ residual), axis=0)
        top = max([abs(theta[0]), *map(abs, values)])
        whole = v.shape[1] + locked.shape[1] >= d
        stuck = stuck + 1 if sizes.max() > best / 2 else 0
        best = min(best, sizes.max())
        floor = 1e-12 if stuck >= 3 or whole else 1e-14
        done = 0
        while done < need and sizes[done] <= floor * top:
            done += 1
        if done:
            locked = np.concatenate((locked, v[:, :done]), axis=1)
            values += theta[:done].tolist()
            v, av, theta, residual = v[:, done:], av[:, done:], theta[done:], residual[:, done:]
            best, stuck = np.inf, 0
        need = k - len(values)
        if need == 0:
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], locked[:, order]
        if v.shape[1] + need > min(subspace, d):
            v, av, theta = v[:, :kept], av[:, :kept], theta[:kept]
        beside = np.concatenate((locked, v[:, :need]), axis=1)
        project = lambda t, q=beside: t - q @ (q.T @ t)
        shifts = theta[:need]
        shifted = lambda t: project(product(t) - t * shifts)  # noqa: E731, B023
        step = minres(shifted, -project(residual), inner)
        new = orthonormal(step, locked, v)
        if new.shape[1] == 0:
            new = orthonormal(rng.standard_normal((d, need)), locked, v)
        if new.shape[1] == 0:  # the subspace is the whole space, its products are made anew
            av = product(v)
            continue
        v, av = np.concatenate((v, new), axis=1), np.concatenate((av, product(new)), axis=1)
    raise RuntimeError(f"residuals did not fall to rounding in {MOST_ROUNDS} rounds")


def _block(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _added(df: DataFrame, run, width: int) -> np.ndarray:
    """The sum of one matrix a task: ``run`` turns a task's batches into a float64 matrix of
    ``width`` columns (or None). A few tasks add them up before the driver does."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = run(batches)
        if m is not None:
            yield pa.RecordBatch.from_pydict({"m": [np.ascontiguousarray(m, np.float64).tobytes()]})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total = total + np.frombuffer(m, np.float64)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    rows = df.mapInArrow(first, "m binary").repartition(ADDERS).mapInArrow(again, "m binary").collect()
    return sum((np.frombuffer(r["m"], np.float64) for r in rows), np.zeros(1)).reshape(-1, width)


class Fit:
    """The whole-number vectors of a table (column ``x``) with their count, sums, and centred
    products. ``base`` is near the mean, so centred entries are small and exact up to it."""

    def __init__(self, df: DataFrame, d: int):
        self.df, self.d = df, d
        self.n, self.sums = self._moments()
        self.base = np.array([s // self.n for s in self.sums]) if self.n else np.zeros(d, np.int64)
        self.shift = np.array([(s - self.n * int(b)) / self.n for s, b in zip(self.sums, self.base, strict=True)]) if self.n else np.zeros(d)

    def _moments(self) -> tuple[int, list[int]]:
        """Rows, and exact sums a dimension. Entries are cut into two
        parts whose sums over a task are exact."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
            for batch in batches:
                x = _block(batch.column(0))
                n += len(x)
                high += (x >> 26).sum(0)
                low += (x & ((1 << 26) - 1)).sum(0)
            yield pa.RecordBatch.from_pydict({"i": list(range(d)), "n": [n] * d, "high": high, "low": low})

        parts = self.df.select("x").mapInArrow(run, "i long, n long, high long, low long")
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        rows = parts.groupBy("i").agg(F.sum("n").alias("n"), wide("high"), wide("low")).orderBy("i").collect()
        if not rows or not rows[0]["n"]:
            return 0, [0] * d
        return rows[0]["n"], [(int(r["high"]) << 26) + int(r["low"]) for r in rows]

    def centring(self, at: int = 0) -> Callable[[pa.RecordBatch], np.ndarray]:
        """What makes centred rows of a batch's column; holds nothing of the session."""
        base, shift = self.base, self.shift
        return lambda batch: (_block(batch.column(at)) - base).astype(np.float64) - shift

    def trace(self) -> float:
        centred = self.centring()

        def run(batches):
            return np.array([[sum(float((y * y).sum()) for y in map(centred, batches))]])

        return float(_added(self.df.select("x"), run, 1)[0, 0]) / self.n

    def product(self, u: np.ndarray) -> np.ndarray:
        """The covariance times ``u``, in one pass over the vectors."""
        centred, d = self.centring(), self.d

        def run(batches):
            total = np.zeros((d, u.shape[1]))
            for y in map(centred, batches):
                total += y.T @ (y @ u)
            return total

        return _added(self.df.select("x"), run, u.shape[1]) / self.n


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and x, the entries as whole numbers, of the vectors that can be used, and their
    length: that of most of them (the smallest of such lengths)."""
    v = F.col(f"`{column}`")
    usable = vectors.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(SCALE * c.cast("double")) < LARGEST)))
    lengths = usable.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths["d"] if lengths else 1
    x = F.transform(v, lambda c: F.floor(SCALE * c.cast("double")).cast("long") + SHIFT)
    return usable.where(F.size(v) == d).select("vec_id", x.alias("x")), d


def deviations(x: np.ndarray, n: int, sums: list[int], base: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 of each row, exact; None where no long holds it."""
    y = x - base
    rest = [s - n * int(b) for s, b in zip(sums, base, strict=True)]
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
    if most * most * x.shape[1] < 1 << 63:
        t = n * y - np.array(rest, np.int64)
        return (t * t).sum(1).tolist()
    t = n * y.astype(object) - np.array(rest, object)
    return [s if s < 1 << 63 else None for s in (t * t).sum(1)]


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable vector
    and each of the leading components of all of them.

    Rows go whose vector is null or empty, holds a null, NaN, infinity or an entry of 2^32 or more,
    or has another length than most. Repeated rows and ids count and are returned each; null ids
    stay. No usable row gives no rows. There are as many components as dimensions if fewer than
    asked for. A component without variance (equal vectors, one vector) has null ``whitened`` and
    explains 0; ``identity_error`` is over the others, null without any. ``deviation`` is null where
    it exceeds a long. Eigenvectors of equal eigenvalues are any basis of their space. Other
    columns, whatever their names, are ignored.

    The vectors are written once to the shared folder; each product with the covariance is one
    pass over them, of which a few matrices (dimensions x components) reach the driver.
    """
    spark = vectors.sparkSession
    chosen, d = whole_numbers(vectors, column)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    chosen = cut(chosen.select(F.col("vec_id").cast("long"), "x"))
    fit = Fit(chosen, d)
    if fit.n == 0:
        return spark.createDataFrame([], schema)
    k = min(components, d)
    trace = fit.trace()
    values, axes = leading(fit.product, d, k) if trace > 0 else (np.zeros(k), np.eye(d)[:, :k])
    held = values > trace * d * np.finfo(float).eps
    turn = axes / np.sqrt(np.where(held, values, np.inf))
    explained = np.where(held, values / trace if trace > 0 else 0.0, 0.0)
    centred, second = fit.centring(), fit.centring(1)

    def gram(batches):
        total = np.zeros((k + 1, k))
        for y in map(centred, batches):
            w = y @ turn
            total += np.concatenate((w.T @ w, w.sum(0, keepdims=True)))
        return total

    seen = _added(chosen.select("x"), gram, k) / fit.n
    off = np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k))[np.ix_(held, held)]
    error = float(off.max()) if held.any() else None
    n, sums, base = fit.n, fit.sums, fit.base

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            w = second(batch) @ turn
            far = pa.array(deviations(_block(batch.column(1)), n, sums, base), pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    far.take(each),
                    pa.array(w.ravel(), mask=np.tile(~held, m)),
                    pa.array(np.tile(explained, m)),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return chosen.mapInArrow(rows, schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
