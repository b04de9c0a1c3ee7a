"""Embedding whitening by a matrix-free block subspace iteration.

Components become integers, x = floor(scale * c). The fit list holds each distinct x once. Its covariance V is never formed: a pass over the stored
list multiplies the centred rows with a block Q of a few columns, Xᵀ(XQ)/n, and the tasks' matrices, of the size of Q, are summed in a
tree. On the driver, which holds only matrices of `dimensions` rows, QR makes the block orthonormal and Rayleigh-Ritz takes the best
directions; passes go on until the residual |Vq - eq| of every component wanted is at most TOLERANCE of the largest eigenvalue.

Each next block is the part of V times the best directions that is new, and earlier blocks stay in the basis of the Rayleigh-Ritz step, up to `most`
columns, when the best directions replace it. Without that a block iteration gains only the ratio of neighbouring eigenvalues in a
pass, some 0.96 on near-even spectra as those of the test tables, and would take hundreds of passes; so it takes four in 64 dimensions.

Means are exact: column sums are decimals. Sums over rows are made in double precision in an order fixed by the stored files, so reruns
over the same files agree. Every pass reads a written table, so a lost executor costs its tasks only.

Edge cases: vectors that are null or hold null or non-finite components are dropped; rows with a null or a repeated id stay, each for itself;
vectors of different lengths are as if padded with 0; components beyond 64 bits after scaling are the nearest long; a `deviation` beyond 64 bits is
null; a component whose eigenvalue is 0 to double precision can't be whitened, so its rows are left out, and with one distinct vector, or none,
the result is empty; other columns of vectors are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialize

K, SCALE, BLOCK, BASIS = 4, 256.0, 16, 256
#: A residual counts as none below this part of the largest eigenvalue; PASSES are the most that are made, and STALL a residual good enough
#: where rounding lets it fall no further.
TOLERANCE, STALL, PASSES = 1e-13, 1e-11, 400
#: Matrices that one task of the tree adds up.
FAN = 32


@dataclass
class Whitening:
    """A fitted model: integer column sums over n distinct vectors, eigenvalues falling, one unit eigenvector a column."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    residuals: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # correctly rounded quotients of integers


def integers(vectors: DataFrame, scale: float = SCALE, vector: str = "embedding") -> DataFrame:
    """Rows of vectors that can be used, with x, an array of longs of one length."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # (floor of a double is a long, the nearest one where it doesn't fit; adding 0 makes -0 a 0)
    rows = vectors.where(F.col(vector).isNotNull() & good).withColumn("x", F.transform(vector, lambda v: F.floor(F.lit(scale) * v.cast("double")) + F.lit(0).cast("long")))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("x"))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches, width: int):
    """The rows' integers in matrices of some MB, whatever their width."""
    rows = max(1, (8 << 20) // (8 * max(1, width)))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield _matrix(b.column(0).slice(at, rows))


def tree_sum(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices in a table (part, data), doubles in bytes; FAN of them at a time, in order of their part, until one task's are left."""

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        data = table.column("data").to_pylist()
        out = np.zeros(shape)
        for i in order:
            out += np.frombuffer(data[i]).reshape(shape)
        return pa.table({"part": pa.array([table.column("next")[0].as_py()], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    n = parts.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.withColumn("next", F.floor(F.col("part") / FAN)).groupBy("next").applyInArrow(add, "part long, data binary")
    out = np.zeros(shape)
    for r in sorted(parts.select("part", "data").toLocalIterator(), key=lambda r: r.part):
        out += np.frombuffer(r.data).reshape(shape)
    return out


def _one_per_task(rows: DataFrame, shape: tuple[int, int], work) -> np.ndarray:
    """The sum over all rows of work(matrix of integers), which gives a matrix of that shape."""

    def run(batches):
        from pyspark import TaskContext

        out = np.zeros(shape)
        for x in _slices(batches, width):
            out += work(x)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["part", "data"])

    width = shape[0]
    return tree_sum(rows.select("x").mapInArrow(run, "part long, data binary"), shape)


def product(rows: DataFrame, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Σ (x - mean)(x - mean)ᵀ q and Σ |x - mean|², in one pass."""
    d, b = q.shape

    def work(x: np.ndarray) -> np.ndarray:
        c = x - mean
        out = np.empty((d, b + 1))
        out[:, :b] = c.T @ (c @ q)
        out[:, b] = (c * c).sum(axis=0)
        return out

    got = _one_per_task(rows, (d, b + 1), work)
    return got[:, :b], float(got[:, b].sum())


def column_sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sums of the columns of x."""

    def run(batches):
        total = [0] * d
        for x in _slices(batches, d):  # halves of 32 bits add up in 64 without overflow
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + lo for t, h, lo in zip(total, high, low, strict=True)]
        yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], names=["i", "s"])

    got = rows.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by = {r.i: int(r.s) for r in got.collect()}  # a row for each dimension
    return [by.get(i, 0) for i in range(d)]


def orthonormal(y: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of what y adds to the basis; directions of which less than `least` is left are dropped."""
    for _ in range(2):
        y = y - basis @ (basis.T @ y)
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    q = u[:, s > least]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def top_components(multiply, d: int, k: int, block: int = BLOCK, most: int = BASIS, seed: int = 7):
    """(values, vectors, passes, residuals) of the k largest eigenvalues of a symmetric matrix that only multiplies blocks: multiply(q)."""
    k, block = min(k, d), min(block, d)
    most = min(d, max(most, 2 * block + 2 * k))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    u, au = np.zeros((d, 0)), np.zeros((d, 0))
    best = np.inf
    stalled = 0
    for passes in range(1, PASSES + 1):
        au = np.concatenate([au, multiply(q)], axis=1)
        u = np.concatenate([u, q], axis=1)
        t = u.T @ au
        values, w = np.linalg.eigh((t + t.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        scale = max(values[0], 0.0)
        keep = min(u.shape[1], block)
        x, ax = u @ w[:, :keep], au @ w[:, :keep]
        off = ax - x * values[:keep]
        residuals = np.sqrt((off * off).sum(axis=0))[:k]
        if scale == 0 or len(residuals) == k and residuals.max() <= TOLERANCE * scale:
            break
        stalled = stalled + 1 if residuals.max() > 0.5 * best else 0
        best = min(best, residuals.max())
        if stalled >= 3 and best <= STALL * scale:
            break
        if u.shape[1] + block > most and u.shape[1] < d:  # start again from the best directions
            hold = min(u.shape[1], most - block)
            u, au = u @ w[:, :hold], au @ w[:, :hold]
        q = orthonormal(off, u, 1e-15 * scale)
        if not q.shape[1]:  # the basis is invariant to double precision, or the whole space
            if residuals.max() > STALL * scale:  # rounding has made its products stale: multiply the best directions anew
                u, au, q = np.zeros((d, 0)), np.zeros((d, 0)), np.linalg.qr(x)[0]
                continue
            break
    else:
        raise ArithmeticError(f"residuals {residuals.tolist()} after {PASSES} passes")
    x = np.linalg.qr(x[:, :k])[0] * np.sign(np.sum(np.linalg.qr(x[:, :k])[0] * x[:, :k], axis=0))
    return values[:k], x, passes, residuals


def fit(rows: DataFrame, k: int = K, block: int = BLOCK, most: int = BASIS) -> tuple[Whitening, DataFrame]:
    """The model of rows with integers x, and the stored fit list."""
    distinct, _ = materialize(rows.select("x").distinct(), "fit")
    n, d = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    d = d or 0
    if n < 2 or d == 0:
        return Whitening(n, [0] * d, np.zeros(0), np.zeros((d, 0)), 0.0, 0, np.zeros(0)), distinct
    sums = column_sums(distinct, d)
    mean, trace = np.array([s / n for s in sums]), []

    def multiply(q):
        y, squares = product(distinct, mean, q)
        trace.append(squares / n)
        return y / n

    values, vectors, passes, residuals = top_components(multiply, d, k, block, most)
    real = values > 1e-12 * trace[0]  # the others are 0 to double precision
    return Whitening(n, sums, values[real], vectors[:, real], trace[0], passes, residuals), distinct


def identity_error(model: Whitening, distinct: DataFrame) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, by a pass of its own."""
    k = len(model.values)
    if not k:
        return 0.0
    mean, scaled, d = model.mean, model.vectors / np.sqrt(model.values), len(model.sums)

    def work(x: np.ndarray) -> np.ndarray:
        out = np.zeros((d, max(k * k, 1)))
        z = (x - mean) @ scaled
        out[0, :] = (z.T @ z).ravel()
        return out

    covariance = _one_per_task(distinct, (d, k * k), work)[0].reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Σ (n x - S)² a row, exactly; null beyond 64 bits."""
    most = 2 * n * max(int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, *(abs(s) // n + 1 for s in sums))
    if most * most * len(sums) < 2**63:
        off = n * x - np.array(sums, dtype=np.int64)
        return pa.array((off * off).sum(axis=1), pa.int64())
    off = n * x.astype(object) - np.array(sums, dtype=object)
    return pa.array([s if s < 2**63 else None for s in (off * off).sum(axis=1).tolist()], pa.int64())


def apply(rows: DataFrame, model: Whitening, identity: float, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every row and component."""
    k = len(model.values)
    mean, scaled, share = model.mean, model.vectors / np.sqrt(model.values), model.values / model.trace if k else np.zeros(0)
    schema = f"`{key}` {dict(rows.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    width = max(1, len(model.sums))
    shared = rows.sparkSession.sparkContext.broadcast((mean, scaled, model.sums))  # the size of a few vectors

    def run(batches):
        mean, scaled, sums = shared.value
        step = max(1, (8 << 20) // (8 * width))
        for b in batches:
            for at in range(0, b.num_rows if k else 0, step):
                part = b.slice(at, step)
                x = _matrix(part.column(1))
                z, m = (x - mean) @ scaled, len(x)
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch([
                    part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model_n)), _deviation(x, model_n, sums).take(again),
                    pa.array(z.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, identity)),
                ], names=names)

    model_n = model.n
    return rows.select(key, "x").mapInArrow(run, schema)


def whiten(embeddings: DataFrame, k: int = K, scale: float = SCALE) -> DataFrame:
    """Whitened coordinates of all usable vectors along the k first components of the distinct ones."""
    rows, _ = materialize(integers(embeddings.select("vec_id", "embedding"), scale).select("vec_id", "x"), "vectors")
    model, distinct = fit(rows, k)
    return apply(rows, model, identity_error(model, distinct))
