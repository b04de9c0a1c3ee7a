"""Dense products over vector tables: weights as tables, block products, attention by tiles with an online softmax.

Weights are a table of blocks (name, i, j, rows, cols, data), never part of a plan. A product with weights of up to WEIGHTS bytes, which is measured,
broadcasts them and moves no row; larger ones meet blocks of rows by a join on j, and the products are summed by (rows, i).

Attention cuts queries and keys into tiles of TILE positions, each packed into one row. A task meets one tile of queries with SPAN tiles of keys, one
after another, and keeps for each query the largest score so far, the sum of exponentials and their sum of values; what the tasks of a query tile
have found is put together in the same way. So a task's memory follows the tiles' size, not the sequence's length. Sequences that are known to fit
in a tile are done whole, after one exchange.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from loomtext.functions import columns
from loomtext.sources import files
from loomtext.sources.arrow import by_bytes

BLOCK, WEIGHTS, TILE, SPAN = 512, 64 << 20, 512, 16
#: Rows in a block of a large product.
ROWS = 1_024
_LEAST = -1.7976931348623157e308
_BLOCKS = "name string, i int, j int, rows int, cols int, data binary"


def weights_table(spark: SparkSession, matrices: dict, block: int = BLOCK) -> DataFrame:
    """Matrices (output rows x input columns) as a stored table of blocks."""
    rows = []
    for name, m in matrices.items():
        m = np.asarray(m, dtype=float)
        for i in range(0, m.shape[0], block):
            for j in range(0, m.shape[1], block):
                part = m[i : i + block, j : j + block]
                rows.append((name, i // block, j // block, *part.shape, part.tobytes()))
    return files.stored(spark.createDataFrame(rows, _BLOCKS), "weights")


def _held(weights: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """Whole matrices of a table that has been measured."""
    parts: dict = {}
    for r in weights.where(F.col("name").isin(*names)).collect():
        parts.setdefault(r.name, {})[r.i, r.j] = np.frombuffer(r.data).reshape(r.rows, r.cols)
    if missing := [n for n in names if n not in parts]:
        raise ValueError(f"no weights {missing}")
    return {n: np.block([[p[i, j] for j in range(1 + max(j for _, j in p))] for i in range(1 + max(i for i, _ in p))]) for n, p in parts.items()}


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lists(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d or 1, dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(m).ravel()))


def linear(rows: DataFrame, x: str, weights: DataFrame, names: list[str], most: int = WEIGHTS) -> DataFrame:
    """rows with a column W x for each name, which takes the place of one of that name. Vectors have one length and no nulls."""
    size = weights.where(F.col("name").isin(*names)).agg(F.sum(F.octet_length("data"))).first()[0] or 0
    if size > most:
        return _linear_blocks(rows, x, weights, names)
    shared = rows.sparkSession.sparkContext.broadcast(_held(weights, names))
    kept = [c for c in rows.columns if c not in names]
    held = rows.select(F.struct(*map(columns.column, kept)).alias("row"), columns.column(x).cast("array<double>").alias("x"))

    def run(batches):
        for b in by_bytes(batches, 1, 8 << 20):
            m = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(_lists(m @ shared.value[n].T) for n in names)], names=["row", *(f"y{i}" for i in range(len(names)))])

    schema = StructType([held.schema["row"], *(StructField(f"y{i}", ArrayType(DoubleType())) for i in range(len(names)))])
    out = held.mapInArrow(run, schema)
    return columns.unpacked(out, kept, **{n: F.col(f"y{i}") for i, n in enumerate(names)})


def _linear_blocks(rows: DataFrame, x: str, weights: DataFrame, names: list[str]) -> DataFrame:
    """The product by blocks of rows and weights, joined on the block of columns."""
    width = weights.agg(F.max("cols")).first()[0]  # of a whole block
    kept = [c for c in rows.columns if c not in names]
    held = files.stored(rows.select(F.struct(*map(columns.column, kept)).alias("row"), columns.column(x).cast("array<double>").alias("x")).withColumn("id", F.monotonically_increasing_id()), "rows")

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                m, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                js = range(0, m.shape[1], width)
                yield pa.record_batch({
                    "ids": pa.array([ids.tobytes()] * len(js), pa.binary()), "at": pa.array([int(ids[0])] * len(js), pa.int64()), "j": pa.array([j // width for j in js], pa.int32()),
                    "x": pa.array([np.ascontiguousarray(m[:, j : j + width]).tobytes() for j in js], pa.binary()),
                })

    blocks = held.select("id", "x").mapInArrow(cut, "ids binary, at long, j int, x binary")
    met = blocks.join(weights.where(F.col("name").isin(*names)), "j").select("name", "at", "i", "j", "ids", "x", "rows", "cols", "data")

    def multiply(batches):
        for b in by_bytes(batches, 5, 8 << 20):
            r = b.to_pydict()
            got = [(np.frombuffer(p).reshape(-1, c) @ np.frombuffer(w).reshape(n, c).T).tobytes() for p, w, n, c in zip(r["x"], r["data"], r["rows"], r["cols"], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("name", "at", "i", "j", "ids", "rows")), pa.array(got, pa.binary())], names=["name", "at", "i", "j", "ids", "rows", "y"])

    parts = met.mapInArrow(multiply, "name string, at long, i int, j int, ids binary, rows int, y binary")

    def add(table: pa.Table) -> pa.Table:
        r = table.sort_by("j").to_pydict()
        total = np.frombuffer(r["y"][0]).copy()
        for y in r["y"][1:]:
            total += np.frombuffer(y)
        return pa.table({"name": r["name"][:1], "at": pa.array(r["at"][:1], pa.int64()), "i": pa.array(r["i"][:1], pa.int32()), "ids": pa.array(r["ids"][:1], pa.binary()), "rows": pa.array(r["rows"][:1], pa.int32()), "y": pa.array([total.tobytes()], pa.binary())})

    sums = parts.groupBy("name", "at", "i").applyInArrow(add, "name string, at long, i int, ids binary, rows int, y binary")

    def whole(table: pa.Table) -> pa.Table:
        r = table.sort_by("i").to_pydict()
        ids = np.frombuffer(r["ids"][0], dtype=np.int64)
        y = np.concatenate([np.frombuffer(v).reshape(len(ids), n) for v, n in zip(r["y"], r["rows"], strict=True)], axis=1)
        return pa.table({"name": [r["name"][0]] * len(ids), "id": ids, "y": _lists(y)})

    found = sums.groupBy("name", "at").applyInArrow(whole, "name string, id long, y array<double>")
    out = held.select("id", "row")
    for k, n in enumerate(names):
        out = out.join(found.where(F.col("name") == n).select("id", F.col("y").alias(f"y{k}")), "id")
    return columns.unpacked(out, kept, **{n: F.col(f"y{k}") for k, n in enumerate(names)})


class _Running:
    """For each head and query the largest score, the sum of exponentials and their sum of values."""

    def __init__(self, heads: int, n: int, d: int):
        self.top, self.sum, self.out = np.full((heads, n, 1), -np.inf), np.zeros((heads, n, 1)), np.zeros((heads, n, d))

    def put(self, top: np.ndarray, total: np.ndarray, out: np.ndarray) -> None:
        new = np.maximum(self.top, top)
        a, b = np.exp(self.top - new), np.exp(top - new)
        self.top, self.sum, self.out = new, self.sum * a + total * b, self.out * a + out * b

    def meet(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, keep: np.ndarray) -> None:
        s = np.where(keep, q @ k.swapaxes(1, 2) / math.sqrt(q.shape[2]), _LEAST)
        top = s.max(axis=2, keepdims=True)
        e = np.exp(s - top)
        self.put(top, e.sum(axis=2, keepdims=True), e @ v)

    def result(self) -> np.ndarray:
        """Queries x all heads' values."""
        o = self.out / self.sum
        return o.swapaxes(0, 1).reshape(o.shape[1], -1)


def _heads(m: np.ndarray, heads: int) -> np.ndarray:
    return m.reshape(len(m), heads, -1).swapaxes(0, 1)


def turned(m: np.ndarray, pos: np.ndarray, heads: int, theta: float) -> np.ndarray:
    """Rotary embedding of every head: neighbours (2k, 2k + 1) by pos * theta ** (-2k / width)."""
    x = m.reshape(len(m), heads, -1)
    angle = pos[:, None] * theta ** (-np.arange(0, x.shape[2], 2) / x.shape[2])[None, :]
    cos, sin, out = np.cos(angle)[:, None, :], np.sin(angle)[:, None, :], np.empty_like(x)
    out[..., 0::2], out[..., 1::2] = x[..., 0::2] * cos - x[..., 1::2] * sin, x[..., 0::2] * sin + x[..., 1::2] * cos
    return out.reshape(len(m), -1)


def causal(q_pos: np.ndarray, k_pos: np.ndarray) -> np.ndarray:
    return k_pos <= q_pos


def attention(q: DataFrame, k: DataFrame, keep: Callable = causal, heads: int = 1, before: bool = False, tile: int = TILE, span: int = SPAN) -> DataFrame:
    """softmax(q k^T / sqrt(d)) v of every head, whose parts stand side by side in the vectors.

    q: (b, q_pos, q); k: (b, k_pos, k, v), positions from 0, each once. keep(q_pos, k_pos), of numpy arrays: which pairs stay; others get the least double,
    so a row without any is uniform. before: no query needs keys after its own position, and each query is a key too. Result: (b, q_pos, o).
    """
    kind = dict(q.dtypes)["b"]

    def packed(parts: list[str], pos: str):
        def pack(table: pa.Table) -> pa.Table:
            at = table.column(pos).to_numpy()
            order = np.argsort(at, kind="stable")
            data = {c: pa.array([np.ascontiguousarray(_matrix(table.column(c).combine_chunks())[order]).tobytes()], pa.binary()) for c in parts}
            return pa.table({"b": table.column("b").slice(0, 1), "tile": table.column("tile").slice(0, 1), "pos": pa.array([at[order].astype(np.int64).tobytes()], pa.binary()), **data})

        return pack

    def tiles(rows: DataFrame, parts: list[str], pos: str) -> DataFrame:
        rows = rows.select("b", F.col(pos).cast("long").alias(pos), *parts, F.floor(F.col(pos) / tile).cast("long").alias("tile"))
        return rows.groupBy("b", "tile").applyInArrow(packed(parts, pos), f"b {kind}, tile long, pos binary, " + ", ".join(f"{p} binary" for p in parts))

    qt, kt = files.stored(tiles(q, ["q"], "q_pos"), "queries"), files.stored(tiles(k, ["k", "v"], "k_pos").withColumn("part", F.floor(F.col("tile") / span)), "keys")
    parts = kt.select(F.col("b").alias("kb"), F.col("part").alias("group")).distinct()
    asking = qt.select(F.col("b").alias("qb"), F.col("tile").alias("ask"))
    on = F.col("b").eqNullSafe(F.col("kb"))
    left = qt.join(parts, on & (F.col("group") * span <= F.col("tile")) if before else on).select("b", F.col("tile").alias("ask"), F.col("group").alias("part"), "pos", "q")
    on = F.col("b").eqNullSafe(F.col("qb"))
    right = kt.join(asking, on & (F.col("tile") <= F.col("ask")) if before else on).select("b", "ask", "part", "tile", "pos", "k", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["b", "ask", "part", "pos", "top", "sum", "out"]
        if not left.num_rows or not right.num_rows:  # keys alone
            none = pa.array([], pa.binary())
            return pa.table([right.column("b").slice(0, 0), *(pa.array([], pa.int64()) for _ in range(2)), *[none] * 4], names=names)
        pos = np.frombuffer(left.column("pos")[0].as_py(), dtype=np.int64)
        one = _heads(np.frombuffer(left.column("q")[0].as_py()).reshape(len(pos), -1), heads)
        run = None
        for r in right.sort_by("tile").to_pylist():
            at = np.frombuffer(r["pos"], dtype=np.int64)
            two, v = (_heads(np.frombuffer(r[c]).reshape(len(at), -1), heads) for c in ("k", "v"))
            run = run or _Running(heads, len(pos), v.shape[2])
            run.meet(one, two, v, keep(pos[:, None], at[None, :]))
        state = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (run.top, run.sum, run.out)]
        return pa.table([*(left.column(c) for c in ("b", "ask", "part", "pos")), *state], names=names)

    met = left.groupBy("b", "ask", "part").cogroup(right.groupBy("b", "ask", "part")).applyInArrow(meet, f"b {kind}, ask long, part long, pos binary, top binary, sum binary, out binary")

    def join(table: pa.Table) -> pa.Table:
        run = None
        for r in table.sort_by("part").to_pylist():
            pos = np.frombuffer(r["pos"], dtype=np.int64)
            top, total, out = (np.frombuffer(r[c]).reshape(heads, len(pos), -1) for c in ("top", "sum", "out"))
            run = run or _Running(heads, len(pos), out.shape[2])
            run.put(top, total, out)
        b = pa.concat_arrays(table.column("b").slice(0, 1).chunks).take(pa.array(np.zeros(len(pos), dtype=np.int64)))
        return pa.table({"b": b, "q_pos": pos, "o": _lists(run.result())})

    return met.groupBy("b", "ask").applyInArrow(join, f"b {kind}, q_pos long, o array<double>")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of b: those of each b as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = b.column("b").to_pylist()
        starts = [i for i in range(len(keys)) if i and keys[i] != keys[i - 1] or not i and held and keys[0] != last]
        at = 0
        for i in [*starts, len(keys)]:
            if i > at:
                held.append(b.slice(at, i - at))
            if i < len(keys):
                if held:
                    yield pa.Table.from_batches(held)
                held, at = [], i
        last = keys[-1] if keys else last
    if held:
        yield pa.Table.from_batches(held)


def short_attention(rows: DataFrame, heads: int, theta: float | None = None, keep: Callable = causal) -> DataFrame:
    """Self-attention of whole sequences: (b, pos, q, k, v) -> (b, pos, o). A sequence is held by one task, so it is for those of bounded length."""
    kind = dict(rows.dtypes)["b"]

    def run(batches):
        for t in _whole(batches):
            pos = t.column("pos").to_numpy()
            q, k, v = (_matrix(t.column(c).combine_chunks()) for c in "qkv")
            if theta:
                q, k = turned(q, pos, heads, theta), turned(k, pos, heads, theta)
            one = _Running(heads, len(pos), v.shape[1] // heads)
            one.meet(_heads(q, heads), _heads(k, heads), _heads(v, heads), keep(pos[:, None], pos[None, :]))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(t.column("b").chunks), pa.array(pos), _lists(one.result())], names=["b", "pos", "o"])

    rows = rows.select("b", F.col("pos").cast("long"), "q", "k", "v").repartition("b").sortWithinPartitions("b", "pos")
    return rows.mapInArrow(run, f"b {kind}, pos long, o array<double>")


def rotated(rows: DataFrame, names: list[str], pos: str, heads: int, theta: float) -> DataFrame:
    """rows with the vectors `names` turned by their positions, head by head."""

    def run(batches):
        for b in by_bytes(batches, names[0], 8 << 20):
            at = b.column(pos).to_numpy()
            for n in names:
                b = b.set_column(b.schema.get_field_index(n), n, _lists(turned(_matrix(b.column(n)), at, heads, theta)))
            yield b

    return rows.mapInArrow(run, rows.schema)


def self_attention(rows: DataFrame, heads: int, weights: DataFrame, theta: float | None = None, longest: int | None = None, names: tuple[str, ...] = ("wq", "wk", "wv", "wo"), most: int = WEIGHTS, tile: int = TILE) -> DataFrame:
    """Causal multi-head self-attention with weights from a table: (b, pos, x) -> (b, pos, y). longest: positions that no sequence passes, if known; a position
    beyond raises."""
    pos = F.col("pos")
    if longest is not None:
        pos = F.when((pos >= 0) & (pos < longest), pos).otherwise(F.raise_error(F.lit("position out of range")).cast("long"))
    wq, wk, wv, wo = names
    rows = linear(rows.select("b", pos.cast("long").alias("pos"), "x"), "x", weights, [wq, wk, wv], most).select("b", "pos", F.col(wq).alias("q"), F.col(wk).alias("k"), F.col(wv).alias("v"))
    if longest is not None and longest <= tile:
        o = short_attention(rows, heads, theta)
    else:
        if theta:
            rows = rotated(rows, ["q", "k"], "pos", heads, theta)
        rows = files.stored(rows, "vectors")  # projected once, then read as queries and as keys
        o = attention(rows.select("b", F.col("pos").alias("q_pos"), "q"), rows.select("b", F.col("pos").alias("k_pos"), "k", "v"), causal, heads, True, tile).withColumnRenamed("q_pos", "pos")
    return linear(o, "o", weights, [wo], most).select("b", "pos", F.col(wo).alias("y"))
