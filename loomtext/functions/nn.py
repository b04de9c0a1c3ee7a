"""Neural forward operators over ARRAY<DOUBLE> columns and vector tables. Weights are given as Python lists."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import columns
from loomtext.sources.arrow import by_bytes


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def let(value: Column, f) -> Column:
    """f(value) with value computed once, even if f names it often or inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def weights(w) -> Column:
    """A list of numbers, or of lists of them, as one constant, which the optimizer folds: one string to plan, not a column per number."""

    def text(x) -> str:
        if isinstance(x, (list, tuple, np.ndarray)):
            return "[" + ",".join(map(text, x)) + "]"
        x = float(x)
        return repr(x) if math.isfinite(x) else "NaN" if math.isnan(x) else f'"{"-" * (x < 0)}Infinity"'

    kind, x = "double", w
    while isinstance(x, (list, tuple, np.ndarray)):
        kind, x = f"array<{kind}>", x[0] if len(x) else 0.0
    return F.from_json(F.lit(text(w)), kind)


def linear(x: Column, w: list[list[float]]) -> Column:
    """x W^T, no bias; w: output rows."""
    return let(x, lambda v: F.transform(weights(w), lambda row: dot(row, v)))


def embedding(ids: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Row lookup as a join."""
    return ids.join(table, on)


def rmsnorm(x: Column, w: list[float], eps: float = 1e-5) -> Column:
    scale = lambda y: F.sqrt(dot(y, y) / F.size(y) + F.lit(eps))
    return let(x, lambda y: let(scale(y), lambda s: F.zip_with(y, weights(w), lambda a, b: a / s * b)))


def softmax(x: Column) -> Column:
    """Over the array, shifted by its maximum."""
    e = lambda y: let(F.array_max(y), lambda m: F.transform(y, lambda v: F.exp(v - m)))
    return let(x, lambda y: let(e(y), lambda z: let(total(z), lambda t: F.transform(z, lambda v: v / t))))


def softmax_over(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """rows with `value` replaced by its softmax over rows that share the columns `by`: any axis of a tensor in long form.

    The maxima and the sums are aggregates, summed up map-side, and joined back: no group's rows need lie in one task. Null keys
    form a group. Columns may have any names.
    """
    key = F.struct(*(columns.column(c).alias(f"k{i}") for i, c in enumerate(by))) if by else F.lit(0)
    held = rows.select(columns.whole_row(rows).alias("row"), columns.column(value).alias("x"), key.alias("key"))

    def beside(held: DataFrame, found: DataFrame) -> DataFrame:
        found = found.withColumnRenamed("key", "group")
        return held.join(found, F.col("key").eqNullSafe(F.col("group"))).drop("group")

    e = beside(held, held.groupBy("key").agg(F.max("x").alias("top"))).select("row", "key", F.exp(F.col("x") - F.col("top")).alias("x"))
    out = beside(e, e.groupBy("key").agg(F.sum("x").alias("sum")))
    return columns.unpacked(out, rows.columns, **{value: F.col("x") / F.col("sum")})


def sigmoid(v: Column) -> Column:
    """Without overflow for large negative values."""
    return F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v)))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v * sigmoid(v))


def feed_forward_size(d_model: int) -> int:
    """8/3 of the model size, to the nearest multiple of 64, at least 64."""
    return max(64, round(8 * d_model / 3 / 64) * 64)


def swiglu(x: Column, w1, w2, w3) -> Column:
    """W2 (SiLU(W1 x) * W3 x)."""
    return let(x, lambda y: linear(F.zip_with(silu(linear(y, w1)), linear(y, w3), lambda a, b: a * b), w2))


def rope(x: Column, position: Column, d: int, theta: float = 10_000.0, longest: int | None = None) -> Column:
    """Rotates neighbours (2k, 2k + 1) by position * theta ** (-2k / d). Odd d raises ValueError, a position outside
    [0, longest) raises when computed."""
    if d % 2:
        raise ValueError("d must be even")
    if longest is not None:
        position = F.when((position >= 0) & (position < longest), position).otherwise(F.raise_error(F.lit("position out of range")).cast("int"))
    rate = weights([theta ** (-2 * k / d) for k in range(d // 2)])
    angle = lambda p, i: p * F.get(rate, F.floor(i / 2).cast("int"))
    other = lambda y, i: F.when(i % 2 == 0, -F.get(y, i + 1)).otherwise(F.get(y, i - 1))
    turn = lambda y, p: F.transform(y, lambda v, i: v * F.cos(angle(p, i)) + other(y, i) * F.sin(angle(p, i)))
    return let(x, lambda y: let(position, lambda p: turn(y, p)))


#: Keys in a block: what a query meets at once.
KEYS = 128
_LEAST = -1.7976931348623157e308


def attention(q: DataFrame, k: DataFrame, keep, d: int, before: bool = False, keys: int = KEYS) -> DataFrame:
    """softmax(q k^T / sqrt(d)) v by a join on `b` (batch or batch and head).

    q: (b, q_pos, q); k: (b, k_pos, k, v), positions from 0. keep(q_pos, k_pos): which pairs stay; others get the least double, so a row without
    any is uniform. before: no query needs keys after its own position, which holds for a causal mask if each query is a key too; the join then
    leaves out blocks that lie behind it. Result: (b, q_pos, o).

    Keys are put into blocks, arrays of `keys` positions, and a query meets a block as a whole: it takes the largest score, the sum of the
    exponentials and their sum of values, and a query's blocks are put together at the end by their largest score. So vectors are never
    taken apart, a pair of query and block is one row of bounded size, and long sequences spread over many tasks.
    """
    block = k.groupBy("b", F.floor(F.col("k_pos") / keys).alias("block")).agg(F.array_sort(F.collect_list(F.struct("k_pos", "k", "v"))).alias("keys"))
    block = block.withColumnRenamed("b", "_b")
    on = F.col("b").eqNullSafe(F.col("_b"))
    met = q.join(block, on & (F.col("block") * keys <= F.col("q_pos")) if before else on).drop("_b")
    score = lambda x: F.when(keep(F.col("q_pos"), x["k_pos"]), dot(F.col("q"), x["k"]) / math.sqrt(d)).otherwise(F.lit(_LEAST))
    met = met.select("b", "q_pos", "block", "keys", F.transform("keys", score).alias("s"))
    met = met.select("b", "q_pos", "block", "keys", "s", F.array_max("s").alias("top"))
    met = met.select("b", "q_pos", "block", "keys", "top", F.transform("s", lambda v: F.exp(v - F.col("top"))).alias("e"))
    part = met.select("b", "q_pos", F.struct("block", "top", total(F.col("e")).alias("sum"), _weighted(F.col("e"), F.transform("keys", lambda x: x["v"])).alias("o")).alias("part"))
    parts = part.groupBy("b", "q_pos").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # a query's blocks, a vector each
    parts = parts.select("b", "q_pos", "parts", F.array_max(F.transform("parts", lambda p: p["top"])).alias("top"))
    parts = parts.select("b", "q_pos", "parts", F.transform("parts", lambda p: F.exp(p["top"] - F.col("top"))).alias("w"))
    parts = parts.select("b", "q_pos", _weighted(F.col("w"), F.transform("parts", lambda p: p["o"])).alias("o"), dot(F.col("w"), F.transform("parts", lambda p: p["sum"])).alias("sum"))
    return parts.select("b", "q_pos", F.transform("o", lambda v: v / F.col("sum")).alias("o"))


def _weighted(w: Column, vectors: Column) -> Column:
    """The sum of vectors, each times its weight."""
    zero = F.transform(F.element_at(vectors, 1), lambda v: F.lit(0.0))
    return F.aggregate(F.arrays_zip(w.alias("w"), vectors.alias("x")), zero, lambda acc, t: F.zip_with(acc, t["x"], lambda a, v: a + t["w"] * v))


def causal(q_pos: Column, k_pos: Column) -> Column:
    return k_pos <= q_pos


def self_attention(rows: DataFrame, heads: int, d: int, wq, wk, wv, wo, rope_theta: float | None = None, longest: int | None = None) -> DataFrame:
    """Causal multi-head self-attention. rows: (b, pos, x). Result: (b, pos, y)."""
    h = d // heads
    proj = rows.select("b", "pos", linear(F.col("x"), wq).alias("q"), linear(F.col("x"), wk).alias("k"), linear(F.col("x"), wv).alias("v"))
    split = proj.select("b", "pos", "q", "k", "v", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("h"))
    part = lambda c: F.slice(c, F.col("h") * h + 1, h)
    turn = (lambda c: rope(c, F.col("pos"), h, rope_theta, longest)) if rope_theta else (lambda c: c)
    split = split.select(F.struct("b", "h").alias("b"), "pos", part("q").alias("q"), part("k").alias("k"), part("v").alias("v"))
    split = split.select("b", "pos", turn(F.col("q")).alias("q"), turn(F.col("k")).alias("k"), "v")
    o = attention(split.select("b", F.col("pos").alias("q_pos"), "q"), split.select("b", F.col("pos").alias("k_pos"), "k", "v"), causal, h, before=True)
    joined = o.groupBy(F.col("b.b").alias("b"), F.col("q_pos").alias("pos")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("b.h").alias("h"), "o"))), lambda r: r["o"])).alias("o"))
    return joined.select("b", "pos", linear(F.col("o"), wo).alias("y"))


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def transformer_block(rows: DataFrame, heads: int, d: int, p: dict, rope_theta: float | None = 10_000.0, longest: int | None = None) -> DataFrame:
    """Pre-norm block: x += attention(norm x); x += swiglu(norm x). p: ln1, ln2, wq, wk, wv, wo, w1, w2, w3."""
    normed = rows.select("b", "pos", rmsnorm(F.col("x"), p["ln1"]).alias("x"))
    y = self_attention(normed, heads, d, p["wq"], p["wk"], p["wv"], p["wo"], rope_theta, longest)
    x = rows.join(y, ["b", "pos"]).select("b", "pos", add(F.col("x"), F.col("y")).alias("x"))
    return x.select("b", "pos", add(F.col("x"), swiglu(rmsnorm(F.col("x"), p["ln2"]), p["w1"], p["w2"], p["w3"])).alias("x"))


#: Names of a layer's weights, and other names they go by.
LAYER = ("ln1.weight", "ln2.weight", "attn.q_proj.weight", "attn.k_proj.weight", "attn.v_proj.weight", "attn.output_proj.weight", "ffn.w1.weight", "ffn.w2.weight", "ffn.w3.weight")
RENAMED = {"attn.o_proj.weight": "attn.output_proj.weight", "transformer_blocks.": "layers."}


def _renamed(name: str) -> str:
    for old, new in RENAMED.items():
        if name.startswith(old) and old.endswith(".") or name.endswith(old) and not old.endswith("."):
            name = name.replace(old, new)
    return name


def block_state(state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights of one block by the parameter names of transformer_block. Strict: names missing, unknown or given twice, and sizes that don't
    fit together, raise ValueError."""
    got = _strict(state, LAYER)
    d = got["ln1.weight"].shape[-1]
    ff = got["ffn.w1.weight"].shape[0]
    want = dict.fromkeys(LAYER, (d, d)) | {"ln1.weight": (d,), "ln2.weight": (d,), "ffn.w1.weight": (ff, d), "ffn.w2.weight": (d, ff), "ffn.w3.weight": (ff, d)}
    _fit(got, want)
    short = {"attn.q_proj": "wq", "attn.k_proj": "wk", "attn.v_proj": "wv", "attn.output_proj": "wo"}
    return {short.get(n.removesuffix(".weight"), n.removesuffix(".weight").removeprefix("ffn.")): got[n] for n in LAYER}


def lm_state(state: dict[str, np.ndarray], layers: int) -> dict[str, np.ndarray]:
    """The state of a language model under its usual names; layers may be called transformer_blocks, and output_proj o_proj. Strict, as block_state."""
    top = ("token_embeddings.weight", "ln_final.weight", "lm_head.weight")
    got = _strict(state, [*top, *(f"layers.{i}.{n}" for i in range(layers) for n in LAYER)])
    v, d = got["token_embeddings.weight"].shape
    _fit(got, {"ln_final.weight": (d,), "lm_head.weight": (v, d)})
    for i in range(layers):
        block_state({n: got[f"layers.{i}.{n}"] for n in LAYER})
        _fit(got, {f"layers.{i}.ln1.weight": (d,)})
    return got


def _strict(state: dict, names) -> dict[str, np.ndarray]:
    got: dict[str, np.ndarray] = {}
    for name, w in state.items():
        if (new := _renamed(name)) in got:
            raise ValueError(f"{new} is given twice")
        got[new] = np.asarray(w, dtype=float)
    if wrong := [f"missing {n}" for n in names if n not in got] + [f"unknown {n}" for n in got if n not in set(names)]:
        raise ValueError("; ".join(wrong))
    return got


def _fit(got: dict, want: dict) -> None:
    if wrong := [f"{n} is {got[n].shape}, not {shape}" for n, shape in want.items() if got[n].shape != shape]:
        raise ValueError("; ".join(wrong))


#: Bytes of logits that a task makes at once, beyond those of one sequence.
LOGITS = 64 << 20


def lm_logits(tokens: DataFrame, state: dict[str, np.ndarray], layers: int, heads: int, theta: float = 10_000.0) -> DataFrame:
    """Transformer LM over rows (b, ids): (b, logits), logits flattened over positions. Whole sequences are computed in
    Arrow batches, since one is a dense tensor program. The state is checked first (lm_state)."""
    state = lm_state(state, layers)
    shared = tokens.sparkSession.sparkContext.broadcast(state)  # the model's size, not the data's

    def run(batches):
        vocabulary = len(shared.value["lm_head.weight"])
        for b in by_bytes(batches, "ids", max(1, LOGITS // vocabulary)):  # the logits of few sequences at a time
            got = [lm_forward(np.array(ids, dtype=int), shared.value, layers, heads, theta).ravel() for ids in b.column("ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("b"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(got)))], names=["b", "logits"])

    return tokens.select("b", "ids").mapInArrow(run, f"b {dict(tokens.dtypes)['b']}, logits array<double>")


def lm_forward(ids: np.ndarray, s: dict[str, np.ndarray], layers: int, heads: int, theta: float) -> np.ndarray:
    """Logits, positions x vocabulary."""
    x = s["token_embeddings.weight"][ids]
    n, d = x.shape
    h = d // heads
    norm = lambda x, w: x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + 1e-5) * w
    angle = np.arange(n)[:, None] * theta ** (-np.arange(0, h, 2) / h)[None, :]
    cos, sin = np.cos(angle), np.sin(angle)

    def turn(v):
        out = np.empty_like(v)
        out[..., 0::2], out[..., 1::2] = v[..., 0::2] * cos - v[..., 1::2] * sin, v[..., 0::2] * sin + v[..., 1::2] * cos
        return out

    for i in range(layers):
        w = lambda name: s[f"layers.{i}.{name}.weight"]  # noqa: B023, E731
        y = norm(x, w("ln1"))
        q, k, v = ((y @ w(f"attn.{c}_proj").T).reshape(n, heads, h).swapaxes(0, 1) for c in "qkv")
        a = turn(q) @ turn(k).swapaxes(1, 2) / math.sqrt(h)
        a = np.where(np.tril(np.ones((n, n), dtype=bool)), a, -np.inf)
        a = np.exp(a - a.max(axis=-1, keepdims=True))
        a = a / a.sum(axis=-1, keepdims=True)
        x = x + (a @ v).swapaxes(0, 1).reshape(n, d) @ w("attn.output_proj").T
        y = norm(x, w("ln2"))
        g = y @ w("ffn.w1").T
        x = x + (g / (1 + np.exp(-g)) * (y @ w("ffn.w3").T)) @ w("ffn.w2").T
    return norm(x, s["ln_final.weight"]) @ s["lm_head.weight"].T


def init_linear(rows: int, cols: int, seed: int = 0) -> np.ndarray:
    """Normal with variance 2 / (rows + cols), cut at three deviations."""
    sigma = math.sqrt(2 / (rows + cols))
    return _cut_normal((rows, cols), sigma, seed)


def init_embedding(rows: int, cols: int, seed: int = 0) -> np.ndarray:
    """Standard normal, cut at three deviations."""
    return _cut_normal((rows, cols), 1.0, seed)


def _cut_normal(shape, sigma: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(shape)
    while (bad := np.abs(x) > 3).any():
        x[bad] = rng.standard_normal(int(bad.sum()))
    return x * sigma
