"""Training-side operators: batches, loss, clipping, optimizer step, learning-rate schedule."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import columns, nn


def windows(stream: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """(sample_id, start, x, y) from a stream (pos, token_id), positions 0 .. n - 1, and (sample_id, start): x = d[s : s + m], y = d[s + 1 : s + m + 1].

    The stream is cut into blocks, arrays that are longer than a window, so a start asks for the one or two blocks that hold its
    window, not for a row per position; of each only the window's part goes on.
    """
    size = max(64, 2 * (length + 1))
    block = F.floor(F.col("pos") / size)
    held = stream.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("held"))
    want = starts.select("sample_id", "start", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + length) / size))).alias("block"))
    first = F.greatest(F.col("start") - F.col("block") * size, F.lit(0))
    last = F.least(F.col("start") + length - F.col("block") * size, F.lit(size - 1))
    part = F.slice("held", (first + 1).cast("int"), (last - first + 1).cast("int"))
    got = want.join(held, "block").select("sample_id", "start", F.struct("block", F.transform(part, lambda r: r["token_id"]).alias("part")).alias("part"))
    got = got.groupBy("sample_id", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["part"])).alias("all"))
    return got.select("sample_id", "start", F.slice("all", 1, length).alias("x"), F.slice("all", 2, length).alias("y"))


def get_batch(stream: DataFrame, batch_size: int, length: int, seed: int = 0) -> DataFrame:
    """Uniform starts in [0, n - length), by a seeded digest of the sample number; the same seed gives the same batch. A stream of `length`
    tokens or fewer has no window and raises ValueError."""
    n = stream.count()
    if n <= length:
        raise ValueError(f"a stream of {n} tokens has no window of {length} and its successor")
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    starts = stream.sparkSession.range(batch_size).select(F.col("id").alias("sample_id"), (number % (n - length)).alias("start"))
    return windows(stream, starts, length)


def cross_entropy(logits: Column, target: Column) -> Column:
    """logsumexp(x) - x[t] of one row; the loss is its mean. target counts from 0."""
    loss = lambda x, top: F.log(nn.total(F.transform(x, lambda v: F.exp(v - top)))) + top - F.get(x, target)
    return nn.let(logits, lambda x: nn.let(F.array_max(x), lambda top: loss(x, top)))


def clip_gradients(grads: DataFrame, most: float, eps: float = 1e-6) -> DataFrame:
    """(..., g) scaled by min(1, most / (norm + eps)), with the norm over all non-null g of all parameters. Other columns may have any names."""
    norm = grads.agg(F.sqrt(F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0.0))).alias("norm"))
    held = grads.select(columns.whole_row(grads).alias("row")).crossJoin(F.broadcast(norm))  # one row
    return columns.unpacked(held, grads.columns, g=F.col("row.g") * F.least(F.lit(1.0), F.lit(most) / (F.col("norm") + eps)))


def adamw_step(rows: DataFrame, t: int, lr: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, decay: float = 0.01) -> DataFrame:
    """One step over rows with w, g, m, v; decay is decoupled; rows with null g stay. Other columns may have any names."""
    m, v = F.col("m") * b1 + F.col("g") * (1 - b1), F.col("v") * b2 + F.col("g") * F.col("g") * (1 - b2)
    step = lr * math.sqrt(1 - b2**t) / (1 - b1**t)
    w = F.col("w") * (1 - lr * decay) - F.lit(step) * m / (F.sqrt(v) + eps * math.sqrt(1 - b2**t))
    none = F.col("g").isNull()  # all three come from the row as it was
    return rows.withColumns({"w": F.when(none, F.col("w")).otherwise(w), "m": F.when(none, F.col("m")).otherwise(m), "v": F.when(none, F.col("v")).otherwise(v)})


def cosine_rate(it: Column, most: float, least: float, warmup: int, cycle: int) -> Column:
    """Linear warm-up, cosine until `cycle`, then the least rate."""
    part = (it - warmup) / F.lit(float(max(1, cycle - warmup)))
    mid = least + (1 + F.cos(part * math.pi)) * 0.5 * (most - least)
    return F.when(it < warmup, it / F.lit(float(max(1, warmup))) * most).when(it <= cycle, mid).otherwise(F.lit(float(least)))
