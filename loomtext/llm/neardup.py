"""Embedding near-dedup by collision counting over projections.

Vectors with equal labels are compared. Each is scaled to length 1 and projected on PROJECTIONS random directions;
within a tile every projection is sorted, and two vectors collide in it if one lies in the other's window of
half-width w. Two vectors at the threshold's distance r differ in a projection like a normal variable of
deviation r, so they collide with probability p = P(|N| <= w / r), independently. After each STEP projections a pair goes on
if it has collided at least as often as Binomial(projections so far, p) does with the target recall; those that pass the last
count are verified by the cosine in double precision. Wide windows prune best here: the pairs sought then collide nearly always.

Equal vectors form a class; classes of a label are dealt to tiles of bounded size by a hash, each pair of tiles is one
task, and a task returns per class its number of links and one spanning link, never pairs. The work in a task is a few integer
operations per pair for the first STEP projections; few pairs go further. Every pair of a label is counted once: windows that keep all
pairs at the threshold hold most random pairs too (README), so no order of the vectors lets a tile pair be skipped.

Edge cases: a null id, label or vector, an empty or zero vector, or one with null or non-finite components links with
nothing (n_links 0, itself its component); vectors of different lengths don't link; repeated vec_id rows are one vector, the smallest by
content; ids that aren't whole numbers raise TypeError at the call; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import connected_components, integer_ids, materialize

THRESHOLD, RECALL, PROJECTIONS, SEED = 0.93, 0.99999, 48, 11
#: Half-width of a window, in units of the distance at the threshold.
WINDOW = 3.0
#: Vectors in a tile, and their bytes at most; a task holds two tiles, some five times over. Every vector of a label with t tiles is copied t
#: times, so tiles are as large as a task's time allows (a few seconds), not as small as its memory would. Ranks take 16 bits.
TILE, TILE_BYTES = 16_384, 64 << 20
_STEP = 16


def least_collisions(projections: int, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall`."""
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for c in range(projections, -1, -1):
        tail += math.comb(projections, c) * p**c * (1 - p) ** (projections - c)
        if tail >= recall:
            return c
    return 0


def directions(dim: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


def _ranks(h: np.ndarray, w: float):
    """For sorted projections, rank of each vector and its window [low, low + width) in ranks."""
    order = np.argsort(h, axis=0, kind="stable")
    rank = np.empty(h.shape, dtype=np.uint16)
    np.put_along_axis(rank, order, np.arange(len(h), dtype=np.uint16)[:, None], axis=0)
    return rank, np.take_along_axis(h, order, axis=0)


def _tile_links(threshold: float, recall: float):
    radius = math.sqrt(2 - 2 * threshold)
    width = WINDOW * radius
    need = {m: least_collisions(m, recall=recall) for m in range(_STEP, PROJECTIONS + 1, _STEP)}

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("cls").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, table = ids[order], table.take(pa.array(order))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        tile, mult = table.column("tile").to_numpy(), table.column("mult").to_numpy()
        raw = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares of large or small components stay finite
        x = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        h = x @ directions(x.shape[1])
        one, two = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        rank, line = _ranks(h[two], width)
        links, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        low = np.stack([np.searchsorted(line[:, j], h[one, j] - width, "left") for j in range(h.shape[1])], axis=1)
        span = np.stack([np.searchsorted(line[:, j], h[one, j] + width, "right") for j in range(h.shape[1])], axis=1) - low
        low, span, flat = low.astype(np.uint16), span.astype(np.uint16), np.ascontiguousarray(rank.T)
        for k in range(0, len(one), 128):
            block, left = slice(k, min(k + 128, len(one))), k if a == b else 0
            shape = (block.stop - k, len(two) - left)
            count, gap, inside = np.zeros(shape, dtype=np.uint8), np.empty(shape, dtype=np.uint16), np.empty(shape, dtype=bool)
            for j in range(_STEP):
                np.subtract(flat[j, left:][None, :], low[block, j][:, None], out=gap)
                np.less(gap, span[block, j][:, None], out=inside)
                np.add(count, inside.view(np.uint8), out=count)
            p, q = np.nonzero(count >= need[_STEP])
            c, q = count[p, q].astype(np.int16), q + left
            if a == b:
                on = two[q] > one[k + p]
                p, q, c = p[on], q[on], c[on]
            for s in range(_STEP, PROJECTIONS, _STEP):
                for j in range(s, s + _STEP):
                    c += (flat[j][q] - low[k + p, j]) < span[k + p, j]
                on = c >= need[s + _STEP]
                p, q, c = p[on], q[on], c[on]
            if not len(p):
                continue
            i, j = one[k + p], two[q]
            near = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)]) >= threshold
            i, j = i[near], j[near]
            np.add.at(links, i, mult[j])
            np.add.at(links, j, mult[i])
            while (up := parent[parent] != parent).any():  # all roots at once: pairs within a group are done without a loop over them
                parent[up] = parent[parent[up]]
            u, v = parent[i], parent[j]
            for u, v in np.unique(np.stack([u, v], axis=1)[u != v], axis=0).tolist():
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
        on = np.flatnonzero(links)
        return pa.table({"cls": ids[on], "root": ids[[root(i) for i in on]] if len(on) else ids[:0], "links": links[on]})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for pairs of equal labels with cosine >= threshold."""
    integer_ids(embeddings, "vec_id")
    if not 0 < tile <= 1 << 16:
        raise ValueError("a tile holds 65,536 vectors at most")
    kind = dict(embeddings.dtypes)["vec_id"]
    vec = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vec.alias("vec"))
    rows = rows.select("vec_id", "label", F.when(F.coalesce(good, F.lit(False)), F.col("vec")).alias("vec"))
    ids = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct(F.col("vec").isNull().alias("z"), "label", "vec")).alias("r"))
    ids, _ = materialize(ids.select("vec_id", "r.label", "r.vec"), "vectors")
    usable = ids.where("vec is not null")
    classes = usable.groupBy("label", "vec").agg(F.min("vec_id").alias("cls"), F.count("*").alias("mult"))
    classes, _ = materialize(classes.withColumn("dim", F.size("vec")), "classes")
    tiles = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dim")))))).cast("int").alias("tiles"))
    # labels and lengths are few beside the rows; the join is left to the optimiser
    dealt = classes.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", "dim", F.least("tile", "x").alias("a"), F.greatest("tile", "x").alias("b"), "cls", "mult", "tile", "vec")
    found = dealt.groupBy("label", "dim", "a", "b").applyInArrow(_tile_links(threshold, recall), "cls long, root long, links long")
    found, _ = materialize(found, "links")
    comps = connected_components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cls")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    info = classes.join(links, "cls", "left").join(comps, "cls", "left")
    info = info.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    out = ids.join(info, ["label", "vec"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    none = F.lit(None).cast("long")
    out = out.union(rows.where("vec_id is null").select(none, F.lit(0).cast("long"), none, F.lit(True)))
    return out.withColumn("vec_id", F.col("vec_id").cast(kind))
