"""Exact top-k search by integer inner product: exhaustive term-at-a-time accumulation.

Components become integers, floor(scale * x). A component is a term, and the non-zero components of a block of
candidates are its postings. A task holds one block of queries and one of candidates; term by term, every
query that has the term scatters its weight times the postings into a dense array of scores. Partition
selection keeps the k best per query, and the blocks' best are merged per query.

Every candidate is scored; nothing is indexed or pruned. Blocks are dealt by a hash of the id, so their number, not any key,
sets the tasks; both sides are copied once per block of the other side. A query set that grows with the rows makes this
grow as their product, whatever the plan.

Edge cases: vectors that are null or hold null or non-finite components, and null ids, take no part; empty vectors score 0;
vectors of different lengths are as if padded with 0; rows that repeat a vec_id are one vector, the smallest by content; ties go to the
smaller vec_id; fewer than k candidates give them all; an empty table gives an empty result. Finite components of any size take part
exactly; scores beyond 64 bits are clamped after that. Ids that aren't whole numbers raise TypeError at the call.
"""
from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import integer_ids, materialize

K, SCALE = 5, 256.0
#: Rows in a block of queries and of candidates. Each side is copied once per block of the other, so blocks are large; scores
#: are made for _STEP candidates at a time. Either has BLOCK_BYTES of components at most.
QUERIES, CANDIDATES, BLOCK_BYTES = 32_768, 16_384, 64 << 20
_STEP = 128


def _integers(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Rows x longest vector of floor(scale * x); 64-bit integers, or Python's where those don't suffice."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(rows.offsets.to_numpy())
    x = np.zeros((len(rows), max(1, n.max(initial=0))))
    x[np.arange(x.shape[1])[None, :] < n[:, None]] = rows.flatten().to_numpy()
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.abs(y).max(initial=0) < 2.0**62:
        return y.astype(np.int64)
    exact = lambda v, w: int(w) if np.isfinite(w) else math.floor(Fraction(v) * Fraction(scale))
    return np.array([[exact(*p) for p in zip(*r, strict=True)] for r in zip(x.tolist(), y.tolist(), strict=True)], dtype=object)


def fitting(queries: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest integers that hold their scores."""
    terms = min(queries.shape[1], block.shape[1])
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(block).max(initial=0)) * max(1, terms)
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    return queries.astype(kind), block.astype(kind)


def having_terms(queries: np.ndarray) -> list[np.ndarray]:
    """The queries that have each term."""
    return [np.flatnonzero(queries[:, t]) for t in range(queries.shape[1])]


def accumulate(queries: np.ndarray, block: np.ndarray, havings: list[np.ndarray] | None = None) -> np.ndarray:
    """Scores, queries x candidates, term by term over the postings of the block. havings: having_terms of queries in fitting integers, where
    many blocks meet the same ones."""
    if havings is None:
        queries, block = fitting(queries, block)
        havings = having_terms(queries)
    kind = queries.dtype
    scores = np.zeros((len(queries), len(block)), dtype=kind)
    part = np.empty_like(scores)
    for t in range(min(queries.shape[1], block.shape[1])):
        having, postings = havings[t], np.flatnonzero(block[:, t])
        if 4 * len(having) * len(postings) > scores.size:  # mostly full: zero weights add nothing
            np.multiply.outer(queries[:, t], block[:, t], out=part)
            scores += part
        elif len(having) and len(postings):
            scores[np.ix_(having, postings)] += np.multiply.outer(queries[having, t], block[postings, t])
    return scores if kind != object else np.clip(scores, -(2**63), 2**63 - 1)


def _best(k: int, scale: float):
    def run(table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("is_query").to_pylist(), dtype=bool)
        ids, vec = table.column("vec_id").to_numpy(), table.column("vec")
        qi, ci = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        ci = ci[np.argsort(ids[ci], kind="stable")]  # a later candidate has a larger id, so it must score more to displace
        if not len(qi) or not len(ci):
            return pa.table({"query_id": ids[:0], "vec_id": ids[:0], "score": ids[:0]})
        q, c = fitting(_integers(vec.take(pa.array(qi)), scale), _integers(vec.take(pa.array(ci)), scale))
        havings = having_terms(q)
        best: list = [[] for _ in qi]
        least = [None] * len(qi)
        for at in range(0, len(ci), _STEP):
            scores, own = accumulate(q, c[at : at + _STEP], havings), ids[ci[at : at + _STEP]]
            if at == 0 and len(own) > k + 1 and scores.dtype != object:
                floor = np.partition(scores, len(own) - k - 1, axis=1)[:, len(own) - k - 1]
            else:
                low = scores.min(axis=1)
                floor = np.array([x if y is None else y + 1 for x, y in zip(low.tolist(), least, strict=True)])
            rows, cols = np.nonzero(scores >= floor[:, None])
            for r, j in zip(rows.tolist(), cols.tolist(), strict=True):
                if own[j] != ids[qi[r]]:
                    best[r].append((-int(scores[r, j]), int(own[j])))
            for r in np.unique(rows).tolist():
                best[r] = sorted(best[r])[:k]
                least[r] = -best[r][-1][0] if len(best[r]) == k else None
        out = [(int(ids[qi[r]]), v, -s) for r, b in enumerate(best) for s, v in b]
        return pa.table({n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query picks, the k best of all other rows."""
    integer_ids(vectors, "vec_id")
    x = F.col("embedding").cast("array<double>")
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("vec").isNotNull() & good).groupBy("vec_id").agg(F.min(F.struct("vec", "is_query")).alias("r"))
    rows, _ = materialize(rows.select("vec_id", "r.vec", "r.is_query"), "vectors")
    n, m, longest = rows.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1)), F.max(F.size("vec"))).first()
    fit = max(1, BLOCK_BYTES // (8 * max(1, longest or 1)))
    qb, cb = max(1, math.ceil(m / min(queries, fit))), max(1, math.ceil(n / min(candidates, fit)))
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    block = lambda b, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(b)).cast("int")
    left = rows.where("is_query").select("vec_id", "vec", F.lit(True).alias("is_query"), block(qb, 1).alias("q"), every(cb).alias("c"))
    right = rows.select("vec_id", "vec", F.lit(False).alias("is_query"), every(qb).alias("q"), block(cb, 2).alias("c"))
    part = left.unionByName(right).groupBy("q", "c").applyInArrow(_best(k, scale), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same result in DuckDB SQL for queries with vec_id divisible by 50, k = 5, scale 256.
TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
