"""Tiled attention and block products against dense programs."""
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import nn, tiles
from loomtext.plans import queries as Q


def dense(q, k, v, keep):
    s = np.where(keep, q @ k.T / math.sqrt(q.shape[1]), -1.7976931348623157e308)
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True) @ v


@pytest.mark.parametrize("tile, span", [(3, 2), (5, 1), (64, 4)])
def test_attention_of_other_keys(spark, tile, span):
    rng = np.random.default_rng(tile)
    q, k, v = rng.standard_normal((2, 13, 4)), rng.standard_normal((2, 22, 4)) * 30, rng.standard_normal((2, 22, 6))
    qs = spark.createDataFrame([(b or None, i, q[b, i].tolist()) for b in range(2) for i in range(13)] + [(7, 0, [1.0] * 4)], "b int, q_pos int, q array<double>")
    ks = spark.createDataFrame([(b or None, i, k[b, i].tolist(), v[b, i].tolist()) for b in range(2) for i in range(22)], "b int, k_pos int, k array<double>, v array<double>")
    keep = lambda a, b: (a != 3) & ((a + b) % 3 != 0)
    got = {(r.b or 0, r.q_pos): r.o for r in tiles.attention(qs, ks, keep, tile=tile, span=span).collect()}
    assert len(got) == 26  # a batch without keys has no result
    mask = keep(np.arange(13)[:, None], np.arange(22)[None, :])
    for b in range(2):
        assert np.allclose([got[b, i] for i in range(13)], dense(q[b], k[b], v[b], mask))


def test_long_causal_sequence(spark):
    n, d = 6_000, 8
    x = np.random.default_rng(0).standard_normal((n, d))
    rows = spark.createDataFrame([("s", i, r.tolist()) for i, r in enumerate(x)], "b string, pos int, x array<double>")
    o = tiles.attention(rows.select("b", F.col("pos").alias("q_pos"), F.col("x").alias("q")), rows.select("b", F.col("pos").alias("k_pos"), F.col("x").alias("k"), F.col("x").alias("v")), heads=2, before=True, tile=500, span=3)
    got = np.array([r.o for r in o.orderBy("q_pos").collect()])
    keep = np.tril(np.ones((n, n), dtype=bool))
    for h in range(2):
        part = x[:, h * 4 : h * 4 + 4]
        assert np.allclose(got[:, h * 4 : h * 4 + 4], dense(part, part, part, keep))


def test_block_products_and_weights_outside_the_plan(spark):
    rng = np.random.default_rng(1)
    w, u, x = rng.standard_normal((37, 50)), rng.standard_normal((5, 50)), rng.standard_normal((2_500, 50))
    rows = spark.createDataFrame([(i, r.tolist(), "mine") for i, r in enumerate(x)], "id int, x array<double>, row string").repartition(3)
    table = tiles.weights_table(spark, {"w": w, "u": u}, 16)
    for most in (0, 1 << 20):
        out = tiles.linear(rows, "x", table, ["w", "u"], most)
        assert out.columns == ["id", "x", "row", "w", "u"]
        plan = out._jdf.queryExecution().toString()
        assert repr(float(w[0, 0])) not in plan and "from_json" not in plan
        got = {r.id: r for r in out.collect()}
        assert len(got) == 2_500 and got[0].row == "mine"
        assert np.allclose([got[i].w for i in range(2_500)], x @ w.T) and np.allclose([got[i].u for i in range(2_500)], x @ u.T)
    with pytest.raises(ValueError, match="no weights"):
        tiles.linear(rows, "x", table, ["other"])


def test_self_attention_equals_the_column_form(spark):
    sf = "/root/testdata/sf0.001"
    rows = Q._grouped(spark, sf)
    want = {(r.b, r.pos): r.y for r in nn.self_attention(rows, Q.HEADS, Q.D, Q.WQ, Q.WK, Q.WV, Q.WO, 10_000.0).collect()}
    for options in ({"longest": Q.GROUP}, {"tile": 5}, {"most": 0, "tile": 7}):
        got = {(r.b, r.pos): r.y for r in tiles.self_attention(rows, Q.HEADS, Q._weights(spark, 40), 10_000.0, **options).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    with pytest.raises(Exception, match="out of range"):
        tiles.self_attention(rows, Q.HEADS, Q._weights(spark), 10_000.0, 3).collect()


def test_a_sequence_of_100_000_positions(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(0).alias("b"), F.col("id").alias("pos"), F.array(F.sin("id"), F.cos("id")).alias("x"))
    began = time.time()
    o = tiles.attention(rows.select("b", F.col("pos").alias("q_pos"), F.col("x").alias("q")), rows.select("b", F.col("pos").alias("k_pos"), F.col("x").alias("k"), F.col("x").alias("v")), before=True, tile=2048)
    got = {r.q_pos: r.o for r in o.where("q_pos % 33333 = 0").collect()}
    assert time.time() - began < 300
    x = np.stack([np.sin(np.arange(n)), np.cos(np.arange(n))], axis=1)
    for i, y in got.items():
        assert np.allclose(y, dense(x[i : i + 1], x[: i + 1], x[: i + 1], np.ones((1, i + 1), dtype=bool))[0])
    assert len(got) == 4
