"""Whitening against numpy's own decomposition of the covariance."""
import math

import numpy as np
import pytest

from loomtext.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def plain(vectors, k=4):
    """(n, sums, eigenvalues, eigenvectors, trace) of the distinct integer vectors."""
    x = np.array(sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors}), dtype=object)
    sums = [int(s) for s in x.sum(axis=0)]
    c = np.array(x, dtype=float) - np.array([s / len(x) for s in sums])
    e, v = np.linalg.eigh(c.T @ c / len(x))
    return len(x), sums, e[::-1][:k], v[:, ::-1][:, :k], e.sum()


def check(rows, vectors, k=4, near=1e-7):
    n, sums, e, v, trace = plain(vectors.values(), k)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == k * len(vectors)
    sign = np.zeros(k)
    for i, vec in vectors.items():
        x = [math.floor(256 * float(c)) for c in vec]
        want = (np.array(x, dtype=float) - np.array([s / n for s in sums])) @ v / np.sqrt(e)
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for j in range(k):
            r = by[i, j + 1]
            assert (r.n, r.deviation) == (n, dev if dev < 2**63 else None)
            if not sign[j] and abs(want[j]) > 1e-3:
                sign[j] = np.sign(r.whitened * want[j])
            assert r.whitened == pytest.approx(want[j] * (sign[j] or 1), abs=near)
            assert r.explained == pytest.approx(e[j] / trace, rel=1e-9)
            assert r.identity_error < 1e-9
    assert len({r.identity_error for r in rows}) == 1


def test_query_equals_a_full_decomposition(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check(queries.op12_whitening(spark, SF).collect(), vectors)


def test_passes_and_certificate(spark):
    rows = whitening.integers(spark.read.parquet(f"{SF}/embeddings.parquet"))
    model, _ = whitening.fit(rows)
    assert model.passes <= 5 and model.residuals.max() <= whitening.TOLERANCE * model.values[0]
    assert np.abs(model.vectors.T @ model.vectors - np.eye(4)).max() < 1e-13


@pytest.mark.parametrize("d, gap", [(400, 0.999), (300, 0.9), (40, 1.0)])
def test_iteration_on_near_even_spectra(d, gap):
    rng = np.random.default_rng(d)
    v = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = 1000 * np.maximum(gap ** np.arange(d), 0.2)
    a = (v * e) @ v.T
    values, x, passes, residuals = whitening.top_components(lambda q: a @ q, d, 4, most=96)
    assert np.allclose(values, e[:4], rtol=1e-12)
    assert np.sqrt(((a @ x - x * values) ** 2).sum(axis=0)).max() <= 2 * whitening.STALL * e[0] and passes < 200
    if gap < 1:
        assert np.abs(np.abs(np.sum(x * v[:, :4], axis=0)) - 1).max() < 1e-8


def test_tree_of_sums(spark):
    rows = spark.range(5000).selectExpr("array(id, id * 2, 7) AS x").repartition(100)
    y, squares = whitening.product(rows, np.zeros(3), np.eye(3))
    x = np.array([(i, 2 * i, 7) for i in range(5000)], dtype=float)
    assert np.allclose(y, x.T @ x) and squares == pytest.approx((x * x).sum())
    assert whitening.column_sums(rows, 3) == [sum(range(5000)), 2 * sum(range(5000)), 35000]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [0.5, 1.0, -0.25]), (2, [0.25, -1.0, 0.5]), (2, [0.25, -1.0, 0.5]), (3, [1.5, 0.75, 2.0]), (None, [0.1, 0.2, 0.3]), (4, None), (5, [0.1, None, 0.2]), (6, [nan, 0.0, 0.0]), (7, [inf, 0.0, 0.0]),
               (8, [0.1, 0.9]), (9, [-0.0, 0.0, 0.0]), (10, []), (11, [0.0, 3.0, 1.0])]
    df = spark.createDataFrame([(i, v, "e") for i, v in vectors], "vec_id long, embedding array<float>, x string")
    got = whitening.whiten(df).collect()
    used = [(i, [*v, *[0.0] * (3 - len(v))]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    assert len(got) == 3 * len(used)  # three dimensions give three components
    once = [r for r in got if r.vec_id != 2] + sorted((r for r in got if r.vec_id == 2), key=lambda r: r.component)[::2]
    check(once, {i: np.float32(v) for i, v in used}, 3)
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == [] == whitening.whiten(df.where("false")).collect()
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(line).collect()
    assert {r.component for r in rows} == {1} and rows[0].explained == pytest.approx(1.0)
    large = spark.createDataFrame([(i, [1e10 * i, -3e9 * i * i]) for i in range(8)], "vec_id long, embedding array<double>")
    check(whitening.whiten(large).collect(), {i: [1e10 * i, -3e9 * i * i] for i in range(8)}, 2, 1e-6)
