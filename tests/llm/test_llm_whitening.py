"""Whitened embeddings against a dense eigendecomposition, and odd inputs."""

import numpy as np
import pytest

from codestrata.llm import whitening


def dense(x: np.ndarray, k: int = 16):
    """n, deviations, absolute whitened values and explained shares of whole-number vectors."""
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    c = (n * distinct - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(1), np.abs(((n * x - sums) / n) @ vectors / np.sqrt(values)), values / (c**2).sum() * n


def check(out, x, k=16):
    n, deviation, whitened, explained = dense(x, k)
    out = out.toPandas().sort_values(["vec_id", "component"])
    assert len(out) == len(x) * k and (out.n == n).all() and out.identity_error.max() < 1e-10
    assert out.deviation.to_list() == np.repeat(deviation, k).tolist()
    assert np.allclose(np.abs(out.whitened.to_numpy()).reshape(len(x), k), whitened, atol=1e-9)
    assert np.allclose(out.explained.to_numpy().reshape(len(x), k), explained, rtol=1e-9)


def integers(vectors) -> np.ndarray:
    return (np.floor(64 * np.asarray(vectors, float)) + 1_000_000).astype(np.int64)


@pytest.mark.parametrize(("d", "k"), [(40, 8), (120, 6), (4, 4)])
def test_search_equals_dense_decomposition(d, k):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((500, d)) * np.linspace(1, 3, d)
    v = np.cov(x.T, bias=True)
    asked = []
    values, vectors = whitening.jacobi_davidson(lambda b: (asked.append(b.shape), v @ b)[1], d, k)
    e, q = np.linalg.eigh(v)
    assert np.allclose(values, e[::-1][:k], rtol=1e-12)
    assert np.allclose(np.abs((vectors * q[:, ::-1][:, :k]).sum(0)), 1, atol=1e-11)
    assert max(s[1] for s in asked) <= k + 4  # never the whole matrix


def test_corrections_solve_the_projected_equation():
    rng = np.random.default_rng(1)
    v = np.diag(np.arange(1.0, 31.0))
    away = np.linalg.qr(rng.standard_normal((30, 3)))[0]
    r = rng.standard_normal((30, 2))
    whitening_inner = whitening.INNER
    whitening.INNER = 60
    try:
        t = whitening.corrections(lambda b: v @ b, away, np.array([40.0, 45.0]), r)
    finally:
        whitening.INNER = whitening_inner
    project = np.eye(30) - away @ away.T
    for i, shift in enumerate((40.0, 45.0)):
        left = project @ (v - shift * np.eye(30)) @ project @ t[:, i] + project @ r[:, i]
        assert np.linalg.norm(left) < 2e-3 * np.linalg.norm(project @ r[:, i]) and np.allclose(away.T @ t[:, i], 0, atol=1e-12)


def test_table_equals_dense_decomposition(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    check(whitening.op13(table), integers(np.stack(rows.embedding)))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.standard_normal((40, 5)).round(3).tolist()
    good[7] = good[3]  # repeated vector: once in the fit list, both in the result
    rows = [(i, v, "a", 1) for i, v in enumerate(good)]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf")] * 5, [1.0, 2.0], [1e300] * 5]
    schema = "vec_id long, embedding array<double>, x string, n int"
    table = spark.createDataFrame(rows + [(100 + i, v, None, None) for i, v in enumerate(bad)], schema)
    check(whitening.op13(table), integers(good), k=5)


def test_no_variance_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.op13(spark.createDataFrame([], schema)).count() == 0
    assert whitening.op13(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    flat = spark.createDataFrame([(None, [1.0, float(i), 7.0]) for i in range(6)], schema)
    out = whitening.op13(flat).collect()  # one dimension varies: one component
    assert len(out) == 6 and {r.component for r in out} == {1} and all(r.vec_id is None for r in out)
    assert abs(sum(r.whitened**2 for r in out) / 6 - 1) < 1e-12
