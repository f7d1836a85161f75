"""Whitening against numpy's eigenvectors, whole-number deviations and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import whitening


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64])
def test_components_equal_an_eigendecomposition(d):
    r = np.random.default_rng(d)
    a = r.normal(size=(d, d)) * np.logspace(0, -3, d)[:, None]
    v = a @ a.T
    values, unit = whitening.components_of(v)
    expected = np.linalg.eigvalsh(v)[::-1]
    assert np.allclose(values, expected, rtol=1e-7, atol=1e-13 * expected[0]) and (np.diff(values) <= 0).all()
    assert np.allclose(v @ unit, unit * values, atol=1e-13 * expected[0])
    assert np.allclose(unit.T @ unit, np.eye(d), atol=1e-12)


def test_cholesky_is_triangular_in_pivot_order_and_stops_at_the_rank():
    r = np.random.default_rng(1)
    a = r.normal(size=(6, 3))
    g = whitening.pivoted_cholesky(a @ a.T)
    assert g.shape == (6, 3) and np.allclose(g @ g.T, a @ a.T)
    first = [int(np.flatnonzero(g[:, k])[g[np.flatnonzero(g[:, k]), k].argmax()]) for k in range(3)]
    pivots = []
    for k in range(3):
        rows = [i for i in range(6) if i not in pivots and not np.any(g[i, k + 1 :])]
        pivots.append(next(i for i in rows if g[i, k] > 0))
    assert len(set(pivots)) == 3 and first[0] == int(np.diag(a @ a.T).argmax())
    assert whitening.components_of(np.zeros((3, 3)))[1].shape == (3, 0)


def _check(rows, vectors: dict):
    x = {k: [math.floor(64 * float(c)) + 1_000_000 for c in v] for k, v in vectors.items()}
    m = np.array(list(x.values()), dtype=object)
    n, s = len(m), m.sum(0)
    y = np.array([[float(n * c - t) / n for c, t in zip(row, s, strict=True)] for row in m])
    v = y.T @ y / n
    e = np.linalg.eigvalsh(v)[::-1]
    found = {}
    for r in rows:
        assert r["n"] == n and r["deviation"] == sum((n * c - t) ** 2 for c, t in zip(x[r["vec_id"]], s, strict=True))
        assert math.isclose(r["explained"], e[r["component"] - 1] / np.trace(v), rel_tol=1e-6) and r["identity_error"] < 1e-4
        found[r["vec_id"], r["component"]] = r["whitened"]
    k = max(c for _, c in found)
    w = np.array([[found[i, c] for c in range(1, k + 1)] for i in x])
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-8) and np.allclose(w.mean(0), 0, atol=1e-9)
    # back from the whitened values: y projected on a component is whitened * sqrt(e), so its squared loading is e
    assert np.allclose(((y.T @ w / n) ** 2).sum(0), e[:k], rtol=1e-8)
    return k


def test_query_on_the_whole_table(spark, sf):
    rows = whitening.op12_whitening(spark, sf)
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in rows.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert _check(rows.collect(), vectors) == 32


_SCHEMA = "vec_id long, embedding array<float>, at string, white int"


def test_odd_rows(spark):
    r = np.random.default_rng(4)
    good = {i: [float(c) for c in r.normal(size=5)] for i in range(30)}
    bad = [(100, None, "x", 1), (101, [], "x", 1), (102, [1.0, None, 0.0, 0.0, 0.0], "x", 1), (103, [math.nan] * 5, "x", 1), (104, [math.inf] * 5, "x", 1), (105, [1.0, 2.0], "x", 1)]
    rows = spark.createDataFrame([(k, v, None, 2) for k, v in good.items()] + bad, _SCHEMA)
    assert _check(whitening.whiten(rows).collect(), {k: [float(np.float32(c)) for c in v] for k, v in good.items()}) == 5
    twice = whitening.whiten(rows.union(rows))
    assert twice.groupBy("vec_id", "component").count().where("count <> 2").count() == 0 and twice.select("n").first()[0] == 60
    nulls = whitening.whiten(rows.withColumn("vec_id", F.lit(None).cast("long")))
    assert nulls.count() == 30 * 5 and nulls.where("vec_id IS NOT NULL").count() == 0


def test_no_variance_and_no_rows(spark):
    none = spark.createDataFrame([], _SCHEMA)
    assert whitening.whiten(none).count() == 0
    one = spark.createDataFrame([(i, [0.5, 0.25], "x", 1) for i in range(4)], _SCHEMA)
    assert whitening.whiten(one).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], "x", 1) for i in range(9)], _SCHEMA)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}
    far = spark.createDataFrame([(1, [3e38, 0.0], "x", 1), (2, [-3e38, 1.0], "x", 1)], _SCHEMA)
    assert whitening.whiten(far).count() == 2
