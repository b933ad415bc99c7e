"""Components of sparse vectors against the plain decomposition."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from tillroll.operators.components import fit_components

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT())])


def sparse_rows(n=400, d=90, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, d)) < rng.random(d) * 0.2).astype(float)
    x[:, 3] *= 5
    x[7] = 0  # a row without entries
    return x


def frame(spark, x, dense_every=9):
    rows = [(i, Vectors.dense(r) if i % dense_every == 0 else Vectors.sparse(len(r), [(j, v) for j, v in enumerate(r) if v])) for i, r in enumerate(x.tolist())]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("k", [1, 5, 50, None])
def test_variances_equal_the_exact_ones(spark, k):
    x = sparse_rows()
    found = fit_components(frame(spark, x), k)
    exact = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    want = exact[:len(found.variances)]
    assert len(found.variances) == (k or x.shape[1])
    assert np.allclose(found.variances, want, rtol=1e-6, atol=1e-9) and found.total == pytest.approx(exact.sum())
    assert np.allclose([r.explained for r in found.explained(spark).orderBy("component").collect()], want / exact.sum(), atol=1e-6)
    assert np.allclose(found.directions.T @ found.directions, np.eye(len(want)), atol=1e-8)


def test_projection_is_centred_and_sparse_rows_stay_sparse(spark):
    x = sparse_rows()
    table = frame(spark, x)
    found = fit_components(table, 3)
    got = found.transform(table).orderBy("id")
    y = np.array([r.pca.toArray() for r in got.collect()])
    assert np.allclose(y, (x - x.mean(0)) @ found.directions) and np.allclose(y.mean(0), 0, atol=1e-9)
    assert np.allclose(y.var(0), found.variances, rtol=1e-6)
    plan = got._jdf.queryExecution().toString()
    assert "vector_to_array" not in plan.lower()


def test_few_directions_and_few_rows(spark):
    x = np.outer(np.arange(6.0), [1, 0, 2, 0, 0, 0, 0, 0])  # one direction only
    found = fit_components(frame(spark, x), 4)
    assert found.variances[0] == pytest.approx(np.var(np.arange(6.0)) * 5) and np.allclose(found.variances[1:], 0, atol=1e-9)
    alone = fit_components(frame(spark, x[:1]))
    assert np.allclose(alone.variances, 0) and alone.total == 0
    with pytest.raises(ValueError):
        fit_components(frame(spark, x[:0]))
