import numpy as np
import pandas as pd
import pytest

from geostat_spark.operators.kernel import adaptive_bandwidth, kernel_average, kernel_weights

rng = np.random.default_rng(3)


def dense_weights(q, p, k):
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(axis=2))
    b = np.sort(d, axis=1)[:, min(k, len(p) - 1)][:, None]
    w = np.where(b > 0, np.exp(-0.5 * (d / np.where(b > 0, b, 1)) ** 2), (d == 0).astype(float))
    return b.ravel(), w / w.sum(axis=1, keepdims=True)


def frames(spark, q, p, v):
    qdf = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(q)), "x": q[:, 0], "y": q[:, 1]}))
    pdf = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "v": v}))
    return qdf, pdf


@pytest.mark.parametrize("crowded,tol", [(1024, 1e-11), (20, 1e-7)])
def test_kernel_average_equals_dense_matrix(spark, crowded, tol):
    """Crowded = 20 drives most of the mass through the node lattice."""
    p = np.vstack([rng.normal(0, 0.05, (300, 2)), rng.normal(2, 1, (100, 2)), np.zeros((60, 2))])
    q = np.vstack([rng.normal(0, 1, (30, 2)), np.zeros((1, 2)), [[40.0, 40.0]]])
    v = rng.random(len(p)) + 0.5
    qdf, pdf = frames(spark, q, p, v)
    b, w = dense_weights(q, p, 12)
    band = adaptive_bandwidth(qdf, pdf, 12)
    got = {r["id"]: r for r in kernel_average(band, pdf, ["v"], crowded=crowded).collect()}
    assert len(got) == len(q)
    for i in range(len(q)):
        assert got[i]["bandwidth"] == pytest.approx(b[i], abs=1e-12)
        assert got[i]["avg_v"] == pytest.approx(w[i] @ v, rel=tol)
        assert abs(got[i]["avg_v"] - w[i] @ v) <= got[i]["error_v"] + 1e-13 and got[i]["error_v"] < 1e-5


def test_sparse_weights_hold_every_pair_above_the_minimum(spark):
    p, q = rng.normal(0, 1, (150, 2)), rng.normal(0, 1, (20, 2))
    qdf, pdf = frames(spark, q, p, np.ones(150))
    _, w = dense_weights(q, p, 10)
    got = kernel_weights(adaptive_bandwidth(qdf, pdf, 10), pdf, 1e-4).collect()
    assert len(got) == int((w >= 1e-4).sum())
    for r in got:
        assert r["weight"] == pytest.approx(w[r["id"], r["source"]], rel=1e-9)
