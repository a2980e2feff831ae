"""Neighbour joins against brute force on shapes that break naive grids."""

import numpy as np
import pandas as pd
import pytest

from geostat_spark.operators.neighbors import knn, knn_between

rng = np.random.default_rng(7)


def uniform(n, d):
    return rng.random((n, d))


def clustered(n, d):
    """A tight blob, far outliers and a broad field in one table."""
    a = rng.normal(0, 1e-5, (n // 2, d))
    b = rng.normal(50, 10, (n // 3, d))
    c = rng.uniform(-1000, 1000, (n - len(a) - len(b), d))
    return np.vstack([a, b, c])


def stacked(n, d):
    """A third of all rows at one place, plus a lattice with many equal distances."""
    a = np.zeros((n // 3, d))
    g = rng.integers(0, 6, (n - len(a), d)).astype(float)
    return np.vstack([a, g])


def brute(q, qi, p, pi, k, skip_self):
    out = {}
    for x, i in zip(q, qi):
        dist = np.sqrt(sum((x[a] - p[:, a]) ** 2 for a in range(p.shape[1])))
        order = np.lexsort((pi, dist))
        picked = [(int(pi[j]), float(dist[j])) for j in order if not (skip_self and pi[j] == i)][:k]
        out[int(i)] = picked
    return out


def edges_to_dict(df):
    rows = df.orderBy("src", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r["src"], []).append((r["dst"], r["dist"]))
        assert r["rank"] == len(out[r["src"]])
    return out


def frame(spark, xy, ids):
    cols = ["x", "y", "z"][: xy.shape[1]]
    pdf = pd.DataFrame(xy, columns=cols)
    pdf.insert(0, "id", ids)
    return spark.createDataFrame(pdf), cols


@pytest.mark.parametrize(
    "shape,d,k,crowded",
    [(uniform, 2, 4, None), (clustered, 2, 5, 12), (clustered, 3, 3, 16), (stacked, 3, 3, 16), (stacked, 2, 4, None)],
)
def test_knn_equals_brute_force(spark, shape, d, k, crowded):
    xy = shape(240, d)
    ids = rng.permutation(240) + 1000
    df, cols = frame(spark, xy, ids)
    got = edges_to_dict(knn(df, k, cols, crowded=crowded))
    want = brute(xy, ids, xy, ids, k, True)
    assert got == want


def test_fewer_rows_than_k(spark):
    df, cols = frame(spark, np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]]), [1, 2, 3])
    got = edges_to_dict(knn(df, 8, cols))
    assert got == {1: [(2, 1.0), (3, 2.0)], 2: [(1, 1.0), (3, 5**0.5)], 3: [(1, 2.0), (2, 5**0.5)]}


@pytest.mark.parametrize("shape", [clustered, stacked])
def test_knn_between_equals_brute_force(spark, shape):
    p, q = shape(200, 2), np.vstack([shape(40, 2), uniform(20, 2) * 2000 - 1000])
    pi, qi = rng.permutation(200), rng.permutation(60) + 5000
    pdf, cols = frame(spark, p, pi)
    qdf, _ = frame(spark, q, qi)
    got = edges_to_dict(knn_between(qdf, pdf, 6, cols, crowded=20))
    assert got == brute(q, qi, p, pi, 6, False)


def test_search_inside_groups(spark):
    xy = clustered(240, 2)
    ids, group = np.arange(240), rng.integers(0, 3, 240)
    df, cols = frame(spark, xy, ids)
    tags = spark.createDataFrame(pd.DataFrame({"id": ids, "g": group}))
    from geostat_spark.operators.neighbors import edges, neighbours

    got = edges_to_dict(edges(neighbours(df.join(tags, "id"), 4, cols, by=["g"])))
    want = {}
    for g in range(3):
        m = group == g
        want.update(brute(xy[m], ids[m], xy[m], ids[m], 4, True))
    assert got == want


def test_copies_of_a_place_bound_the_search(spark):
    """a place's copies used to count as one row, and rows of all places around were sorted."""
    from pyspark.sql import functions as F

    from geostat_spark.operators import neighbors

    rng = np.random.default_rng(5)
    at = np.repeat(rng.random((40, 2)), 10, axis=0)
    rows = spark.createDataFrame(pd.DataFrame({"id": rng.permutation(400), "x": at[:, 0], "y": at[:, 1]}))
    grid = neighbors.grid_over(rows, ["x", "y"])
    places = neighbors._locations(rows, ["x", "y"], 8)
    assert neighbors._with_bound(places, None, grid, 7, []).agg(F.max("bound")).first()[0] == 0.0
    asked = rows.where("id % 10 = 0")
    between = neighbors._with_bound(neighbors._locations(asked, ["x", "y"], 1), places, grid, 7, [])
    assert between.agg(F.max("bound")).first()[0] == 0.0
    ids, xy = (rows.toPandas()[c].to_numpy() for c in (["id"], ["x", "y"]))
    ids = ids.ravel()
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = {r["id"]: [e["id"] for e in r["near"]] for r in neighbors.neighbours(rows, 12, ["x", "y"]).collect()}
    assert got == {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, d[i]))[:12]] for i in range(len(ids))}
