import numpy as np
import pandas as pd
import pytest

from geostat_spark.operators.grid import grid_over
from geostat_spark.operators.kernel import _packets, adaptive_bandwidth, fixed_bandwidth, kernel_average, kernel_weights
from geostat_spark.operators.packets import PACKET

rng = np.random.default_rng(11)


def test_a_wide_bandwidth_meets_cells_by_packet_and_not_by_query(spark):
    """every query used to meet each cell within its radius as a row of its own."""
    n = 5_000
    at = np.vstack([rng.normal(0, 0.12, (n - 1, 2)), [[3.0, 3.0]]])
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": at[:, 0], "y": at[:, 1], "v": rng.random(n)}))
    band = fixed_bandwidth(rows.select("id", "x", "y"), 0.1)
    packets = _packets(grid_over(rows, ["x", "y"]), band.select("x", "y", "bandwidth"), ["x", "y", "bandwidth"])
    held = packets.selectExpr("size(data) / 3 AS n").toPandas()["n"]
    assert held.sum() == n and held.max() <= PACKET and len(held) < n / 50
    got = kernel_average(band, rows, ["v"]).toPandas().set_index("id")
    v = rows.toPandas()["v"].to_numpy()
    some = np.append(rng.integers(0, n, 20), n - 1)
    d2 = ((at[some][:, None] - at[None]) ** 2).sum(axis=2)
    w = np.exp(-0.5 * d2 / 0.01)
    assert got.loc[some, "avg_v"].to_numpy() == pytest.approx(w @ v / w.sum(axis=1), rel=1e-8)
    assert (got["error_v"] < 1e-6).all()


def test_weights_keep_ids_of_any_kind_and_copies_of_a_place(spark):
    """copies share a place and a bandwidth of zero; ids are texts and each pair is returned."""
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 0.0), ("d", 5.0, 1.0)], "id string, x double, y double")
    got = {(r["id"], r["source"]): r["weight"] for r in kernel_weights(adaptive_bandwidth(rows, rows, 2), rows, 1e-3).collect()}
    assert {k: v for k, v in got.items() if k[0] != "d"} == {(a, b): pytest.approx(1 / 3) for a in "abc" for b in "abc"}
    assert {b for a, b in got if a == "d"} == set("abcd")


def test_silhouette_of_many_clusters_meets_only_parts_that_can_be_nearest(spark):
    """F1, F8: every row used to meet every cluster of every subset."""
    from pyspark.sql import functions as F

    from geostat_spark.operators import kernel
    from geostat_spark.operators.clustering import silhouette

    centres = rng.uniform(0, 100, (150, 3))
    label = np.repeat(np.arange(150), 8)
    at = centres[label] + rng.normal(0, 0.5, (1_200, 3))
    label[:300] = 1  # one wide cluster among narrow ones
    subset = np.where(np.arange(1_200) % 2 == 0, "even", "odd")
    rows = spark.createDataFrame(pd.DataFrame({"subset": subset, "cluster": label, **{c: at[:, i] for i, c in enumerate("xyz")}}))
    numbered = rows.select(F.lit(0).cast("long").alias("grp"), F.col("cluster").cast("long").alias("part"), "x", "y", "z", F.lit(1.0).alias("mass"))
    sizes = numbered.groupBy("grp", "part").agg(F.sum("mass").alias("n"))
    packets = kernel.packed(grid_over(numbered, list("xyz")), numbered, [*"xyz", "part", "grp"], ["grp"], F.col("grp"))
    met = kernel._parts_to_meet(packets, numbered, sizes, list("xyz"))
    assert met.count() <= packets.count() * sizes.count() < 1_200 * sizes.count() / 50

    def direct(x, y):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        total = np.stack([d[:, y == c].sum(axis=1) for c in np.unique(y)], axis=1)
        n, own = np.array([(y == c).sum() for c in np.unique(y)]), y[:, None] == np.unique(y)[None]
        a, b = total[own] / np.maximum(n[None].repeat(len(y), 0)[own] - 1, 1), np.where(own, np.inf, total / n).min(axis=1)
        return np.where(n[None].repeat(len(y), 0)[own] == 1, 0.0, (b - a) / np.maximum(a, b)).mean()

    got = {r["subset"]: r["silhouette"] for r in silhouette(rows, list("xyz"), ["subset"]).collect()}
    assert got == {s: pytest.approx(direct(at[subset == s], label[subset == s]), rel=1e-12) for s in ("even", "odd")}
