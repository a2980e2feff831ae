import numpy as np
import pandas as pd
import pytest

from geostat_spark.operators import packets
from geostat_spark.operators.ensemble import local_weights
from geostat_spark.operators.kernel import fixed_bandwidth, kernel_sums
from geostat_spark.operators.nearest import nearest


def _places(kind: str, n: int) -> pd.DataFrame:
    rng = np.random.default_rng(7)
    at = rng.normal(size=(n, 2))
    if kind == "stacked":
        at[: n // 2] = at[0]
    if kind == "outliers":
        at[:3] *= 1e6
    return pd.DataFrame({"id": rng.permutation(n), "x": at[:, 0], "y": at[:, 1], "v": rng.normal(size=n)})


@pytest.mark.parametrize("kind", ["stacked", "outliers"])
def test_nearest_rows_of_every_place_in_rounds(spark, monkeypatch, kind):
    monkeypatch.setattr(packets, "ROUND_BYTES", 100_000)
    pdf, k = _places(kind, 2_000), 9
    rows = spark.createDataFrame(pdf)
    work = lambda dist, carried: [dist[:, -1], (carried[:, :, 0] * np.arange(1, k + 1)).sum(axis=1)]
    asked = pdf.iloc[::3]
    got = nearest(spark.createDataFrame(asked), rows, k, ["x", "y"], work, ["last", "mixed"], ["v"], crowded=32).collect()
    got = {(r["x"], r["y"]): (r["last"], r["mixed"]) for r in got}
    assert len(got) == len(asked[["x", "y"]].drop_duplicates())
    for x, y in got:
        dist = np.sqrt((pdf["x"] - x) ** 2 + (pdf["y"] - y) ** 2)
        near = pdf.assign(dist=dist).sort_values(["dist", "id"]).head(k)
        assert got[x, y] == pytest.approx((near["dist"].iloc[-1], (near["v"] * np.arange(1, k + 1)).sum()), rel=1e-12)


def test_fewer_points_than_asked_for(spark):
    rows = spark.createDataFrame(_places("plain", 4))
    got = nearest(rows, rows, 9, ["x", "y"], lambda dist, _: [(dist >= 0).sum(axis=1).astype(float)], ["n"]).collect()
    assert [r["n"] for r in got] == [4.0] * 4
    assert nearest(rows, rows.limit(0), 9, ["x", "y"], lambda dist, _: [dist[:, 0]], ["n"]).collect() == []


def test_kernel_sums_in_rounds_are_the_same(spark, monkeypatch):
    rows = spark.createDataFrame(_places("plain", 3_000))
    asked = fixed_bandwidth(rows, 0.05)
    once = kernel_sums(asked, rows, ["v"], crowded=64).toPandas().sort_values(["x", "y"]).to_numpy()
    cuts = []
    monkeypatch.setattr(packets, "ROUND_BYTES", 200_000)
    monkeypatch.setattr(packets, "cut", lambda df, cut=packets.cut: cuts.append(df) or cut(df))
    rounds = kernel_sums(asked, rows, ["v"], crowded=64).toPandas().sort_values(["x", "y"]).to_numpy()
    assert len(cuts) > 3 and np.allclose(once, rounds, rtol=1e-9, atol=1e-12)


def test_local_weights_send_no_neighbour_lists(spark, tmp_path):
    """What the neighbour search writes to disk stays a few times the rows; a list of 51 neighbours a row is 51 times."""
    rng = np.random.default_rng(3)
    n = 20_000
    pdf = pd.DataFrame({"id": np.arange(n), "latitude": rng.normal(size=n), "longitude": rng.normal(size=n), **{c: rng.normal(size=n) for c in ("p_a", "p_b", "label")}})
    rows = spark.createDataFrame(pdf)
    written = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    before = {f.getPath() for f in _each(written())}
    local_weights(rows, ["a", "b"]).collect()
    files = [f for f in _each(written()) if f.getPath() not in before]
    assert sum(f.length() for f in files) < 20 * n * 48


def _each(files) -> list:
    return [files.apply(i) for i in range(files.size())]
