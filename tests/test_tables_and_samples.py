"""Stored tables replaced in place, samples by hash prefixes, vectors of very many levels, tail expressions."""

import hashlib

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from geostat_spark.functions import distributions as dist, tails
from geostat_spark.operators import clean, features
from geostat_spark.sources import tables

SCORES = "model string, r2 double"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_in_place(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = tables.upsert_current(spark, path, spark.createDataFrame([("a", 0.5), ("b", 0.4)], SCORES), "model", "r2")
    second = tables.upsert_current(spark, path, spark.createDataFrame([("b", 0.9), ("c", 0.1)], SCORES), "model", "r2")
    assert rows_of(first) == [("a", 0.5), ("b", 0.4)]  # a reader that has begun goes on
    assert rows_of(second) == rows_of(tables.read_current(spark, path)) == [("a", 0.5), ("b", 0.9), ("c", 0.1)]
    tables.upsert_current(spark, path, spark.createDataFrame([("c", 0.2)], SCORES), "model", "r2")
    assert sum(p.name.startswith("rows-") for p in (tmp_path / "t").iterdir()) == 2


def test_lost_run_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    tables.upsert_current(spark, path, spark.createDataFrame([("a", 0.5)], SCORES), "model", "r2")

    def lost(*_):
        raise RuntimeError("lost between write and swap")

    with monkeypatch.context() as m:
        m.setattr(tables, "_put", lost)
        with pytest.raises(RuntimeError):
            tables.upsert_current(spark, path, spark.createDataFrame([("a", 0.9)], SCORES), "model", "r2")
    assert rows_of(tables.read_current(spark, path)) == [("a", 0.5)]
    assert rows_of(tables.upsert_current(spark, path, spark.createDataFrame([("b", 0.1)], SCORES), "model", "r2")) == [("a", 0.5), ("b", 0.1)]


@pytest.mark.parametrize("n", [0, 1, 777, 2_500, 4_999, 5_000, 9_999])
@pytest.mark.parametrize("few", [100_000, 1])
def test_sample_rows(spark, monkeypatch, n, few):
    monkeypatch.setattr(clean, "FEW", few)
    order = sorted(range(5_000), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    got = clean.sample_rows(spark.range(5_000), "id", n)
    assert sorted(r["id"] for r in got.collect()) == sorted(order[:n]) and got.columns == ["id"]


def test_vectors_of_ten_thousand_levels(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3_000 != 0, F.concat(F.lit("v"), F.col("id") % 10_000)).alias("level"))
    levels = features.numbered_levels(rows, "level")
    known = {r["level"]: r["index"] for r in levels.collect()}
    assert sorted(known.values()) == list(range(len(known))) and len(known) > 9_900
    out = features.one_hot_vectors(rows, "level", "v", levels)
    for r in out.where("id % 500 = 0").collect():
        want = [] if r["level"] is None else [known[r["level"]]]
        assert list(r["v"].indices) == want and r["v"].size == len(known) and list(r["v"].values) == [1.0] * len(want)
    other = spark.createDataFrame([("v1",), ("unheard of",)], "level string")
    assert [sum(x) for (x,) in features.one_hot_vectors(other, "level", "v", levels).orderBy("level").select(vector_to_array("v")).collect()] == [0.0, 1.0]


def test_tail_expressions_equal_plain_ones(spark):
    rows = [(x, df) for df in (1.0, 2.0, 7.0, 60.0, 10_000.0) for x in (0.0, 1e-6, 1.0, 3.84, df * 0.9, df, df * 2 + 10)]
    found = spark.createDataFrame([*rows, (1.0, 0.0), (None, 2.0)], "x double, df double").select(
        "x", "df", tails.chi_square_p("x", "df").alias("c"), tails.student_p("x", "df").alias("t"), tails.normal_p("x").alias("z")
    )
    for r in found.collect():
        if r["x"] is None or r["df"] == 0:
            assert r["c"] is None and r["t"] is None
            continue
        want = dist.chi_square_upper(r["x"], r["df"]), dist.student_two_sided(r["x"], r["df"]), dist.normal_two_sided(r["x"])
        assert (r["c"], r["t"], r["z"]) == pytest.approx(want, rel=1e-9, abs=1e-15)
    ranks = spark.createDataFrame([(float(w), n) for n in (1, 5, 12) for w in range(0, n * 2)], "w double, n int")
    assert all(r["p"] == dist.signed_rank_two_sided(r["w"], r["n"]) for r in ranks.select("w", "n", tails.signed_rank_p("w", "n").alias("p")).collect())
    p = spark.createDataFrame([(v,) for v in (1e-300, 1e-12, 0.01, 0.075, 0.3, 0.5, 0.93, 1 - 1e-12)], "p double")
    assert all(r["q"] == pytest.approx(dist.normal_quantile(r["p"]), abs=1e-14) for r in p.select("p", tails.normal_quantile("p").alias("q")).collect())
