"""Joining counted groups back to rows: as an ordinary left join, whatever keys are hot or null."""

import collections

import pytest
from pyspark.sql import functions as F

from geostat_spark.operators.attach import attach_counted


@pytest.mark.parametrize("share", [1, 3, 1_000])
def test_attach_counted(spark, share):
    rows = [(i, "hot" if i % 2 else f"k{i % 7}" if i % 5 else None, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, key string, part int")
    groups = df.where("key <> 'k2'").groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = attach_counted(df, groups, ["key", "part"], "n", "id", len(rows), share)
    assert got.columns == ["id", "key", "part", "n", "top"]
    want = df.join(groups, ["key", "part"], "left").select(*got.columns)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))
    assert attach_counted(df.limit(0), groups, ["key", "part"], "n", "id", 0, share).count() == 0
