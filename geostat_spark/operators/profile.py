"""Group profiles, rankings, coverage, histograms and box-plot numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.functions.scalar import half_even, nan_to_null, ratio
from geostat_spark.operators.ordering import quantiles, quantiles_of_ranks, value_ranks


def _weighted_share() -> Column:
    return ratio(F.sum(F.col("is_renewable") * F.col("capacity_mw")), F.sum("capacity_mw"))


def regional_stats(df: DataFrame, group: str = "continent") -> DataFrame:
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            half_even(F.avg("capacity_factor")).alias("mean_capacity_factor"),
            half_even(F.sum("capacity_mw")).alias("total_capacity_mw"),
            half_even(_weighted_share()).alias("renewable_share"),
        )
        .orderBy(F.desc("total_capacity_mw"), group)
    )


def country_rankings(df: DataFrame, top: int = 20) -> DataFrame:
    return (
        df.where(F.col("country_long").isNotNull())
        .groupBy("country_long")
        .agg(
            half_even(F.sum("capacity_mw")).alias("total_capacity_mw"),
            half_even(F.avg("capacity_factor")).alias("mean_capacity_factor"),
            half_even(_weighted_share()).alias("renewable_share"),
            F.count("country").alias("plant_count"),
        )
        .orderBy(F.desc("total_capacity_mw"), "country_long")
        .limit(top)
    )


def capacity_rankings(df: DataFrame, top: int = 50) -> DataFrame:
    return (
        df.where(F.col("country_long").isNotNull())
        .groupBy("country_long")
        .agg(
            half_even(F.sum("capacity_mw")).alias("total_capacity_mw"),
            half_even(F.avg("capacity_mw")).alias("mean_capacity_mw"),
            F.count("capacity_mw").alias("plant_count"),
            half_even(F.avg("capacity_factor")).alias("mean_capacity_factor"),
            half_even(_weighted_share()).alias("renewable_share"),
        )
        .orderBy(F.desc("total_capacity_mw"), "country_long")
        .limit(top)
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), column)
    )


def sum_by(df: DataFrame, key: str, value: str, top: int | None = None) -> DataFrame:
    out = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(f"total_{value}"))
        .orderBy(F.desc(f"total_{value}"), key)
    )
    return out if top is None else out.limit(top)


def distribution_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """mean, median, sample std and count of a value per category, rounded, by falling mean."""
    rows = df.where(F.col(key).isNotNull())
    moments = rows.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")
    )
    middle = quantiles(rows.select(key, value), value, {"median": 0.5}, keys=[key])
    return (
        moments.join(middle, key, "left")
        .select(
            key,
            half_even(F.col("mean")).alias("mean"),
            half_even(F.col("median")).alias("median"),
            half_even(F.col("std")).alias("std"),
            "count",
        )
        .orderBy(F.desc("mean"), key)
    )


def coverage_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(value).alias("count"),
            F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"),
            F.avg(value).alias("mean"),
            half_even(F.lit(100.0) * F.count(value) / F.count(F.lit(1)), 1).alias("coverage_rate"),
        )
        .orderBy(F.desc("sum"), key)
    )


def coverage_total(df: DataFrame, value: str) -> DataFrame:
    have, rows = F.count(value), F.count(F.lit(1))
    return df.agg(
        have.alias("with_value"),
        (rows - have).alias("without_value"),
        half_even(F.lit(100.0) * have / rows, 1).alias("with_pct"),
    )


def missing_profile(df: DataFrame, top: int | None = None) -> DataFrame:
    """Missing count and percentage per column with any missing value, worst first; one scan."""
    counts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_rows")
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("missing_count")) for c in df.columns]
    )
    out = (
        counts.select("_rows", F.explode(pairs).alias("p"))
        .select(
            "p.column_name",
            "p.missing_count",
            half_even(F.lit(100.0) * F.col("p.missing_count") / F.col("_rows"), 2).alias("percentage"),
        )
        .where(F.col("missing_count") > 0)
        .orderBy(F.desc("missing_count"), "column_name")
    )
    return out if top is None else out.limit(top)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column, all columns in one job."""
    columns = list(columns)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value"
    )
    long = long.withColumn("value", nan_to_null(F.col("value"))).where(F.col("value").isNotNull())
    moments = long.groupBy("column_name").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quarts = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, keys=["column_name"])
    return moments.join(quarts, "column_name").select(
        "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def table_totals(df: DataFrame, value: str, key: str, approximate: bool = False) -> DataFrame:
    """sum, mean, median of a value and the number of distinct keys."""
    distinct = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    sums = df.agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), distinct.alias("distinct_keys"))
    middle = quantiles(df.select(value), value, {"median": 0.5}).scalar()
    return sums.select("total", "mean", middle.alias("median"), "distinct_keys")


def class_comparison(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Mean and median of a value in the two classes of a 0/1 flag."""
    rows = df.where(F.col(flag).isNotNull())
    means = rows.groupBy(flag).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return means.join(quantiles(rows.select(flag, value), value, {"median": 0.5}, keys=[flag]), flag).select(
        flag, "n", "mean", "median"
    )


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("correlation"))


def histogram(
    df: DataFrame, value: str, bins: int = 50, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Equal-width bins over [low, high] (the data's range unless given); the last bin is closed.
    All ``bins`` rows appear, empty ones with 0, and every row carries the mean and the median."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    lo = F.min("v") if low is None else F.lit(float(low))
    hi = F.max("v") if high is None else F.lit(float(high))
    # a single value would leave no width: it sits in the middle of a unit range
    lo_of = F.when(F.col("s.hi") == F.col("s.lo"), F.col("s.lo") - 0.5).otherwise(F.col("s.lo"))
    hi_of = F.when(F.col("s.hi") == F.col("s.lo"), F.col("s.hi") + 0.5).otherwise(F.col("s.hi"))
    stats = rows.agg(F.struct(lo.alias("lo"), hi.alias("hi"), F.avg("v").alias("mean")).alias("s")).scalar()
    median = quantiles(rows, "v", {"median": 0.5}).scalar()
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    placed = (
        rows.withColumn("s", stats)
        .select("v", lo_of.alias("lo"), hi_of.alias("hi"))
        .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        .select(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spark = df.sparkSession
    frame = (
        spark.range(bins)
        .select(F.col("id").cast("int").alias("bin"))
        .withColumn("s", stats)
        .select("bin", lo_of.alias("lo"), hi_of.alias("hi"), F.col("s.mean").alias("mean"), median.alias("median"))
    )
    return frame.join(placed, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "mean",
        "median",
    )


def box_stats(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles, mean, whiskers at the outermost values within 1.5 IQR, and the outlier count.
    Works on distinct values with counts, so the second pass is over the collapsed table."""
    keys = list(keys)
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    ranks = value_ranks(rows.select(*keys, F.col(value).cast("double").alias("v")), "v", keys)
    quarts = quantiles_of_ranks(ranks, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    if keys:
        both = ranks.select(*keys, "v", "n").join(quarts, keys)
    else:
        q = quarts.select(F.struct("q1", "median", "q3").alias("q")).scalar()
        both = ranks.select("v", "n").withColumn("q", q).select("v", "n", "q.*")
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= low) & (F.col("v") <= high)
    return both.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        # a whisker never retreats into the box
        F.least(F.min(F.when(inside, F.col("v"))), F.max("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, F.col("v"))), F.max("q3")).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
    )


def shape_of(df: DataFrame) -> DataFrame:
    """Row count and column count."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).cast("long").alias("column_count")
    )


def column_inventory(df: DataFrame) -> DataFrame:
    """Non-missing count and type per column; one scan."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    types = dict(df.dtypes)
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"`{c}`").alias("non_null"),
                F.lit(types[c]).alias("data_type"),
            )
            for c in df.columns
        ]
    )
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def first_rows(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)
