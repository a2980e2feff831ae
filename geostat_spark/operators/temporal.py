"""Features of a wide table with one generation column per year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.functions.scalar import capacity_factor, clip, flag, year_of_column
from geostat_spark.operators.clean import keep_top_categories, keep_with_enough_values, top_categories
from geostat_spark.operators.ordering import quantiles
from geostat_spark.operators.profile import histogram
from geostat_spark.session import cut

DEFAULT_YEARS = [2013, 2014, 2015, 2016, 2017]
STABLE_BELOW = 0.1
VOLATILE_ABOVE = 0.3
FEATURES = [
    "cf_mean", "cf_std", "cf_cv", "cf_min", "cf_max", "cf_range",
    "cf_trend", "cf_trend_r2", "is_stable", "is_volatile", "cf_recent_change",
]


def generation_column(year: int) -> str:
    return f"estimated_generation_gwh_{year}"


def present_years(df: DataFrame, years: Sequence[int] = DEFAULT_YEARS) -> list[int]:
    return [y for y in years if generation_column(y) in df.columns]


def yearly_capacity_factors(
    df: DataFrame, years: Sequence[int] = DEFAULT_YEARS, hours_factor: float = 8.76
) -> DataFrame:
    return df.withColumns(
        {
            f"cf_{y}": capacity_factor(F.col(generation_column(y)), F.col("capacity_mw"), hours_factor)
            for y in present_years(df, years)
        }
    )


def _sum_over(series: Column, term) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda total, e: total + term(e))


def temporal_features(
    df: DataFrame, years: Sequence[int] = DEFAULT_YEARS, hours_factor: float = 8.76
) -> DataFrame:
    """Level, spread, trend and stability of each row's years. Everything is arithmetic over one array
    of the row's own known values: no shuffle, no Python."""
    have = present_years(df, years)
    cols = [f"cf_{y}" for y in have]
    out = keep_with_enough_values(yearly_capacity_factors(df, have, hours_factor), cols)
    series = F.array(*[F.struct(F.lit(float(y)).alias("year"), F.col(f"cf_{y}").alias("cf")) for y in have])
    out = out.withColumn("_known", F.filter(series, lambda e: e["cf"].isNotNull()))
    known, mean = F.col("_known"), F.col("cf_mean")
    values = F.transform(known, lambda e: e["cf"])
    # with a single year column no row filter applies, so a row may have no value at all
    out = out.withColumns(
        {
            "_n": F.size(known),
            "cf_mean": F.try_divide(_sum_over(known, lambda e: e["cf"]), F.size(known)),
            "_year_mean": F.try_divide(_sum_over(known, lambda e: e["year"]), F.size(known)),
            "cf_min": F.array_min(values),
            "cf_max": F.array_max(values),
        }
    )
    n, year_mean = F.col("_n"), F.col("_year_mean")
    out = out.withColumns(
        {
            "_syy": _sum_over(known, lambda e: (e["cf"] - mean) * (e["cf"] - mean)),
            "_sxx": _sum_over(known, lambda e: (e["year"] - year_mean) * (e["year"] - year_mean)),
            "_sxy": _sum_over(known, lambda e: (e["year"] - year_mean) * (e["cf"] - mean)),
        }
    )
    # a constant series has no spread; its rounding residue must not pass for a trend
    varies = F.col("cf_max") > F.col("cf_min")
    out = out.withColumns(
        {
            "cf_std": F.when(varies, F.sqrt(F.try_divide(F.col("_syy"), n))).when(n > 0, 0.0),
            "cf_range": F.col("cf_max") - F.col("cf_min"),
            "cf_trend": F.when(varies & (n >= 3), F.try_divide(F.col("_sxy"), F.col("_sxx"))).otherwise(0.0),
            "cf_trend_r2": F.when(
                varies & (n >= 3),
                F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx") * F.col("_syy")),
            ).otherwise(0.0),
        }
    )
    out = out.withColumn("cf_cv", F.col("cf_std") / (mean + F.lit(1e-10)))
    out = out.withColumns(
        {
            "is_stable": flag(F.col("cf_cv") < STABLE_BELOW),
            "is_volatile": flag(F.col("cf_cv") > VOLATILE_ABOVE),
        }
    )
    if len(cols) >= 2:
        out = out.withColumn("cf_recent_change", F.col(cols[-1]) - F.col(cols[-2]))
    return out.drop("_known", "_n", "_year_mean", "_syy", "_sxx", "_sxy")


def long_years(df: DataFrame, prefix: str, years: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """(keep..., year, value) rows of the wide columns ``prefix``_YYYY, missing values included."""
    cols = [f"{prefix}_{y}" for y in years if f"{prefix}_{y}" in df.columns]
    return df.select(*keep, *cols).unpivot(list(keep), cols, "column_name", "value")


def temporal_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("cf_mean").alias("mean_cf"),
        F.stddev_samp("cf_mean").alias("std_cf"),
        F.avg("cf_cv").alias("mean_cv"),
        F.sum("is_stable").alias("stable_count"),
        (F.avg("is_stable") * 100).alias("stable_pct"),
        F.sum("is_volatile").alias("volatile_count"),
        (F.avg("is_volatile") * 100).alias("volatile_pct"),
    )


def year_coverage(df: DataFrame, years: Sequence[int] = DEFAULT_YEARS) -> DataFrame:
    """Rows with a value, their share, and their capacity, per year; one scan, no row explosion."""
    have = present_years(df, years)
    valid = {y: F.col(generation_column(y)).isNotNull() for y in have}
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(generation_column(y)).alias(f"n{y}") for y in have],
        *[F.coalesce(F.sum(F.when(valid[y], F.col("capacity_mw"))), F.lit(0.0)).alias(f"c{y}") for y in have],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(y).alias("year"),
                F.col(f"n{y}").alias("n_plants"),
                F.try_divide(F.lit(100.0) * F.col(f"n{y}"), F.col("_rows")).alias("pct"),
                F.col(f"c{y}").alias("total_capacity_mw"),
            )
            for y in have
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def coverage_by_fuel(df: DataFrame, years: Sequence[int] = DEFAULT_YEARS, top: int = 15) -> DataFrame:
    """Non-missing values per (year, fuel) for the fuels with the most values overall."""
    have = present_years(df, years)
    by_fuel = (
        df.where(F.col("primary_fuel").isNotNull())
        .groupBy("primary_fuel")
        .agg(*[F.count(generation_column(y)).alias(str(y)) for y in have])
    )
    total = sum((F.col(f"`{y}`") for y in have[1:]), F.col(f"`{have[0]}`"))
    leaders = by_fuel.withColumn("_total", total).orderBy(F.desc("_total"), "primary_fuel").limit(top)
    return leaders.unpivot(["primary_fuel"], [str(y) for y in have], "year", "n").select(
        F.col("year").cast("int").alias("year"), "primary_fuel", "n"
    )


def coverage_matrix(df: DataFrame, years: Sequence[int] = DEFAULT_YEARS, top: int = 15) -> DataFrame:
    """The same as a matrix, one column per leading fuel, largest first."""
    long = coverage_by_fuel(df, years, top)
    order = (
        long.groupBy("primary_fuel").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "primary_fuel").collect()
    )
    return long.groupBy("year").pivot("primary_fuel", [r[0] for r in order]).agg(F.sum("n")).orderBy("year")


def yearly_profile_of_top_fuels(df: DataFrame, years: Sequence[int] = DEFAULT_YEARS, top: int = 8) -> DataFrame:
    """Mean and sample std of the yearly capacity factor for the most frequent fuels."""
    long = long_years(keep_top_categories(df, "primary_fuel", top), "cf", years, ["primary_fuel"])
    return (
        long.groupBy("primary_fuel", year_of_column(F.col("column_name")).alias("year"))
        .agg(F.avg("value").alias("mean_cf"), F.stddev_samp("value").alias("std_cf"))
    )


def stability_by_fuel(df: DataFrame, minimum: int = 50) -> DataFrame:
    return (
        df.where(F.col("primary_fuel").isNotNull())
        .groupBy("primary_fuel")
        .agg(
            F.avg("is_stable").alias("is_stable"),
            F.avg("is_volatile").alias("is_volatile"),
            F.count("capacity_mw").alias("count"),
        )
        .where(F.col("count") >= minimum)
        .orderBy("is_stable", "primary_fuel")
    )


def stability_by_class(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("is_renewable").isNotNull())
        .groupBy("is_renewable")
        .agg(F.avg("is_stable").alias("is_stable"), F.avg("is_volatile").alias("is_volatile"))
    )


def temporal_pattern(df: DataFrame, key: str, top: int | None = None, more_than: int = 10) -> DataFrame:
    """Mean level, volatility, trend and stable share of the groups with more than ``more_than`` rows."""
    rows = df.where(F.col(key).isNotNull())
    if top is not None:
        rows = rows.join(F.broadcast(top_categories(df, key, top).select(key)), key, "left_semi")
    return (
        rows.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("cf_mean").alias("mean_cf"),
            F.avg("cf_cv").alias("mean_cv"),
            F.avg("cf_trend").alias("mean_trend"),
            (F.avg("is_stable") * 100).alias("stable_pct"),
        )
        .where(F.col("n") > more_than)
    )


def clipped_histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Distribution of a feature with its tails pulled in to [low, high]; the median is the unpulled one.

    The column is written out first: its passes would each derive it again, and a filter on a feature pulls the whole
    derivation into its condition, which takes the planner minutes."""
    values = cut(df.select(column))
    pulled = values.select(clip(F.col(column), low, high).alias(column))
    median = quantiles(values, column, {"median": 0.5}).scalar()
    return histogram(pulled, column, bins).drop("mean", "median").withColumn("median", median)
