"""Scoring predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.functions.scalar import ratio
from geostat_spark.operators.ordering import quantiles


def attach_attributes(rows: DataFrame, sites: DataFrame, columns: Sequence[str], key: str = "site_id") -> DataFrame:
    """Bring source attributes back to scored rows by row identity."""
    return rows.join(sites.select(key, *columns), key, "inner")


def metric_columns(actual: Column, predicted: Column, weight: Column | None = None) -> dict[str, Column]:
    """mae, rmse and r2 as aggregates of one pass, optionally with row weights. R2 is
    1 - SSE / SST, with SST taken as var_pop * n to stay stable for large means; a constant target
    scores 1 when met exactly and 0 otherwise."""
    w = F.lit(1.0) if weight is None else weight
    n = F.sum(w)
    error = actual - predicted
    sse = F.sum(w * error * error)
    if weight is None:
        sst = F.var_pop(actual) * n
    else:
        sst = F.sum(w * actual * actual) - F.sum(w * actual) * F.sum(w * actual) / n
    return {
        "mae": F.sum(w * F.abs(error)) / n,
        "rmse": F.sqrt(sse / n),
        "r2": F.when(sst > 0, 1 - ratio(sse, sst)).when(sse == 0, 1.0).otherwise(0.0),
    }


def score(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """mae, rmse, r2 (and the row count) per key."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    metrics = metric_columns(F.col(actual), F.col(predicted))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in metrics.items()]
    )


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    residual = F.col(actual) - F.col(predicted)
    return df.withColumns({"residual": residual, "abs_error": F.abs(residual)})


def residual_stats(df: DataFrame) -> DataFrame:
    middle = quantiles(df.select("residual"), "residual", {"median": 0.5}).scalar()
    return df.agg(
        F.avg("residual").alias("mean"),
        F.stddev_samp("residual").alias("std"),
        F.min("residual").alias("min"),
        F.max("residual").alias("max"),
    ).withColumn("median", middle)


def error_by_category(df: DataFrame, category: str, minimum: int = 20, top: int = 15) -> DataFrame:
    rows = df.where(F.col(category).isNotNull())
    means = rows.groupBy(category).agg(F.avg("abs_error").alias("mean"), F.count("abs_error").alias("count"))
    middle = quantiles(rows.select(category, "abs_error"), "abs_error", {"median": 0.5}, keys=[category])
    return (
        means.where(F.col("count") >= minimum)
        .join(middle, category)
        .select(category, "mean", "median", "count")
        .orderBy(F.desc("mean"), category)
        .limit(top)
    )


def best_model(scores: DataFrame, baselines: DataFrame) -> DataFrame:
    """The model with the highest r2 and its improvement over the best baseline, in percent. Of equal scores the
    smallest name stands first; a missing score is no candidate."""
    first = F.min_by("model", F.struct(-F.col("r2"), "model"))
    scores, baselines = (df.where(F.col("r2").isNotNull()) for df in (scores, baselines))
    model = scores.agg(first.alias("best_model"), F.max("r2").alias("best_r2"))
    base = baselines.agg(F.struct(first.alias("name"), F.max("r2").alias("r2")).alias("b")).scalar()
    return model.withColumn("b", base).select(
        "best_model",
        "best_r2",
        F.col("b.name").alias("best_baseline"),
        F.col("b.r2").alias("baseline_r2"),
        (ratio(F.col("best_r2") - F.col("b.r2"), F.abs(F.col("b.r2"))) * 100).alias("improvement_pct"),
    )
