"""Bootstrap intervals of prediction metrics and normal quantile plots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from geostat_spark.functions.permutation import mixed
from geostat_spark.functions.scalar import ratio
from geostat_spark.functions.tails import normal_quantile
from geostat_spark.operators.ordering import every_rank, with_row_number


def _metrics_of_sums(sums: DataFrame) -> DataFrame:
    """mae, rmse, r2 from weighted sums n, e1 = |error|, e2 = error^2, y, yy of shifted targets."""
    sst = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    return sums.select(
        "rep",
        (F.col("e1") / F.col("n")).alias("mae"),
        F.sqrt(F.col("e2") / F.col("n")).alias("rmse"),
        (1 - ratio(F.col("e2"), sst)).alias("r2"),
    )


def _summary(reps: DataFrame, metrics: tuple[str, ...] = ("mae", "rmse", "r2")) -> DataFrame:
    long = reps.unpivot(["rep"], list(metrics), "metric", "score")
    # one value per replicate and metric: the exact percentile stays small
    return long.groupBy("metric").agg(
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.percentile("score", 0.025).alias("ci_lower"),
        F.percentile("score", 0.975).alias("ci_upper"),
    )


def _scored(df: DataFrame, actual: str, predicted: str, id_column: str) -> DataFrame:
    """Targets shifted by their mean, so that sums of squares keep their digits."""
    rows = df.select(F.col(id_column).alias("id"), F.col(actual).alias("a"), F.col(predicted).alias("p")).na.drop()
    centre = rows.agg(F.avg("a")).scalar()
    error = F.col("a") - F.col("p")
    return rows.withColumn("_c", centre).select(
        "id", F.abs(error).alias("e1"), (error * error).alias("e2"), (F.col("a") - F.col("_c")).alias("y")
    )


def bootstrap_draws(
    df: DataFrame, actual: str, predicted: str, id_column: str = "site_id", replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """Resampling with replacement: each replicate is exactly n draws of the n rows.

    How often a row is drawn is found from above: the draws of a run of row blocks are split between its halves by a
    binomial number, which is keyed by the run alone, so that every block follows its own path down and all blocks
    agree. Within a block the draws fall on its rows as a multinomial. A task holds one block's counts; rows cross the
    network once, and what is added up is one row a block and replicate."""
    rows = with_row_number(_scored(df, actual, predicted, id_column), F.col("id"), "id", "row")
    n = rows.count()

    def draw(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        counts = block_draws(int(key[0]), n, replicates, seed)
        own = own.sort_values("row", kind="stable")
        e1, e2, y = (own[c].to_numpy() for c in ("e1", "e2", "y"))
        total = counts @ np.column_stack([np.ones(len(own)), e1, e2, y, y * y])
        return pd.DataFrame(total, columns=["n", "e1", "e2", "y", "yy"]).assign(rep=np.arange(replicates))

    blocked = rows.withColumn("block", F.expr(f"(row - 1) div {BLOCK}"))
    parts = blocked.groupBy("block").applyInPandas(draw, "n double, e1 double, e2 double, y double, yy double, rep long")
    return _summary(_metrics_of_sums(parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n", "e1", "e2", "y", "yy")])))


BLOCK = 512  # rows whose draws are made together


def block_draws(block: int, n: int, replicates: int, seed: int) -> np.ndarray:
    """(replicates, rows of the block): how often each row of a block is drawn when n rows are drawn n times."""
    low, high, draws = 0, -(-n // BLOCK), np.full(replicates, n, np.int64)
    rows = lambda a, b: min(b * BLOCK, n) - min(a * BLOCK, n)
    while high - low > 1:
        middle = (low + high) // 2
        first = np.random.default_rng([seed, low, high]).binomial(draws, rows(low, middle) / rows(low, high))
        if block < middle:
            high, draws = middle, first
        else:
            low, draws = middle, draws - first
    m = rows(low, high)
    return np.random.default_rng([seed, low, high]).multinomial(draws, np.full(m, 1.0 / m))


def bootstrap_weights(
    df: DataFrame, actual: str, predicted: str, id_column: str = "site_id", replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """The same intervals from independent Poisson(1) row weights: every row draws its weights from its own
    id, tasks reduce to one row per replicate, and nothing of size rows * replicates is shuffled.

    A weight is the number of Poisson levels at or below a 62-bit uniform number of (id, replicate); the levels reach
    as far as that number can tell them apart, so no weight is cut off."""
    id_hash = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")
    rows = _scored(df, actual, predicted, id_column).withColumn("key", id_hash)
    levels = poisson_levels()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, 5))
        number = np.arange(replicates, dtype=np.int64)
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                w = poisson_weights(part["key"].to_numpy().astype(np.int64)[:, None], number[None], levels)
                e1, e2, y = (part[c].to_numpy() for c in ("e1", "e2", "y"))
                total += w.T @ np.column_stack([np.ones(len(part)), e1, e2, y, y * y])
        yield pd.DataFrame(total, columns=["n", "e1", "e2", "y", "yy"]).assign(rep=np.arange(replicates))

    parts = rows.mapInPandas(weigh, "n double, e1 double, e2 double, y double, yy double, rep long")
    sums = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n", "e1", "e2", "y", "yy")])
    return _summary(_metrics_of_sums(sums.where(F.col("n") > 0)))


def poisson_levels(bits: int = 62) -> list[int]:
    """Cumulative Poisson(1) probabilities as integers of so many bits, up to the last that is below one."""
    from fractions import Fraction

    # 1/e to far more digits than the bits hold, by its own series.
    inverse, term = Fraction(0), Fraction(1)
    for k in range(40):
        inverse += term
        term /= -(k + 1)
    out, total, term = [], Fraction(0), inverse
    for k in range(40):
        total += term
        term /= k + 1
        level = int(total * (1 << bits))
        if level >= (1 << bits) - 1:
            return out
        out.append(level)
    return out


def poisson_weights(key: np.ndarray, replicate: np.ndarray, levels: list[int]) -> np.ndarray:
    """Weights of rows (60-bit hashes of their ids) in replicates: two mixed 31-bit numbers make the uniform one."""
    high = mixed(mixed(key, replicate + 1), 1)
    low = mixed(mixed(key, replicate + 1), 2)
    return np.searchsorted(np.array(levels, dtype=np.int64), (high << 31) | low, side="right").astype(float)


def normal_quantiles(df: DataFrame, value: str) -> DataFrame:
    """(rank, theoretical, ordered): sorted values against normal quantiles of the order-statistic medians."""
    n, i = F.col("total"), F.col("rank")
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    median = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    ranked = every_rank(df.select(F.col(value).cast("double").alias("v")), "v")
    return ranked.select("rank", normal_quantile(median).alias("theoretical"), F.col("v").alias("ordered"))


def normal_fit(quantile_rows: DataFrame) -> DataFrame:
    """Slope, intercept and correlation of the quantile plot."""
    return quantile_rows.agg(
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        F.corr("ordered", "theoretical").alias("r"),
    )
