"""Gini, Lorenz and Theil over distributed ranks and one-pass group sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geostat_spark.functions.scalar import ratio
from geostat_spark.operators.ordering import every_rank, value_ranks
from geostat_spark.operators.profile import capacity_rankings
from geostat_spark.session import cut


def gini(df: DataFrame, value: str) -> DataFrame:
    """2 * sum(i * x_i) / (n * sum(x)) - (n + 1) / n with i the ascending rank. The ranks of the ``n``
    copies of a value are ``before + 1 .. before + n``, so each distinct value adds a closed form."""
    v, n, before = F.col(value).cast("double"), F.col("n").cast("double"), F.col("before").cast("double")
    rank_sum = n * before + n * (n + 1) / 2
    sums = value_ranks(df.select(value), value).agg(
        F.sum(v * rank_sum).alias("weighted"),
        F.sum(v * n).alias("total"),
        F.sum("n").cast("double").alias("rows"),
    )
    return sums.select(
        (2 * ratio(F.col("weighted"), F.col("rows") * F.col("total")) - ratio(F.col("rows") + 1, F.col("rows"))).alias(
            "gini"
        )
    )


def lorenz_curve(df: DataFrame, value: str, points: int | None = None) -> DataFrame:
    """(rank, x, y) of the Lorenz plot. x runs over n equal steps from 0 to 1 and starts at 0 for the
    first row as well as for the origin, which is rank 0. ``points`` thins the curve to about that many
    evenly spaced ranks (always with both ends); without it every row has its point."""
    step = None if points is None else F.greatest(F.lit(1), F.floor(F.col("total") / F.lit(points)))
    values = df.select(F.col(value).cast("double").alias("v"))
    curve = every_rank(values, "v", {"w": F.col("v")}, step).select(
        "rank",
        F.coalesce(ratio(F.col("rank") - 1, F.col("total") - 1), F.lit(0.0)).alias("x"),
        ratio(F.col("w_before") + F.col("v") * (F.col("rank") - F.col("before")), F.col("w_total")).alias("y"),
    )
    origin = df.sparkSession.range(1).select(F.col("id").alias("rank"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return origin.unionByName(curve)


def _group_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: rows, sum, and over the positive values sum(x) and sum(x ln x). Enough for both Theil
    terms, in one scan."""
    x = F.col(value).cast("double")
    positive = x > 0
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(positive, x)), F.lit(0.0)).alias("positive_total"),
        F.coalesce(F.sum(F.when(positive, x * F.log(x))), F.lit(0.0)).alias("x_log_x"),
    )


def theil_groups(df: DataFrame, group: str = "continent", value: str = "capacity_mw") -> DataFrame:
    """Count, sum, mean and share of the whole per group. The whole includes rows without a group."""
    sums = cut(_group_sums(df, group, value))
    whole = sums.agg(F.sum("total").alias("t")).scalar()
    return sums.where(F.col(group).isNotNull()).select(
        F.col(group).alias("group"),
        "count",
        F.col("total").alias("total_capacity"),
        ratio(F.col("total"), F.col("count")).alias("mean_capacity"),
        ratio(F.col("total"), whole).alias("share_of_total"),
    )


def theil_index(df: DataFrame, group: str = "continent", value: str = "capacity_mw") -> DataFrame:
    """Theil T: total, within, between and their percentages. Zero and negative values count in the
    sizes and sums but add nothing to the within term."""
    sums = cut(_group_sums(df, group, value))
    whole = sums.agg(F.struct(F.sum("total").alias("t"), F.sum("count").alias("n")).alias("w")).scalar()
    mean = ratio(F.col("total"), F.col("count"))
    share, share_n = ratio(F.col("total"), F.col("w.t")), ratio(F.col("count"), F.col("w.n"))
    within = F.when(
        mean > 0, ratio(F.col("x_log_x") - F.log(mean) * F.col("positive_total"), F.col("w.t"))
    ).otherwise(0.0)
    between = F.when((share > 0) & (share_n > 0), share * F.log(share / share_n)).otherwise(0.0)
    parts = (
        sums.where(F.col(group).isNotNull())
        .withColumn("w", whole)
        .agg(F.sum(within).alias("within"), F.sum(between).alias("between"))
        .withColumn("total", F.col("within") + F.col("between"))
    )

    def percent(part: str):
        return F.when(F.col("total") > 0, F.col(part) / F.col("total") * 100).otherwise(0.0)

    return parts.select(
        "total",
        "within",
        "between",
        percent("within").alias("within_percentage"),
        percent("between").alias("between_percentage"),
    )


def theil_report(df: DataFrame, group: str = "continent", value: str = "capacity_mw") -> DataFrame:
    """The decomposition as (metric, value) rows."""
    names = {
        "total": "Theil Index (Total)",
        "within": "Theil Within Groups",
        "between": "Theil Between Groups",
        "within_percentage": "Within Group Percentage",
        "between_percentage": "Between Group Percentage",
    }
    wide = theil_index(df, group, value)
    return wide.select(*[F.col(k).alias(v) for k, v in names.items()]).unpivot([], list(names.values()), "metric", "value")


def inequality_summary(df: DataFrame, top: int = 10) -> DataFrame:
    """Gini, Theil rows and the leading countries as one (section, subject, value) table."""
    g = gini(df, "capacity_mw").select(F.lit("gini").alias("section"), F.lit("capacity_mw").alias("subject"), F.col("gini").alias("value"))
    t = theil_report(df).select(F.lit("theil").alias("section"), F.col("metric").alias("subject"), "value")
    c = capacity_rankings(df, top).select(
        F.lit("top_countries").alias("section"), F.col("country_long").alias("subject"), F.col("total_capacity_mw").alias("value")
    )
    return g.unionByName(t).unionByName(c)
