"""Rank-based and paired tests. Ranks and sums are Spark jobs; the tail probability of the resulting statistic is an
expression over the finished rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geostat_spark.functions.scalar import direction_label, ratio, significance_label
from geostat_spark.functions.tails import chi_square_p, normal_p, signed_rank_p, student_p
from geostat_spark.operators.ordering import average_rank, value_ranks
from geostat_spark.session import cut


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: ``n``, ``rank_sum`` (average ranks over all rows), plus the whole table's ``rows`` and
    ``ties`` = sum(t^3 - t). Rows collapse to (value, group) counts before anything is ranked."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(
        F.col(group).alias("g"), F.col(value).cast("double").alias("v")
    )
    held = cut(rows.groupBy("v", "g").agg(F.count(F.lit(1)).alias("held")))
    ranks = value_ranks(held, "v", copies=F.col("held")).select("v", average_rank().alias("rank"), "n")
    n = F.col("n").cast("double")
    whole = ranks.agg(
        F.struct(F.sum(n).alias("rows"), F.sum(n * n * n - n).alias("ties")).alias("w")
    ).scalar()
    per_group = held.join(ranks.select("v", "rank"), "v").groupBy("g").agg(
        F.sum("held").alias("n"), F.sum(F.col("held") * F.col("rank")).alias("rank_sum")
    )
    return cut(
        per_group.withColumn("w", whole).select(
            F.col("g").alias(group), "n", "rank_sum", F.col("w.rows").alias("rows"), F.col("w.ties").alias("ties")
        )
    )


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """Tie-corrected H over all groups, its degrees of freedom and chi-square p."""
    s = rank_sums(df, group, value)
    n, ties = F.max("rows"), F.max("ties")
    raw = 12.0 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (n + 1)
    return s.agg(
        (ratio(raw, 1 - ties / (n * n * n - n))).alias("h_statistic"),
        (F.count(F.lit(1)) - 1).alias("df"),
    ).withColumn("p_value", chi_square_p("h_statistic", F.col("df").cast("double")))


def dunn_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """All pairs of groups: z of the mean-rank difference and the Bonferroni-adjusted p. The group table
    (one row per group) pairs with itself by name order."""
    s = rank_sums(df, group, value)
    a = s.select(F.col(group).alias("group_1"), F.col("n").alias("n1"), (F.col("rank_sum") / F.col("n")).alias("mean_1"), "rows", "ties")
    b = s.select(F.col(group).alias("group_2"), F.col("n").alias("n2"), (F.col("rank_sum") / F.col("n")).alias("mean_2"))
    pairs = a.join(b, F.col("group_1") < F.col("group_2"))
    n = F.col("rows")
    variance = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("n1") + 1 / F.col("n2"))
    groups = s.agg(F.count(F.lit(1)).alias("g")).scalar()
    scored = pairs.withColumn("z", ratio(F.col("mean_1") - F.col("mean_2"), F.sqrt(variance))).withColumn("m", groups * (groups - 1) / 2)
    return scored.select(
        "group_1", "group_2", "z", F.least(F.lit(1.0), normal_p("z") * F.col("m")).alias("p_adjusted")
    )


def mann_whitney(df: DataFrame, flag: str, value: str) -> DataFrame:
    """U of the flagged group against the rest, two-sided p by the tie-corrected normal approximation
    with continuity correction."""
    s = rank_sums(df, flag, value)
    one = F.col(flag).cast("int") == 1
    sums = s.agg(
        F.max(F.when(one, F.col("n"))).cast("double").alias("n1"),
        F.max(F.when(~one, F.col("n"))).cast("double").alias("n2"),
        F.max(F.when(one, F.col("rank_sum"))).alias("r1"),
        F.max("rows").alias("n"),
        F.max("ties").alias("ties"),
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mean = F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(
        F.col("n1") * F.col("n2") / 12 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    )
    larger = F.greatest(u, F.col("n1") * F.col("n2") - u)
    return sums.select(u.alias("u_statistic"), ratio(larger - mean - 0.5, sd).alias("z")).select(
        "u_statistic", "z", F.least(F.lit(1.0), F.when(F.col("z") < 0, F.lit(1.0)).otherwise(normal_p("z"))).alias("p_value")
    )


def paired_pairs(scores: DataFrame, score: str = "r2") -> DataFrame:
    """Fold-wise differences of every unordered pair of models: (model_1, model_2, fold, s1, s2, d)."""
    a = scores.select(F.col("model").alias("model_1"), "fold", F.col(score).alias("s1"))
    b = scores.select(F.col("model").alias("model_2"), "fold", F.col(score).alias("s2"))
    return a.join(b, "fold").where(F.col("model_1") < F.col("model_2")).withColumn("d", F.col("s1") - F.col("s2"))


PAIR = ["model_1", "model_2"]


def paired_t(pairs: DataFrame) -> DataFrame:
    """t = mean(d) / (std(d) / sqrt(n)) per pair of models."""
    n = F.count("d")
    sums = pairs.groupBy(*PAIR).agg(
        n.alias("n"), ratio(F.avg("d"), F.stddev_samp("d") / F.sqrt(n)).alias("t_statistic")
    )
    return sums.withColumn("t_pvalue", student_p("t_statistic", (F.col("n") - 1).cast("double")))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """min(W+, W-) over the non-zero differences per pair. Exact p without ties up to 50 differences,
    tie-corrected normal approximation otherwise. A pair holds one row per fold, so its window is small
    by construction."""
    used = pairs.where(F.col("d") != 0).withColumn("size", F.abs("d"))
    same = Window.partitionBy(*PAIR, "size")
    ranked = used.withColumn("t", F.count(F.lit(1)).over(same)).withColumn(
        "rank", F.rank().over(Window.partitionBy(*PAIR).orderBy("size")) + (F.col("t") - 1) / 2.0
    )
    sums = ranked.groupBy(*PAIR).agg(
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("minus"),
        F.count(F.lit(1)).alias("m"),
        # each of the t tied rows adds (t^3 - t) / t
        F.sum(F.col("t") * F.col("t") - 1).alias("ties"),
    )
    zeros = pairs.groupBy(*PAIR).agg(F.count_if(F.col("d") == 0).alias("zeros"))
    m = F.col("m").cast("double")
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    z = ratio(F.col("wilcoxon_statistic") - m * (m + 1) / 4, sd)
    exact = (F.col("m") <= 50) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    return (
        sums.join(zeros, PAIR)
        .withColumn("wilcoxon_statistic", F.least("plus", "minus"))
        .withColumn("z", z)
        .select(
            *PAIR,
            "wilcoxon_statistic",
            F.when(exact, signed_rank_p("wilcoxon_statistic", m)).otherwise(normal_p("z")).alias("wilcoxon_pvalue"),
        )
    )


def cohens_d() -> Column:
    """Mean difference over the pooled population deviation, an aggregate over paired rows."""
    pooled = F.sqrt((F.var_pop("s1") + F.var_pop("s2")) / 2)
    return F.when(pooled > 0, F.avg("d") / pooled).otherwise(0.0)


def compare_models(scores: DataFrame, score: str = "r2", alpha: float = 0.05, labels: str = "direction") -> DataFrame:
    """Every pair of models: paired t, Wilcoxon, effect size, verdict. ``labels`` picks the wording:
    'direction' says better or worse, 'difference' only whether they differ."""
    if labels not in ("direction", "difference"):
        raise ValueError("labels must be 'direction' or 'difference'")
    pairs = paired_pairs(scores, score)
    effect = pairs.groupBy(*PAIR).agg(cohens_d().alias("cohens_d"), F.avg("d").alias("mean_difference"))
    out = paired_t(pairs).drop("n").join(wilcoxon(pairs), PAIR, "left").join(effect, PAIR)
    verdict = (
        direction_label(F.col("t_pvalue"), F.col("mean_difference"), alpha)
        if labels == "direction"
        else significance_label(F.col("t_pvalue"), alpha)
    )
    return out.select(
        *PAIR, "t_statistic", "t_pvalue", "wilcoxon_statistic", "wilcoxon_pvalue", "cohens_d",
        F.coalesce(F.col("t_pvalue") < alpha, F.lit(False)).alias("significant"), verdict.alias("interpretation"),
    )


def fold_intervals(scores: DataFrame, metrics: list[str], level: float = 0.95) -> DataFrame:
    """Mean, population std and percentile interval of each metric over the folds of a model. A model has
    one row per fold, so the exact percentile aggregate stays small."""
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    aggs = []
    for m in metrics:
        aggs += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_pop(m).alias(f"{m}_std"),
            F.percentile(m, low).alias(f"{m}_ci_lower"),
            F.percentile(m, high).alias(f"{m}_ci_upper"),
        ]
    return scores.groupBy("model").agg(*aggs)
