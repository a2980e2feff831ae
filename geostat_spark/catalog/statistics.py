"""Queries over inequality, rank tests, neighbours, kernels and spatial autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from geostat_spark.catalog.inputs import define, points, raw_sites, sites, sql, table
from geostat_spark.catalog.registry import query
from geostat_spark.catalog.tabular import r
from geostat_spark.functions.permutation import FIRST, PRIME, ROUNDS, SECOND
from geostat_spark.operators import clean, hypothesis, inequality, kernel, neighbors, ordering, spatial, splits

# ---- inequality


@query("gini", sql("""SELECT round(2 * sum(i * capacity_mw) / (max(n) * sum(capacity_mw)) - (max(n) + 1) / max(n), 9) AS gini
FROM (SELECT capacity_mw, row_number() OVER (ORDER BY capacity_mw) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM raw_sites)""", "raw_sites"))
def _(spark, d):
    return r(inequality.gini(raw_sites(spark, d), "capacity_mw"), 9)


_LORENZ = """SELECT 0 AS rank, 0e0 AS x, 0e0 AS y UNION ALL
SELECT i AS rank, round((i - 1) / (n - 1e0), 9) AS x, round(c / t, 9) AS y FROM (
 SELECT row_number() OVER (ORDER BY capacity_mw, site_id) AS i, sum(capacity_mw) OVER (ORDER BY capacity_mw, site_id ROWS UNBOUNDED PRECEDING) AS c,
 count(*) OVER () AS n, sum(capacity_mw) OVER () AS t FROM raw_sites)"""


@query("lorenz_curve", sql(f"SELECT CAST(rank AS BIGINT) AS rank, x, y FROM ({_LORENZ})", "raw_sites"))
def _(spark, d):
    return r(inequality.lorenz_curve(raw_sites(spark, d), "capacity_mw"), 9)


@query("lorenz_curve_thinned", sql(f"""SELECT CAST(rank AS BIGINT) AS rank, x, y FROM ({_LORENZ})
WHERE rank % (SELECT greatest(1, count(*) // 100) FROM raw_sites) = 0 OR rank = (SELECT count(*) FROM raw_sites)""", "raw_sites"))
def _(spark, d):
    return r(inequality.lorenz_curve(raw_sites(spark, d), "capacity_mw", 100), 9)


define("theil_groups", """SELECT continent AS grp, count(*) AS n, sum(capacity_mw) AS total, avg(capacity_mw) AS mean,
 sum(capacity_mw) / (SELECT sum(capacity_mw) FROM sites) AS share, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM sites) AS share_n
 FROM sites GROUP BY 1""", "sites")
define("theil", """SELECT within_t + between_t AS total, within_t AS within, between_t AS between_, within_t / (within_t + between_t) * 100 AS wp,
 between_t / (within_t + between_t) * 100 AS bp FROM
 (SELECT sum(capacity_mw / (SELECT sum(capacity_mw) FROM sites) * ln(capacity_mw / mean)) AS within_t FROM sites JOIN theil_groups ON continent = grp),
 (SELECT sum(share * ln(share / share_n)) AS between_t FROM theil_groups)""", "theil_groups")


@query("theil_index", sql("""SELECT round(total, 9) AS total, round(within, 9) AS within, round(between_, 9) AS between,
 round(wp, 7) AS within_percentage, round(bp, 7) AS between_percentage FROM theil""", "theil"))
def _(spark, d):
    out = inequality.theil_index(sites(spark, d))
    return r(r(out, 9, "total", "within", "between"), 7, "within_percentage", "between_percentage")


@query("theil_groups", sql("""SELECT grp AS "group", n AS count, round(total, 2) AS total_capacity, round(mean, 6) AS mean_capacity,
 round(share, 9) AS share_of_total FROM theil_groups""", "theil_groups"))
def _(spark, d):
    out = inequality.theil_groups(sites(spark, d))
    return r(r(r(out, 2, "total_capacity"), 6, "mean_capacity"), 9, "share_of_total")


@query("inequality_summary", sql("""
SELECT 'gini' AS section, 'capacity_mw' AS subject, round(2 * sum(i * capacity_mw) / (max(n) * sum(capacity_mw)) - (max(n) + 1) / max(n), 6) AS value
FROM (SELECT capacity_mw, row_number() OVER (ORDER BY capacity_mw) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM sites)
UNION ALL SELECT 'theil', 'Theil Index (Total)', round(total, 6) FROM theil UNION ALL SELECT 'theil', 'Theil Within Groups', round(within, 6) FROM theil
UNION ALL SELECT 'theil', 'Theil Between Groups', round(between_, 6) FROM theil UNION ALL SELECT 'theil', 'Within Group Percentage', round(wp, 6) FROM theil
UNION ALL SELECT 'theil', 'Between Group Percentage', round(bp, 6) FROM theil
UNION ALL SELECT * FROM (SELECT 'top_countries', country_long, round(round_even(sum(capacity_mw), 3), 6) FROM sites GROUP BY country_long
 ORDER BY sum(capacity_mw) DESC, country_long LIMIT 10)""", "theil"))
def _(spark, d):
    return r(inequality.inequality_summary(sites(spark, d)), 6)


# ---- ranks and tests

def chi_upper_sql(x: str, df: str) -> str:
    """Upper chi-square tail by the plain power series of the lower one."""
    term = f"exp(({df} / 2e0 + k) * ln(greatest({x}, 1e-300) / 2) - {x} / 2 - lgamma({df} / 2e0 + k + 1))"
    return f"greatest(0e0, 1 - list_sum(list_transform(range(0, 2000), lambda k : {term})))"


def _beta_series(a: str, b: str, x: str) -> str:
    head = f"exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a}"
    return f"{head} * list_sum(list_transform(range(0, 400), lambda k : exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) + lgamma({a} + 1) - lgamma({a} + 1 + k) + k * ln({x}))))"


def student_sql(t: str, df: str) -> str:
    x, rest = f"({df} / ({df} + {t} * {t}))", f"({t} * {t} / ({df} + {t} * {t}))"
    return f"CASE WHEN {x} <= 0.5 THEN {_beta_series(f'({df} / 2e0)', '0.5e0', x)} ELSE 1 - {_beta_series('0.5e0', f'({df} / 2e0)', rest)} END"


define("ranked", """SELECT site_id, primary_fuel, is_renewable, capacity_factor AS v,
 rank() OVER (ORDER BY capacity_factor) + (count(*) OVER (PARTITION BY capacity_factor) - 1) / 2e0 AS rk FROM sites""", "sites")
define("ties", """SELECT sum(t * t * t - t) AS ties, sum(t) AS n FROM
 (SELECT CAST(count(*) AS DOUBLE) AS t FROM sites GROUP BY capacity_factor)""", "sites")
define("top12", "SELECT * FROM sites WHERE primary_fuel IN (SELECT primary_fuel FROM sites GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12)", "sites")
define("ranked12", """SELECT primary_fuel, capacity_factor AS v,
 rank() OVER (ORDER BY capacity_factor) + (count(*) OVER (PARTITION BY capacity_factor) - 1) / 2e0 AS rk FROM top12""", "top12")
define("ties12", """SELECT sum(t * t * t - t) AS ties, sum(t) AS n FROM
 (SELECT CAST(count(*) AS DOUBLE) AS t FROM top12 GROUP BY capacity_factor)""", "top12")
define("sums12", "SELECT primary_fuel AS g, CAST(count(*) AS DOUBLE) AS n, sum(rk) AS s FROM ranked12 GROUP BY 1", "ranked12")


def _top_fuels(spark, d):
    return clean.keep_top_categories(sites(spark, d), "primary_fuel", 12)


@query("average_ranks", sql("SELECT v, max(rk) AS rank, count(*) AS n FROM ranked GROUP BY v", "ranked"))
def _(spark, d):
    ranks = ordering.value_ranks(sites(spark, d).select(F.col("capacity_factor").alias("v")), "v")
    return ranks.select("v", ordering.average_rank().alias("rank"), "n")


@query("global_row_number", """SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey) AS row_no FROM orders""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey")
    return ordering.with_row_number(rows, ordering.hash_position("o_orderkey", 7), "o_orderkey")


@query("kruskal_wallis", sql("""SELECT round((12e0 / (max(t.n) * (max(t.n) + 1)) * sum(s * s / u.n) - 3 * (max(t.n) + 1)) / (1 - max(ties) / (max(t.n) * max(t.n) * max(t.n) - max(t.n))), 6) AS h_statistic,
 count(*) - 1 AS df FROM sums12 u CROSS JOIN ties12 t""", "sums12", "ties12"))
def _(spark, d):
    return r(hypothesis.kruskal_wallis(_top_fuels(spark, d), "primary_fuel", "capacity_factor").drop("p_value"), 6)


define("kruskal", """SELECT (12e0 / (max(t.n) * (max(t.n) + 1)) * sum(s * s / u.n) - 3 * (max(t.n) + 1)) / (1 - max(ties) / (max(t.n) * max(t.n) * max(t.n) - max(t.n))) AS h,
 count(*) - 1 AS df FROM sums12 u CROSS JOIN ties12 t""", "sums12", "ties12")


@query("kruskal_wallis_p", sql(f"SELECT round(h, 6) AS h_statistic, df, round({chi_upper_sql('h', 'df')}, 9) AS p_value FROM kruskal", "kruskal"))
def _(spark, d):
    return r(r(hypothesis.kruskal_wallis(_top_fuels(spark, d), "primary_fuel", "capacity_factor"), 6, "h_statistic"), 9, "p_value")


@query("dunn_test", sql("""SELECT a.g AS group_1, b.g AS group_2,
 round((a.s / a.n - b.s / b.n) / sqrt((t.n * (t.n + 1) / 12 - ties / (12 * (t.n - 1))) * (1 / a.n + 1 / b.n)), 6) + 0e0 AS z
FROM sums12 a JOIN sums12 b ON a.g < b.g CROSS JOIN ties12 t""", "sums12", "ties12"))
def _(spark, d):
    return r(hypothesis.dunn_test(_top_fuels(spark, d), "primary_fuel", "capacity_factor").drop("p_adjusted"), 6)


define("dunn", """SELECT a.g AS group_1, b.g AS group_2, (a.s / a.n - b.s / b.n) / sqrt((t.n * (t.n + 1) / 12 - ties / (12 * (t.n - 1))) * (1 / a.n + 1 / b.n)) AS z,
 (SELECT count(*) * (count(*) - 1) / 2 FROM sums12) AS m FROM sums12 a JOIN sums12 b ON a.g < b.g CROSS JOIN ties12 t""", "sums12", "ties12")


@query("dunn_test_p", sql(f"SELECT group_1, group_2, round(z, 6) + 0e0 AS z, round(least(1e0, {chi_upper_sql('(z * z)', '1')} * m), 8) AS p_adjusted FROM dunn", "dunn"))
def _(spark, d):
    return r(r(hypothesis.dunn_test(_top_fuels(spark, d), "primary_fuel", "capacity_factor"), 6, "z"), 8, "p_adjusted")


@query("mann_whitney", sql("""SELECT u AS u_statistic, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5e0) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z
FROM (SELECT sum(rk) FILTER (WHERE is_renewable = 1) - n1 * (n1 + 1) / 2 AS u, n1, n2 FROM ranked,
 (SELECT CAST(count(*) FILTER (WHERE is_renewable = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE is_renewable = 0) AS DOUBLE) AS n2 FROM sites) GROUP BY n1, n2), ties""",
    "ranked", "ties"))
def _(spark, d):
    return r(hypothesis.mann_whitney(sites(spark, d), "is_renewable", "capacity_factor").drop("p_value"), 6)


def fold_scores(spark, d):
    """Scores of five models over seven folds: mean order value by priority and year."""
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("fold"))
        .agg(F.round(F.avg("o_totalprice") / F.lit(1e6), 9).alias("r2"), F.round(F.stddev_pop("o_totalprice") / F.lit(1e6), 9).alias("mae"))
    )


define("fold_scores", """SELECT o_orderpriority AS model, year(o_orderdate) AS fold, round(avg(o_totalprice) / 1e6, 9) AS r2,
 round(stddev_pop(o_totalprice) / 1e6, 9) AS mae FROM orders GROUP BY 1, 2""")
define("pairs", """SELECT a.model AS model_1, b.model AS model_2, a.fold, a.r2 AS s1, b.r2 AS s2, a.r2 - b.r2 AS d
 FROM fold_scores a JOIN fold_scores b ON a.fold = b.fold AND a.model < b.model""", "fold_scores")


@query("model_pairs", sql("SELECT model_1, model_2, CAST(fold AS INTEGER) AS fold, s1, s2, round(d, 9) + 0e0 AS d FROM pairs", "pairs"))
def _(spark, d):
    return r(hypothesis.paired_pairs(fold_scores(spark, d)), 9)


@query("paired_t", sql("SELECT model_1, model_2, count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_statistic FROM pairs GROUP BY 1, 2", "pairs"))
def _(spark, d):
    return r(hypothesis.paired_t(hypothesis.paired_pairs(fold_scores(spark, d))).drop("t_pvalue"), 6)


@query("wilcoxon", sql("""SELECT model_1, model_2, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS wilcoxon_statistic
FROM (SELECT model_1, model_2, d, rank() OVER (PARTITION BY model_1, model_2 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model_1, model_2, abs(d)) - 1) / 2e0 AS rk
 FROM pairs WHERE d <> 0) GROUP BY 1, 2""", "pairs"))
def _(spark, d):
    return hypothesis.wilcoxon(hypothesis.paired_pairs(fold_scores(spark, d))).drop("wilcoxon_pvalue")


@query("cohens_d", sql("""SELECT model_1, model_2, round(CASE WHEN var_pop(s1) + var_pop(s2) > 0 THEN avg(d) / sqrt((var_pop(s1) + var_pop(s2)) / 2) ELSE 0 END, 6) + 0e0 AS cohens_d
FROM pairs GROUP BY 1, 2""", "pairs"))
def _(spark, d):
    pairs = hypothesis.paired_pairs(fold_scores(spark, d))
    return r(pairs.groupBy(*hypothesis.PAIR).agg(hypothesis.cohens_d().alias("cohens_d")), 6)


define("compared", f"""SELECT model_1, model_2, t, {student_sql('t', '(n - 1)')} AS tp, w,
 least(1e0, 2e0 * len(list_filter(range(0, 1 << m), lambda s : list_sum(list_transform(range(0, m), lambda i : ((s >> i) & 1) * (i + 1))) <= w)) / (1 << m)) AS wp, cd, md
FROM (SELECT model_1, model_2, count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, avg(d) AS md,
  CASE WHEN var_pop(s1) + var_pop(s2) > 0 THEN avg(d) / sqrt((var_pop(s1) + var_pop(s2)) / 2) ELSE 0 END AS cd FROM pairs GROUP BY 1, 2)
JOIN (SELECT model_1, model_2, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w, count(*) AS m
 FROM (SELECT *, rank() OVER (PARTITION BY model_1, model_2 ORDER BY abs(d)) AS rk FROM pairs WHERE d <> 0) GROUP BY 1, 2) USING (model_1, model_2)""", "pairs")
_COMPARED = """SELECT model_1, model_2, round(t, 6) + 0e0 AS t_statistic, round(tp, 9) AS t_pvalue, CAST(w AS DOUBLE) AS wilcoxon_statistic, round(wp, 9) AS wilcoxon_pvalue,
 round(cd, 6) + 0e0 AS cohens_d, tp < 0.05e0 AS significant, {} AS interpretation FROM compared"""


def _compared(spark, d, labels):
    out = hypothesis.compare_models(fold_scores(spark, d), labels=labels)
    return r(r(out, 6, "t_statistic", "cohens_d"), 9, "t_pvalue", "wilcoxon_pvalue")


@query("compare_models", sql(_COMPARED.format("""CASE WHEN tp < 0.05e0 AND md > 0 THEN 'significantly better' WHEN tp < 0.05e0 AND md < 0 THEN 'significantly worse'
 ELSE 'not significantly different' END"""), "compared"))
def _(spark, d):
    return _compared(spark, d, "direction")


@query("compare_models_difference", sql(_COMPARED.format("CASE WHEN tp < 0.05e0 THEN 'significantly different' ELSE 'not significantly different' END"), "compared"))
def _(spark, d):
    return _compared(spark, d, "difference")


@query("fold_intervals", sql("SELECT model, " + ", ".join(
    f"round(avg({m}), 9) AS {m}_mean, round(stddev_pop({m}), 9) AS {m}_std, round(quantile_cont({m}, 0.025), 9) AS {m}_ci_lower, round(quantile_cont({m}, 0.975), 9) AS {m}_ci_upper"
    for m in ("mae", "r2")) + " FROM fold_scores GROUP BY 1", "fold_scores"))
def _(spark, d):
    return r(hypothesis.fold_intervals(fold_scores(spark, d), ["mae", "r2"]), 9)


@query("significance_labels", sql("""SELECT model_1, model_2, CASE WHEN abs(t) > 2.4469118511449692e0 AND m > 0 THEN 'significantly better'
 WHEN abs(t) > 2.4469118511449692e0 AND m < 0 THEN 'significantly worse' ELSE 'not significantly different' END AS interpretation
FROM (SELECT model_1, model_2, avg(d) AS m, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM pairs GROUP BY 1, 2)""", "pairs"))
def _(spark, d):
    # 2.4469... is the two-sided 5 % point of t with 6 degrees of freedom (seven folds)
    return hypothesis.compare_models(fold_scores(spark, d)).select("model_1", "model_2", "interpretation")


# ---- splits

@query("shuffled_folds", """SELECT o_orderkey, CAST(ntile(10) OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) AS BIGINT) AS fold FROM orders""")
def _(spark, d):
    return splits.with_folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 10, shuffle=True)


@query("contiguous_folds", "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) AS BIGINT) AS fold FROM orders")
def _(spark, d):
    return splits.with_folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, shuffle=False)


_SPLIT = """SELECT site_id, continent, CASE WHEN pos <= t THEN 'test' WHEN pos <= t + ceil(round((n - t) * 0.1765e0, 9)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, ceil(round(n * 0.15e0, 9)) AS t FROM (SELECT site_id, continent,
  row_number() OVER (PARTITION BY continent ORDER BY md5(CAST(site_id AS VARCHAR) || ':42'), site_id) AS pos, count(*) OVER (PARTITION BY continent) AS n FROM sites))"""


@query("stratified_split", sql(_SPLIT, "sites"))
def _(spark, d):
    return splits.train_val_test(sites(spark, d).select("site_id", "continent"), "site_id", "continent")


# ---- neighbours and kernels

define("dists", """SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist,
 b.value AS dst_value, a.category AS cat, b.category AS dst_cat FROM points a CROSS JOIN points b""", "points")
define("knn20", """SELECT src, dst, dist, dst_value, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM dists WHERE src <> dst
 QUALIFY rank <= 20""", "dists")
define("knn8", "SELECT * FROM knn20 WHERE rank <= 8", "knn20")
define("zed", "SELECT id, value - (SELECT avg(value) FROM points) AS z, category FROM points", "points")
define("lags", "SELECT src AS id, max(s.z) AS z, avg(d.z) AS lag FROM knn8 JOIN zed s ON src = s.id JOIN zed d ON dst = d.id GROUP BY src", "knn8", "zed")


@query("knn_join", sql("SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(dist, 9) AS dist FROM knn8", "knn8"))
def _(spark, d):
    return r(neighbors.knn(points(spark, d), 8), 9)


@query("knn_join_largest_k", sql("SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(dist, 9) AS dist FROM knn20", "knn20"))
def _(spark, d):
    return r(neighbors.knn(points(spark, d), 20), 9)


_NEAREST = """SELECT a.site_id AS src, min({{'dist': sqrt((a.longitude - b.longitude) * (a.longitude - b.longitude) + (a.latitude - b.latitude) * (a.latitude - b.latitude)), 'dst': b.site_id}}, 8) AS near
 FROM {0} a JOIN {0} b ON a.site_id <> b.site_id GROUP BY 1"""
define("raw_nearest", _NEAREST.format("(SELECT site_id, longitude, latitude FROM raw_sites WHERE longitude IS NOT NULL AND latitude IS NOT NULL)"), "raw_sites")


@query("site_knn_join", sql("""SELECT src, e.dst AS dst, CAST(i AS INTEGER) AS rank, round(e.dist, 9) AS dist FROM
 (SELECT src, unnest(near) AS e, unnest(range(1, len(near) + 1)) AS i FROM raw_nearest)""", "raw_nearest"))
def _(spark, d):
    return r(neighbors.knn(raw_sites(spark, d), 8, ("longitude", "latitude"), "site_id"), 9)


@query("knn_weights", sql("SELECT src, dst, 0.125e0 AS w FROM knn8", "knn8"))
def _(spark, d):
    return spatial.knn_weights(points(spark, d))


define("both_ways", "SELECT src AS a, dst AS b FROM knn8 UNION SELECT dst, src FROM knn8", "knn8")
define("reach", "SELECT id, id AS root FROM points UNION SELECT b, root FROM reach JOIN both_ways ON a = id", "points", "both_ways")


@query("graph_components", sql("SELECT count(DISTINCT root) AS n_components FROM (SELECT id, min(root) AS root FROM reach GROUP BY id)", "reach"))
def _(spark, d):
    return spatial.graph_components(points(spark, d))


define("bands", """SELECT src AS id, dist AS bandwidth FROM (SELECT src, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM dists) WHERE rn = 51""", "dists")
define("kernels", "SELECT src, dst, dst_value, exp(-0.5e0 * (dist / bandwidth) * (dist / bandwidth)) AS kw FROM dists JOIN bands ON src = id", "dists", "bands")


@query("adaptive_bandwidth", sql("SELECT id, round(bandwidth, 9) AS bandwidth FROM bands", "bands"))
def _(spark, d):
    p = points(spark, d)
    return r(kernel.adaptive_bandwidth(p, p, 50).select("id", "bandwidth"), 9)


@query("kernel_weights", sql("""SELECT id, source, round(w, 9) AS weight FROM (SELECT src AS id, dst AS source, kw / sum(kw) OVER (PARTITION BY src) AS w FROM kernels) WHERE w >= 1e-5""", "kernels"))
def _(spark, d):
    p = points(spark, d)
    return r(kernel.kernel_weights(kernel.adaptive_bandwidth(p, p, 50), p, 1e-5), 9)


@query("kernel_lag", sql("SELECT src AS id, round(sum(kw * dst_value) / sum(kw), 7) + 0e0 AS lag FROM kernels GROUP BY src", "kernels"))
def _(spark, d):
    p = points(spark, d)
    out = kernel.kernel_average(kernel.adaptive_bandwidth(p, p, 50), p, ["value"])
    return r(out.select("id", F.col("avg_value").alias("lag")), 7)


@query("kernel_lag_of_lattices", sql("SELECT src AS id, round(sum(kw * dst_value) / sum(kw), 7) + 0e0 AS lag, true AS sure FROM kernels GROUP BY src", "kernels"))
def _(spark, d):
    """The same with lattices in place of all cells of more than eight sources, and with the error bound."""
    p = points(spark, d)
    out = kernel.kernel_average(kernel.adaptive_bandwidth(p, p, 50), p, ["value"], crowded=8)
    return r(out.select("id", F.col("avg_value").alias("lag"), (F.col("error_value") < 1e-6).alias("sure")), 7, "lag")


@query("kernel_lag_fixed_bandwidth", sql("""SELECT src AS id, round(sum(exp(-0.5e0 * (dist / 0.1e0) * (dist / 0.1e0)) * dst_value) / sum(exp(-0.5e0 * (dist / 0.1e0) * (dist / 0.1e0))), 7) + 0e0 AS lag
FROM dists GROUP BY src""", "dists"))
def _(spark, d):
    p = points(spark, d)
    out = kernel.kernel_average(kernel.fixed_bandwidth(p.select("id", "x", "y"), 0.1), p, ["value"])
    return r(out.select("id", F.col("avg_value").alias("lag")), 7)


# ---- autocorrelation

@query("morans_i", sql("SELECT round(sum(z * lag) / sum(z * z), 7) AS moran_i, count(*) AS n FROM lags", "lags"))
def _(spark, d):
    return r(spatial.morans_i(points(spark, d), "value"), 7)


define("site_z", "SELECT site_id, longitude, latitude, capacity_factor - (SELECT avg(capacity_factor) FROM sites) AS z FROM sites", "sites")
define("site_nearest", _NEAREST.format("site_z"), "site_z")


@query("site_morans_i", sql("""SELECT round(sum(z * lag) / sum(z * z), 7) AS moran_i, count(*) AS n FROM (SELECT src, max(s.z) AS z, avg(t.z) AS lag FROM
 (SELECT src, unnest(near).dst AS dst FROM site_nearest) JOIN site_z s ON s.site_id = src JOIN site_z t ON t.site_id = dst GROUP BY src)""", "site_nearest"))
def _(spark, d):
    rows = sites(spark, d).withColumnRenamed("site_id", "id")
    return r(spatial.morans_i(rows, "capacity_factor", 8, ("longitude", "latitude")), 7, "moran_i")


@query("morans_i_normal", sql("""SELECT round(i, 7) AS moran_i, round(e, 9) AS expected_i, round(v, 9) AS variance, round((i - e) / sqrt(v), 5) AS z_score FROM (
 SELECT i, -1 / (n - 1) AS e, (n * n * s1 - n * s2 + 3 * n * n) / ((n * n - 1) * n * n) - (1 / (n - 1)) * (1 / (n - 1)) AS v
 FROM (SELECT sum(z * lag) / sum(z * z) AS i, CAST(count(*) AS DOUBLE) AS n FROM lags),
 (SELECT sum(w * w) AS s1 FROM (SELECT sum(0.125e0) AS w FROM knn8 GROUP BY least(src, dst), greatest(src, dst))),
 (SELECT sum((1 + coalesce(c, 0) / 8e0) * (1 + coalesce(c, 0) / 8e0)) AS s2 FROM points LEFT JOIN (SELECT dst, count(*) AS c FROM knn8 GROUP BY 1) ON dst = id))""", "lags"))
def _(spark, d):
    out = spatial.morans_i_normal(points(spark, d), "value").drop("p_value")
    return r(r(r(out, 7, "moran_i"), 9, "expected_i", "variance"), 5, "z_score")


def _mix(source: str, x: str, key: str, out: str) -> str:
    """The table with 31 mixed bits of ``x`` under ``key`` as a column ``out``."""
    first = f"SELECT *, ({x} + {key}) % {PRIME} * {FIRST} % {PRIME} AS f_ FROM {source}"
    second = f"SELECT *, (xor(f_, f_ >> 16) * {SECOND} + {key}) % {PRIME} AS s_ FROM ({first})"
    return f"(SELECT * EXCLUDE (f_, s_), xor(s_, s_ >> 13) AS {out} FROM ({second}))"


def _keys(turns: str, seed: int = 42, permutations: int = 999) -> str:
    numbers = f"(SELECT p, turn FROM (SELECT unnest(range({permutations})) AS p), (SELECT unnest({turns}) AS turn))"
    return _mix(_mix(numbers, "(p + 1)", str(seed + 1), "h_"), "h_", "(turn + 1)", "key")


def _permuted_sql(name: str, rows: str, needs: str) -> str:
    """Adds ``name`` (g, p, x, z): the value z that permutation p puts at place x. rows: table (g, n, i, z)."""
    step = f"(SELECT *, x // b AS l, x % b AS r FROM {name}_walk WHERE NOT done)"
    for turn in range(ROUNDS):
        moved, other, side = ("l", "r", "a") if turn % 2 == 0 else ("r", "l", "b")
        step = f"(SELECT * EXCLUDE (h_) REPLACE (({moved} + h_) % {side} AS {moved}) FROM {_mix(step, other, f'ks[{turn + 1}]', 'h_')})"
    sides = f"SELECT *, (n + a - 1) // a AS b FROM (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM {rows})"
    define(
        f"{name}_walk",
        f"""SELECT g, n, a, b, i, z, p, ks, i AS x, false AS done FROM ({sides}),
 (SELECT p, list(key ORDER BY turn) AS ks FROM {_keys(f'range({ROUNDS})')} GROUP BY p)
 UNION ALL SELECT g, n, a, b, i, z, p, ks, l * b + r AS x, l * b + r < n AS done FROM {step}""",
        needs,
    )
    return define(name, f"SELECT g, p, x, z FROM {name}_walk WHERE done", f"{name}_walk")


define("numbered", """SELECT 0 AS g, count(*) OVER () AS n, id, z, row_number() OVER (ORDER BY substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 14), id) - 1 AS i FROM zed""", "zed")
_permuted_sql("permuted", "numbered", "numbered")


def _tests_sql(ks: str, permuted: str, rows: str, near: str, group: str) -> str:
    """(k, group, n, moran_i, p_value, z_score) by a plain join of every permuted value to its neighbours'."""
    return f"""SELECT k, {group}, max(n) AS n, max(i) AS moran_i, (least(count(*) FILTER (WHERE ip >= i), count(*) FILTER (WHERE ip < i)) + 1) / 1000e0 AS p_value,
 (max(i) - avg(ip)) / stddev_pop(ip) AS z_score
FROM (SELECT k, l.g, l.p, sum(v.z * lag) AS cross_ FROM
  (SELECT k, d.g, p, s.i AS x, avg(v.z) AS lag FROM (VALUES {ks}) kk(k) JOIN {near} e ON e.rank <= k JOIN {rows} s ON s.id = e.src JOIN {rows} d ON d.id = e.dst
   JOIN {permuted} v ON v.g = d.g AND v.x = d.i GROUP BY ALL) l JOIN {permuted} v ON v.g = l.g AND v.p = l.p AND v.x = l.x GROUP BY ALL) c
JOIN (SELECT k, g, {group} AS grp, sum(z * lag) / sum(z * z) AS i, sum(z * z) AS zz, count(*) AS n FROM
  (SELECT k, s.g, s.id, max(s.{group}) AS {group}, max(s.z) AS z, avg(d.z) AS lag FROM (VALUES {ks}) kk(k) JOIN {near} e ON e.rank <= k JOIN {rows} s ON s.id = e.src JOIN {rows} d ON d.id = e.dst GROUP BY ALL)
  GROUP BY ALL) o USING (k, g), LATERAL (SELECT cross_ / zz AS ip, grp AS {group}) GROUP BY k, {group}"""


define("moran_tests", _tests_sql("(8)", "permuted", "(SELECT *, g AS grp_ FROM numbered)", "knn20", "grp_"), "permuted", "knn20")
define("moran_tests_by_k", _tests_sql("(4), (8), (12), (16), (20)", "permuted", "(SELECT *, g AS grp_ FROM numbered)", "knn20", "grp_"), "permuted", "knn20")


@query("morans_i_permutation", sql("SELECT round(moran_i, 7) AS moran_i, p_value, round(z_score, 6) AS z_score FROM moran_tests", "moran_tests"))
def _(spark, d):
    return r(r(spatial.morans_i_permutation(points(spark, d), "value"), 7, "moran_i"), 6, "z_score")


@query("site_morans_i_permutation")
def _(spark, d):
    """All sites, 999 permutations."""
    rows = sites(spark, d).withColumnRenamed("site_id", "id").select("id", "longitude", "latitude", "capacity_factor")
    return spatial.morans_i_permutation(rows, "capacity_factor", 8, ("longitude", "latitude"))


@query("moran_scatter", sql("SELECT id, round(z / s, 7) + 0e0 AS z, round(lag / s, 7) + 0e0 AS lag FROM lags, (SELECT stddev_pop(value) AS s FROM points)", "lags"))
def _(spark, d):
    return r(spatial.moran_scatter(points(spark, d), "value"), 7)


@query("moran_scatter_sample", sql("""SELECT id, round(z / s, 7) + 0e0 AS z, round(lag / s, 7) + 0e0 AS lag FROM lags, (SELECT stddev_pop(value) AS s FROM points)
ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 5000""", "lags"))
def _(spark, d):
    return r(clean.sample_rows(spatial.moran_scatter(points(spark, d), "value"), "id", 5000), 7)


@query("local_moran", sql("""SELECT id, round(z, 7) + 0e0 AS z, round(lag, 7) + 0e0 AS lag, round((count(*) OVER () - 1) * z * lag / sum(z * z) OVER (), 6) + 0e0 AS local_i,
 CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS lisa_cluster FROM lags""", "lags"))
def _(spark, d):
    return r(r(spatial.local_moran(points(spark, d), "value"), 7, "z", "lag"), 6, "local_i")


define("floyd", f"""SELECT p, 0 AS step, n, []::BIGINT[] AS d FROM (SELECT unnest(range(999)) AS p), (SELECT count(*) AS n FROM points)
 UNION ALL SELECT f.p, step + 1, n, list_append(d, CASE WHEN list_contains(d, h_ % (j + 1)) THEN j ELSE h_ % (j + 1) END)
 FROM {_mix(f"(SELECT f.*, n - 1 - 8 + step AS j, key FROM floyd f JOIN {_keys('[77]')} k ON k.p = f.p WHERE step < 8)", "j", "key", "h_")} f""", "points")
define("local_tests", """SELECT s.id, max(li) AS local_i, max(lc) AS lisa_cluster, (least(count(*) FILTER (WHERE s.z * lag_p >= s.z * s.lag), count(*) FILTER (WHERE s.z * lag_p < s.z * s.lag)) + 1) / 1000e0 AS lisa_pvalue
FROM (SELECT *, (count(*) OVER () - 1) * z * lag / sum(z * z) OVER () AS li, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS lc FROM lags) s
JOIN (SELECT o.id, p, avg(v.z) AS lag_p FROM numbered o CROSS JOIN (SELECT p, unnest(d) AS pos FROM floyd WHERE step = 8) f JOIN numbered v ON v.i = CASE WHEN pos < o.i THEN pos ELSE pos + 1 END GROUP BY ALL) l ON l.id = s.id GROUP BY s.id""",
    "lags", "numbered", "floyd")


@query("local_moran_significance", sql("""SELECT id, round(local_i, 6) + 0e0 AS local_i, lisa_cluster, lisa_pvalue, CAST(lisa_pvalue < 0.05e0 AS INTEGER) AS lisa_significant FROM local_tests""", "local_tests"))
def _(spark, d):
    return r(spatial.local_moran_significance(points(spark, d), "value"), 6, "local_i")


@query("significance_breakdown", sql("""SELECT lisa_cluster, count(*) AS sites, CAST(sum(CAST(lisa_pvalue < 0.05e0 AS BIGINT)) AS BIGINT) AS significant,
 round(100e0 * sum(CAST(lisa_pvalue < 0.05e0 AS BIGINT)) / (SELECT count(*) FROM local_tests), 7) AS significant_pct FROM local_tests GROUP BY 1""", "local_tests"))
def _(spark, d):
    return r(spatial.significance_breakdown(spatial.local_moran_significance(points(spark, d), "value")), 7)


define("cat_z", "SELECT id, category, value - avg(value) OVER (PARTITION BY category) AS z FROM points", "points")
define("cat_knn", """SELECT src, dst, cat FROM dists WHERE src <> dst AND cat = dst_cat
 QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 8""", "dists")


define("top_category", """SELECT category, row_number() OVER (ORDER BY category) - 1 AS g FROM (SELECT category FROM points GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6)""", "points")
define("cat_numbered", """SELECT g, count(*) OVER (PARTITION BY g) AS n, id, z, category,
 row_number() OVER (PARTITION BY g ORDER BY substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 14), id) - 1 AS i FROM cat_z JOIN top_category USING (category)""", "cat_z", "top_category")
define("cat_near", "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rank FROM cat_knn", "cat_knn")
_permuted_sql("cat_permuted", "cat_numbered", "cat_numbered")
define("moran_tests_by_category", _tests_sql("(8)", "cat_permuted", "cat_numbered", "cat_near", "category"), "cat_permuted", "cat_near")


@query("morans_i_by_category", sql("""SELECT category, round(moran_i, 7) + 0e0 AS moran_i, n, p_value, round(z_score, 6) + 0e0 AS z_score FROM moran_tests_by_category WHERE n > 50""", "moran_tests_by_category"))
def _(spark, d):
    return r(r(spatial.morans_i_by_category(points(spark, d), "value", "category"), 7, "moran_i"), 6, "z_score")


@query("morans_i_by_k", sql("""SELECT CAST(k AS INTEGER) AS k, round(moran_i, 7) + 0e0 AS moran_i, p_value, round(z_score, 6) + 0e0 AS z_score FROM moran_tests_by_k""", "moran_tests_by_k"))
def _(spark, d):
    return r(r(spatial.morans_i_by_k(points(spark, d), "value"), 7, "moran_i"), 6, "z_score")


@query("autocorrelation_label", sql("""SELECT round(moran_i, 7) AS moran_i, p_value, round(z_score, 6) AS z_score, CASE WHEN p_value >= 0.05e0 THEN 'no significant spatial autocorrelation'
 WHEN moran_i > 0 THEN 'significant positive spatial autocorrelation' ELSE 'significant negative spatial autocorrelation' END AS interpretation FROM moran_tests""", "moran_tests"))
def _(spark, d):
    from geostat_spark.functions.scalar import autocorrelation_label

    out = spatial.morans_i_permutation(points(spark, d), "value")
    out = out.withColumn("interpretation", autocorrelation_label(F.col("p_value"), F.col("moran_i")))
    return r(r(out, 7, "moran_i"), 6, "z_score")
