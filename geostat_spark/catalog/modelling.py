"""Queries over splits, models, evaluation and the locally weighted ensemble.

Models here are smaller than the library defaults (fewer trees, less depth): the registered queries run
every operator on whole tables, the defaults are those of the functions they call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geostat_spark.catalog.inputs import define, points, sites, sql, table
from geostat_spark.catalog.registry import query
from geostat_spark.catalog.statistics import _SPLIT, fold_scores
from geostat_spark.catalog.tabular import r
from geostat_spark.functions import tails
from geostat_spark.functions.permutation import mixed_sql
from geostat_spark.operators import ensemble, evaluation, hypothesis, models, resampling, shap, splits
from geostat_spark.plans import reports
from geostat_spark.session import cut, last_path, release_others, shared_folder, shuffles_dropped, tables_so_far
from geostat_spark.sources import models as stored, tables


def _parts(spark, d):
    """(feature names, rows with split) of the model table, written out once; what led to it is deleted."""
    since = tables_so_far()
    with shuffles_dropped(spark):
        rows, names = models.model_table(sites(spark, d))
        split = splits.train_val_test(rows)
        keep = ["site_id", "latitude", "longitude", "split"]
        parts = models.training_table(models.assembled(split, names, keep=keep))
        release_others(spark, since, [last_path()])
    return names, parts


def _train_test(spark, d):
    names, rows = _parts(spark, d)
    return names, rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")


_FUELS = sorted(f"{p} {s}" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for s in "FOP")
_CONTINENTS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "Unknown"]


@query("model_table", sql("SELECT site_id, capacity_mw, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, plant_age, round(log_capacity_mw, 9) AS log_capacity_mw, round(regional_renewable_share, 9) AS regional_renewable_share, "
    + ", ".join(f"CAST(primary_fuel = '{v}' AS INTEGER) AS \"primary_fuel_{v}\"" for v in _FUELS) + ", "
    + ", ".join(f"CAST(continent = '{v}' AS INTEGER) AS \"continent_{v}\"" for v in _CONTINENTS)
    + ", round(capacity_factor, 9) AS capacity_factor FROM sites WHERE plant_age IS NOT NULL", "sites"))
def _(spark, d):
    rows, names = models.model_table(sites(spark, d))
    return r(rows.select("site_id", *names, "capacity_factor"), 9)


define("parts", _SPLIT, "sites")
define("scored", """SELECT s.site_id, s.primary_fuel, s.is_renewable, s.capacity_factor AS actual, f.m AS predicted
 FROM sites s JOIN (SELECT primary_fuel, avg(capacity_factor) AS m FROM sites GROUP BY 1) f ON s.primary_fuel = f.primary_fuel""", "sites")


def _scored(spark, d):
    """Sites with the mean of their fuel as the prediction: a model any engine can reproduce."""
    s = sites(spark, d)
    means = s.groupBy("primary_fuel").agg(F.avg("capacity_factor").alias("predicted"))
    return s.join(means, "primary_fuel").select(
        "site_id", "primary_fuel", "is_renewable", F.col("capacity_factor").alias("actual"), "predicted"
    )


@query("constant_baselines", sql("""SELECT model, count(*) AS n, round(avg(abs(a - p)), 8) AS mae, round(sqrt(avg((a - p) * (a - p))), 8) AS rmse,
 round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 8) AS r2 FROM (
 SELECT 'Mean Baseline' AS model, s.capacity_factor AS a, (SELECT avg(t.capacity_factor) FROM sites t JOIN parts q ON t.site_id = q.site_id WHERE q.split = 'train') AS p
 FROM sites s JOIN parts USING (site_id) WHERE split = 'test'
 UNION ALL SELECT 'Median Baseline', s.capacity_factor, (SELECT median(t.capacity_factor) FROM sites t JOIN parts q ON t.site_id = q.site_id WHERE q.split = 'train')
 FROM sites s JOIN parts USING (site_id) WHERE split = 'test') GROUP BY 1""", "parts"))
def _(spark, d):
    rows = cut(splits.train_val_test(sites(spark, d)))
    return r(models.constant_baselines(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test"), "capacity_factor"), 8)


@query("prediction_scores", sql("""SELECT primary_fuel, count(*) AS n, round(avg(abs(actual - predicted)), 8) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 8) AS rmse,
 round(1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)), 8) + 0e0 AS r2 FROM scored GROUP BY 1""", "scored"))
def _(spark, d):
    return r(evaluation.score(_scored(spark, d), "actual", "predicted", ["primary_fuel"]), 8)


@query("residuals", sql("""SELECT site_id, primary_fuel, is_renewable, actual, round(predicted, 8) AS predicted, round(actual - predicted, 8) + 0e0 AS residual, round(abs(actual - predicted), 8) AS abs_error FROM scored""", "scored"))
def _(spark, d):
    return r(evaluation.residuals(_scored(spark, d)), 8, "predicted", "residual", "abs_error")


@query("residual_stats", sql("""SELECT round(avg(e), 7) + 0e0 AS mean, round(stddev_samp(e), 7) AS std, round(min(e), 7) AS min, round(max(e), 7) AS max, round(median(e), 7) AS median
FROM (SELECT actual - predicted AS e FROM scored)""", "scored"))
def _(spark, d):
    return r(evaluation.residual_stats(evaluation.residuals(_scored(spark, d))), 7)


@query("error_by_category", sql("""SELECT primary_fuel, round(avg(abs(actual - predicted)), 7) AS mean, round(median(abs(actual - predicted)), 7) AS median, count(*) AS count
FROM scored GROUP BY 1 HAVING count(*) >= 20 ORDER BY mean DESC, 1 LIMIT 15""", "scored"))
def _(spark, d):
    return r(evaluation.error_by_category(evaluation.residuals(_scored(spark, d)), "primary_fuel"), 7)


@query("best_model", sql("""SELECT (SELECT arg_max(model, r2) FROM means) AS best_model, (SELECT round(max(r2), 9) FROM means) AS best_r2, arg_max(model, r2) AS best_baseline,
 round(max(r2), 9) AS baseline_r2, round(((SELECT max(r2) FROM means) - max(r2)) / abs(max(r2)) * 100, 6) AS improvement_pct
FROM (SELECT o_orderstatus AS model, avg(o_totalprice) / 1e6 AS r2 FROM orders GROUP BY 1)""".replace("means", "(SELECT model, avg(r2) AS r2 FROM fold_scores GROUP BY 1)"), "fold_scores"))
def _(spark, d):
    scores = fold_scores(spark, d).groupBy("model").agg(F.avg("r2").alias("r2"))
    orders = table(spark, d, "orders")
    base = orders.groupBy(F.col("o_orderstatus").alias("model")).agg((F.avg("o_totalprice") / F.lit(1e6)).alias("r2"))
    return r(r(evaluation.best_model(scores, base), 9, "best_r2", "baseline_r2"), 6, "improvement_pct")


# ---- fitted models


def _fitted(name, maker):
    @query(name)
    def _(spark, d):
        _, train, test = _train_test(spark, d)
        model = models.fitted(maker, train)
        return evaluation.score(model.transform(test), "label", "prediction").withColumn("model", F.lit(name))


_fitted("random_forest", lambda t: models.random_forest(trees=20, depth=8))
_fitted("boosted_trees", lambda t: models.boosted_trees(rounds=15, depth=4))
_fitted("gradient_boosting", lambda t: models.gradient_boosting(rounds=15))
_fitted("ridge", lambda t: models.ridge(t))
_fitted("least_squares", lambda t: models.least_squares())


@query("naive_baselines")
def _(spark, d):
    _, train, test = _train_test(spark, d)
    return models.naive_baselines(train, test)


def _small_learners():
    return {
        "rf": lambda t: models.random_forest(trees=10, depth=6, min_leaf=1),
        "gb": lambda t: models.gradient_boosting(rounds=8),
        "ridge": lambda t: models.ridge(t),
    }


@query("model_comparison")
def _(spark, d):
    """Fitted models are saved, found again and compared on the stored test part."""
    _, train, test = _train_test(spark, d)
    shelf = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    fitted = {}
    for name, maker in _small_learners().items():
        stored.load_or_fit(spark, f"{shelf}/{name}", lambda: models.fitted(maker, train))
        fitted[name] = stored.load_model(spark, f"{shelf}/{name}")
    return models.model_comparison(fitted, test)


@query("cross_validation")
def _(spark, d):
    _, rows = _parts(spark, d)
    makers = {"forest": lambda t: models.random_forest(trees=5, depth=5), "linear": lambda t: models.least_squares()}
    scores = models.cross_validate(rows, makers, folds=10)
    return hypothesis.fold_intervals(scores, ["mae", "rmse", "r2"])


@query("cross_validated_report")
def _(spark, d):
    """Forest and boosting in ten folds; their fold scores go into intervals, paired tests and, with the ablation of
    feature groups, into one report."""
    rows, names = models.model_table(sites(spark, d))
    makers = {"forest": lambda t: models.random_forest(trees=5, depth=5), "boosting": lambda t: models.gradient_boosting(rounds=4)}
    scores = cut(models.cross_validate(models.assembled(rows, names, keep=["site_id"]), makers, folds=10))
    drops = models.ablation(rows, names, makers["forest"])
    return reports.statistical_report(
        hypothesis.fold_intervals(scores, ["mae", "rmse", "r2"]), hypothesis.compare_models(scores).drop("interpretation", "significant"), drops
    )


@query("ablation")
def _(spark, d):
    rows, names = models.model_table(sites(spark, d))
    return models.ablation(rows, names, lambda t: models.random_forest(trees=5, depth=5))


@query("feature_importance")
def _(spark, d):
    names, train, _ = _train_test(spark, d)
    return models.importances(models.fitted(lambda t: models.random_forest(trees=10, depth=6), train), names)


@query("shap_importance")
def _(spark, d):
    names, train, test = _train_test(spark, d)
    model = models.fitted(lambda t: models.boosted_trees(rounds=10, depth=4), train)
    return shap.shap_importance(shap.shap_values(model, test, names), names)


@query("bootstrap_intervals")
def _(spark, d):
    return resampling.bootstrap_draws(_scored(spark, d), "actual", "predicted", replicates=1000)


_LEVELS = ", ".join(map(str, resampling.poisson_levels()))
_OF_REPLICATE = mixed_sql("key", "(rep + 1)")
define("boot_rows", """SELECT CAST('0x' || substr(md5(CAST(site_id AS VARCHAR) || ':42'), 1, 15) AS BIGINT) AS key, abs(actual - predicted) AS e1,
 (actual - predicted) * (actual - predicted) AS e2, actual - (SELECT avg(actual) FROM scored) AS y FROM scored""", "scored")
define("boot_hashed", f"SELECT rep, key, e1, e2, y, {_OF_REPLICATE} AS h FROM boot_rows, (SELECT unnest(range(1000)) AS rep)", "boot_rows")
define("boot_weighted", f"""SELECT rep, e1, e2, y, len(list_filter([{_LEVELS}]::BIGINT[], lambda v : v <= u)) AS w
 FROM (SELECT *, ({mixed_sql('h', '1')} << 31) | {mixed_sql('h', '2')} AS u FROM boot_hashed)""", "boot_hashed")
define("boot_scores", """SELECT sum(w * e1) / sum(w) AS mae, sqrt(sum(w * e2) / sum(w)) AS rmse, 1 - sum(w * e2) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)) AS r2 FROM boot_weighted GROUP BY rep""", "boot_weighted")


@query("bootstrap_intervals_weighted", sql(" UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(avg({m}), 8) AS mean, round(stddev_pop({m}), 8) AS std, round(quantile_cont({m}, 0.025), 8) AS ci_lower, round(quantile_cont({m}, 0.975), 8) AS ci_upper FROM boot_scores"
    for m in ("mae", "rmse", "r2")), "boot_scores"))
def _(spark, d):
    return r(resampling.bootstrap_weights(_scored(spark, d), "actual", "predicted", replicates=1000), 8)


def _horner(coefficients, x: str) -> str:
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


def _quantile_sql(p: str) -> str:
    ratio = lambda pair, x: f"{_horner(pair[0], x)} / {_horner(pair[1], x)}"
    centre, side = f"(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))", f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {side} <= 5 THEN {ratio(tails.TAILS, f'({side} - 1.6e0)')} ELSE {ratio(tails.FAR_TAILS, f'({side} - 5)')} END"
    return f"CASE WHEN abs({p} - 0.5e0) <= 0.425e0 THEN ({p} - 0.5e0) * {ratio(tails.CENTRE, centre)} ELSE sign({p} - 0.5e0) * ({tail}) END"


define("medians", """SELECT rank, e AS ordered, CASE WHEN rank = n THEN pow(0.5e0, 1e0 / n) WHEN rank = 1 THEN 1 - pow(0.5e0, 1e0 / n) ELSE (rank - 0.3175e0) / (n + 0.365e0) END AS p
FROM (SELECT actual - predicted AS e, row_number() OVER (ORDER BY actual - predicted) AS rank, count(*) OVER () AS n FROM scored)""", "scored")
define("quantiles", f"SELECT rank, ordered, {_quantile_sql('p')} AS theoretical FROM medians", "medians")


@query("normal_quantiles", sql("SELECT rank, round(theoretical, 9) + 0e0 AS theoretical, round(ordered, 9) + 0e0 AS ordered FROM quantiles", "quantiles"))
def _(spark, d):
    return r(resampling.normal_quantiles(evaluation.residuals(_scored(spark, d)), "residual"), 9)


@query("normal_fit", sql("SELECT round(regr_slope(ordered, theoretical), 8) AS slope, round(regr_intercept(ordered, theoretical), 8) + 0e0 AS intercept, round(corr(ordered, theoretical), 8) AS r FROM quantiles", "quantiles"))
def _(spark, d):
    return r(resampling.normal_fit(resampling.normal_quantiles(evaluation.residuals(_scored(spark, d)), "residual")), 8)


@query("validation_report", sql("""SELECT 'cross_validation' AS section, model AS subject, metric, round(value, 8) AS value FROM (
 SELECT model, 'r2_mean' AS metric, avg(r2) AS value FROM fold_scores GROUP BY 1 UNION ALL SELECT model, 'r2_std', stddev_pop(r2) FROM fold_scores GROUP BY 1
 UNION ALL SELECT model, 'r2_ci_lower', quantile_cont(r2, 0.025) FROM fold_scores GROUP BY 1 UNION ALL SELECT model, 'r2_ci_upper', quantile_cont(r2, 0.975) FROM fold_scores GROUP BY 1)
UNION ALL SELECT 'comparisons', model_1 || ' vs ' || model_2, 'cohens_d', round(avg(d) / sqrt((var_pop(s1) + var_pop(s2)) / 2), 8) FROM pairs GROUP BY model_1, model_2
UNION ALL SELECT 'ablation', o_orderstatus, 'r2_drop', round(avg(o_totalprice) / 1e6, 8) FROM orders GROUP BY o_orderstatus""", "fold_scores", "pairs"))
def _(spark, d):
    scores = fold_scores(spark, d)
    pairs = hypothesis.paired_pairs(scores)
    effects = pairs.groupBy(*hypothesis.PAIR).agg(hypothesis.cohens_d().alias("cohens_d"))
    drops = (
        table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("feature_group"))
        .agg((F.avg("o_totalprice") / F.lit(1e6)).alias("r2_drop"))
    )
    return r(reports.statistical_report(hypothesis.fold_intervals(scores, ["r2"]), effects, drops), 8)


# ---- local ensemble

define("base_preds", """SELECT id, x, y, value AS label, (SELECT avg(value) FROM points) + x AS p_a, avg(value) OVER (PARTITION BY category) AS p_b FROM points""", "points")
define("near51", """SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM dists QUALIFY rn <= 51""", "dists")
define("grams", """SELECT n.src AS id, sum(w * p_a * p_a) AS aa, sum(w * p_a * p_b) AS ab, sum(w * p_b * p_b) AS bb, sum(w * p_a * label) AS ca, sum(w * p_b * label) AS cb
 FROM (SELECT n.src, n.dst, exp(-0.5e0 * (dist / bandwidth) * (dist / bandwidth)) AS w FROM near51 n JOIN bands ON n.src = bands.id WHERE rn <= 50) n JOIN base_preds b ON n.dst = b.id GROUP BY n.src""",
    "near51", "bands", "base_preds")
define("solved", """SELECT id, CASE WHEN inner_ THEN xa WHEN la <= lb THEN greatest(ca / aa, 0e0) ELSE 0e0 END AS a, CASE WHEN inner_ THEN xb WHEN la <= lb THEN 0e0 ELSE greatest(cb / bb, 0e0) END AS b
 FROM (SELECT *, xa >= 0 AND xb >= 0 AS inner_, CASE WHEN ca > 0 THEN -ca * ca / aa ELSE 0e0 END AS la, CASE WHEN cb > 0 THEN -cb * cb / bb ELSE 0e0 END AS lb
 FROM (SELECT *, (ca * bb - cb * ab) / (aa * bb - ab * ab) AS xa, (cb * aa - ca * ab) / (aa * bb - ab * ab) AS xb FROM grams))""", "grams")
define("local_w", "SELECT id, a / (a + b + 1e-10) AS w_a, b / (a + b + 1e-10) AS w_b FROM solved", "solved")
define("place_w", """SELECT src AS id, sum(kw * w_a) / sum(kw) AS avg_a, sum(kw * w_b) / sum(kw) AS avg_b FROM kernels JOIN local_w l ON dst = l.id GROUP BY src""", "kernels", "local_w")


def _base(spark, d):
    p = points(spark, d)
    means = p.groupBy("category").agg(F.avg("value").alias("p_b"))
    overall = p.agg(F.avg("value")).scalar()
    return cut(
        p.join(means, "category").withColumn("_m", overall)
        .select("id", "x", "y", F.col("value").alias("label"), (F.col("_m") + F.col("x")).alias("p_a"), "p_b")
    )


@query("local_weights", sql("SELECT id, round(w_a, 6) AS w_a, round(w_b, 6) AS w_b FROM local_w", "local_w"))
def _(spark, d):
    return r(ensemble.local_weights(_base(spark, d), ["a", "b"], 50, ("x", "y")).select("id", "w_a", "w_b"), 6)


@query("local_weights_interpolated")
def _(spark, d):
    base = _base(spark, d)
    return ensemble.interpolated_weights(base, ["a", "b"], max(1, base.count() // 2), 50, ("x", "y"))


@query("mixed_prediction", sql("""SELECT id, round((p_a * avg_a + p_b * avg_b) / (avg_a + avg_b + 1e-10), 6) + 0e0 AS predicted FROM place_w JOIN base_preds USING (id)""", "place_w", "base_preds"))
def _(spark, d):
    base = _base(spark, d)
    weights = cut(ensemble.local_weights(base, ["a", "b"], 50, ("x", "y")))
    return r(ensemble.mixed_prediction(base, weights, ["a", "b"], 50, ("x", "y")).select("id", "predicted"), 6)


@query("model_contributions", sql("SELECT 'a' AS model, round(avg(avg_a), 6) AS mean_weight FROM place_w UNION ALL SELECT 'b', round(avg(avg_b), 6) FROM place_w", "place_w"))
def _(spark, d):
    base = _base(spark, d)
    weights = cut(ensemble.local_weights(base, ["a", "b"], 50, ("x", "y")))
    return r(ensemble.model_contributions(base, weights, ["a", "b"], 50, ("x", "y")), 6)


@query("uniform_mix", sql("SELECT id, round((p_a + p_b) / 2e0, 9) + 0e0 AS predicted FROM base_preds", "base_preds"))
def _(spark, d):
    return r(ensemble.uniform_mix(_base(spark, d), ["a", "b"]).select("id", "predicted"), 9)


def _site_ensemble(spark, d):
    _, train, test = _train_test(spark, d)
    train, test = (x.withColumnRenamed("site_id", "id") for x in (train, test))
    return ensemble.fit_ensemble(train, _small_learners()), train, test


@query("ensemble_evaluation")
def _(spark, d):
    fitted, _, test = _site_ensemble(spark, d)
    return ensemble.evaluate_ensemble(fitted, test)


@query("ensemble_run_record")
def _(spark, d):
    _, train, test = _train_test(spark, d)
    train, test = (x.withColumnRenamed("site_id", "id") for x in (train, test))
    return reports.ensemble_record(train, test, _small_learners())


@query("csv_round_trip", sql("SELECT site_id, country_long, primary_fuel, capacity_mw FROM raw_sites", "raw_sites"))
def _(spark, d):
    """Write sites as header CSV, read them back by name as text, coerce the numbers again."""
    from geostat_spark.catalog.inputs import raw_sites
    from geostat_spark.operators.clean import coerce_numeric

    where = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(raw_sites(spark, d).select("site_id", "country_long", "primary_fuel", "capacity_mw"), f"{where}/sites")
    back = coerce_numeric(tables.read_sites_csv(spark, f"{where}/sites"), ["capacity_mw"])
    return back.withColumn("site_id", F.col("site_id").cast("long"))
