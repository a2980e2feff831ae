"""The end-to-end runs: site analysis, model validation, local ensemble, yearly features; and the studies that look
into one subject each: the raw table, capacity factors, autocorrelation, a model's errors.

Each takes a raw site table and a folder, writes its result tables below the folder (Parquet, one per
result) and returns them by name. Tables that feed several results are written first and read back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from geostat_spark.functions.scalar import autocorrelation_label, log10_positive
from geostat_spark.operators import (
    clean, clustering, evaluation, features, hypothesis, inequality, models, profile, resampling, shap, spatial, splits, temporal,
)
from geostat_spark.plans import reports
from geostat_spark.session import cut
from geostat_spark.sources.models import load_or_fit, load_or_split
from geostat_spark.sources.tables import write_table

COORDINATES = ("longitude", "latitude")


@dataclass
class Settings:
    """What differs between data sets and budgets; the defaults are the method's own."""

    renewable: Sequence[str] = tuple(features.RENEWABLE_FUELS)
    hours_factor: float = 8.76
    reference_year: int = features.REFERENCE_YEAR
    neighbours: int = 8
    permutations: int = 999
    min_cluster_size: int = 50
    min_samples: int = 10
    forest_trees: int = 100
    forest_depth: int = 15
    boosting_rounds: int = 100
    boosting_depth: int = 6
    folds: int = 10
    ablation_folds: int = 5
    ensemble_neighbours: int = 50
    makers: dict[str, models.Maker] = field(default_factory=dict)

    def forest(self, min_leaf: int = 5) -> models.Maker:
        return lambda train: models.random_forest(self.forest_trees, self.forest_depth, min_leaf)

    def boosted(self, rows: float = 0.8, columns: float = 0.8) -> models.Maker:
        return lambda train: models.boosted_trees(self.boosting_rounds, self.boosting_depth, rows=rows, columns=columns)


def _keep(results: dict[str, DataFrame], folder: str, name: str, df: DataFrame) -> DataFrame:
    write_table(df, f"{folder}/{name}")
    results[name] = df.sparkSession.read.parquet(f"{folder}/{name}")
    return results[name]


def site_features(raw: DataFrame, continents: DataFrame, folder: str, s: Settings, results: dict[str, DataFrame]) -> DataFrame:
    """Clean, keep valid generation, store, derive features, store. Rows need a ``site_id``."""
    _keep(results, folder, "cleaning_funnel", clean.cleaning_funnel(raw))
    processed = _keep(results, folder, "processed", clean.valid_generation(clean.clean(raw)))
    derived = features.derive_features(processed, continents, s.renewable, s.hours_factor, s.reference_year)
    return _keep(results, folder, "features", derived)


def _model_rows(sites: DataFrame, folder: str) -> tuple[list[str], DataFrame]:
    table, names = models.model_table(sites)
    table = cut(table)
    spark = sites.sparkSession
    parts = load_or_split(
        spark, f"{folder}/split", lambda: splits.train_val_test(table).select("site_id", "split")
    )
    rows = models.assembled(table.join(parts, "site_id"), names, keep=["site_id", "latitude", "longitude", "split"])
    return names, cut(rows)


def analyse_sites(raw: DataFrame, continents: DataFrame, folder: str, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Features, regional profiles, autocorrelation, clusters, models, explanation, inequality."""
    s, results = settings or Settings(), {}
    sites = site_features(raw, continents, folder, s, results)
    points = sites.withColumnRenamed("site_id", "id")
    moran = spatial.morans_i_permutation(points, "capacity_factor", s.neighbours, COORDINATES, s.permutations)
    _keep(results, folder, "morans_i", moran)
    _keep(results, folder, "moran_scatter", spatial.moran_scatter(points, "capacity_factor", s.neighbours, COORDINATES))
    _keep(results, folder, "regional_stats", profile.regional_stats(sites))
    _keep(results, folder, "country_rankings", profile.country_rankings(sites))

    labelled = _keep(
        results, folder, "clusters", clustering.cluster_subsets(points, s.min_cluster_size, s.min_samples)
    )
    _keep(results, folder, "cluster_summary", clustering.cluster_summary(labelled, ["subset"]))
    dims = [f"{c}_z" for c in clustering.FEATURES]
    _keep(results, folder, "clustering_comparison", clustering.compare_clusterings(labelled, dims))

    spark = raw.sparkSession
    names, rows = _model_rows(sites, folder)
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    fitted = {
        name: load_or_fit(spark, f"{folder}/models/{name}", lambda maker=maker: models.fitted(maker, train))
        for name, maker in {"RandomForest": s.forest(), "BoostedTrees": s.boosted()}.items()
    }
    comparison = _keep(results, folder, "model_comparison", models.model_comparison(fitted, test))
    explained = shap.shap_values(fitted["BoostedTrees"], test, names)
    _keep(results, folder, "shap_importance", shap.shap_importance(explained, names))
    _keep(results, folder, "feature_importance", models.importances(fitted["RandomForest"], names))
    best = comparison.orderBy(F.desc("r2"), "model").first()["model"]
    scored = fitted[best].transform(test).select(
        "site_id", F.col("label").alias("actual"), F.col("prediction").alias("predicted")
    )
    scored = evaluation.attach_attributes(scored, sites, ["primary_fuel", "is_renewable", "continent"])
    scored = _keep(results, folder, "predictions", evaluation.residuals(scored))
    _keep(results, folder, "residual_stats", evaluation.residual_stats(scored))
    _keep(results, folder, "error_by_fuel", evaluation.error_by_category(scored, "primary_fuel"))

    _keep(results, folder, "inequality_summary", inequality.inequality_summary(sites))
    _keep(results, folder, "theil_decomposition", inequality.theil_report(sites))
    _keep(results, folder, "theil_groups", inequality.theil_groups(sites))
    _keep(results, folder, "capacity_rankings", profile.capacity_rankings(sites))
    _keep(results, folder, "lorenz_curve", inequality.lorenz_curve(sites, "capacity_mw", 1000))
    return results


def validate_models(raw: DataFrame, continents: DataFrame, folder: str, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Cross-validation with intervals, pairwise tests, ablation, baselines and the summary."""
    s, results = settings or Settings(), {}
    sites = site_features(raw, continents, folder, s, results)
    table, names = models.model_table(sites)
    table = cut(table)
    rows = cut(models.assembled(table, names))
    makers = {"RandomForest": s.forest(min_leaf=1), "BoostedTrees": s.boosted(1.0, 1.0)}
    scores = _keep(results, folder, "fold_scores", models.cross_validate(rows, makers, s.folds))
    intervals = _keep(results, folder, "cross_validation", hypothesis.fold_intervals(scores, ["mae", "rmse", "r2"]))
    pairs = _keep(results, folder, "comparisons", hypothesis.compare_models(scores))
    dropped = _keep(
        results, folder, "ablation", models.ablation(table, names, s.forest(min_leaf=1), folds=s.ablation_folds)
    )
    _, split_rows = _model_rows(sites, folder)
    train, test = (split_rows.where(F.col("split") == part) for part in ("train", "test"))
    baselines = _keep(results, folder, "baselines", models.naive_baselines(train, test))
    best = evaluation.best_model(intervals.select("model", F.col("r2_mean").alias("r2")), baselines)
    _keep(results, folder, "summary", best)
    _keep(results, folder, "report", reports.statistical_report(intervals, pairs, dropped))
    return results


def run_ensemble(raw: DataFrame, continents: DataFrame, folder: str, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Fit the locally weighted ensemble on the training part and record its scores on the test part."""
    s, results = settings or Settings(), {}
    sites = site_features(raw, continents, folder, s, results)
    _, rows = _model_rows(sites, folder)
    rows = rows.withColumnRenamed("site_id", "id")
    train, test = (rows.where(F.col("split") == part) for part in ("train", "test"))
    makers = s.makers or models.base_learners(s.forest_trees, s.forest_depth, s.boosting_rounds)
    _keep(results, folder, "ensemble_record", reports.ensemble_record(train, test, makers, s.ensemble_neighbours))
    return results


def analyse_years(raw: DataFrame, folder: str, years: Sequence[int] = tuple(temporal.DEFAULT_YEARS), hours_factor: float = 8.76) -> dict[str, DataFrame]:
    """Yearly features, coverage, patterns and stability of a wide table with its classes attached."""
    results: dict[str, DataFrame] = {}
    rows = _keep(results, folder, "temporal_features", temporal.temporal_features(raw, list(years), hours_factor))
    _keep(results, folder, "temporal_totals", temporal.temporal_totals(rows))
    _keep(results, folder, "year_coverage", temporal.year_coverage(rows, years))
    _keep(results, folder, "coverage_by_fuel", temporal.coverage_by_fuel(rows, years))
    _keep(results, folder, "pattern_by_fuel", temporal.temporal_pattern(rows, "primary_fuel", 10))
    _keep(results, folder, "yearly_profile", temporal.yearly_profile_of_top_fuels(rows, years, 4))
    _keep(results, folder, "stability_by_fuel", temporal.stability_by_fuel(rows))
    if "continent" in rows.columns:
        _keep(results, folder, "pattern_by_continent", temporal.temporal_pattern(rows, "continent"))
    if "is_renewable" in rows.columns:
        _keep(results, folder, "stability_by_class", temporal.stability_by_class(rows))
    _keep(results, folder, "volatility_histogram", temporal.clipped_histogram(rows, "cf_cv", 0.0, 1.0))
    _keep(results, folder, "trend_histogram", temporal.clipped_histogram(rows, "cf_trend", -0.1, 0.1))
    return results


def explore_table(raw: DataFrame, folder: str, numbers: Sequence[str] = ("capacity_mw", "latitude", "longitude")) -> dict[str, DataFrame]:
    """What a raw site table holds: its shape and columns, missing values, numbers, fuels, countries and the spread of
    capacities."""
    results: dict[str, DataFrame] = {}
    rows = _keep(results, folder, "coerced", clean.coerce_numeric(raw))
    _keep(results, folder, "shape", profile.shape_of(rows))
    _keep(results, folder, "columns", profile.column_inventory(rows))
    _keep(results, folder, "missing_profile", profile.missing_profile(rows))
    _keep(results, folder, "describe", profile.describe(rows, list(numbers)))
    _keep(results, folder, "totals", profile.table_totals(rows, "capacity_mw", "country"))
    _keep(results, folder, "fuel_counts", profile.value_counts(rows, "primary_fuel"))
    _keep(results, folder, "capacity_by_fuel", profile.sum_by(rows, "primary_fuel", "capacity_mw"))
    _keep(results, folder, "capacity_by_country", profile.sum_by(rows, "country", "capacity_mw", 20))
    _keep(results, folder, "distribution_by_fuel", profile.distribution_by(rows, "primary_fuel", "capacity_mw"))
    generation = [c for c in rows.columns if c.startswith("estimated_generation_gwh_")]
    for name in generation[-1:]:
        _keep(results, folder, "coverage_by_fuel", profile.coverage_by(rows, "primary_fuel", name))
        _keep(results, folder, "coverage_total", profile.coverage_total(rows, name))
    logs = rows.withColumn("log_capacity", log10_positive(F.col("capacity_mw")))
    _keep(results, folder, "capacity_histogram", profile.histogram(logs, "log_capacity", 100))
    _keep(results, folder, "capacity_box", profile.box_stats(rows, "capacity_mw", ["primary_fuel"]))
    return results


def study_capacity_factors(sites: DataFrame, folder: str, top: int = 12) -> dict[str, DataFrame]:
    """How capacity factors spread, and whether fuels and the renewable class differ. ``sites``: with features."""
    results: dict[str, DataFrame] = {}
    value = "capacity_factor"
    frequent = cut(clean.keep_top_categories(sites, "primary_fuel", top).select("primary_fuel", value))
    _keep(results, folder, "histogram", profile.histogram(sites, value, 50))
    _keep(results, folder, "by_fuel", profile.distribution_by(sites, "primary_fuel", value))
    _keep(results, folder, "box_by_fuel", profile.box_stats(frequent, value, ["primary_fuel"]))
    _keep(results, folder, "kruskal_wallis", hypothesis.kruskal_wallis(frequent, "primary_fuel", value))
    _keep(results, folder, "dunn_test", hypothesis.dunn_test(frequent, "primary_fuel", value))
    _keep(results, folder, "class_comparison", profile.class_comparison(sites, "is_renewable", value))
    _keep(results, folder, "box_by_class", profile.box_stats(sites, value, ["is_renewable"]))
    _keep(results, folder, "mann_whitney", hypothesis.mann_whitney(sites, "is_renewable", value))
    _keep(results, folder, "capacity_correlation", profile.correlation(sites, "capacity_mw", value))
    return results


def study_autocorrelation(
    sites: DataFrame, folder: str, settings: Settings | None = None, ks: Sequence[int] = (4, 8, 12, 16, 20)
) -> dict[str, DataFrame]:
    """Global and local autocorrelation of the capacity factor, by fuel and by neighbourhood size, with permutation
    p values throughout."""
    s, results = settings or Settings(), {}
    points = cut(sites.select(F.col("site_id").alias("id"), *COORDINATES, "primary_fuel", "capacity_factor"))
    value, k, p = "capacity_factor", s.neighbours, s.permutations
    moran = spatial.morans_i_permutation(points, value, k, COORDINATES, p)
    label = autocorrelation_label(F.col("p_value"), F.col("moran_i"))
    _keep(results, folder, "morans_i", moran.withColumn("interpretation", label))
    _keep(results, folder, "components", spatial.graph_components(points, k, COORDINATES))
    _keep(results, folder, "moran_scatter", spatial.moran_scatter(points, value, k, COORDINATES))
    lisa = _keep(results, folder, "local_moran", spatial.local_moran_significance(points, value, k, COORDINATES, p))
    _keep(results, folder, "significance_breakdown", spatial.significance_breakdown(lisa))
    _keep(results, folder, "morans_i_by_fuel", spatial.morans_i_by_category(points, value, "primary_fuel", k=k, dims=COORDINATES, permutations=p))
    _keep(results, folder, "morans_i_by_k", spatial.morans_i_by_k(points, value, ks, COORDINATES, p))
    return results


def study_errors(predictions: DataFrame, folder: str) -> dict[str, DataFrame]:
    """A model's errors: their spread, how normal they are, and where they are large. ``predictions``: actual,
    predicted and the sites' classes, as ``analyse_sites`` leaves them."""
    results: dict[str, DataFrame] = {}
    rows = predictions if "residual" in predictions.columns else evaluation.residuals(predictions)
    _keep(results, folder, "scores", evaluation.score(rows, "actual", "predicted"))
    _keep(results, folder, "residual_stats", evaluation.residual_stats(rows))
    _keep(results, folder, "residual_histogram", profile.histogram(rows, "residual", 50))
    quantiles = _keep(results, folder, "normal_quantiles", resampling.normal_quantiles(rows, "residual"))
    _keep(results, folder, "normal_fit", resampling.normal_fit(quantiles))
    _keep(results, folder, "error_by_fuel", evaluation.error_by_category(rows, "primary_fuel"))
    _keep(results, folder, "intervals", resampling.bootstrap_weights(rows, "actual", "predicted"))
    return results
