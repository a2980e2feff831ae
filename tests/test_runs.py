"""The end-to-end runs on the smallest data set, with small models."""

import pytest

from geostat_spark.catalog import inputs
from geostat_spark.plans import runs

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def settings():
    return runs.Settings(
        renewable=inputs.RENEWABLE, hours_factor=1.0, permutations=99, min_cluster_size=20, min_samples=5,
        forest_trees=3, forest_depth=3, boosting_rounds=3, boosting_depth=3, folds=3, ablation_folds=2,
    )


def test_site_analysis(spark, tmp_path, settings):
    got = runs.analyse_sites(inputs.raw_sites(spark, DATA), inputs.continents(spark, DATA), str(tmp_path), settings)
    counts = {name: df.count() for name, df in got.items()}
    assert counts["features"] == counts["processed"] == got["cleaning_funnel"].first().rows_valid
    assert counts["clusters"] == 2 * counts["features"] and counts["clustering_comparison"] == 3
    assert counts["model_comparison"] == 2 and counts["predictions"] == got["model_comparison"].first().n
    assert counts["theil_decomposition"] == 5 and all(counts[n] > 0 for n in counts if n != "cluster_summary")


def test_validation(spark, tmp_path, settings):
    got = runs.validate_models(inputs.raw_sites(spark, DATA), inputs.continents(spark, DATA), str(tmp_path), settings)
    assert got["fold_scores"].count() == 6 and got["comparisons"].count() == 1
    assert got["baselines"].count() == 3 and got["ablation"].count() == 6
    assert {r.section for r in got["report"].collect()} == {"cross_validation", "comparisons", "ablation"}


def test_ensemble_run(spark, tmp_path, settings):
    got = runs.run_ensemble(inputs.raw_sites(spark, DATA), inputs.continents(spark, DATA), str(tmp_path), settings)
    row = got["ensemble_record"].first()
    assert row.rf_weight + row.gb_weight + row.ridge_weight == pytest.approx(1.0, abs=1e-3)
    assert row.training_samples > row.test_samples > 0


def test_years(spark, tmp_path):
    got = runs.analyse_years(inputs.raw_site_years(spark, DATA), str(tmp_path), inputs.YEARS, 1.0)
    assert got["year_coverage"].count() == 7 and got["volatility_histogram"].agg({"n": "sum"}).first()[0] == got["temporal_features"].count()


def test_studies(spark, tmp_path, settings):
    raw = inputs.raw_sites(spark, DATA)
    explored = runs.explore_table(raw, f"{tmp_path}/a")
    assert explored["fuel_counts"].agg({"row_count": "sum"}).first()[0] == raw.where("primary_fuel is not null").count()
    assert {"missing_profile", "capacity_histogram", "coverage_total", "capacity_box"} <= set(explored)
    sites = inputs.sites(spark, DATA)
    factors = runs.study_capacity_factors(sites, f"{tmp_path}/b")
    assert 0 <= factors["kruskal_wallis"].first().p_value <= 1 and factors["class_comparison"].count() == 2
    groups = factors["kruskal_wallis"].first().df + 1
    assert factors["dunn_test"].count() == groups * (groups - 1) // 2
    near = runs.study_autocorrelation(sites, f"{tmp_path}/c", settings, (4, 8))
    assert near["morans_i_by_k"].count() == 2 and near["morans_i"].first().interpretation.endswith("spatial autocorrelation")
    assert near["significance_breakdown"].agg({"sites": "sum"}).first()[0] == near["local_moran"].count() == sites.count()
    scored = sites.selectExpr("site_id", "primary_fuel", "is_renewable", "continent", "capacity_factor as actual", "0.4 as predicted")
    errors = runs.study_errors(scored, f"{tmp_path}/d")
    assert errors["normal_quantiles"].count() == sites.count() and errors["intervals"].count() == 3
    assert errors["residual_stats"].first().mean == pytest.approx(scored.selectExpr("avg(actual - predicted)").first()[0])
