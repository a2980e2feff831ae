"""Missing-value rules and hand-computed results on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from geostat_spark.functions import distributions as dist
from geostat_spark.functions.scalar import (
    autocorrelation_label, capacity_factor, clip, coerce_double, direction_label, finite_or_null, flag, nan_to_null, ratio,
)
from geostat_spark.operators import clean, features, hypothesis, inequality, ordering, profile, splits, temporal

NAN, INF = float("nan"), float("inf")


def values(spark, items, kind="double"):
    return spark.createDataFrame([(v,) for v in items], f"v {kind}")


def column(df):
    return [r[0] for r in df.collect()]


def test_clip_keeps_missing(spark):
    assert column(values(spark, [None, -1.0, 0.5, 9.0]).select(clip(F.col("v"), 0, 1.1))) == [None, 0.0, 0.5, 1.1]


def test_nan_and_infinities_become_missing(spark):
    df = values(spark, [NAN, INF, -INF, 2.0, None])
    assert column(df.select(finite_or_null(F.col("v")))) == [None, None, None, 2.0, None]
    assert column(df.select(nan_to_null(F.col("v"))))[0] is None


def test_text_that_is_no_number_becomes_missing(spark):
    items = ["7", " 7 ", "abc", "1e3", "", None, "1d", "3.", ".5", "-2", "{}", "0x1"]
    got = column(values(spark, items, "string").select(coerce_double(F.col("v"))))
    assert got == [7.0, 7.0, None, 1000.0, None, None, None, 3.0, 0.5, -2.0, None, None]


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert column(df.select(ratio(F.col("a"), F.col("b")))) == [None, None, 0.5, None]
    assert column(df.select(capacity_factor(F.col("a"), F.col("b"), 1.0))) == [None, None, 0.5, None]


def test_flag_of_unknown_is_zero(spark):
    assert column(values(spark, [None, 1.0]).select(flag(F.col("v") > 0))) == [0, 1]


def test_labels(spark):
    df = spark.createDataFrame([(0.01, 1.0), (0.01, -1.0), (0.2, 1.0)], "p double, d double")
    assert column(df.select(direction_label(F.col("p"), F.col("d")))) == [
        "significantly better", "significantly worse", "not significantly different",
    ]
    assert [s.split()[1] for s in column(df.select(autocorrelation_label(F.col("p"), F.col("d"))))] == [
        "positive", "negative", "significant",
    ]


RAW = "site_id long, capacity_mw string, latitude double, longitude double, primary_fuel string, commissioning_year double, estimated_generation_gwh_2017 string"


def test_cleaning_order_and_funnel(spark):
    rows = [
        (1, "10", 0.0, 0.0, "Coal", None, "5"),
        (1, "10", 0.0, 0.0, "Coal", None, "5"),
        (2, "abc", 0.0, 0.0, "Coal", 2000.0, "5"),
        (3, None, 0.0, 0.0, "Coal", 2000.0, "5"),
        (4, "10", 0.0, 0.0, None, 2000.0, "5"),
        (5, "0", 0.0, 0.0, "Coal", 2000.0, "5"),
        (6, "10", 0.0, 0.0, "Coal", 2000.0, "-1"),
        (7, "20", 0.0, 0.0, "Wind", 2000.0, " 7 "),
        (8, "20", 0.0, 0.0, "Wind", 2000.0, None),
    ]
    df = spark.createDataFrame(rows, RAW)
    cleaned = clean.clean(df)
    assert sorted(r["site_id"] for r in cleaned.collect()) == [1, 2, 5, 6, 7, 8]
    assert sorted(r["site_id"] for r in clean.valid_generation(cleaned).collect()) == [1, 7]
    f = clean.cleaning_funnel(df).first()
    assert (f.rows_in, f.rows_distinct, f.rows_complete, f.rows_valid) == (9, 8, 6, 2)
    assert (f.min_capacity, f.max_capacity, f.min_generation, f.max_generation) == (10.0, 20.0, 5.0, 7.0)


def test_group_median_imputation(spark):
    rows = [("a", 2000.0), ("a", 2001.0), ("a", None), ("b", None), ("c", 1990.0)]
    df = spark.createDataFrame(rows, "primary_fuel string, commissioning_year double")
    for few in (True, False):
        got = features.impute_group_median(df, "commissioning_year", "primary_fuel", "age_missing", few)
        assert sorted((r.primary_fuel, r.commissioning_year or 0, r.age_missing) for r in got.collect()) == [
            ("a", 2000.0, 0), ("a", 2000.5, 1), ("a", 2001.0, 0), ("b", 0, 1), ("c", 1990.0, 0),
        ]


def test_medians_of_the_training_rows_alone(spark):
    rows = spark.createDataFrame([(1, "a", 10.0), (2, "a", 30.0), (3, "a", None), (4, "a", 500.0), (5, "b", None)], "id long, g string, v double")
    for few in (False, True):
        out = features.impute_group_median(rows, "v", "g", "was", few, fit_on=rows.where("id < 3")).orderBy("id").collect()
        assert [(r["v"], r["was"]) for r in out] == [(10.0, 0), (30.0, 0), (20.0, 1), (500.0, 0), (None, 1)]


def test_lookup_default_and_unknown_group(spark):
    df = spark.createDataFrame([("X",), ("Y",), (None,)], "country_long string")
    look = spark.createDataFrame([("X", "Asia")], "country_long string, continent string")
    assert sorted(r.continent for r in features.add_continent(df, look).collect()) == ["Asia", "Unknown", "Unknown"]


def test_large_group_table_joins_by_shuffle(spark):
    from geostat_spark.operators.attach import attach

    df = spark.range(50).withColumn("k", F.col("id") % 7)
    g = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = attach(df, g, ["k"])
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = attach(df, g, ["k"])
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().toString()
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) and small.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def years_frame(spark):
    rows = [
        (1, 1.0, 0.1, 0.2, 0.3, 0.4, 0.5),
        (2, 1.0, 0.5, 0.5, 0.5, 0.5, 0.5),
        (3, 1.0, None, None, None, 0.4, 0.6),
        (4, 1.0, None, None, None, None, 0.6),
        (5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (6, 1.0, 0.2, None, 0.4, 0.9, None),
    ]
    cols = ", ".join(f"estimated_generation_gwh_{y} double" for y in range(2013, 2018))
    return spark.createDataFrame(rows, f"site_id long, capacity_mw double, {cols}")


def test_yearly_features(spark):
    got = {r.site_id: r for r in temporal.temporal_features(years_frame(spark), hours_factor=1.0).collect()}
    assert set(got) == {1, 2, 3, 5, 6}  # two of five years are enough, one is not
    one = got[1]
    assert one.cf_mean == pytest.approx(0.3) and one.cf_std == pytest.approx(math.sqrt(0.02))
    assert one.cf_trend == pytest.approx(0.1) and one.cf_trend_r2 == pytest.approx(1.0)
    assert one.cf_recent_change == pytest.approx(0.1) and (one.is_stable, one.is_volatile) == (0, 1)
    for site in (2, 5):  # constant series
        assert (got[site].cf_trend, got[site].cf_trend_r2, got[site].cf_std, got[site].is_stable) == (0.0, 0.0, 0.0, 1)
    assert (got[3].cf_trend, got[3].cf_trend_r2) == (0.0, 0.0)  # too few years for a trend
    assert got[3].cf_recent_change == pytest.approx(0.2)
    assert got[6].cf_recent_change is None
    assert got[6].cf_trend == pytest.approx(0.1 / 2 + 0.0, abs=0.2) and got[6].cf_range == pytest.approx(0.7)


def test_histogram_of_a_feature_reads_the_written_column(spark):
    rows = [(i, 1.0, *[0.1 * (1 + (i * y) % 7) for y in range(1, 5)]) for i in range(40)]
    years = [2014, 2015, 2016, 2017]
    df = spark.createDataFrame(rows, ["site_id", "capacity_mw", *[temporal.generation_column(y) for y in years]])
    found = temporal.temporal_features(df, years, hours_factor=1.0).select("cf_cv")
    out = temporal.clipped_histogram(found, "cf_cv", 0.0, 1.0, bins=5)
    # no pass derives the feature again, in a filter least of all
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    values = sorted(column(found))
    got = out.orderBy("bin").collect()
    assert sum(r["n"] for r in got) == 40 and got[0]["bin_low"] == pytest.approx(values[0])
    assert got[0]["median"] == pytest.approx((values[19] + values[20]) / 2)


def test_gini_theil_lorenz(spark):
    assert inequality.gini(values(spark, [4.0, 1.0, 3.0, 2.0]), "v").first()[0] == pytest.approx(0.25)
    assert inequality.gini(values(spark, [5.0] * 6), "v").first()[0] == pytest.approx(0.0)
    equal = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 2.0)], "continent string, capacity_mw double")
    t = inequality.theil_index(equal).first()
    assert t.total == pytest.approx(0.0, abs=1e-12)
    mixed = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("b", 8.0), ("b", 0.0), ("b", 4.0)], "continent string, capacity_mw double"
    )
    t = inequality.theil_index(mixed).first()
    x, mean = [1.0, 3.0, 8.0, 4.0], {1.0: 2.0, 3.0: 2.0, 8.0: 4.0, 4.0: 4.0}
    within = sum(v / 16 * math.log(v / mean[v]) for v in x)
    between = 4 / 16 * math.log((4 / 16) / (2 / 5)) + 12 / 16 * math.log((12 / 16) / (3 / 5))
    assert (t.within, t.between) == (pytest.approx(within), pytest.approx(between))
    assert t.within_percentage + t.between_percentage == pytest.approx(100.0)
    curve = inequality.lorenz_curve(values(spark, [1.0, 1.0, 2.0]), "v").orderBy("rank").collect()
    assert [(r.rank, r.x, r.y) for r in curve] == [(0, 0.0, 0.0), (1, 0.0, 0.25), (2, 0.5, 0.5), (3, 1.0, 1.0)]


def test_hot_value_keeps_ranks_exact(spark):
    """Two thirds of the rows share one value."""
    items = [float(i) for i in range(50)] + [25.0] * 100
    ranks = {r.v: r for r in ordering.value_ranks(values(spark, items), "v").collect()}
    assert ranks[25.0].n == 101 and ranks[25.0].before == 25 and ranks[26.0].before == 126
    q = ordering.quantiles(values(spark, items), "v", {"q25": 0.25, "q50": 0.5, "q90": 0.9}).first()
    items.sort()
    at = lambda p: items[int(p * 149)] + (items[min(149, int(p * 149) + 1)] - items[int(p * 149)]) * (p * 149 % 1)
    assert (q.q25, q.q50, q.q90) == (pytest.approx(at(0.25)), 25.0, pytest.approx(at(0.9)))
    numbers = sorted(r.rank for r in ordering.every_rank(values(spark, items), "v").collect())
    assert numbers == list(range(1, 151))


def test_ranks_do_not_depend_on_partitions(spark):
    items = [float(i * 37 % 101) for i in range(300)]
    want = None
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted(tuple(r) for r in ordering.value_ranks(values(spark, items).repartition(5), "v").collect())
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_box_and_histogram(spark):
    b = profile.box_stats(values(spark, [1.0, 2.0, 3.0, 4.0, 100.0]), "v").first()
    assert (b.q1, b.median, b.q3, b.whisker_low, b.whisker_high, b.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    h = profile.histogram(values(spark, [0.0, 1.0, 2.0, 4.0]), "v", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [1, 1, 1, 1] and h[-1].bin_high == 4.0
    one = profile.histogram(values(spark, [3.0, 3.0]), "v", 2).orderBy("bin").collect()
    assert [(r.bin_low, r.n) for r in one] == [(2.5, 0), (3.0, 2)]


def test_folds_and_split(spark):
    df = spark.range(13).withColumnRenamed("id", "site_id")
    folds = splits.with_folds(df, "site_id", 5, shuffle=False).orderBy("site_id").collect()
    assert [r.fold for r in folds] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5]
    shuffled = [r.fold for r in splits.with_folds(df, "site_id", 5, shuffle=True).collect()]
    assert sorted(shuffled.count(f) for f in range(1, 6)) == [2, 2, 3, 3, 3]
    rows = df.withColumn("continent", F.when(F.col("site_id") == 0, "A").otherwise("B"))
    parts = [r.split for r in splits.train_val_test(rows).collect()]  # a stratum of one row
    assert (parts.count("test"), parts.count("val"), parts.count("train")) == (2, 2, 9)
    small = spark.range(40).select(F.col("id").alias("site_id"), F.when(F.col("id") < 2, "A").otherwise("B").alias("continent"))
    parts = [r.split for r in splits.train_val_test(small).collect()]  # a stratum left with one row
    assert (parts.count("test"), len(parts)) == (7, 40)


def test_tail_probabilities():
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert dist.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert dist.student_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert dist.chi_square_upper(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert dist.chi_square_upper(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert dist.signed_rank_two_sided(0, 10) == pytest.approx(2 / 1024)
    assert dist.signed_rank_two_sided(8, 10) == pytest.approx(2 * 25 / 1024)


def test_rank_tests_against_hand_values(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    # ranks: 1, 3, 3 | 5, 6, 3; rank sums 7 and 14; one tie of three
    h = hypothesis.kruskal_wallis(df, "g", "v").first()
    raw = 12 / 42 * (49 / 3 + 196 / 3) - 21
    assert h.h_statistic == pytest.approx(raw / (1 - 24 / 210)) and h.df == 1
    flags = df.withColumn("f", (F.col("g") == "a").cast("int"))
    assert hypothesis.mann_whitney(flags, "f", "v").first().u_statistic == 1.0
    z = hypothesis.dunn_test(df, "g", "v").first()
    assert z.z == pytest.approx((7 / 3 - 14 / 3) / math.sqrt((42 / 12 - 24 / 60) * (2 / 3)))


def test_paired_tests_with_zero_and_tied_differences(spark):
    rows = [("a", f, s) for f, s in enumerate([0.9, 0.8, 0.7, 0.6])] + [("b", f, s) for f, s in enumerate([0.8, 0.7, 0.7, 0.8])]
    rows += [("c", f, s) for f, s in enumerate([0.9, 0.8, 0.7, 0.6])]
    scores = spark.createDataFrame(rows, "model string, fold int, r2 double").withColumn("r2", F.round("r2", 3))
    got = {(r.model_1, r.model_2): r for r in hypothesis.compare_models(scores).collect()}
    ab, ac = got[("a", "b")], got[("a", "c")]
    assert ab.t_statistic == pytest.approx(0.0, abs=1e-9) and ab.cohens_d == pytest.approx(0.0, abs=1e-9)
    assert (ac.cohens_d, ac.significant, ac.interpretation) == (0.0, False, "not significantly different")


def test_upsert_replaces_adds_and_sorts(spark):
    from geostat_spark.sources.tables import upsert

    old = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "model string, r2 double")
    new = spark.createDataFrame([("x", 3.0), ("z", 0.5)], "model string, r2 double")
    assert [tuple(r) for r in upsert(old, new, "model", "r2").collect()] == [("x", 3.0), ("y", 2.0), ("z", 0.5)]
