"""Queries over cleaning, features, profiles and yearly features."""

from __future__ import annotations

from pyspark.sql import functions as F

from geostat_spark.catalog.inputs import (
    RENEWABLE, YEARS, continents, define, raw_site_years, raw_sites, readings, site_years, sites, sql, table, valid_sites,
)
from geostat_spark.catalog.registry import query
from geostat_spark.functions.scalar import half_even, log10_positive
from geostat_spark.operators import clean, features, profile, temporal
from geostat_spark.operators.features import add_capacity_factor, add_renewable_class
from geostat_spark.session import new_path
from geostat_spark.sources.tables import upsert, upsert_current


def r(df, digits=6, *columns):
    """Round the listed columns (all doubles by default) so that summation order does not show."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


# ---- scans, sinks, inspection

@query("site_scan", sql("SELECT * FROM raw_sites", "raw_sites"))
def _(spark, d):
    return raw_sites(spark, d)


_UPSERTED = """
WITH results AS (SELECT c_mktsegment AS model, round(avg(c_acctbal), 6) AS r2 FROM customer GROUP BY 1),
fresh AS (SELECT 'MACHINERY' AS model, round(max(s_acctbal), 6) AS r2 FROM supplier
          UNION ALL SELECT 'SUPPLIERS', round(avg(s_acctbal), 6) FROM supplier)
SELECT * FROM results WHERE model NOT IN (SELECT model FROM fresh) UNION ALL SELECT * FROM fresh"""


def _results(spark, d):
    """(a result table, rows that replace one of it and add another)"""
    results = (
        table(spark, d, "customer")
        .groupBy(F.col("c_mktsegment").alias("model"))
        .agg(F.round(F.avg("c_acctbal"), 6).alias("r2"))
    )
    s = table(spark, d, "supplier")
    fresh = s.agg(F.round(F.max("s_acctbal"), 6).alias("r2")).select(F.lit("MACHINERY").alias("model"), "r2")
    fresh = fresh.unionByName(
        s.agg(F.round(F.avg("s_acctbal"), 6).alias("r2")).select(F.lit("SUPPLIERS").alias("model"), "r2")
    )
    return results, fresh


@query("upsert_result_row", _UPSERTED)
def _(spark, d):
    return upsert(*_results(spark, d), "model", "r2")


@query("upsert_result_file", _UPSERTED)
def _(spark, d):
    """The same in a stored table, which each upsert replaces in place."""
    path = new_path(spark)
    for rows in _results(spark, d):
        stored = upsert_current(spark, path, rows, "model", "r2")
    return stored


@query("table_shape", sql("SELECT count(*) AS row_count, CAST(9 AS BIGINT) AS column_count FROM raw_sites", "raw_sites"))
def _(spark, d):
    return profile.shape_of(raw_sites(spark, d))


_RAW_COLUMNS = {
    "site_id": "bigint", "country": "string", "country_long": "string", "capacity_mw": "double",
    "latitude": "double", "longitude": "double", "primary_fuel": "string", "commissioning_year": "double",
    "estimated_generation_gwh_2017": "double",
}


@query("column_inventory", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, '{t}' AS data_type FROM raw_sites"
    for c, t in _RAW_COLUMNS.items()), "raw_sites"))
def _(spark, d):
    return profile.column_inventory(raw_sites(spark, d))


@query("head_rows", sql("SELECT * FROM raw_sites ORDER BY site_id LIMIT 10", "raw_sites"))
def _(spark, d):
    return profile.first_rows(raw_sites(spark, d), ["site_id"], 10)


# ---- filters and cleaning

@query("drop_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def _(spark, d):
    return clean.drop_duplicate_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("drop_missing", sql("SELECT site_id, commissioning_year, estimated_generation_gwh_2017 FROM raw_sites "
       "WHERE commissioning_year IS NOT NULL AND estimated_generation_gwh_2017 IS NOT NULL", "raw_sites"))
def _(spark, d):
    cols = ["commissioning_year", "estimated_generation_gwh_2017"]
    return clean.drop_missing(raw_sites(spark, d), cols).select("site_id", *cols)


@query("coerce_numeric", sql("SELECT event_id, event_type, try_cast(raw_value AS DOUBLE) AS raw_value FROM readings", "readings"))
def _(spark, d):
    return clean.coerce_numeric(readings(spark, d), ["raw_value", "absent_column"])


@query("valid_generation", sql("SELECT * FROM valid_sites", "valid_sites"))
def _(spark, d):
    return valid_sites(spark, d)


@query("cleaning_funnel", sql("""
SELECT (SELECT count(*) FROM raw_sites) AS rows_in, count(*) AS rows_distinct,
  count(*) FILTER (WHERE ok) AS rows_complete, count(*) FILTER (WHERE valid) AS rows_valid,
  min(capacity_mw) FILTER (WHERE valid) AS min_capacity, max(capacity_mw) FILTER (WHERE valid) AS max_capacity,
  min(estimated_generation_gwh_2017) FILTER (WHERE valid) AS min_generation,
  max(estimated_generation_gwh_2017) FILTER (WHERE valid) AS max_generation
FROM (SELECT *, commissioning_year IS NOT NULL AND latitude IS NOT NULL AS ok,
  commissioning_year IS NOT NULL AND latitude IS NOT NULL AND estimated_generation_gwh_2017 > 0 AND capacity_mw > 0 AS valid
  FROM (SELECT DISTINCT * FROM raw_sites))""", "raw_sites"))
def _(spark, d):
    return clean.cleaning_funnel(raw_sites(spark, d), ["commissioning_year", "latitude"])


@query("finite_only", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 9) END AS rate,
  CASE WHEN l_discount = 0 THEN NULL ELSE round(ln(l_discount), 9) END AS log_discount
FROM lineitem WHERE l_discount <> 0""")
def _(spark, d):
    inf = F.lit(float("inf"))
    lines = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_tax") == 0, inf).otherwise(F.try_divide("l_discount", "l_tax")).alias("rate"),
        F.when(F.col("l_discount") == 0, -inf).otherwise(F.log("l_discount")).alias("log_discount"),
    )
    return r(clean.finite_only(lines, ["rate", "log_discount"], ["log_discount"]), 9)


@query("enough_values", sql("SELECT site_id FROM year_values GROUP BY site_id HAVING count(*) >= 3", "year_values"))
def _(spark, d):
    cols = [f"cf_{y}" for y in YEARS]
    wide = temporal.yearly_capacity_factors(raw_site_years(spark, d), YEARS, 1.0)
    return clean.keep_with_enough_values(wide, cols).select("site_id")


@query("top_category_rows", sql("""
SELECT site_id, primary_fuel FROM raw_sites WHERE primary_fuel IN
 (SELECT primary_fuel FROM raw_sites GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12)""", "raw_sites"))
def _(spark, d):
    return clean.keep_top_categories(raw_sites(spark, d), "primary_fuel", 12).select("site_id", "primary_fuel")


@query("rows_by_class", sql("""SELECT is_renewable, count(*) AS n, round(sum(capacity_mw), 2) AS capacity
FROM sites GROUP BY 1""", "sites"))
def _(spark, d):
    one, zero = clean.split_by_flag(sites(spark, d))
    return (
        one.unionByName(zero).groupBy("is_renewable")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("capacity_mw"), 2).alias("capacity"))
    )


@query("groups_with_enough_rows", sql("""SELECT country_long, count(*) AS n, round(avg(capacity_mw), 6) AS mean_capacity
FROM raw_sites GROUP BY 1 HAVING count(*) >= 50""", "raw_sites"))
def _(spark, d):
    return clean.groups_at_least(
        raw_sites(spark, d), ["country_long"], 50, F.round(F.avg("capacity_mw"), 6).alias("mean_capacity")
    )


@query("seeded_sample", """SELECT o_orderkey, o_totalprice FROM orders
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 5000""")
def _(spark, d):
    return clean.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5000)


@query("complete_model_rows", sql("""SELECT site_id, plant_age, capacity_factor FROM sites
WHERE plant_age IS NOT NULL AND latitude IS NOT NULL AND capacity_factor IS NOT NULL""", "sites"))
def _(spark, d):
    keep = ["site_id", "plant_age", "capacity_factor"]
    return clean.drop_missing(sites(spark, d), [*keep, "latitude"]).select(*keep)


# ---- features

@query("capacity_factor", sql("""SELECT site_id, CASE WHEN estimated_generation_gwh_2017 IS NOT NULL THEN
 least(greatest(estimated_generation_gwh_2017 / (capacity_mw * 8.76e0), 0e0), 1.1e0) END AS capacity_factor FROM raw_sites""", "raw_sites"))
def _(spark, d):
    return add_capacity_factor(raw_sites(spark, d)).select("site_id", "capacity_factor")


@query("renewable_class", sql("SELECT site_id, is_renewable, energy_category FROM sites", "sites"))
def _(spark, d):
    return add_renewable_class(valid_sites(spark, d), RENEWABLE).select("site_id", "is_renewable", "energy_category")


@query("missing_flag", sql("SELECT site_id, CAST(commissioning_year IS NULL AS INTEGER) AS age_missing FROM raw_sites", "raw_sites"))
def _(spark, d):
    return raw_sites(spark, d).select("site_id", F.col("commissioning_year").isNull().cast("int").alias("age_missing"))


@query("group_median_imputation", sql("SELECT site_id, age_missing, commissioning_year, plant_age FROM sites", "sites"))
def _(spark, d):
    return features.add_plant_age(valid_sites(spark, d)).select(
        "site_id", "age_missing", "commissioning_year", "plant_age"
    )


@query("log_capacity", sql("SELECT site_id, round(ln(1 + capacity_mw), 9) AS log_capacity_mw FROM raw_sites", "raw_sites"))
def _(spark, d):
    return features.add_log_capacity(raw_sites(spark, d)).select(
        "site_id", F.round("log_capacity_mw", 9).alias("log_capacity_mw")
    )


@query("log10_capacity", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 9) END AS log10_balance
FROM customer""")
def _(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.round(log10_positive(F.col("c_acctbal")), 9).alias("log10_balance")
    )


@query("unit_scaling", sql("""SELECT country_long, round_even(sum(capacity_mw) / 1e6, 2) AS capacity_tw,
 round_even(sum(capacity_mw) / 1000, 1) AS capacity_gw FROM raw_sites GROUP BY 1""", "raw_sites"))
def _(spark, d):
    return (
        raw_sites(spark, d).groupBy("country_long")
        .agg(F.sum("capacity_mw").alias("c"))
        .select(
            "country_long",
            half_even(F.col("c") / F.lit(1e6), 2).alias("capacity_tw"),
            half_even(F.col("c") / F.lit(1000.0), 1).alias("capacity_gw"),
        )
    )


@query("z_scores", sql("""SELECT site_id, round((latitude - avg(latitude) OVER ()) / stddev_pop(latitude) OVER (), 6) + 0e0 AS latitude_z,
 round((longitude - avg(longitude) OVER ()) / stddev_pop(longitude) OVER (), 6) + 0e0 AS longitude_z,
 round((log_capacity_mw - avg(log_capacity_mw) OVER ()) / stddev_pop(log_capacity_mw) OVER (), 6) + 0e0 AS log_capacity_mw_z
FROM sites""", "sites"))
def _(spark, d):
    cols = ["latitude", "longitude", "log_capacity_mw"]
    out = features.standardise(sites(spark, d).select("site_id", *cols), cols)
    return r(out.select("site_id", *[f"{c}_z" for c in cols]))


@query("one_hot_many_levels", "SELECT CAST(o_custkey AS VARCHAR) AS level, CAST(count(*) AS DOUBLE) AS ones FROM orders GROUP BY 1")
def _(spark, d):
    """Orders as sparse vectors over their customers, summed."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("customer"))
    levels = features.numbered_levels(rows, "customer")
    sums = features.one_hot_vectors(rows, "customer", "v", levels).agg(Summarizer.sum(F.col("v")).alias("s"))
    ones = sums.select(F.posexplode(vector_to_array("s")).alias("index", "ones"))
    return ones.join(levels, "index").select("level", "ones")


@query("one_hot", sql("SELECT site_id, " + ", ".join(
    f"CAST(continent = '{c}' AS INTEGER) AS \"continent_{c}\"" for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "Unknown")
) + " FROM sites", "sites"))
def _(spark, d):
    rows = features.add_continent(valid_sites(spark, d), continents(spark, d)).select("site_id", "continent")
    return features.one_hot(rows, "continent").drop("continent")


@query("year_of_column", sql(" UNION ALL ".join(
    f"SELECT site_id, 'cf_{y}' AS column_name, {y} AS year, cf_{y} AS value FROM site_years" for y in YEARS), "site_years"))
def _(spark, d):
    from geostat_spark.functions.scalar import year_of_column

    long = temporal.long_years(site_years(spark, d), "cf", YEARS, ["site_id"])
    return long.select("site_id", "column_name", year_of_column(F.col("column_name")).alias("year"), "value")


@query("continent_lookup", sql("SELECT site_id, continent FROM sites", "sites"))
def _(spark, d):
    return features.add_continent(valid_sites(spark, d), continents(spark, d)).select("site_id", "continent")


@query("regional_renewable_share", sql("SELECT site_id, round(regional_renewable_share, 9) AS regional_renewable_share FROM sites", "sites"))
def _(spark, d):
    return r(sites(spark, d).select("site_id", "regional_renewable_share"), 9)


@query("derived_features", sql("""SELECT site_id, capacity_factor, is_renewable, energy_category, age_missing, plant_age, continent,
 round(regional_renewable_share, 9) AS regional_renewable_share, round(log_capacity_mw, 9) AS log_capacity_mw FROM sites""", "sites"))
def _(spark, d):
    out = sites(spark, d).select("site_id", "capacity_factor", "is_renewable", "energy_category", "age_missing",
                                 "plant_age", "continent", "regional_renewable_share", "log_capacity_mw")
    return r(out, 9, "regional_renewable_share", "log_capacity_mw")


@query("feature_summary", sql("""SELECT round(avg(capacity_factor), 9) AS mean_cf, min(capacity_factor) AS min_cf, max(capacity_factor) AS max_cf,
 CAST(sum(is_renewable) AS BIGINT) AS renewable_count, round(avg(is_renewable) * 100, 9) AS renewable_pct, round(avg(plant_age), 9) AS mean_age,
 CAST(sum(age_missing) AS BIGINT) AS imputed_count, round(min(log_capacity_mw), 9) AS min_log_capacity, round(max(log_capacity_mw), 9) AS max_log_capacity
FROM sites""", "sites"))
def _(spark, d):
    return r(features.feature_summary(sites(spark, d)), 9, "mean_cf", "renewable_pct", "mean_age", "min_log_capacity", "max_log_capacity")


@query("row_identity_join", sql("""SELECT s.site_id, s.capacity_factor, r.country, r.primary_fuel FROM sites s JOIN raw_sites r ON s.site_id = r.site_id""", "sites"))
def _(spark, d):
    from geostat_spark.operators.evaluation import attach_attributes

    scored = add_capacity_factor(valid_sites(spark, d), hours_factor=1.0).select("site_id", "capacity_factor")
    return attach_attributes(scored, raw_sites(spark, d), ["country", "primary_fuel"])


@query("anti_membership", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    return table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


# ---- profiles

_SHARE = "sum(is_renewable * capacity_mw) / sum(capacity_mw)"


@query("regional_stats", sql(f"""SELECT continent, round_even(avg(capacity_factor), 3) AS mean_capacity_factor,
 round_even(sum(capacity_mw), 3) AS total_capacity_mw, round_even({_SHARE}, 3) AS renewable_share FROM sites GROUP BY 1
 ORDER BY total_capacity_mw DESC, continent""", "sites"))
def _(spark, d):
    return profile.regional_stats(sites(spark, d))


@query("country_rankings", sql(f"""SELECT country_long, round_even(sum(capacity_mw), 3) AS total_capacity_mw,
 round_even(avg(capacity_factor), 3) AS mean_capacity_factor, round_even({_SHARE}, 3) AS renewable_share, count(country) AS plant_count
 FROM sites GROUP BY 1 ORDER BY total_capacity_mw DESC, country_long LIMIT 20""", "sites"))
def _(spark, d):
    return profile.country_rankings(sites(spark, d))


@query("capacity_rankings", sql(f"""SELECT country_long, round_even(sum(capacity_mw), 3) AS total_capacity_mw,
 round_even(avg(capacity_mw), 3) AS mean_capacity_mw, count(capacity_mw) AS plant_count,
 round_even(avg(capacity_factor), 3) AS mean_capacity_factor, round_even({_SHARE}, 3) AS renewable_share
 FROM sites GROUP BY 1 ORDER BY total_capacity_mw DESC, country_long LIMIT 50""", "sites"))
def _(spark, d):
    return profile.capacity_rankings(sites(spark, d))


@query("value_counts", sql("SELECT primary_fuel, count(*) AS row_count FROM raw_sites GROUP BY 1 ORDER BY 2 DESC, 1", "raw_sites"))
def _(spark, d):
    return profile.value_counts(raw_sites(spark, d), "primary_fuel")


@query("capacity_by_fuel", sql("""SELECT primary_fuel, round(sum(capacity_mw), 2) AS total_capacity_mw FROM raw_sites
GROUP BY 1 ORDER BY 2 DESC, 1""", "raw_sites"))
def _(spark, d):
    return r(profile.sum_by(raw_sites(spark, d), "primary_fuel", "capacity_mw"), 2)


@query("capacity_by_country_top", sql("""SELECT country_long, round(sum(capacity_mw), 2) AS total_capacity_mw FROM raw_sites
GROUP BY 1 ORDER BY sum(capacity_mw) DESC, 1 LIMIT 20""", "raw_sites"))
def _(spark, d):
    return r(profile.sum_by(raw_sites(spark, d), "country_long", "capacity_mw", 20), 2)


@query("distribution_by_fuel", sql("""SELECT primary_fuel, round_even(avg(capacity_factor), 3) AS mean, round_even(median(capacity_factor), 3) AS median,
 round_even(stddev_samp(capacity_factor), 3) AS std, count(capacity_factor) AS count FROM sites GROUP BY 1""", "sites"))
def _(spark, d):
    return profile.distribution_by(sites(spark, d), "primary_fuel", "capacity_factor")


@query("generation_coverage_by_fuel", sql("""SELECT primary_fuel, count(estimated_generation_gwh_2017) AS count,
 round(sum(estimated_generation_gwh_2017), 3) AS sum, round(avg(estimated_generation_gwh_2017), 6) AS mean,
 round_even(100e0 * count(estimated_generation_gwh_2017) / count(*), 1) AS coverage_rate FROM raw_sites GROUP BY 1""", "raw_sites"))
def _(spark, d):
    out = profile.coverage_by(raw_sites(spark, d), "primary_fuel", "estimated_generation_gwh_2017")
    return r(r(out, 3, "sum"), 6, "mean")


@query("generation_coverage_total", sql("""SELECT count(estimated_generation_gwh_2017) AS with_value,
 count(*) - count(estimated_generation_gwh_2017) AS without_value,
 round_even(100e0 * count(estimated_generation_gwh_2017) / count(*), 1) AS with_pct FROM raw_sites""", "raw_sites"))
def _(spark, d):
    return profile.coverage_total(raw_sites(spark, d), "estimated_generation_gwh_2017")


@query("missing_profile", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, round_even(100e0 * (count(*) - count({c})) / count(*), 2) AS percentage FROM raw_sites"
    for c in _RAW_COLUMNS) + ") WHERE missing_count > 0 ORDER BY 2 DESC, 1 LIMIT 15", "raw_sites"))
def _(spark, d):
    return profile.missing_profile(raw_sites(spark, d), 15)


_NUM = ["capacity_mw", "latitude", "longitude", "commissioning_year", "estimated_generation_gwh_2017"]


@query("describe", sql(" UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std,
 round(min({c}), 7) AS min, round(quantile_cont({c}, 0.25), 7) AS q25, round(quantile_cont({c}, 0.5), 7) AS q50, round(quantile_cont({c}, 0.75), 7) AS q75, round(max({c}), 7) AS max FROM raw_sites"""
    for c in _NUM), "raw_sites"))
def _(spark, d):
    return r(profile.describe(raw_sites(spark, d), _NUM), 7)


@query("table_totals", sql("""SELECT round(sum(capacity_mw), 2) AS total, round(avg(capacity_mw), 6) AS mean, median(capacity_mw) AS median,
 count(DISTINCT country) AS distinct_keys FROM raw_sites""", "raw_sites"))
def _(spark, d):
    return r(r(profile.table_totals(raw_sites(spark, d), "capacity_mw", "country"), 2, "total"), 6, "mean")


@query("class_comparison", sql("""SELECT is_renewable, count(*) AS n, round(avg(capacity_factor), 9) AS mean, round(median(capacity_factor), 9) AS median
FROM sites GROUP BY 1""", "sites"))
def _(spark, d):
    return r(profile.class_comparison(sites(spark, d), "is_renewable", "capacity_factor"), 9)


@query("correlation", sql("SELECT round(corr(capacity_mw, capacity_factor), 9) AS correlation FROM sites", "sites"))
def _(spark, d):
    return r(profile.correlation(sites(spark, d), "capacity_mw", "capacity_factor"), 9)


def _hist_sql(value, bins, lo, hi, source, extra):
    return f"""SELECT CAST(b.bin AS INTEGER) AS bin, round(s.lo + b.bin * (s.hi - s.lo) / {bins}, 9) + 0e0 AS bin_low,
 round(s.lo + (b.bin + 1) * (s.hi - s.lo) / {bins}, 9) + 0e0 AS bin_high, coalesce(c.n, 0) AS n{extra}
FROM range({bins}) b(bin) CROSS JOIN (SELECT {lo} AS lo, {hi} AS hi, avg({value}) AS mean, median({value}) AS median FROM {source}) s
LEFT JOIN (SELECT least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) AS bin, count(*) AS n
  FROM (SELECT {value} AS v FROM {source} WHERE {value} IS NOT NULL) CROSS JOIN (SELECT {lo} AS lo, {hi} AS hi FROM {source}) GROUP BY 1) c
  ON c.bin = b.bin"""


@query("histogram", sql(_hist_sql("capacity_factor", 50, "min(capacity_factor)", "max(capacity_factor)", "sites",
                                  ", round(s.mean, 9) AS mean, round(s.median, 9) AS median"), "sites"))
def _(spark, d):
    return r(profile.histogram(sites(spark, d), "capacity_factor", 50), 9)


@query("log_histogram", sql(_hist_sql("log10(capacity_mw)", 100, "min(log10(capacity_mw))", "max(log10(capacity_mw))", "raw_sites",
                                      ", round(s.mean, 9) AS mean, round(s.median, 9) AS median"), "raw_sites"))
def _(spark, d):
    logs = raw_sites(spark, d).select(log10_positive(F.col("capacity_mw")).alias("v"))
    return r(profile.histogram(logs, "v", 100), 9)


def _box_sql(keys, source):
    k = ", ".join(keys)
    pre = f"{k}, " if keys else ""
    on = " AND ".join(f"a.{c} = q.{c}" for c in keys) or "TRUE"
    grp = f"GROUP BY {', '.join('a.' + c for c in keys)}" if keys else ""
    sel = "".join(f"a.{c}, " for c in keys)
    inside = "a.capacity_factor BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)"
    return f"""SELECT {sel}count(*) AS n, round(avg(a.capacity_factor), 9) AS mean, round(max(q1), 9) AS q1, round(max(med), 9) AS median, round(max(q3), 9) AS q3,
 round(least(min(a.capacity_factor) FILTER (WHERE {inside}), max(q1)), 9) AS whisker_low,
 round(greatest(max(a.capacity_factor) FILTER (WHERE {inside}), max(q3)), 9) AS whisker_high,
 count(*) FILTER (WHERE NOT ({inside})) AS outliers
FROM {source} a JOIN (SELECT {pre}quantile_cont(capacity_factor, 0.25) AS q1, median(capacity_factor) AS med, quantile_cont(capacity_factor, 0.75) AS q3
  FROM {source} {'GROUP BY ' + k if keys else ''}) q ON {on} {grp}"""


@query("box_stats", sql(_box_sql([], "sites"), "sites"))
def _(spark, d):
    return r(profile.box_stats(sites(spark, d), "capacity_factor"), 9)


@query("box_stats_by_fuel", sql(_box_sql(["primary_fuel"], """(SELECT * FROM sites WHERE primary_fuel IN
 (SELECT primary_fuel FROM sites GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12))"""), "sites"))
def _(spark, d):
    return r(profile.box_stats(clean.keep_top_categories(sites(spark, d), "primary_fuel", 12), "capacity_factor", ["primary_fuel"]), 9)


@query("box_stats_by_class", sql(_box_sql(["is_renewable"], "sites"), "sites"))
def _(spark, d):
    return r(profile.box_stats(sites(spark, d), "capacity_factor", ["is_renewable"]), 9)


# ---- yearly features

@query("yearly_capacity_factors", sql("SELECT site_id, " + ", ".join(
    f"CASE WHEN estimated_generation_gwh_{y} IS NOT NULL THEN least(greatest(estimated_generation_gwh_{y} / (capacity_mw * 1e0), 0e0), 1.1e0) END AS cf_{y}"
    for y in YEARS) + " FROM raw_site_years", "raw_site_years"))
def _(spark, d):
    return temporal.yearly_capacity_factors(raw_site_years(spark, d), YEARS, 1.0).select("site_id", *[f"cf_{y}" for y in YEARS])


def _temporal(name, *cols):
    body = ", ".join(c if c.startswith("is_") else f"round({c}, 8) + 0e0 AS {c}" for c in cols)

    @query(name, sql(f"SELECT site_id, {body} FROM site_years", "site_years"))
    def _(spark, d):
        return r(site_years(spark, d).select("site_id", *cols), 8)


_temporal("yearly_level_and_spread", "cf_mean", "cf_std", "cf_cv")
_temporal("yearly_range", "cf_min", "cf_max", "cf_range")
_temporal("yearly_trend", "cf_trend", "cf_trend_r2")
_temporal("yearly_stability", "is_stable", "is_volatile")
_temporal("yearly_recent_change", "cf_recent_change")


@query("temporal_totals", sql("""SELECT round(avg(cf_mean), 9) AS mean_cf, round(stddev_samp(cf_mean), 9) AS std_cf, round(avg(cf_cv), 9) AS mean_cv,
 CAST(sum(is_stable) AS BIGINT) AS stable_count, round(avg(is_stable) * 100, 9) AS stable_pct,
 CAST(sum(is_volatile) AS BIGINT) AS volatile_count, round(avg(is_volatile) * 100, 9) AS volatile_pct FROM site_years""", "site_years"))
def _(spark, d):
    return r(temporal.temporal_totals(site_years(spark, d)), 9)


@query("year_coverage", sql(" UNION ALL ".join(
    f"""SELECT {y} AS year, count(estimated_generation_gwh_{y}) AS n_plants, round(100e0 * count(estimated_generation_gwh_{y}) / count(*), 9) AS pct,
 round(coalesce(sum(capacity_mw) FILTER (WHERE estimated_generation_gwh_{y} IS NOT NULL), 0), 6) AS total_capacity_mw FROM raw_site_years"""
    for y in YEARS), "raw_site_years"))
def _(spark, d):
    return r(r(temporal.year_coverage(raw_site_years(spark, d), YEARS), 9, "pct"), 6, "total_capacity_mw")


@query("coverage_by_year_and_fuel", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {y} AS year, primary_fuel, count(estimated_generation_gwh_{y}) AS n FROM raw_site_years GROUP BY primary_fuel" for y in YEARS)
    + """) WHERE primary_fuel IN (SELECT primary_fuel FROM raw_site_years GROUP BY 1 ORDER BY sum("""
    + " + ".join(f"CAST(estimated_generation_gwh_{y} IS NOT NULL AS INTEGER)" for y in YEARS) + ") DESC, 1 LIMIT 15)", "raw_site_years"))
def _(spark, d):
    return temporal.coverage_by_fuel(raw_site_years(spark, d), YEARS, 15)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("coverage_matrix", sql(" UNION ALL ".join(f"SELECT {y} AS year, " + ", ".join(
    f"count(estimated_generation_gwh_{y}) FILTER (WHERE primary_fuel = '{s}') AS \"{s}\"" for s in _SEGMENTS)
    + " FROM raw_site_years" for y in YEARS), "raw_site_years"))
def _(spark, d):
    return temporal.coverage_matrix(raw_site_years(spark, d), YEARS, 15)


@query("yearly_profile_of_top_fuels", sql("""SELECT primary_fuel, yr AS year, round(avg(cf), 9) AS mean_cf, round(stddev_samp(cf), 9) AS std_cf
FROM year_values v JOIN site_years s ON v.site_id = s.site_id
WHERE primary_fuel IN (SELECT primary_fuel FROM site_years GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) GROUP BY 1, 2""", "year_values", "site_years"))
def _(spark, d):
    return r(temporal.yearly_profile_of_top_fuels(site_years(spark, d), YEARS, 4), 9)


@query("stability_by_fuel", sql("""SELECT primary_fuel, round(avg(is_stable), 9) AS is_stable, round(avg(is_volatile), 9) AS is_volatile, count(capacity_mw) AS count
FROM site_years GROUP BY 1 HAVING count(capacity_mw) >= 50""", "site_years"))
def _(spark, d):
    return r(temporal.stability_by_fuel(site_years(spark, d)), 9)


@query("stability_by_class", sql("""SELECT is_renewable, round(avg(is_stable), 9) AS is_stable, round(avg(is_volatile), 9) AS is_volatile
FROM site_years GROUP BY 1""", "site_years"))
def _(spark, d):
    return r(temporal.stability_by_class(site_years(spark, d)), 9)


def _pattern(name, key, top):
    keep = f"WHERE {key} IN (SELECT {key} FROM site_years GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {top})" if top else ""

    @query(name, sql(f"""SELECT {key}, count(*) AS n, round(avg(cf_mean), 9) AS mean_cf, round(avg(cf_cv), 9) AS mean_cv, round(avg(cf_trend), 9) + 0e0 AS mean_trend,
 round(avg(is_stable) * 100, 9) AS stable_pct FROM site_years {keep} GROUP BY 1 HAVING count(*) > 10""", "site_years"))
    def _(spark, d):
        return r(temporal.temporal_pattern(site_years(spark, d), key, top), 9)


_pattern("temporal_pattern_by_fuel", "primary_fuel", 10)
_pattern("temporal_pattern_by_continent", "continent", None)


@query("volatility_histogram", sql(_hist_sql("least(greatest(cf_cv, 0e0), 1e0)", 50, "min(least(greatest(cf_cv, 0e0), 1e0))", "max(least(greatest(cf_cv, 0e0), 1e0))",
    "site_years", ", round((SELECT median(cf_cv) FROM site_years), 9) AS median"), "site_years"))
def _(spark, d):
    return r(temporal.clipped_histogram(site_years(spark, d), "cf_cv", 0.0, 1.0), 9)


# a slope that is zero up to float residue would fall on either side of the middle bin's edge
define("rounded_trend", "SELECT round(cf_trend, 9) + 0e0 AS cf_trend FROM site_years", "site_years")


@query("trend_histogram", sql(_hist_sql("least(greatest(cf_trend, -1e-1), 1e-1)", 50, "min(least(greatest(cf_trend, -1e-1), 1e-1))", "max(least(greatest(cf_trend, -1e-1), 1e-1))",
    "rounded_trend", ", round((SELECT median(cf_trend) FROM rounded_trend), 9) + 0e0 AS median"), "rounded_trend"))
def _(spark, d):
    trends = r(site_years(spark, d).select("cf_trend"), 9)
    return r(temporal.clipped_histogram(trends, "cf_trend", -0.1, 0.1), 9)
