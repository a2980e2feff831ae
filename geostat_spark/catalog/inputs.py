"""The given tables seen as sites, site-years, points and readings, once as DataFrames and once as SQL.

* site: an order; capacity is its price, generation the discounted value of its lines, fuel its
  priority and status, country and continent come from the customer's nation and region, latitude from
  the customer's balance and longitude from the order date;
* site-year: a customer; yearly generation is the customer's order volume of the year;
* point: an embedding; its first two components are coordinates, the third the measured value;
* reading: an event whose raw text is a number for most event types and JSON for errors.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from geostat_spark.operators import clean, features, temporal
from geostat_spark.session import cut

# Fixed values of the mapping.
RENEWABLE = [
    "1-URGENT F", "1-URGENT O", "1-URGENT P", "2-HIGH F", "2-HIGH O", "2-HIGH P", "3-MEDIUM F",
]
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
HOURS = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    generation = lines.groupBy(F.col("l_orderkey").alias("site_id")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias(
            "estimated_generation_gwh_2017"
        )
    )
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    owner = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"])
    return (
        orders.join(owner, orders["o_custkey"] == owner["c_custkey"])
        .withColumnRenamed("o_orderkey", "site_id")
        .join(generation, "site_id", "left")
        .select(
            "site_id",
            F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country"),
            F.col("n_name").alias("country_long"),
            F.col("o_totalprice").alias("capacity_mw"),
            (F.col("c_acctbal") / F.lit(120.0)).alias("latitude"),
            (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / F.lit(10.0) - F.lit(120.0)).alias(
                "longitude"
            ),
            F.concat("o_orderpriority", F.lit(" "), "o_orderstatus").alias("primary_fuel"),
            F.when(F.col("c_mktsegment") != "MACHINERY", F.year("o_orderdate").cast("double")).alias(
                "commissioning_year"
            ),
            "estimated_generation_gwh_2017",
        )
    )


def continents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country lookup that leaves one region unresolved."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        nations.where(F.col("n_regionkey") < 4)
        .join(regions, nations["n_regionkey"] == regions["r_regionkey"])
        .select(F.col("n_name").alias("country_long"), F.col("r_name").alias("continent"))
    )


def valid_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.valid_generation(clean.clean(raw_sites(spark, sf_dir)))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with every derived feature. The cleaned table is written out first, as it feeds the group
    medians, the regional shares and the features themselves."""
    return features.derive_features(
        cut(valid_sites(spark, sf_dir)), continents(spark, sf_dir), RENEWABLE, hours_factor=HOURS
    )


def raw_site_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    yearly = orders.groupBy(F.col("o_custkey").alias("site_id")).agg(
        *[
            F.round(F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))) / F.lit(1e6), 8).alias(
                f"estimated_generation_gwh_{y}"
            )
            for y in YEARS
        ]
    )
    where = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        where.withColumnRenamed("c_custkey", "site_id")
        .join(yearly, "site_id", "left")
        .select(
            "site_id",
            ((F.col("c_acctbal") + F.lit(1500.0)) / F.lit(10000.0)).alias("capacity_mw"),
            F.col("c_mktsegment").alias("primary_fuel"),
            F.col("r_name").alias("continent"),
            F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD").cast("int").alias("is_renewable"),
            *[f"estimated_generation_gwh_{y}" for y in YEARS],
        )
    )


def site_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.temporal_features(raw_site_years(spark, sf_dir), YEARS, hours_factor=HOURS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        e[0].cast("double").alias("x"),
        e[1].cast("double").alias("y"),
        e[2].cast("double").alias("value"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("category"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.when(F.col("event_type") == "error", F.col("props"))
        .otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
        .alias("raw_value"),
    )


_RENEWABLE_SQL = ", ".join(f"'{r}'" for r in RENEWABLE)

# (name, statement, names it needs) of each common table expression
_CTES: dict[str, tuple[str, list[str]]] = {
    "gen": (
        "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS generation "
        "FROM lineitem GROUP BY l_orderkey",
        [],
    ),
    "raw_sites": (
        """SELECT o_orderkey AS site_id, 'C' || CAST(n_nationkey AS VARCHAR) AS country, n_name AS country_long,
          o_totalprice AS capacity_mw, c_acctbal / 120e0 AS latitude,
          date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 10e0 - 120e0 AS longitude,
          o_orderpriority || ' ' || o_orderstatus AS primary_fuel,
          CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(year(o_orderdate) AS DOUBLE) END AS commissioning_year,
          generation AS estimated_generation_gwh_2017
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN gen ON l_orderkey = o_orderkey""",
        ["gen"],
    ),
    "valid_sites": (
        """SELECT DISTINCT * FROM raw_sites WHERE capacity_mw IS NOT NULL AND latitude IS NOT NULL
          AND longitude IS NOT NULL AND primary_fuel IS NOT NULL
          AND estimated_generation_gwh_2017 > 0 AND capacity_mw > 0""",
        ["raw_sites"],
    ),
    "continents": (
        "SELECT n_name AS country_long, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey "
        "WHERE n_regionkey < 4",
        [],
    ),
    "fuel_median": (
        "SELECT primary_fuel, median(commissioning_year) AS median_year FROM valid_sites GROUP BY primary_fuel",
        ["valid_sites"],
    ),
    "base_sites": (
        f"""SELECT v.site_id, v.country, v.country_long, v.capacity_mw, v.latitude, v.longitude, v.primary_fuel,
          coalesce(v.commissioning_year, m.median_year) AS commissioning_year, v.estimated_generation_gwh_2017,
          least(greatest(v.estimated_generation_gwh_2017 / (v.capacity_mw * 1e0), 0e0), 1.1e0) AS capacity_factor,
          CAST(v.primary_fuel IN ({_RENEWABLE_SQL}) AS INTEGER) AS is_renewable,
          CASE WHEN v.primary_fuel IN ({_RENEWABLE_SQL}) THEN 'Renewable' ELSE 'Fossil' END AS energy_category,
          CAST(v.commissioning_year IS NULL AS INTEGER) AS age_missing,
          2019e0 - coalesce(v.commissioning_year, m.median_year) AS plant_age,
          coalesce(c.continent, 'Unknown') AS continent,
          ln(1 + v.capacity_mw) AS log_capacity_mw
        FROM valid_sites v LEFT JOIN fuel_median m ON v.primary_fuel = m.primary_fuel
        LEFT JOIN continents c ON v.country_long = c.country_long""",
        ["valid_sites", "fuel_median", "continents"],
    ),
    "sites": (
        """SELECT b.*, s.share AS regional_renewable_share FROM base_sites b JOIN (
          SELECT continent, sum(is_renewable * capacity_mw) / sum(capacity_mw) AS share
          FROM base_sites GROUP BY continent) s ON b.continent = s.continent""",
        ["base_sites"],
    ),
    "raw_site_years": (
        """SELECT c_custkey AS site_id, (c_acctbal + 1500e0) / 10000e0 AS capacity_mw,
          c_mktsegment AS primary_fuel, r_name AS continent,
          CAST(c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AS INTEGER) AS is_renewable, """
        + ", ".join(f"g{y} AS estimated_generation_gwh_{y}" for y in YEARS)
        + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
        " LEFT JOIN (SELECT o_custkey, "
        + ", ".join(
            f"round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = {y}) / 1e6, 8) AS g{y}" for y in YEARS
        )
        + " FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
        [],
    ),
    "year_values": (
        " UNION ALL ".join(
            f"SELECT site_id, {y} AS yr, least(greatest(estimated_generation_gwh_{y} / (capacity_mw * 1e0), 0e0), 1.1e0)"
            f" AS cf FROM raw_site_years WHERE estimated_generation_gwh_{y} IS NOT NULL"
            for y in YEARS
        ),
        ["raw_site_years"],
    ),
    "year_stats": (
        """SELECT site_id, avg(cf) AS cf_mean, stddev_pop(cf) AS cf_std, min(cf) AS cf_min, max(cf) AS cf_max,
          CASE WHEN count(*) < 3 OR min(cf) = max(cf) THEN 0e0 ELSE regr_slope(cf, yr) END AS cf_trend,
          CASE WHEN count(*) < 3 OR min(cf) = max(cf) THEN 0e0 ELSE regr_r2(cf, yr) END AS cf_trend_r2,
          max(CASE WHEN yr = 2001 THEN cf END) - max(CASE WHEN yr = 2000 THEN cf END) AS cf_recent_change,
          """
        + ", ".join(f"max(CASE WHEN yr = {y} THEN cf END) AS cf_{y}" for y in YEARS)
        + " FROM year_values GROUP BY site_id HAVING count(*) >= 3",
        ["year_values"],
    ),
    "site_years": (
        """SELECT r.*, s.* EXCLUDE (site_id), s.cf_max - s.cf_min AS cf_range,
          s.cf_std / (s.cf_mean + 1e-10) AS cf_cv,
          CAST(s.cf_std / (s.cf_mean + 1e-10) < 0.1e0 AS INTEGER) AS is_stable,
          CAST(s.cf_std / (s.cf_mean + 1e-10) > 0.3e0 AS INTEGER) AS is_volatile
        FROM raw_site_years r JOIN year_stats s ON r.site_id = s.site_id""",
        ["raw_site_years", "year_stats"],
    ),
    "points": (
        """SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
          CAST(embedding[3] AS DOUBLE) AS value, 'L' || CAST(label AS VARCHAR) AS category FROM embeddings""",
        [],
    ),
    "readings": (
        """SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN props
          ELSE ' ' || CAST(value AS VARCHAR) || ' ' END AS raw_value FROM events""",
        [],
    ),
}


def define(name: str, statement: str, *needs: str) -> str:
    """Add a common table expression for later statements."""
    _CTES[name] = (statement, list(needs))
    return name


def sql(body: str, *names: str) -> str:
    """``body`` preceded by the named common table expressions and everything they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for need in _CTES[n][1]:
                visit(need)
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order)
    again = any(re.search(rf"\b{n}\b", _CTES[n][0]) for n in order)
    return f"WITH {'RECURSIVE ' * again}{head}\n{body}"
