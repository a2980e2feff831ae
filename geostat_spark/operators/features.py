"""Feature derivation on sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from geostat_spark.functions.scalar import capacity_factor, finite_or_null, ratio
from geostat_spark.operators.attach import attach
from geostat_spark.operators.ordering import hash_position, quantiles, with_row_number
from geostat_spark.session import cut

# The fuels counted as renewable; every other fuel is labelled Fossil.
RENEWABLE_FUELS = ["Solar", "Wind", "Hydro", "Biomass", "Geothermal", "Waste", "Wave and Tidal"]
REFERENCE_YEAR = 2019
GENERATION = "estimated_generation_gwh_2017"


def add_capacity_factor(
    df: DataFrame, generation: str = GENERATION, capacity: str = "capacity_mw", hours_factor: float = 8.76
) -> DataFrame:
    return df.withColumn("capacity_factor", capacity_factor(F.col(generation), F.col(capacity), hours_factor))


def add_renewable_class(df: DataFrame, renewable: Sequence[str] = RENEWABLE_FUELS) -> DataFrame:
    member = F.coalesce(F.col("primary_fuel").isin(list(renewable)), F.lit(False))
    return df.withColumns(
        {
            "is_renewable": member.cast("int"),
            "energy_category": F.when(member, "Renewable").otherwise("Fossil"),
        }
    )


def impute_group_median(
    df: DataFrame, column: str, group: str, flag: str, few_distinct: bool = False, fit_on: DataFrame | None = None
) -> DataFrame:
    """Fill missing values with the median of the row's group and flag the rows that were filled.

    ``fit_on``: the rows whose medians are used, such as the training part; by default ``df`` itself.

    ``few_distinct`` promises a small domain (years): the exact ``median`` aggregate then holds one count
    per distinct value and pre-aggregates before the shuffle. Any other column goes through the bucketed
    quantiles, whose state does not grow with the group. A group without any value stays NULL."""
    fit_on = df if fit_on is None else fit_on
    if few_distinct:
        medians = fit_on.groupBy(group).agg(F.median(column).alias("_median"))
    else:
        medians = quantiles(fit_on.select(group, column), column, {"_median": 0.5}, keys=[group])
    return (
        attach(df.withColumn(flag, F.col(column).isNull().cast("int")), medians.where(F.col(group).isNotNull()), [group])
        .withColumn(column, F.coalesce(F.col(column), F.col("_median")))
        .drop("_median")
    )


def add_plant_age(df: DataFrame, reference_year: int = REFERENCE_YEAR, fit_on: DataFrame | None = None) -> DataFrame:
    """Age at ``reference_year``; a missing year is the median of its fuel among ``fit_on`` (by default all rows)."""
    filled = impute_group_median(df, "commissioning_year", "primary_fuel", "age_missing", True, fit_on)
    return filled.withColumn("plant_age", F.lit(float(reference_year)) - F.col("commissioning_year"))


def add_continent(df: DataFrame, lookup: DataFrame, key: str = "country_long") -> DataFrame:
    """Left lookup country -> continent; unresolved names read 'Unknown'. ``lookup`` has one row per
    country name."""
    table = lookup.where(F.col(key).isNotNull()).select(key, F.col("continent").alias("_continent"))
    return (
        attach(df, table, [key])
        .withColumn("continent", F.coalesce(F.col("_continent"), F.lit("Unknown")))
        .drop("_continent")
    )


def group_share(df: DataFrame, group: str, member: str, weight: str, name: str) -> DataFrame:
    """Weighted share of flagged rows per group; rows without a group have no share."""
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(ratio(F.sum(F.col(member) * F.col(weight)), F.sum(weight)).alias(name))
    )


def add_regional_share(df: DataFrame, group: str = "continent", fit_on: DataFrame | None = None) -> DataFrame:
    """Attach the group's renewable share of capacity. It is taken over all rows unless ``fit_on``
    names the training rows."""
    share = group_share(
        df if fit_on is None else fit_on, group, "is_renewable", "capacity_mw", "regional_renewable_share"
    )
    return attach(df, share, [group])


def add_log_capacity(df: DataFrame, capacity: str = "capacity_mw") -> DataFrame:
    return df.withColumn("log_capacity_mw", F.log1p(F.col(capacity)))


def derive_features(
    df: DataFrame,
    continents: DataFrame,
    renewable: Sequence[str] = RENEWABLE_FUELS,
    hours_factor: float = 8.76,
    reference_year: int = REFERENCE_YEAR,
) -> DataFrame:
    """All derived columns; infinite values become NULL and rows without a capacity factor go."""
    out = add_capacity_factor(df, hours_factor=hours_factor)
    out = add_renewable_class(out, renewable)
    out = add_plant_age(out, reference_year)
    out = add_continent(out, continents)
    out = add_regional_share(out)
    out = add_log_capacity(out)
    doubles = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({c: finite_or_null(F.col(c)) for c in doubles}).na.drop(subset=["capacity_factor"])


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).alias("stats")
    ).scalar()
    out = df.withColumn("_stats", stats)
    return out.withColumns(
        {
            f"{c}{suffix}": (F.col(c) - F.col(f"_stats.m_{c}"))
            / F.when(F.col(f"_stats.s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_stats.s_{c}"))
            for c in columns
        }
    ).drop("_stats")


def category_levels(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values. Meant for low-cardinality categories: the list becomes columns."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()
    return [r[0] for r in rows]


def one_hot(df: DataFrame, column: str, levels: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per level, all levels kept, alphabetical, named ``column_level``."""
    levels = category_levels(df, column) if levels is None else levels
    return df.withColumns(
        {f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in levels}
    )


def numbered_levels(df: DataFrame, column: str) -> DataFrame:
    """(level, index): the distinct values of a column, numbered from 0 in the order of their hashes. A table, however
    many there are: nothing is collected."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    return cut(with_row_number(levels, hash_position("level", 0), "level", "_row").select("level", (F.col("_row") - 1).alias("index")))


def one_hot_vectors(df: DataFrame, column: str, output: str, levels: DataFrame | None = None) -> DataFrame:
    """``df`` with a sparse 0/1 vector over ``levels`` (see ``numbered_levels``; by default those of ``df``). For columns
    of very many levels: a row holds one number, not a column a level. A missing value or one that is no level has
    no 1. Hot levels stay where they are while the level table is small enough for Spark to broadcast."""
    from pyspark.ml.feature import OneHotEncoder

    levels = numbered_levels(df, column) if levels is None else levels
    size = levels.agg(F.coalesce(F.max("index") + 1, F.lit(0))).first()[0]
    other = df.sparkSession.createDataFrame([(float(i),) for i in (0, size)], "_index double")  # the last category is left out
    encoder = OneHotEncoder(inputCol="_index", outputCol=output, dropLast=True).fit(other)
    found = df.join(levels.select(F.col("level").alias(column), F.col("index").alias("_index")), column, "left")
    indexed = found.withColumn("_index", F.coalesce("_index", F.lit(size)).cast("double"))
    return encoder.transform(indexed).select(*df.columns, output)


def feature_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("capacity_factor").alias("mean_cf"),
        F.min("capacity_factor").alias("min_cf"),
        F.max("capacity_factor").alias("max_cf"),
        F.sum("is_renewable").alias("renewable_count"),
        (F.avg("is_renewable") * 100).alias("renewable_pct"),
        F.avg("plant_age").alias("mean_age"),
        F.sum("age_missing").alias("imputed_count"),
        F.min("log_capacity_mw").alias("min_log_capacity"),
        F.max("log_capacity_mw").alias("max_log_capacity"),
    )
