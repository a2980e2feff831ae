"""Cleaning and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from geostat_spark.functions.scalar import coerce_double, finite_or_null, nan_to_null
from geostat_spark.operators.ordering import seeded_hash

# The columns a site must have, and the ones read as numbers.
CRITICAL_COLUMNS = ["capacity_mw", "latitude", "longitude", "primary_fuel"]
NUMERIC_COLUMNS = ["capacity_mw", "latitude", "longitude", "estimated_generation_gwh_2017"]


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_missing(df: DataFrame, columns: Sequence[str] = CRITICAL_COLUMNS) -> DataFrame:
    return df.na.drop(subset=list(columns))


def coerce_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Read the listed columns as doubles where they exist; bad values become NULL. A column that holds
    numbers already is not taken through text, so that later filters on it reach the scan."""
    return df.withColumns({c: _as_double(df, c) for c in columns if c in df.columns})


def _as_double(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return nan_to_null(F.col(name).cast("double"))
    return F.col(name).cast("double") if isinstance(kind, T.NumericType) else coerce_double(F.col(name))


def clean(
    df: DataFrame,
    critical: Sequence[str] = CRITICAL_COLUMNS,
    numeric: Sequence[str] = NUMERIC_COLUMNS,
) -> DataFrame:
    """Distinct rows, no missing critical values, numeric columns coerced, in that order."""
    return coerce_numeric(drop_missing(drop_duplicate_rows(df), critical), numeric)


def valid_generation(
    df: DataFrame, generation: str = "estimated_generation_gwh_2017", capacity: str = "capacity_mw"
) -> DataFrame:
    return df.where((F.col(generation) > 0) & (F.col(capacity) > 0))


def cleaning_funnel(
    df: DataFrame,
    critical: Sequence[str] = CRITICAL_COLUMNS,
    generation: str = "estimated_generation_gwh_2017",
    capacity: str = "capacity_mw",
) -> DataFrame:
    """Rows left after each cleaning step and the ranges of what remains, in one pass after DISTINCT."""
    present = F.lit(True)
    for c in critical:
        present = present & F.col(c).isNotNull()
    typed = (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .select(
            "_copies",
            present.alias("_complete"),
            _as_double(df, generation).alias(generation),
            _as_double(df, capacity).alias(capacity),
        )
    )
    has_critical = F.col("_complete")
    valid = has_critical & (F.col(generation) > 0) & (F.col(capacity) > 0)
    return typed.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_in"),
        F.count(F.lit(1)).alias("rows_distinct"),
        F.count_if(has_critical).alias("rows_complete"),
        F.count_if(valid).alias("rows_valid"),
        F.min(F.when(valid, F.col(capacity))).alias("min_capacity"),
        F.max(F.when(valid, F.col(capacity))).alias("max_capacity"),
        F.min(F.when(valid, F.col(generation))).alias("min_generation"),
        F.max(F.when(valid, F.col(generation))).alias("max_generation"),
    )


def finite_only(df: DataFrame, columns: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Infinite and NaN values become NULL in ``columns``; rows lacking a ``required`` one are dropped."""
    return df.withColumns({c: finite_or_null(F.col(c)) for c in columns}).na.drop(subset=list(required))


def keep_with_enough_values(df: DataFrame, columns: Sequence[str], minimum: int | None = None) -> DataFrame:
    """Keep rows with at least ``minimum`` of ``columns`` present (half of them, rounded down)."""
    columns = list(columns)
    needed = len(columns) // 2 if minimum is None else minimum
    return df.na.drop(thresh=needed, subset=columns) if needed > 0 else df


FEW = 100_000  # rows that may be put in order in one task


def top_categories(df: DataFrame, category: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties go to the smaller name."""
    return (
        df.where(F.col(category).isNotNull())
        .groupBy(category)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), category)
        .limit(n)
    )


def keep_top_categories(df: DataFrame, category: str, n: int) -> DataFrame:
    """Rows of the ``n`` most frequent categories. The right side has at most ``n`` rows."""
    return df.join(F.broadcast(top_categories(df, category, n).select(category)), category, "left_semi")


def split_by_flag(df: DataFrame, flag_column: str = "is_renewable") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(flag_column) == 1), df.where(F.col(flag_column) == 0)


def groups_at_least(df: DataFrame, keys: Sequence[str], minimum: int, *aggregates: Column) -> DataFrame:
    """Aggregates of the groups that have at least ``minimum`` rows, with their row count as ``n``."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggregates).where(F.col("n") >= F.lit(minimum))
    )


def sample_rows(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), the same ones for the same seed on any cluster: those of the smallest
    seeded hashes.

    Rows are counted by the first digits of their hash; all of the digits below the n-th row's are in, and only among
    the rows that share its digits are the last ones picked by order. Digits are added until these are few."""
    hashed = df.withColumn("_hash", seeded_hash(id_column, seed))
    below, wanted, prefix = F.lit(False), n, ""
    for digits in (4, 8, 12, 16):
        cell = F.substring("_hash", 1, digits)
        counts = hashed.where(F.col("_hash").startswith(prefix)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
        # at most 65,536 cells, whatever the number of rows
        upto = F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("cell"))
        last = counts.withColumn("upto", upto).where(F.col("upto") > wanted).orderBy("cell").first()
        if last is None:
            return df
        below = cell < last["cell"]
        wanted -= last["upto"] - last["rows"]
        prefix = last["cell"]
        if last["rows"] <= FEW:
            break
    edge = hashed.where(F.col("_hash").startswith(prefix)).orderBy("_hash", id_column).limit(wanted)
    return hashed.where(below).unionByName(edge).drop("_hash")
