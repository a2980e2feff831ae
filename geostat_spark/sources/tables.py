"""Readers and writers for site tables and small result tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from geostat_spark.functions.scalar import nan_to_null

CURRENT = "CURRENT"  # names the folder that holds the rows in use

# The text columns of a raw site file; numbers are read as text and coerced by cleaning.
SITE_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "country", "country_long", "capacity_mw", "latitude", "longitude", "primary_fuel",
            "commissioning_year", "estimated_generation_gwh_2013", "estimated_generation_gwh_2014",
            "estimated_generation_gwh_2015", "estimated_generation_gwh_2016", "estimated_generation_gwh_2017",
        )
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV. With a schema nothing is inferred; without one Spark infers, at the cost of a second
    read of the file."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_sites_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw site file by column name: columns the file lacks are left out, others are kept as text."""
    names = spark.read.option("header", True).csv(path).columns
    return read_csv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with NaN read as missing in every floating-point column."""
    df = spark.read.parquet(path)
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert(table: DataFrame, rows: DataFrame, key: str, order_by: str) -> DataFrame:
    """Replace the rows of ``table`` that share a key with ``rows``, add the new ones, largest first."""
    kept = table.join(rows.select(key), key, "left_anti")
    return kept.unionByName(rows).orderBy(F.desc(order_by), key)


def upsert_file(
    spark: SparkSession, current: str, rows: DataFrame, key: str, order_by: str, target: str
) -> DataFrame:
    """Upsert into the result table stored at ``current`` and write the outcome to ``target``, which must
    be another folder: a table is never overwritten while it is being read. ``current`` that does not
    exist yet counts as empty."""
    if current == target:
        raise ValueError("target must differ from current")
    out = upsert(spark.read.parquet(current), rows, key, order_by) if path_exists(spark, current) else rows
    write_table(out, target)
    return spark.read.parquet(target)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``replace_current`` last put at ``path``."""
    return spark.read.parquet(f"{path}/{_current(spark, path)}")


def replace_current(df: DataFrame, path: str) -> DataFrame:
    """Make ``df`` the table at ``path``, also where ``df`` was read from there.

    The rows are written to a folder of their own beside the table in use; then one small file that names the folder in
    use is replaced by a rename, which is atomic. A reader sees the old table or the new one, whole; a run that is
    lost before the rename leaves the old one. The folder in use before stays for readers that have begun, older ones
    are deleted."""
    spark = df.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    root = hadoop.Path(path)
    files = root.getFileSystem(conf)
    before = _current(spark, path) if path_exists(spark, f"{path}/{CURRENT}") else None
    name = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    _put(spark, f"{path}/{CURRENT}", name)
    for status in files.listStatus(root):
        found = status.getPath().getName()
        if found.startswith("rows-") and found not in (name, before):
            files.delete(status.getPath(), True)
    return read_current(spark, path)


def upsert_current(spark: SparkSession, path: str, rows: DataFrame, key: str, order_by: str) -> DataFrame:
    """``upsert`` into the table at ``path`` in place (see ``replace_current``); one that is not there yet is empty."""
    there = path_exists(spark, f"{path}/{CURRENT}")
    return replace_current(upsert(read_current(spark, path), rows, key, order_by) if there else rows, path)


def _current(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}/{CURRENT}").first()[0]


def _put(spark: SparkSession, path: str, line: str) -> None:
    """Replace a file of one line at once: written beside, then renamed over it."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target, beside = hadoop.Path(path), hadoop.Path(f"{path}-{uuid.uuid4().hex}")
    stream = target.getFileSystem(conf).create(beside, True)
    stream.write(bytearray(line.encode()))
    stream.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, over)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file exists on the file system the path names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
