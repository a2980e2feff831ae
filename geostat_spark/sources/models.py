"""Saving, loading and reusing fitted models and the split they were trained on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from geostat_spark.sources.tables import path_exists, write_table


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """Load whatever regressor was saved at ``path``; its class is recorded in the model's metadata."""
    metadata = DefaultParamsReader.loadMetadata(path, spark)
    name = metadata["class"].rsplit(".", 1)[1]
    import pyspark.ml.regression as regression

    return getattr(regression, name).load(path)


def load_or_fit(spark: SparkSession, path: str, fit: Callable[[], Model]) -> Model:
    """The saved model if there is one, otherwise the newly fitted and saved one."""
    if path_exists(spark, f"{path}/metadata"):
        return load_model(spark, path)
    model = fit()
    save_model(model, path)
    return model


def load_or_split(spark: SparkSession, path: str, split: Callable[[], DataFrame]) -> DataFrame:
    """The stored assignment of rows to parts, made once, so that a reused model is scored on rows it has
    not seen."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        write_table(split(), path)
    return spark.read.parquet(path)
