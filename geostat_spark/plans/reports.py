"""Result tables assembled from several operators."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from geostat_spark.operators.ensemble import LocalEnsemble, fit_ensemble, model_contributions
from geostat_spark.operators.evaluation import score
from geostat_spark.operators.models import Maker
from geostat_spark.session import release, shuffles_dropped, tables_so_far


def long_section(df: DataFrame, section: str, subject: str) -> DataFrame:
    """Numeric columns of a result table as (section, subject, metric, value) rows."""
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")]
    numbers = [n for n in numbers if n != subject]
    wide = df.select(F.col(subject).alias("subject"), *[F.col(n).cast("double").alias(n) for n in numbers])
    return wide.unpivot(["subject"], numbers, "metric", "value").select(
        F.lit(section).alias("section"), "subject", "metric", "value"
    )


def statistical_report(intervals: DataFrame, comparisons: DataFrame, ablation: DataFrame) -> DataFrame:
    """Cross-validation, pairwise comparisons and ablation in one long table."""
    named = comparisons.withColumn("pair", F.concat("model_1", F.lit(" vs "), "model_2")).drop("model_1", "model_2")
    parts = [
        long_section(intervals, "cross_validation", "model"),
        long_section(named, "comparisons", "pair"),
        long_section(ablation, "ablation", "feature_group"),
    ]
    return reduce(DataFrame.unionByName, parts)


def ensemble_record(
    train: DataFrame, test: DataFrame, makers: dict[str, Maker], k: int = 50, sample: int | None = None
) -> DataFrame:
    """Fit, contributions (over all training rows, or a seeded sample), prediction and scores of the local ensemble as
    one row."""
    start = time.monotonic()
    fitted: LocalEnsemble = fit_ensemble(train, makers, k)
    training = time.monotonic() - start
    since = tables_so_far()
    with shuffles_dropped(train.sparkSession):
        shares = {
            r["model"]: r["mean_weight"]
            for r in model_contributions(train, fitted.weights, fitted.names, k, fitted.dims, sample).collect()
        }
        release(train.sparkSession, since)
        start = time.monotonic()
        result = score(fitted.predict(test), "label", "predicted").first()
        predicting = time.monotonic() - start
        release(train.sparkSession, since)
    columns = {
        "model": "SpatialEnsemble_Full",
        "training_samples": train.count(),
        "test_samples": result["n"],
        "r2": result["r2"],
        "mae": result["mae"],
        "rmse": result["rmse"],
        "training_time_sec": training,
        "prediction_time_sec": predicting,
        **{f"{n}_weight": shares[n] for n in fitted.names},
    }
    return train.sparkSession.createDataFrame([tuple(columns.values())], list(columns))
