"""Model tables, regressors, cross-validation and ablation on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from geostat_spark.functions.scalar import ratio
from geostat_spark.operators.evaluation import score
from geostat_spark.operators.features import category_levels, one_hot
from geostat_spark.operators.ordering import quantiles
from geostat_spark.operators.splits import with_folds
from geostat_spark.session import cut

# The model's inputs and the groups removed by the ablation.
NUMERIC_FEATURES = [
    "capacity_mw", "latitude", "longitude", "plant_age", "log_capacity_mw", "regional_renewable_share",
]
CATEGORICAL_FEATURES = ["primary_fuel", "continent"]
TARGET = "capacity_factor"
ABLATION_GROUPS = {
    "Spatial": ["latitude", "longitude"],
    "Capacity": ["capacity_mw", "log_capacity_mw"],
    "Temporal": ["plant_age", "commissioning_year"],
    "Regional": ["regional_renewable_share"],
    "Fuel_Type": ["primary_fuel_*"],
    "Continent": ["continent_*"],
}
SEED = 42


def model_table(
    df: DataFrame,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
    target: str = TARGET,
    id_column: str = "site_id",
) -> tuple[DataFrame, list[str]]:
    """Complete rows with numeric and one-hot features, and the feature names in model order."""
    rows = df.select(id_column, *numeric, *categorical, target).na.drop(
        subset=[*numeric, *categorical, target]
    )
    names = list(numeric)
    for c in categorical:
        levels = category_levels(rows, c)
        rows = one_hot(rows, c, levels)
        names += [f"{c}_{v}" for v in levels]
    return rows, names


def assembled(table: DataFrame, names: Sequence[str], target: str = TARGET, keep: Sequence[str] = ("site_id",)) -> DataFrame:
    """keep..., label, features."""
    vector = VectorAssembler(inputCols=list(names), outputCol="features")
    return vector.transform(table).select(*keep, F.col(target).cast("double").alias("label"), "features")


# ---- regressors


def random_forest(trees: int = 100, depth: int = 15, min_leaf: int = 5, seed: int = SEED) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="all",
        seed=seed, maxMemoryInMB=1024, cacheNodeIds=True,
    )


def boosted_trees(rounds: int = 100, depth: int = 6, rate: float = 0.1, rows: float = 0.8, columns: float = 0.8, seed: int = SEED) -> GBTRegressor:
    return GBTRegressor(
        maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=rows,
        featureSubsetStrategy=str(columns), seed=seed, maxMemoryInMB=1024,
    )


def gradient_boosting(rounds: int = 100, depth: int = 3, rate: float = 0.1, seed: int = SEED) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, maxMemoryInMB=1024)


def least_squares() -> LinearRegression:
    return LinearRegression(regParam=0.0, solver="normal")


def ridge(train: DataFrame, alpha: float = 1.0) -> LinearRegression:
    """Ridge with penalty alpha on the squared coefficients. The solver divides its loss by the rows and
    its penalty by the label's deviation, so both go into the strength."""
    n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    return LinearRegression(
        regParam=alpha * (sd or 0.0) / max(n, 1), elasticNetParam=0.0, standardization=False, solver="normal"
    )


Maker = Callable[[DataFrame], Estimator]


def base_learners(trees: int = 100, forest_depth: int = 15, rounds: int = 100) -> dict[str, Maker]:
    """The three members of the local ensemble; each maker sees the training rows."""
    return {
        "rf": lambda train: random_forest(trees, forest_depth, min_leaf=1),
        "gb": lambda train: gradient_boosting(rounds),
        "ridge": lambda train: ridge(train),
    }


# ---- fits

ROWS_A_FILE = 200_000  # rows in a file of a training table
SPLIT = "8m"  # less than two such files' cost of opening: a task reads two of them at most


def training_table(rows: DataFrame) -> DataFrame:
    """``cut`` into files of a bounded number of rows, for ``small_splits`` to read."""
    return cut(rows, rows_a_file=ROWS_A_FILE)


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Fits that start here read a training table by few files a task. The trees keep some 700 bytes a row in memory,
    in partitions of the scan, so one task holds the same however large the table is."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, SPLIT)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fitted(maker: Maker, train: DataFrame) -> Model:
    with small_splits(train.sparkSession):
        return maker(train).fit(train)


# ---- evaluation


def predict(models: dict[str, Model], rows: DataFrame) -> DataFrame:
    """One ``p_<name>`` column per model; narrow transformations only."""
    for name, model in models.items():
        rows = model.transform(rows).withColumnRenamed("prediction", f"p_{name}")
    return rows


def long_predictions(rows: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("predicted")) for n in names])
    return rows.select(*keep, "label", F.explode(pairs).alias("m")).select(*keep, "label", "m.model", "m.predicted")


def model_comparison(models: dict[str, Model], test: DataFrame) -> DataFrame:
    """mae, rmse, r2 per model on the same rows, best first; one pass for all models."""
    return score(long_predictions(predict(models, test), list(models)), "label", "predicted", ["model"]).orderBy(
        F.desc("r2"), "model"
    )


def constant_baselines(train: DataFrame, test: DataFrame, target: str = "label") -> DataFrame:
    """Scores of predicting the training mean and the training median everywhere."""
    mean = train.agg(F.avg(target)).scalar()
    median = quantiles(train.select(target), target, {"m": 0.5}).scalar()
    both = test.select(
        F.col(target).alias("label"),
        F.explode(
            F.array(
                F.struct(F.lit("Mean Baseline").alias("model"), mean.alias("predicted")),
                F.struct(F.lit("Median Baseline").alias("model"), median.alias("predicted")),
            )
        ).alias("m"),
    ).select("label", "m.model", "m.predicted")
    return score(both, "label", "predicted", ["model"])


def naive_baselines(train: DataFrame, test: DataFrame) -> DataFrame:
    """Mean, median and least squares on (label, features) rows."""
    regression = fitted(lambda t: least_squares(), train).transform(test).withColumn("model", F.lit("Linear Regression"))
    linear = score(regression.withColumnRenamed("prediction", "predicted"), "label", "predicted", ["model"])
    return constant_baselines(train, test).unionByName(linear)


AT_ONCE = 4  # fits that run side by side


def _folds(rows: DataFrame, folds: int, shuffle: bool, id_column: str) -> DataFrame:
    return training_table(with_folds(rows, id_column, folds, shuffle))


def _side_by_side(fits: Sequence[Callable[[], DataFrame]], at_once: int = AT_ONCE) -> list[DataFrame]:
    """The results in order; up to ``at_once`` fits run side by side, so that the short jobs of one fill the gaps that
    another leaves on the cluster. More fits wait: what they hold in memory does not grow with their number."""
    spark = SparkSession.active()
    with small_splits(spark), ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(fit)) for fit in fits]]


def out_of_fold(
    rows: DataFrame, makers: dict[str, Maker], folds: int = 10, shuffle: bool = True, id_column: str = "site_id"
) -> DataFrame:
    """(model, fold, id, label, predicted): what each model, fitted without a row's fold, predicts for the row. One table
    for every score, test and report that follows."""
    parts = _folds(rows, folds, shuffle, id_column)

    def fit(fold: int, name: str, maker: Maker) -> DataFrame:
        train, held = parts.where(F.col("fold") != fold), parts.where(F.col("fold") == fold)
        predicted = maker(train).fit(train).transform(held)
        return predicted.select(F.lit(name).alias("model"), "fold", id_column, "label", F.col("prediction").alias("predicted"))

    fits = [lambda f=fold, n=name, m=maker: fit(f, n, m) for fold in range(1, folds + 1) for name, maker in makers.items()]
    return cut(reduce(DataFrame.unionByName, _side_by_side(fits)))


def cross_validate(
    rows: DataFrame, makers: dict[str, Maker], folds: int = 10, shuffle: bool = True, id_column: str = "site_id"
) -> DataFrame:
    """Fold scores (model, fold, n, mae, rmse, r2). Each model is fitted once per fold and all metrics come
    from the same predictions."""
    return score(out_of_fold(rows, makers, folds, shuffle, id_column), "label", "predicted", ["model", "fold"])


def group_members(names: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Features matched by exact name or by ``prefix_*``."""
    return [
        n for n in names if any(n.startswith(p[:-1]) if p.endswith("*") else n == p for p in patterns)
    ]


def ablation(
    table: DataFrame,
    names: Sequence[str],
    maker: Maker,
    target: str = TARGET,
    folds: int = 5,
    groups: dict[str, list[str]] | None = None,
    id_column: str = "site_id",
) -> DataFrame:
    """Loss of contiguous-fold r2 when a feature group is left out; groups without a feature are skipped."""
    groups = ABLATION_GROUPS if groups is None else groups
    parts = cut(with_folds(table, id_column, folds, shuffle=False))

    def mean_r2(kept: Sequence[str], label: str) -> DataFrame:
        rows = training_table(assembled(parts, kept, target, keep=["fold"]))

        def fit(fold: int) -> DataFrame:
            train, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
            return maker(train).fit(train).transform(held).select("fold", "label", F.col("prediction").alias("predicted"))

        scored = _side_by_side([lambda f=fold: fit(f) for fold in range(1, folds + 1)])
        per_fold = score(reduce(DataFrame.unionByName, scored), "label", "predicted", ["fold"])
        return per_fold.agg(F.avg("r2").alias("ablated_r2")).withColumn("feature_group", F.lit(label))

    out = []
    for name, patterns in groups.items():
        gone = group_members(names, patterns)
        if gone:
            kept = [n for n in names if n not in gone]
            out.append(mean_r2(kept, name).withColumn("n_features", F.lit(len(gone))))
    baseline = mean_r2(names, "all").first()["ablated_r2"]
    base = F.lit(float(baseline))
    drop = base - F.col("ablated_r2")
    return (
        reduce(DataFrame.unionByName, out)
        .select(
            "feature_group",
            "n_features",
            base.alias("baseline_r2"),
            "ablated_r2",
            drop.alias("r2_drop"),
            F.when(base > 0, ratio(drop, base) * 100).otherwise(0.0).alias("relative_importance_pct"),
        )
        .orderBy(F.desc("r2_drop"), "feature_group")
    )


def importances(model: Model, names: Sequence[str], top: int | None = None) -> DataFrame:
    """Impurity importances by feature name, largest first: one row per feature, or the ``top`` ones."""
    values = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    spark = SparkSession.active()
    ranked = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return ranked if top is None else ranked.limit(top)
