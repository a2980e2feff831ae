"""Locally weighted ensemble: each site mixes the base models by the weights that fit its neighbourhood."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F

from geostat_spark.functions.scalar import ratio
from geostat_spark.operators.clean import sample_rows
from geostat_spark.operators.evaluation import score
from geostat_spark.operators.kernel import adaptive_bandwidth, fixed_bandwidth, kernel_average
from geostat_spark.operators.models import Maker, fitted, long_predictions, predict, training_table
from geostat_spark.operators.nearest import nearest
from geostat_spark.session import cut, cut_and_release, shuffles_dropped, tables_so_far

# Fixed value: keeps the normalisation of an all-zero solution defined.
EPSILON = 1e-10
NEIGHBOURS = 50


def nonnegative_solutions(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """argmin of x'Gx - 2c'x over x >= 0 for many small problems at once: the best feasible solution over
    the non-empty supports, zero if none is feasible. gram is (n, m, m), moment (n, m)."""
    n, m = moment.shape
    best, best_loss = np.zeros((n, m)), np.zeros(n)
    for size in range(1, m + 1):
        for support in combinations(range(m), size):
            s = list(support)
            g, c = gram[:, s][:, :, s], moment[:, s]
            x = (np.linalg.pinv(g, rcond=1e-12, hermitian=True) @ c[..., None])[..., 0]
            loss = np.einsum("ni,nij,nj->n", x, g, x) - 2 * np.einsum("ni,ni->n", c, x)
            better = (x >= 0).all(axis=1) & (loss < best_loss)
            best[better] = 0.0
            best[np.ix_(better, s)] = x[better]
            best_loss[better] = loss[better]
    return best


def _local_solver(m: int, k: int, bandwidth: float | None) -> Callable[[np.ndarray, np.ndarray], list[np.ndarray]]:
    """Distances and carried (predictions..., target) of the k + 1 nearest rows to the m weights that fit the first k."""

    def solve(dist: np.ndarray, carried: np.ndarray) -> list[np.ndarray]:
        band = dist[:, -1:] if bandwidth is None else np.full((len(dist), 1), float(bandwidth))
        dist, carried = dist[:, :k], carried[:, :k]
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(band > 0, np.exp(-0.5 * (dist / band) * (dist / band)), dist == 0)
        gram, moment = np.zeros((len(dist), m, m)), np.zeros((len(dist), m))
        for at in range(dist.shape[1]):  # in the order of the neighbours
            row, scaled = carried[:, at], weight[:, at, None] * carried[:, at, :m]
            gram += scaled[:, :, None] * row[:, None, :m]
            moment += scaled * row[:, m:]
        upper = np.triu(gram)
        x = nonnegative_solutions(upper + np.triu(gram, 1).transpose(0, 2, 1), moment)
        return list((x / (x.sum(axis=1, keepdims=True) + EPSILON)).T.copy())

    return solve


def local_weights(
    train: DataFrame,
    names: Sequence[str],
    k: int = NEIGHBOURS,
    dims: Sequence[str] = ("latitude", "longitude"),
    target: str = "label",
    bandwidth: float | None = None,
    sites: DataFrame | None = None,
) -> DataFrame:
    """(id, coordinates, w_<name>...): weights of the base predictions ``p_<name>`` that best explain the
    target over the k nearest training rows, the site itself included.

    They are solved once a place, in the task that finds its neighbours, so no neighbour list is written. ``sites``
    restricts which rows are solved."""
    dims, asked = list(dims), train if sites is None else sites
    weights = [f"w_{n}" for n in names]
    solve = _local_solver(len(names), k, bandwidth)
    solved = nearest(asked, train, k + 1, dims, solve, weights, [*[f"p_{n}" for n in names], target])
    return asked.select("id", *dims).na.drop(subset=dims).join(solved, dims).select("id", *dims, *weights)


def _normalised(df: DataFrame, names: Sequence[str], prefix: str, out: str) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(f"{prefix}{n}") for n in names]) + F.lit(EPSILON)
    return df.withColumns({f"{out}{n}": F.col(f"{prefix}{n}") / total for n in names})


def interpolated_weights(
    train: DataFrame,
    names: Sequence[str],
    max_solve_rows: int,
    k: int = NEIGHBOURS,
    dims: Sequence[str] = ("latitude", "longitude"),
    target: str = "label",
    seed: int = 42,
) -> DataFrame:
    """Solve a seeded sample of ``max_solve_rows`` sites and give every other site the kernel average of the
    solved weights, at the bandwidth it has among all training rows."""
    train = cut(train)
    solved = cut(local_weights(train, names, k, dims, target, sites=sample_rows(train, "id", max_solve_rows, seed)))
    others = train.join(solved.select("id"), "id", "left_anti")
    band = adaptive_bandwidth(others, train, k, dims)
    weights = [f"w_{n}" for n in names]
    averaged = kernel_average(band, solved, weights, dims)
    rest = _normalised(averaged, names, "avg_w_", "w_").select("id", *dims, *weights)
    return solved.select("id", *dims, *weights).unionByName(rest)


def location_weights(
    places: DataFrame,
    weights: DataFrame,
    names: Sequence[str],
    k: int = NEIGHBOURS,
    dims: Sequence[str] = ("latitude", "longitude"),
    bandwidth: float | None = None,
    tolerance: float = 1e-12,
) -> DataFrame:
    """(id, coordinates, bandwidth, avg_w_<name>...): the kernel average, at each place, of the weight
    vectors of all training sites."""
    asked = places.select("id", *dims)
    band = fixed_bandwidth(asked, bandwidth) if bandwidth is not None else cut(adaptive_bandwidth(asked, weights, k, dims))
    return kernel_average(band, weights, [f"w_{n}" for n in names], dims, tolerance)


def mixed_prediction(
    test: DataFrame,
    weights: DataFrame,
    names: Sequence[str],
    k: int = NEIGHBOURS,
    dims: Sequence[str] = ("latitude", "longitude"),
    bandwidth: float | None = None,
) -> DataFrame:
    """``test`` plus ``predicted``: its base predictions mixed by the renormalised weights of its place, and
    ``predicted_error``: a proven bound of what the kernel sums can have moved it by (null where the sums are too small
    to tell)."""
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    local = _normalised(location_weights(test, weights, names, k, dims, bandwidth), names, "avg_w_", "m_")
    off, whole = add([F.col(f"error_w_{n}") for n in names]), add([F.col(f"avg_w_{n}") for n in names])
    sure = F.greatest(whole - off, F.lit(0.0))
    moved = {f"e_{n}": ratio(F.col(f"error_w_{n}") + F.col(f"m_{n}") * off, sure) for n in names}
    held = [f"m_{n}" for n in names] + list(moved)
    return (
        test.join(local.withColumns(moved).select("id", *held), "id")
        .withColumn("predicted", add([F.col(f"p_{n}") * F.col(f"m_{n}") for n in names]))
        .withColumn("predicted_error", add([F.abs(f"p_{n}") * F.col(f"e_{n}") for n in names]))
        .drop(*held)
    )


def model_contributions(
    places: DataFrame,
    weights: DataFrame,
    names: Sequence[str],
    k: int = NEIGHBOURS,
    dims: Sequence[str] = ("latitude", "longitude"),
    sample: int | None = None,
) -> DataFrame:
    """Mean kernel-averaged weight of each base model over the places (or a seeded sample of them)."""
    chosen = places if sample is None else sample_rows(places, "id", sample)
    local = location_weights(chosen, weights, names, k, dims)
    means = local.agg(*[F.avg(f"avg_w_{n}").alias(n) for n in names])
    return means.unpivot([], list(names), "model", "mean_weight")


def uniform_mix(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(f"p_{n}") for n in names])
    return rows.withColumn("predicted", total / F.lit(float(len(names))))


@dataclass
class LocalEnsemble:
    """Fitted base models and the weight vectors of the training sites."""

    models: dict[str, Model]
    weights: DataFrame
    k: int
    dims: tuple[str, ...]
    bandwidth: float | None = None

    @property
    def names(self) -> list[str]:
        return list(self.models)

    def predict(self, rows: DataFrame) -> DataFrame:
        return mixed_prediction(predict(self.models, rows), self.weights, self.names, self.k, self.dims, self.bandwidth)


def fit_ensemble(
    train: DataFrame,
    makers: dict[str, Maker],
    k: int = NEIGHBOURS,
    dims: Sequence[str] = ("latitude", "longitude"),
    bandwidth: float | None = None,
    max_solve_rows: int | None = None,
) -> LocalEnsemble:
    """Fit the base models on (id, coordinates, label, features) rows, predict the same rows, and solve the
    local weights. In-sample predictions favour whichever model overfits; that is the method as defined."""
    train = training_table(train)
    models = {name: fitted(maker, train) for name, maker in makers.items()}
    scored, since = predict(models, train).select("id", *dims, "label", *[f"p_{n}" for n in models]), tables_so_far()
    with shuffles_dropped(train.sparkSession):
        if max_solve_rows is not None:
            weights = interpolated_weights(scored, list(models), max_solve_rows, k, dims)
        else:
            weights = local_weights(scored, list(models), k, dims, bandwidth=bandwidth)
        weights = cut_and_release(weights, since)
    return LocalEnsemble(models, weights, k, tuple(dims), bandwidth)


def evaluate_ensemble(ensemble: LocalEnsemble, test: DataFrame) -> DataFrame:
    """Scores of each base model, their plain mean and the local mix on the same rows."""
    base = cut(predict(ensemble.models, test).select("id", *ensemble.dims, "label", *[f"p_{n}" for n in ensemble.names]))
    since = tables_so_far()
    uniform = uniform_mix(base, ensemble.names).select("label", F.lit("UniformEnsemble").alias("model"), "predicted")
    with shuffles_dropped(test.sparkSession):
        local = mixed_prediction(base, ensemble.weights, ensemble.names, ensemble.k, ensemble.dims, ensemble.bandwidth)
        local = cut_and_release(local.select("label", F.lit("SpatialEnsemble").alias("model"), "predicted"), since)
    rows = long_predictions(base, ensemble.names).unionByName(uniform).unionByName(local)
    return score(rows, "label", "predicted", ["model"])
