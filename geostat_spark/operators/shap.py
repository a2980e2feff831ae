"""Path-dependent Shapley values of Spark tree ensembles, as a job over the rows to explain.

For one leaf, a feature on its path either lets the row through (1) or not (0), and when the feature is
unknown the row passes with the share z of training rows that did. The Shapley sum over coalitions of a
leaf's other features equals the integral over t in [0, 1] of prod(z (1 - t) + passed t), a polynomial
that a few Gauss-Legendre points integrate exactly. Leaves, features and rows are then plain arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


@dataclass
class LeafTable:
    """All leaves of an ensemble, padded to the longest path. A padded slot has feature 0, an open
    interval and z = 1, so it multiplies by 1."""

    feature: np.ndarray  # (leaves, slots)
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    used: np.ndarray
    value: np.ndarray  # (leaves,), times the tree's weight
    base: float


def leaf_table(model: Model) -> LeafTable:
    """Read the fitted trees once. The table's size is that of the model, not of any data."""
    leaves: list[tuple[dict[int, tuple[float, float, float]], float]] = []
    base = 0.0
    weights = list(model.treeWeights)
    scale = 1.0 if type(model).__name__.startswith("GBT") else 1.0 / sum(weights)
    for tree, weight in zip(model.trees, weights):
        root = tree._java_obj.rootNode()
        total = float(root.impurityStats().count())
        stack = [(root, total, {})]
        while stack:
            node, cover, path = stack.pop()
            if node.subtreeDepth() == 0:
                v = float(node.prediction()) * weight * scale
                leaves.append((path, v))
                base += v * cover / total
                continue
            split = node.split()
            f, t = int(split.featureIndex()), float(split.threshold())
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in (
                (node.leftChild(), (low, min(high, t))),
                (node.rightChild(), (max(low, t), high)),
            ):
                held = float(child.impurityStats().count())
                stack.append((child, held, {**path, f: (*bounds, share * held / cover)}))
    slots = max(1, max(len(p) for p, _ in leaves))
    shape = (len(leaves), slots)
    table = LeafTable(
        np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape),
        np.zeros(shape, bool), np.array([v for _, v in leaves]), base,
    )
    for i, (path, _) in enumerate(leaves):
        for j, (f, (low, high, share)) in enumerate(sorted(path.items())):
            table.feature[i, j], table.low[i, j], table.high[i, j] = f, low, high
            table.share[i, j], table.used[i, j] = share, True
    return table


def shap_matrix(table: LeafTable, x: np.ndarray) -> np.ndarray:
    """(rows, features) Shapley values; a row's values plus the base sum to its prediction."""
    out = np.zeros(x.shape)
    slots = table.feature.shape[1]
    nodes, weights = np.polynomial.legendre.leggauss(slots // 2 + 1)
    times, weights = (nodes + 1) / 2, weights / 2
    for start in range(0, len(x), 16):
        rows = x[start : start + 16]
        at = rows[:, table.feature]
        passed = ((at > table.low) & (at <= table.high)).astype(float)
        for t, w in zip(times, weights):
            factor = table.share * (1 - t) + passed * t
            # products of all other slots, without dividing by a factor that may be zero
            before = np.cumprod(np.concatenate([np.ones_like(factor[..., :1]), factor[..., :-1]], axis=-1), axis=-1)
            after = np.cumprod(
                np.concatenate([np.ones_like(factor[..., :1]), factor[..., :0:-1]], axis=-1), axis=-1
            )[..., ::-1]
            part = w * table.value[:, None] * (passed - table.share) * before * after
            part[:, ~table.used] = 0.0
            for i in range(len(rows)):
                out[start + i] += np.bincount(
                    table.feature.ravel(), weights=part[i].ravel(), minlength=x.shape[1]
                )
    return out


def shap_values(model: Model, rows: DataFrame, names: Sequence[str], id_column: str = "site_id") -> DataFrame:
    """(id, base, prediction, shap array in feature order). The shipped leaf table is as large as the
    model; rows are explained where they are."""
    table = leaf_table(model)
    shipped = rows.sparkSession.sparkContext.broadcast(table)
    id_type = dict(rows.dtypes)[id_column]

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = shipped.value
        for pdf in batches:
            if len(pdf):
                values = shap_matrix(leaves, np.vstack(pdf["x"].to_numpy()))
                yield pd.DataFrame(
                    {id_column: pdf[id_column], "base": leaves.base, "prediction": leaves.base + values.sum(axis=1),
                     "shap": list(values)}
                )

    flat = rows.select(id_column, vector_to_array("features").alias("x"))
    return flat.mapInPandas(explain, f"{id_column} {id_type}, base double, prediction double, shap array<double>")


def shap_importance(values: DataFrame, names: Sequence[str], top: int | None = None) -> DataFrame:
    """Mean absolute value per feature, largest first: of all features or the ``top`` ones."""
    named = F.array(*[F.lit(n) for n in names])
    ranked = (
        values.select(F.posexplode("shap").alias("pos", "v"))
        .groupBy("pos")
        .agg(F.avg(F.abs("v")).alias("mean_abs_shap"))
        .select(F.element_at(named, F.col("pos") + 1).alias("feature"), "mean_abs_shap")
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )
    return ranked if top is None else ranked.limit(top)
