"""Solvers, Shapley values, resampling and permutation inference against direct computations."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from geostat_spark.functions import permutation
from geostat_spark.operators import ensemble, evaluation, models, resampling, shap, spatial
from geostat_spark.sources import models as stored, tables

rng = np.random.default_rng(5)


def table(spark, n=200):
    x = rng.normal(0, 1, (n, 4))
    y = x[:, 0] ** 2 + x[:, 1] + 0.1 * rng.normal(0, 1, n)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(n), label=y)
    df = spark.createDataFrame(pdf)
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df), x, y


def test_nonnegative_solutions_meet_the_optimality_conditions():
    a, b = rng.normal(0, 1, (300, 20, 3)), rng.normal(0, 1, (300, 20))
    gram, moment = np.einsum("nki,nkj->nij", a, a), np.einsum("nki,nk->ni", a, b)
    x = ensemble.nonnegative_solutions(gram, moment)
    slope = np.einsum("nij,nj->ni", gram, x) - moment
    assert (x >= 0).all() and (slope > -1e-8).all() and np.abs(slope * x).max() < 1e-8
    zero = ensemble.nonnegative_solutions(np.zeros((1, 3, 3)), np.zeros((1, 3)))
    assert (zero == 0).all()
    same = np.ones((1, 2, 2))
    assert ensemble.nonnegative_solutions(same, np.ones((1, 2))).sum() == pytest.approx(1.0)


def test_local_weights_equal_direct_solution(spark):
    n, k = 120, 15
    xy, p = rng.normal(0, 1, (n, 2)), rng.random((n, 3))
    y = p @ np.array([0.2, 0.5, 0.3]) + 0.05 * rng.normal(0, 1, n)
    pdf = pd.DataFrame(xy, columns=["latitude", "longitude"]).assign(id=np.arange(n), label=y)
    for i in range(3):
        pdf[f"p_{i}"] = p[:, i]
    names = ["0", "1", "2"]
    got = ensemble.local_weights(spark.createDataFrame(pdf), names, k).toPandas().sort_values("id")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    for i in range(n):
        order = np.lexsort((np.arange(n), d[i]))
        w = np.exp(-0.5 * (d[i, order[:k]] / d[i, order[k]]) ** 2)
        a = p[order[:k]] * np.sqrt(w)[:, None]
        b = y[order[:k]] * np.sqrt(w)
        x = ensemble.nonnegative_solutions((a.T @ a)[None], (a.T @ b)[None])[0]
        assert got.iloc[i][[f"w_{m}" for m in names]].to_numpy(float) == pytest.approx(x / x.sum(), abs=1e-6)


def test_perfect_base_model_takes_all_weight(spark):
    n = 60
    pdf = pd.DataFrame({"id": np.arange(n), "latitude": rng.random(n), "longitude": rng.random(n), "label": rng.random(n) + 1})
    pdf["p_good"], pdf["p_bad"] = pdf["label"], rng.random(n)
    got = ensemble.local_weights(spark.createDataFrame(pdf), ["good", "bad"], 10)
    assert got.agg(F.min("w_good")).first()[0] > 0.999


def tree_value(node, x, known):
    """Expected tree output when only ``known`` features are seen."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    f = node.split().featureIndex()
    left, right = node.leftChild(), node.rightChild()
    if f in known:
        return tree_value(left if x[f] <= node.split().threshold() else right, x, known)
    a, b = left.impurityStats().count(), right.impurityStats().count()
    return (a * tree_value(left, x, known) + b * tree_value(right, x, known)) / (a + b)


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_shap_equals_subset_enumeration(spark, kind):
    df, x, _ = table(spark)
    maker = models.boosted_trees(rounds=3, depth=3, columns=1.0) if kind == "boosted" else models.random_forest(3, 3)
    model = maker.fit(df)
    got = {r["id"]: r for r in shap.shap_values(model, df, list("abcd"), "id").collect()}
    weights = list(model.treeWeights) if kind == "boosted" else [1 / 3] * 3
    predictions = {r["id"]: r["prediction"] for r in model.transform(df).select("id", "prediction").collect()}
    for i in range(0, 200, 40):
        want = np.zeros(4)
        for tree, w in zip(model.trees, weights):
            root = tree._java_obj.rootNode()
            for f in range(4):
                for size in range(4):
                    for s in itertools.combinations([g for g in range(4) if g != f], size):
                        share = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                        want[f] += w * share * (tree_value(root, x[i], {*s, f}) - tree_value(root, x[i], set(s)))
        assert got[i]["shap"] == pytest.approx(want, abs=1e-9)
    for i in range(200):
        assert got[i]["prediction"] == pytest.approx(predictions[i], abs=1e-9)


def test_ridge_equals_closed_form(spark):
    df, x, y = table(spark)
    model = models.ridge(df, alpha=3.0).fit(df)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(4), xc.T @ yc)
    assert model.coefficients.toArray() == pytest.approx(want, abs=1e-8)


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.0)], "a double, p double")
    s = evaluation.score(df, "a", "p").first()
    assert (s.mae, s.rmse, s.r2) == (pytest.approx(0.5), pytest.approx(math.sqrt(1.25 / 3)), pytest.approx(1 - 1.25 / 2))
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "a double, p double")
    assert evaluation.score(flat, "a", "p").first().r2 == 1.0


def test_cross_validation_and_ablation(spark):
    df, _, _ = table(spark)
    scores = models.cross_validate(df, {"linear": lambda t: models.least_squares()}, folds=4, id_column="id")
    assert sorted((r.fold, r.n) for r in scores.collect()) == [(1, 50), (2, 50), (3, 50), (4, 50)]
    groups = {"Useful": ["b"], "Noise": ["c", "d"], "Absent": ["zz_*"]}
    out = models.ablation(df.drop("features"), list("abcd"), lambda t: models.least_squares(), "label", 3, groups, "id").collect()
    assert [r.feature_group for r in out] == ["Useful", "Noise"] and out[0].r2_drop > 0.1 and out[1].n_features == 2


def test_fits_read_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_A_FILE", 50)
    df, _, _ = table(spark, 1_000)
    before, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []

    def maker(train):
        seen.append(max(train.groupBy(F.spark_partition_id()).count().toPandas()["count"]))
        return models.least_squares()

    rows = df.select("id", "label", "features").coalesce(1)
    models.cross_validate(rows, {"m": maker}, folds=2, id_column="id")
    models.fitted(maker, models.training_table(rows))
    assert len(seen) == 3 and max(seen) <= 100
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_models_and_split_are_reused(spark, tmp_path):
    df, _, _ = table(spark)
    calls = []

    def fit():
        calls.append(1)
        return models.random_forest(2, 2).fit(df)

    first = stored.load_or_fit(spark, f"{tmp_path}/m", fit)
    again = stored.load_or_fit(spark, f"{tmp_path}/m", fit)
    assert len(calls) == 1
    a, b = (m.transform(df).agg(F.sum("prediction")).first()[0] for m in (first, again))
    assert a == pytest.approx(b)
    for _ in range(2):
        part = stored.load_or_split(spark, f"{tmp_path}/s", lambda: df.select("id"))
    assert part.count() == 200


def test_result_file_upsert(spark, tmp_path):
    rows = spark.createDataFrame([("m", 0.5)], "model string, r2 double")
    one = tables.upsert_file(spark, f"{tmp_path}/a", rows, "model", "r2", f"{tmp_path}/b")
    two = tables.upsert_file(spark, f"{tmp_path}/b", spark.createDataFrame([("n", 0.9)], "model string, r2 double"), "model", "r2", f"{tmp_path}/c")
    assert one.count() == 1 and [r.model for r in two.orderBy(F.desc("r2")).collect()] == ["n", "m"]


@pytest.mark.parametrize("method", [resampling.bootstrap_draws, resampling.bootstrap_weights])
def test_bootstrap_interval_covers_the_estimate(spark, method):
    n = 400
    a = rng.normal(5, 1, n)
    p = a + rng.normal(0, 0.5, n)
    df = spark.createDataFrame(pd.DataFrame({"site_id": np.arange(n), "a": a, "p": p}))
    got = {r.metric: r for r in method(df, "a", "p", replicates=400).collect()}
    e = a - p
    want = {"mae": np.abs(e).mean(), "rmse": math.sqrt((e**2).mean()), "r2": 1 - (e**2).sum() / ((a - a.mean()) ** 2).sum()}
    spread = np.abs(e).std() / math.sqrt(n)
    assert got["mae"].std == pytest.approx(spread, rel=0.2)
    for m, v in want.items():
        assert got[m].ci_lower < v < got[m].ci_upper and got[m].mean == pytest.approx(v, rel=0.02)


def test_block_draws_are_one_multinomial():
    """Blocks, each on its own, agree on n draws a replicate; counts have the mean and spread of single draws."""
    n = 3 * resampling.BLOCK + 100
    counts = np.concatenate([resampling.block_draws(b, n, 400, 7) for b in range(4)], axis=1)
    assert counts.shape == (400, n) and (counts.sum(axis=1) == n).all()
    assert counts.mean(axis=0).std() == pytest.approx(1 / 20, rel=0.15) and counts.var() == pytest.approx(1, rel=0.02)
    blocks = [counts[:, a : a + 512].sum(axis=1).var() for a in (0, 512, 1024)]
    assert blocks == pytest.approx([512 * (1 - 512 / n)] * 3, rel=0.25)


def test_normal_quantiles_of_normal_values(spark):
    from statistics import NormalDist

    x = [NormalDist(3, 2).inv_cdf((i + 0.5) / 500) for i in range(500)]
    fit = resampling.normal_fit(resampling.normal_quantiles(spark.createDataFrame([(v,) for v in x], "v double"), "v")).first()
    assert (fit.slope, fit.intercept) == (pytest.approx(2.0, abs=0.02), pytest.approx(3.0, abs=1e-6)) and fit.r > 0.999


def lattice(spark, value):
    rows = [(i * 5 + j, float(i), float(j), float(value(i, j))) for i in range(5) for j in range(5)]
    return spark.createDataFrame(rows, "id long, x double, y double, value double")


def test_moran_signs(spark):
    assert spatial.morans_i(lattice(spark, lambda i, j: i), "value", 4).first().moran_i > 0.3
    assert spatial.morans_i(lattice(spark, lambda i, j: (i + j) % 2), "value", 4).first().moran_i < -0.3


def test_permutations_are_permutations():
    for n in (1, 2, 5, 64, 100, 1000):
        out = permutation.permuted(np.arange(n), n, 42, 3)
        assert sorted(out) == list(range(n))
    a, b = (permutation.permuted(np.arange(1000), 1000, 42, p) for p in (0, 1))
    assert (a == b).mean() < 0.02 and abs(np.corrcoef(a, b)[0, 1]) < 0.1


def test_draws_are_sets_without_favourites():
    draws = permutation.drawn(10, 3, 42, 12_000)
    assert all(len(set(d)) == 3 for d in draws.tolist())
    seen = np.unique(np.sort(draws, axis=1), axis=0, return_counts=True)[1]
    assert len(seen) == 120 and seen.min() > 50 and seen.max() < 160


def direct_tests(xy, v, ks, permutations):
    n, z = len(v), v - v.mean()
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    near = np.array([[j for j in np.lexsort((np.arange(n), d[i])) if j != i] for i in range(n)])
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest()[:14], i))
    out = {}
    for k in ks:
        moran = lambda w: (w * w[near[:, :k]].mean(axis=1)).sum() / (z * z).sum()
        sims = []
        for p in range(permutations):
            w = np.empty(n)
            w[[order[to] for to in permutation.permuted(np.arange(n), n, 42, p)]] = z[order]
            sims.append(moran(w))
        larger = (np.array(sims) >= moran(z)).sum()
        out[k] = (moran(z), (min(larger, permutations - larger) + 1) / (permutations + 1), (moran(z) - np.mean(sims)) / np.std(sims))
    return out


def test_permutation_tests_equal_direct_ones(spark):
    n = 80
    xy = np.vstack([rng.random((n - 6, 2)), np.repeat([[0.5, 0.5]], 6, axis=0)])
    v = xy[:, 0] + 0.3 * rng.random(n)
    pdf = pd.DataFrame({"id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "value": v, "kind": "a"})
    more = pdf.assign(id=pdf["id"] + 1000, x=pdf["x"] + 0.01, kind="b", value=rng.random(n))
    want = direct_tests(xy, v, (4, 6), 99)
    df = spark.createDataFrame(pdf)
    one = spatial.morans_i_permutation(df, "value", 6, permutations=99).first()
    assert tuple(one) == pytest.approx(want[6]) and one.p_value == 0.01 and one.z_score > 4
    both = {r["k"]: r for r in spatial.morans_i_by_k(df, "value", (4, 6), permutations=99).collect()}
    assert all(tuple(both[k])[1:] == pytest.approx(want[k]) for k in (4, 6))
    mixed = spark.createDataFrame(pd.concat([pdf, more]))
    by = {r["kind"]: r for r in spatial.morans_i_by_category(mixed, "value", "kind", k=6, permutations=99).collect()}
    assert (by["a"]["moran_i"], by["a"]["p_value"], by["a"]["z_score"]) == pytest.approx(want[6]) and by["b"]["p_value"] > 0.01
    flat = spatial.morans_i_permutation(spark.createDataFrame(pdf.assign(value=1.0)), "value", 6, permutations=9).first()
    assert flat.p_value is None and flat.z_score is None
    normal = spatial.morans_i_normal(df, "value", 6).first()
    assert normal.z_score == pytest.approx(one.z_score, rel=0.25)


def test_permutations_take_rounds_of_bounded_size(spark, monkeypatch):
    """What lies in shuffle files at a time does not grow with sites times permutations."""
    n, rounds, whole = 70, [], spatial._permuted_values
    xy, v = rng.random((n, 2)), rng.random(n)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "value": v}))
    monkeypatch.setattr(spatial, "ROUND_BYTES", 24 * n * 25)
    monkeypatch.setattr(spatial, "GRID", 400)
    monkeypatch.setattr(spatial, "_permuted_values", lambda f, g, numbers, s: rounds.append(numbers) or whole(f, g, numbers, s))
    got = {r["k"]: tuple(r)[1:] for r in spatial.morans_i_by_k(df, "value", (3, 5), permutations=60).collect()}
    assert [list(r) for r in rounds] == [list(range(25)), list(range(25, 50)), list(range(50, 60))]
    want = direct_tests(xy, v, (3, 5), 60)
    assert all(got[k] == pytest.approx(want[k]) for k in (3, 5))


def test_sources_are_where_a_permutation_takes_its_values_from():
    for n in (1, 2, 5, 64, 1000, 4_999):
        places = permutation.permuted(np.arange(n), n, 42, 3)
        left, right = np.divmod(places, permutation.grid_sides(n)[1])
        assert (permutation.sources(left, right, n, 42, 3) == np.arange(n)).all()


def test_small_tables_of_values_are_not_shuffled_by_permutation(spark, monkeypatch):
    """All values at every task, or permuted values by shuffle: the same sums, and only the second packs values."""
    n, packed, whole = 90, [], spatial._permuted_values
    xy, v = rng.random((n, 2)), rng.random(n)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "value": v}))
    monkeypatch.setattr(spatial, "_permuted_values", lambda *a: packed.append(a) or whole(*a))
    shipped = tuple(spatial.morans_i_permutation(df, "value", 5, permutations=49).first())
    assert not packed
    monkeypatch.setattr(spatial, "SHIPPED", 1 << 40)
    assert tuple(spatial.morans_i_permutation(df, "value", 5, permutations=49).first()) == pytest.approx(shipped, rel=1e-9) and packed


def test_local_significance_matches_direct_draws(spark):
    n = 100
    xy = rng.random((n, 2))
    v = xy[:, 0] * 3 + rng.random(n)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "value": v}))
    got = spatial.local_moran_significance(df, "value", 5, permutations=499).toPandas().sort_values("id")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    z = v - v.mean()
    for i in range(0, n, 9):
        near = np.lexsort((np.arange(n), d[i]))[1:6]
        lag = z[near].mean()
        others = np.delete(z, i)
        sims = np.array([rng.choice(others, 5, replace=False).mean() for _ in range(2000)])
        larger = (z[i] * sims >= z[i] * lag).mean()
        row = got.iloc[i]
        assert row["lisa_pvalue"] == pytest.approx(min(larger, 1 - larger), abs=0.07)
        want = 1 if z[i] > 0 and lag > 0 else 2 if z[i] <= 0 and lag > 0 else 3 if z[i] <= 0 else 4
        assert row["lisa_cluster"] == want
