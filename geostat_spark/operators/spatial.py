"""Spatial autocorrelation on k-nearest-neighbour weights (row-standardised: each neighbour 1/k)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.functions.permutation import drawn, grid_sides, permuted, sources
from geostat_spark.functions.scalar import ratio
from geostat_spark.operators.attach import attach
from geostat_spark.operators.clean import keep_top_categories
from geostat_spark.operators.components import component_count
from geostat_spark.operators.grid import grid_over
from geostat_spark.operators.hypothesis import normal_p
from geostat_spark.operators.neighbors import edges, knn, neighbours
from geostat_spark.operators.ordering import hash_position, with_row_number
from geostat_spark.session import cut, shuffle_width, shuffles_dropped

# Bytes of permuted values that may lie in shuffle files at a time, about 24 a value; and permutations of a round at least.
ROUND_BYTES, ROUND_LEAST = 8 << 30, 16
# Values that a task puts together at a time: blocks and areas have more sites where a round has fewer permutations.
GRID = 1 << 20
# Values of up to this part of ROUND_BYTES (13 million of them) are sent to every task; areas have so many sites then.
SHIPPED, AREA = 80, 1 << 14


def knn_weights(points: DataFrame, k: int = 8, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    """Edges (src, dst, w) whose weights sum to 1 per source."""
    found = neighbours(points, k, dims)
    return edges(found).join(
        found.select(F.col("id").alias("src"), (1.0 / F.size("near")).alias("w")), "src"
    ).select("src", "dst", "w")


def graph_components(points: DataFrame, k: int = 8, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    return component_count(points.select("id"), knn(points, k, dims))


def centred(points: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``z`` = value - mean (of the row's ``by`` group); rows without a value are dropped."""
    rows = points.where(F.col(value).isNotNull())
    if by:
        means = rows.groupBy(*by).agg(F.avg(value).alias("_mean"))
        return attach(rows, means, list(by), "inner").withColumn("z", F.col(value) - F.col("_mean")).drop("_mean")
    return rows.withColumn("z", F.col(value) - rows.agg(F.avg(value)).scalar())


def lag_of(near: Column, name: str = "z") -> Column:
    """Mean of a carried column over a neighbour array."""
    total = F.aggregate(near, F.lit(0.0), lambda s, e: s + e[name])
    return ratio(total, F.size(near))


def spatial_lag(
    points: DataFrame, value: str, k: int = 8, dims: Sequence[str] = ("x", "y"), by: Sequence[str] = ()
) -> DataFrame:
    """id, ``by``, z (centred value) and lag (mean z of the k nearest). The neighbours carry their z, so
    the lag is a row expression."""
    found = neighbours(centred(points, value, by), k, dims, carry=["z"], by=by)
    return found.select("id", *by, "z", lag_of(F.col("near")).alias("lag"))


def _moran() -> Column:
    return ratio(F.sum(F.col("z") * F.col("lag")), F.sum(F.col("z") * F.col("z")))


def morans_i(points: DataFrame, value: str, k: int = 8, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    return spatial_lag(points, value, k, dims).agg(_moran().alias("moran_i"), F.count(F.lit(1)).alias("n"))


def morans_i_normal(points: DataFrame, value: str, k: int = 8, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    """I with its expectation, variance, z and p under normality."""
    found = cut(neighbours(centred(points, value), k, dims, carry=["z"]))
    stat = found.select("z", lag_of(F.col("near")).alias("lag")).agg(
        F.struct(_moran().alias("i"), F.count(F.lit(1)).cast("double").alias("n")).alias("s")
    )
    links = edges(found).select("src", "dst").join(
        found.select(F.col("id").alias("src"), (1.0 / F.size("near")).alias("w")), "src"
    )
    # sum over unordered pairs of (w_ij + w_ji)^2
    s1 = (
        links.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.sum("w").alias("w"))
        .agg(F.sum(F.col("w") * F.col("w")).alias("s1"))
    )
    into = links.groupBy("dst").agg(F.sum("w").alias("w"))
    # every row sums to 1; rows nobody points to contribute (1 + 0)^2
    s2 = into.agg((F.sum((1 + F.col("w")) * (1 + F.col("w")) - 1)).alias("s2"))
    n, e = F.col("s.n"), F.col("expected_i")
    return (
        stat.withColumn("s1", s1.scalar())
        .withColumn("s2", s2.scalar() + n)
        .withColumn("expected_i", -1.0 / (n - 1))
        .withColumn("variance", (n * n * F.col("s1") - n * F.col("s2") + 3 * n * n) / ((n * n - 1) * n * n) - e * e)
        .withColumn("z_score", ratio(F.col("s.i") - e, F.sqrt("variance")))
        .select(F.col("s.i").alias("moran_i"), "expected_i", "variance", "z_score", normal_p("z_score").alias("p_value"))
    )


def _numbered(
    points: DataFrame, value: str, k: int, dims: Sequence[str], seed: int, by: str | None = None
) -> tuple[DataFrame, dict[int, tuple[object, int]]]:
    """(found, groups): neighbours with z, the number ``g`` of the row's group and a dense 0-based ``idx`` in a seeded
    order within it, written out; groups: {g: (name, rows)}, one for each value of ``by``."""
    rows = centred(points.na.drop(subset=list(dims)), value, [by] if by else ()).drop("g", "idx")
    if by:
        rows = rows.where(F.col(by).isNotNull())
        counted = [(r[0], r[1]) for r in rows.groupBy(by).count().orderBy(by).collect()]
        names = points.sparkSession.createDataFrame(
            [(v, g, sum(n for _, n in counted[:g])) for g, (v, _) in enumerate(counted)], f"{by} {dict(rows.dtypes)[by]}, g int, _before long"
        )
        rows = rows.join(F.broadcast(names), by)  # a row a group, and the caller names the groups
    else:
        counted = [(None, rows.count())]
        rows = rows.withColumns({"g": F.lit(0), "_before": F.lit(0).cast("long")})
    order = F.shiftleft(F.col("g").cast("long"), 56) + F.shiftright(hash_position("id", seed), 4)
    rows = with_row_number(rows, order, "id", "_row").withColumn("idx", F.col("_row") - 1 - F.col("_before"))
    return cut(neighbours(rows, k, dims, carry=["z", "idx"], by=["g"])), dict(enumerate(counted))


def _permuted_values(found: DataFrame, groups: dict, numbers: range, seed: int) -> DataFrame:
    """(g, idx, values): the values that the permutations ``numbers`` put at each place, in an array by permutation.

    Permutation p sends the value of row i to the p-th keyed image of i, which is computed for i alone. Values travel
    once, packed by block of places, and each block is put together in a task of its own."""
    sizes = {g: n for g, (_, n) in groups.items()}
    permutations = len(numbers)
    width = max(1, GRID // permutations)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.array(numbers, np.int64)
        together = max(1, GRID // 2 // permutations)
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                part = batch.slice(at, together)
                group, idx, z = (part.column(c).to_numpy(zero_copy_only=False) for c in ("g", "idx", "z"))
                for g in np.unique(group):
                    own = group == g
                    rows = int(own.sum())
                    to = permuted(idx[own][:, None], sizes[int(g)], seed, number).ravel()
                    block = to // width
                    order = np.argsort(block.astype(np.uint16) if sizes[int(g)] // width < 1 << 16 else block, kind="stable")
                    to, what, which = to[order], np.repeat(z[own], permutations)[order], np.tile(number - numbers.start, rows)[order]
                    edge = np.concatenate(([0], np.flatnonzero(np.diff(to // width)) + 1, [len(to)]))
                    cells = (to % width * permutations + which).astype(np.int32)
                    spans = list(zip(edge[:-1], edge[1:]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(g)] * len(spans), pa.int32()),
                            pa.array([int(to[a]) // width for a, _ in spans], pa.int64()),
                            pa.array([cells[a:b].tobytes() for a, b in spans], pa.binary()),
                            pa.array([what[a:b].tobytes() for a, b in spans], pa.binary()),
                        ],
                        names=["g", "block", "cells", "sent"],
                    )

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, grid = None, None

        def answer() -> pa.RecordBatch:
            n = min(width, sizes[key[0]] - key[1] * width)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, key[0], np.int32)),
                    pa.array(key[1] * width + np.arange(n, dtype=np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * permutations, permutations, dtype=np.int32)), pa.array(grid[: n * permutations])),
                ],
                names=["g", "idx", "values"],
            )

        for batch in batches:
            for g, block, cells, sent in zip(*[batch.column(c).to_pylist() for c in ("g", "block", "cells", "sent")]):
                if key != (g, block):
                    if key is not None:
                        yield answer()
                    key, grid = (g, block), np.full(width * permutations, np.nan)
                grid[np.frombuffer(cells, np.int32)] = np.frombuffer(sent, np.float64)
        if key is not None:
            yield answer()

    packed = found.select("g", "idx", "z").mapInArrow(send, "g int, block long, cells binary, sent binary")
    sorted_ = packed.repartition("g", "block").sortWithinPartitions("g", "block")
    return sorted_.mapInArrow(receive, "g int, idx long, values array<double>")


def _all_values(found: DataFrame, starts: np.ndarray, rows: int) -> np.ndarray:
    """The values of all groups, one after the other, each in the order of ``idx``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, idx, z = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "idx", "z"))
            columns = [(starts[g] + idx).astype(np.uint32), z.astype(np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["places", "z"])

    out = np.zeros(rows)
    for row in found.select("g", "idx", "z").mapInArrow(send, "places binary, z binary").toLocalIterator():
        out[np.frombuffer(row["places"], np.uint32)] = np.frombuffer(row["z"], np.float64)
    return out


def _shipped_cross(
    found: DataFrame, groups: dict, dims: Sequence[str], ks: Sequence[int], permutations: int, seed: int
) -> DataFrame:
    """``_permuted_cross`` where all values together are small: each task has them whole, and looks up, permutation by
    permutation, what lies at the sites of its areas and at their neighbours. No permuted value crosses the network."""
    sizes = [n for _, n in groups.values()]
    starts, rows, ks = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64), sum(sizes), [int(k) for k in ks]
    spark, area = found.sparkSession, max(256, min(AREA, rows // 64))
    placed = _areas(found, dims, area)
    areas = -(-rows // area)
    placed = placed.repartition(min(areas, max(shuffle_width(found), areas // 4)), "g", "area")
    values = spark.sparkContext.broadcast(_all_values(found, starts, rows))

    def sums(key: tuple, sites: pa.Table) -> pa.Table:
        g = key[0].as_py()
        n, own = sizes[g], sites.column("idx").to_numpy()
        z = values.value[starts[g] : starts[g] + n]
        near = sites.column("others").combine_chunks()
        count = pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        links, first = near.flatten().to_numpy(), np.cumsum(count) - count
        places, at = np.unique(np.concatenate([own, links]), return_inverse=True)
        own, at = at[: len(own)], at[len(own) :]
        none = len(places)  # a place of value 0 for neighbours that a site lacks
        steps = []
        for j in range(max(ks)):
            to, more = np.full(len(own), none), count > j
            to[more] = at[first[more] + j]
            steps.append((to, np.maximum(np.minimum(count, j + 1), 1).astype(float)))
        left, right = np.divmod(places, grid_sides(n)[1])
        held, total = np.zeros(none + 1), np.zeros((len(ks), permutations))
        step, upto = np.empty(len(own)), np.empty(len(own))
        for p in range(permutations):
            np.take(z, sources(left, right, n, seed, p), out=held[:none], mode="clip")
            here = held[own]
            upto[:] = 0.0
            for j, (to, shared) in enumerate(steps):
                upto += np.take(held, to, out=step, mode="clip")
                for row in (row for row, k in enumerate(ks) if k == j + 1):
                    total[row, p] = (here * upto / shared).sum()
        kept = [np.full(total.size, g, np.int32), np.repeat(np.array(ks, np.int32), permutations), np.tile(np.arange(permutations, dtype=np.int32), len(ks)), total.ravel()]
        return pa.table([pa.array(c) for c in kept], names=["g", "k", "perm", "part"])

    parts = placed.groupBy("g", "area").applyInArrow(sums, "g int, k int, perm int, part double")
    out = cut(parts.groupBy("g", "k", "perm").agg(F.sum("part").alias("cross")))
    values.destroy()
    return out


def _areas(found: DataFrame, dims: Sequence[str], area: int) -> DataFrame:
    """(g, idx, others, area), written out: sites with their neighbours' places, dealt to areas of neighbouring sites."""
    grid = grid_over(found, dims)
    code = F.shiftleft(F.shiftright(grid.code(), 12), 12) + F.pmod(F.xxhash64("id"), F.lit(4_096))  # copies are spread
    others = F.transform("near", lambda e: e["idx"]).alias("others")
    placed = with_row_number(found.select("id", "g", "idx", others, *dims), code, "id", "_place")
    return cut(placed.select("g", "idx", "others", F.expr(f"(_place - 1) div {area}").alias("area")))


def _permuted_cross(
    found: DataFrame, groups: dict, dims: Sequence[str], ks: Sequence[int], permutations: int, seed: int
) -> DataFrame:
    """(g, k, perm, cross): the sum of value times mean of the k nearest values, for each permutation of the values.

    Values that fill no more than a ``SHIPPED``-th of ``ROUND_BYTES`` go to every task whole. Otherwise:

    Sites are dealt to areas of neighbouring sites; an area fetches the arrays of its sites and of their neighbours once
    each and sums them as matrices. No site's array goes to more areas than it has neighbours in. Permutations take
    rounds whose values fill ``ROUND_BYTES`` of shuffle files, which go before the next round begins."""
    rows = sum(n for _, n in groups.values())
    if 0 < 8 * rows * SHIPPED <= ROUND_BYTES:
        return _shipped_cross(found, groups, dims, ks, permutations, seed)
    held_by = 24 * max(1, rows)
    of_round = min(permutations, max(ROUND_LEAST, ROUND_BYTES // held_by))
    placed = _areas(found, dims, max(1, GRID // 4 // of_round))
    wanted = cut(placed.select("g", "area", F.explode(F.concat(F.array("idx"), "others")).alias("idx")).distinct())
    ks = [int(k) for k in ks]

    def one_round(numbers: range) -> DataFrame:
        fetched = _permuted_values(found, groups, numbers, seed).join(wanted, ["g", "idx"])
        fetched = fetched.select(F.col("g").alias("_g"), F.col("area").alias("_area"), "idx", "values")

        def sums(key: tuple, sites: pa.Table, values: pa.Table) -> pa.Table:
            held = values.column("idx").to_numpy()
            order = np.argsort(held)
            matrix = values.column("values").combine_chunks().flatten().to_numpy().reshape(len(held), len(numbers))
            find = lambda idx: order[np.searchsorted(held, idx, sorter=order)]
            near = sites.column("others").combine_chunks()
            count = pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first, at = np.cumsum(count) - count, find(near.flatten().to_numpy())
            own = matrix[find(sites.column("idx").to_numpy())]
            upto, total = np.zeros_like(own), np.zeros((len(ks), len(numbers)))
            some = count > 0
            for j in range(max(ks)):
                more = np.flatnonzero(count > j)
                upto[more] += matrix[at[first[more] + j]]
                for row in (row for row, k in enumerate(ks) if k == j + 1):
                    total[row] = (own[some] * upto[some] / np.minimum(count[some], j + 1)[:, None]).sum(axis=0)
            g = pa.array(np.full(total.size, key[0].as_py(), np.int32))
            perm = pa.array(np.tile(np.array(numbers, np.int32), len(ks)))
            return pa.table([g, pa.array(np.repeat(np.array(ks, np.int32), len(numbers))), perm, pa.array(total.ravel())], names=["g", "k", "perm", "part"])

        parts = placed.groupBy("g", "area").cogroup(fetched.groupBy("_g", "_area")).applyInArrow(sums, "g int, k int, perm int, part double")
        return cut(parts.groupBy("g", "k", "perm").agg(F.sum("part").alias("cross")))

    with shuffles_dropped(found.sparkSession):
        rounds = [one_round(range(p, min(p + of_round, permutations))) for p in range(0, permutations, of_round)]
    return reduce(DataFrame.unionByName, rounds)


def _permutation_tests(
    points: DataFrame, value: str, ks: Sequence[int], dims: Sequence[str], permutations: int, seed: int, by: str | None = None
) -> DataFrame:
    """([by,] k, n, moran_i, p_value, z_score) for each group and neighbourhood size."""
    found, groups = _numbered(points, value, max(ks), dims, seed, by)
    sizes = F.explode(F.array(*[F.lit(int(v)) for v in ks]))
    lags = found.withColumn("k", sizes).select("g", "k", "z", lag_of(F.slice("near", F.lit(1), F.col("k"))).alias("lag"))
    observed = lags.groupBy("g", "k").agg(
        _moran().alias("moran_i"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.count(F.lit(1)).alias("n")
    )
    observed = cut(observed)
    sims = _permuted_cross(found, groups, dims, ks, permutations, seed).join(F.broadcast(observed), ["g", "k"])  # groups x sizes rows
    i = ratio(F.col("cross"), F.col("zz"))
    larger = F.count_if(i >= F.col("moran_i"))
    tested = sims.groupBy("g", "k").agg(
        F.when(F.count(i) == permutations, (F.least(larger, F.lit(permutations) - larger) + 1) / F.lit(permutations + 1.0)).alias("p_value"),
        ratio(F.first("moran_i") - F.avg(i), F.stddev_pop(i)).alias("z_score"),
    )
    out = observed.join(tested, ["g", "k"], "left")
    if by:
        kind = dict(points.dtypes)[by]
        names = points.sparkSession.createDataFrame([(g, name) for g, (name, _) in groups.items()], f"g int, {by} {kind}")
        out = out.join(F.broadcast(names), "g")
    return out.select(*([by] if by else []), "k", "n", "moran_i", "p_value", "z_score")


def morans_i_permutation(
    points: DataFrame,
    value: str,
    k: int = 8,
    dims: Sequence[str] = ("x", "y"),
    permutations: int = 999,
    seed: int = 42,
) -> DataFrame:
    """I with its pseudo p (1 + the smaller tail) / (permutations + 1) and z against the permutations; both NULL
    where all values are equal."""
    return _permutation_tests(points, value, [k], dims, permutations, seed).select("moran_i", "p_value", "z_score")


def moran_scatter(points: DataFrame, value: str, k: int = 8, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    """(id, z, lag): the scatter whose slope is I. z is scaled to unit population deviation."""
    rows = spatial_lag(points, value, k, dims)
    sd = rows.agg(F.sqrt(F.avg(F.col("z") * F.col("z")))).scalar()
    return rows.withColumn("_s", sd).select("id", ratio(F.col("z"), F.col("_s")).alias("z"), ratio(F.col("lag"), F.col("_s")).alias("lag"))


def local_moran(points: DataFrame, value: str, k: int = 8, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    """Local I and quadrant: 1 high-high, 2 low-high, 3 low-low, 4 high-low."""
    rows = cut(spatial_lag(points, value, k, dims))
    s = rows.agg(F.struct(F.sum(F.col("z") * F.col("z")).alias("zz"), (F.count(F.lit(1)) - 1).alias("m")).alias("s")).scalar()
    return rows.withColumn("s", s).select("id", "z", "lag", _local_i().alias("local_i"), quadrant().alias("lisa_cluster"))


def _local_i() -> Column:
    return ratio(F.col("s.m") * F.col("z") * F.col("lag"), F.col("s.zz"))


def quadrant() -> Column:
    high, near_high = F.col("z") > 0, F.col("lag") > 0
    return (
        F.when(high & near_high, 1).when(~high & near_high, 2).when(~high & ~near_high, 3).otherwise(4).cast("int")
    )


def local_moran_significance(
    points: DataFrame,
    value: str,
    k: int = 8,
    dims: Sequence[str] = ("x", "y"),
    permutations: int = 999,
    seed: int = 42,
    alpha: float = 0.05,
) -> DataFrame:
    """Local I, quadrant and conditional-permutation p: a site keeps its value while its neighbours are
    drawn from all other sites, without replacement, by keyed hashes. The draws are shared by all sites, as
    positions among the others, so the only thing shipped to the tasks is 2 * permutations * k values, whatever
    the table's size."""
    found, _ = _numbered(points, value, k, dims, seed)
    rows = found.select("id", "idx", "z", F.size("near").alias("k"), lag_of(F.col("near")).alias("lag"))
    n, sum_zz = rows.agg(F.count(F.lit(1)), F.sum(F.col("z") * F.col("z"))).first()
    draws = drawn(n - 1, min(k, n - 1), seed, permutations)
    wanted = np.unique(np.concatenate([draws.ravel(), draws.ravel() + 1]))
    spark = points.sparkSession
    keys = spark.createDataFrame(pd.DataFrame({"idx": wanted}))
    got = found.select("idx", "z").join(F.broadcast(keys), "idx").collect()
    value_at = {r["idx"]: r["z"] for r in got}
    low = np.array([[value_at[j] for j in d] for d in draws])
    high = np.array([[value_at[j + 1] for j in d] for d in draws])
    shipped = spark.sparkContext.broadcast((draws, low, high))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, lo, hi = shipped.value
        for pdf in batches:
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start : start + 256]
                idx = part["idx"].to_numpy()[:, None, None]
                lag = np.where(pos[None] >= idx, hi[None], lo[None]).mean(axis=2)
                z = part["z"].to_numpy()[:, None]
                larger = (z * lag >= z * part["lag"].to_numpy()[:, None]).sum(axis=1)
                yield part.assign(tail=np.minimum(larger, len(pos) - larger))[["id", "z", "lag", "tail"]]

    id_type = dict(rows.dtypes)["id"]
    scored = rows.mapInPandas(tails, f"id {id_type}, z double, lag double, tail long")
    p = (F.col("tail") + 1) / F.lit(permutations + 1.0)
    s = F.struct(F.lit(float(sum_zz)).alias("zz"), F.lit(n - 1).alias("m"))
    return scored.withColumn("s", s).select(
        "id",
        _local_i().alias("local_i"),
        quadrant().alias("lisa_cluster"),
        p.alias("lisa_pvalue"),
        (p < alpha).cast("int").alias("lisa_significant"),
    )


def significance_breakdown(lisa: DataFrame) -> DataFrame:
    """Significant sites and their share, per quadrant."""
    rows = lisa.agg(F.count(F.lit(1))).scalar()
    return (
        lisa.groupBy("lisa_cluster")
        .agg(F.count(F.lit(1)).alias("sites"), F.sum("lisa_significant").alias("significant"))
        .withColumn("significant_pct", F.lit(100.0) * F.col("significant") / rows)
    )


def morans_i_by_category(
    points: DataFrame,
    value: str,
    category: str,
    top: int = 6,
    more_than: int = 50,
    k: int = 8,
    dims: Sequence[str] = ("x", "y"),
    permutations: int = 999,
    seed: int = 42,
) -> DataFrame:
    """I, permutation p and z inside each of the most frequent categories with more than ``more_than`` rows,
    neighbours and permutations taken within the category; all categories in the same jobs."""
    rows = keep_top_categories(points, category, top)
    tests = _permutation_tests(rows, value, [k], dims, permutations, seed, category)
    return tests.where(F.col("n") > more_than).select(category, "moran_i", "n", "p_value", "z_score")


def morans_i_by_k(
    points: DataFrame,
    value: str,
    ks: Sequence[int] = (4, 8, 12, 16, 20),
    dims: Sequence[str] = ("x", "y"),
    permutations: int = 999,
    seed: int = 42,
) -> DataFrame:
    """I, permutation p and z for several neighbourhood sizes, from one search at the largest and one set of
    permuted values."""
    return _permutation_tests(points, value, ks, dims, permutations, seed).select("k", "moran_i", "p_value", "z_score")
