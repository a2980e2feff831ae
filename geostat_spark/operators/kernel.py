"""Gaussian kernel sums over all sources with a proven error bound and bounded work per query.

A source further than ``R`` bandwidths away weighs less than exp(-R^2/2); R is chosen from the number of
sources so that all of them together stay below ``tolerance``. Inside that radius a packet of queries visits cells;
crowded ones are replaced by their halves, and a crowded cell no larger than half a bandwidth is
represented by a fixed lattice of nodes that reproduces the kernel to a few 1e-9 (polynomial
interpolation of a smooth function). Both errors are bounded and the bound is returned. So the work of one query depends neither on how many rows share a
place nor on how dense a far-away cell is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geostat_spark.functions.scalar import ratio
from geostat_spark.operators.grid import Grid, cell_names, cells_of, children, grid_over
from geostat_spark.operators.nearest import nearest
from geostat_spark.operators.neighbors import distance, levels_in_use
from geostat_spark.operators.packets import SOURCES, blocks, box_gap, cells_around, contents, in_rounds, packed, scaled_packets, squares, streamed
from geostat_spark.session import cut

NODES = 8
# A node lattice stands in for cells of up to this many bandwidths a side.
WIDEST = 0.5


def lattice_error(axes: int) -> float:
    """The most by which a lattice misses the kernel weight of a unit mass in its cell.

    On one axis, interpolation at m Chebyshev nodes of a cell of side s errs by at most 2 (s / 4)^m / m! times the
    m-th derivative, which for the Gaussian is at most 1.0865 sqrt(m!) / bandwidth^m (Cramer's bound); each further
    axis multiplies by the nodes' Lebesgue constant."""
    one = 2 * 1.0865 * (WIDEST / 4) ** NODES / math.sqrt(math.factorial(NODES))
    spread = 2 / math.pi * math.log(NODES) + 1
    return one * sum(spread**k for k in range(axes))


def adaptive_bandwidth(
    queries: DataFrame, sources: DataFrame, k: int = 50, dims: Sequence[str] = ("x", "y"), id_column: str = "id"
) -> DataFrame:
    """(id, coordinates, bandwidth): the distance at 0-based position min(k, n - 1) of the sorted distances
    to all sources. A query that is a source itself occupies position 0."""
    dims = list(dims)
    bands = nearest(queries, sources, k + 1, dims, lambda dist, _: [dist[:, -1]], ["bandwidth"], id_column=id_column)
    asked = queries.select(F.col(id_column).alias("id"), *dims).na.drop(subset=dims)
    return asked.join(bands, dims).select("id", *dims, "bandwidth")


def radius_factor(n_sources: int, tolerance: float) -> float:
    """Bandwidths beyond which all sources together weigh less than ``tolerance``."""
    return math.sqrt(2.0 * math.log(max(n_sources, 1) / tolerance))


def _packets(grid: Grid, rows: DataFrame, columns: Sequence[str], id_column: str | None = None) -> DataFrame:
    return scaled_packets(grid, rows, columns, "bandwidth", id_column)


def _weights(asked: np.ndarray, held: np.ndarray, axes: int) -> np.ndarray:
    """exp(-(d/b)^2/2) of every query and source; with no bandwidth only coincident sources count, evenly. The columns are
    the coordinates and, for queries, the bandwidth."""
    square, bandwidth = squares(asked[:, :axes], held[:, :axes]), asked[:, axes, None]
    if not (bandwidth > 0).all():  # packets do not mix
        return (square == 0).astype(float)
    if bandwidth.min() > 1e-140:  # the square of a bandwidth is a number
        square *= -0.5 / (bandwidth * bandwidth)
    else:
        square = -0.5 * (np.sqrt(square) / bandwidth) ** 2
    return np.exp(square, out=square)


def _lattice(
    grid: Grid, dense: DataFrame, sources: DataFrame, measures: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Node weights of the listed (by, level, cell) rows: each source spreads its measures over the cell's
    nodes by the interpolation polynomials of its position."""
    cells = cell_names(grid.dims)
    inside = cells_of(grid, sources, levels_in_use(dense)).join(dense, [*by, "level", *cells], "left_semi")
    at = [math.cos((2 * i + 1) * math.pi / (2 * NODES)) for i in range(NODES)]
    side = grid.cell_side(F.col("level"))
    share = F.lit(1.0)
    for o, d, c in zip(grid.origin, grid.dims, cells):
        t = (F.col(d) - (F.lit(o) + F.col(c) * side)) / side * 2 - 1
        basis = []
        for i, s in enumerate(at):
            top = reduce(lambda a, b: a * b, [t - F.lit(q) for j, q in enumerate(at) if j != i])
            basis.append(top / F.lit(math.prod(s - q for j, q in enumerate(at) if j != i)))
        inside = inside.withColumn(f"_b_{d}", F.array(*basis))
    for d in grid.dims:
        inside = inside.select("*", F.posexplode(f"_b_{d}").alias(f"_p_{d}", f"_w_{d}")).drop(f"_b_{d}")
        share = share * F.col(f"_w_{d}")
    nodes = F.array(*[F.lit(s) for s in at])
    lattice = inside.groupBy(*by, "level", *cells, *[f"_p_{d}" for d in grid.dims]).agg(
        *[F.sum(share * F.col(m)).alias(m) for m in measures]
    )
    return lattice.select(
        *by,
        "level",
        *cells,
        *[
            (F.lit(o) + F.col(c) * side + (F.element_at(nodes, F.col(f"_p_{d}") + 1) + 1) / 2 * side).alias(f"t_{d}")
            for o, d, c in zip(grid.origin, grid.dims, cells)
        ],
        *measures,
    )


def _parts_to_meet(packets: DataFrame, places: DataFrame, sizes: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(packet, part): the parts that hold a packet's rows or can be the nearest other part of one of them.

    The mean distance to a part is at least the distance to its centre and at most that plus the part's mean distance
    from its centre, so a part further than another one at its worst is never the nearest."""
    axes, mass = len(dims), F.sum("mass")
    centres = places.groupBy("part").agg(mass.alias("_m"), *[(F.sum(F.col(d) * F.col("mass")) / mass).alias(f"m_{d}") for d in dims])
    away = distance([F.col(d) for d in dims], [F.col(f"m_{d}") for d in dims])
    spread = places.join(centres, "part").groupBy("part").agg((F.sum(away * F.col("mass")) / mass).alias("_spread"))
    known = centres.join(spread, "part").join(sizes, "part").withColumn("_share", F.col("_m") / F.col("n"))
    known = cut(contents(known.withColumn("_deal", F.col("part") % 64), ["grp", "_deal"], [*[f"m_{d}" for d in dims], "_spread", "_share", "part"]))
    met = packets.select("packet", F.col("lo_grp").cast("long").alias("grp")).join(known, "grp")
    met = met.select("packet", F.explode(F.array(F.lit(1), F.lit(2))).alias("kind"), "data")  # once for the bounds, once for the choice

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, worst, packet = None, None, 0
        for kind, doubles, rows in blocks(batches):
            if kind == 0:
                asked, packet = doubles.reshape(-1, axes + 2), rows.column("packet")[0].as_py()
                worst = np.full(len(asked), np.inf)
                continue
            held = doubles.reshape(-1, axes + 3)
            for at in range(0, len(held), SOURCES):
                part = held[at : at + SOURCES]
                centre, own = np.sqrt(squares(asked[:, :axes], part[:, :axes])), asked[:, axes, None] == part[:, axes + 2]
                if kind == 1:
                    worst = np.minimum(worst, np.where(own, np.inf, (centre + part[:, axes]) * part[:, axes + 1]).min(axis=1))
                    continue
                wanted = (own | (centre * part[:, axes + 1] <= worst[:, None] * (1 + 1e-5))).any(axis=0)  # and what lattices err
                numbers = part[wanted, axes + 2].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), packet)), pa.array(numbers)], names=["packet", "part"])

    return cut(streamed(packets.select("packet", "data"), met, choose, "packet long, part long"))


def mean_distances(places: DataFrame, sizes: DataFrame, dims: Sequence[str], crowded: int = 1024) -> DataFrame:
    """(part, coordinates, a, b) of each place: the mean distance to the other rows of its part (null for a part of one
    row), and the least mean distance to another part of its group (null without one).

    ``places``: grp, part (long), coordinates, mass, each place of a part once; ``sizes``: grp, part, n. Crowded cells at
    least their own side away from a packet stand in through their node lattice (relative error below 1e-6); nearer ones
    are halved, small ones are summed directly."""
    dims, cells = list(dims), cell_names(dims)
    places = places.na.drop(subset=dims)
    grid, axes = grid_over(places, dims), len(dims)
    packets = packed(grid, places, [*dims, "part", "grp"], ["grp"], F.col("grp"))
    pairs = _parts_to_meet(packets, places, sizes, dims)
    boxes = packets.select("packet", *[f"{e}_{d}" for e in ("lo", "hi") for d in dims])
    pairs = pairs.join(boxes, "packet").withColumns({"level": F.lit(0), **{c: F.lit(0).cast("long") for c in cells}})
    key, done, lattice_pairs = ["part", "level", *cells], None, None
    while True:
        counts = cells_of(grid, places, levels_in_use(pairs)).groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
        sized = cut(pairs.join(counts, key))
        heavy = (F.col("held") > crowded) & (F.col("level") < grid.deepest)
        side = grid.cell_side(F.col("level"))
        apart = box_gap(grid, F.col("level")) >= side * side
        light, dense = sized.where(~heavy).select("packet", *key), sized.where(heavy & apart).select("packet", *key)
        done = light if done is None else done.unionByName(light)
        lattice_pairs = dense if lattice_pairs is None else lattice_pairs.unionByName(dense)
        pairs = sized.where(heavy & ~apart).drop("held")
        if pairs.isEmpty():
            break
        pairs = children(grid, pairs)
    n = sizes.select("part", "n")
    raw = cells_of(grid, places, levels_in_use(done)).join(done.select(*key).distinct(), key, "left_semi")
    met = done.join(contents(raw.join(n, "part"), key, [*dims, "mass", "n"]), key).select("packet", F.col("part").alias("kind"), "data")
    if not lattice_pairs.isEmpty():
        nodes = _lattice(grid, lattice_pairs.select(*key).distinct(), places, ["mass"], ["part"])
        nodes = contents(nodes.join(n, "part"), key, [*[f"t_{d}" for d in dims], "mass", "n"])
        met = met.unionByName(lattice_pairs.join(nodes, key).select("packet", F.col("part").alias("kind"), "data"))
    names = ["part", *dims, "a", "b"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, inside, others, total, at_part, n = None, None, None, None, 0, 0.0

        def close() -> None:
            own = asked[:, axes] == at_part
            if n > 1:
                inside[own] = total[own] / (n - 1)
            others[~own] = np.minimum(others[~own], total[~own] / n)

        def answer() -> pa.RecordBatch:
            if at_part:
                close()
            means = [pa.array(c, mask=~np.isfinite(c)) for c in (inside, others)]
            return pa.RecordBatch.from_arrays([pa.array(asked[:, axes].astype(np.int64)), *[pa.array(asked[:, i].copy()) for i in range(axes)], *means], names=names)

        for kind, doubles, _ in blocks(batches):
            if kind == 0:
                if asked is not None:
                    yield answer()
                asked, at_part = doubles.reshape(-1, axes + 2), 0
                inside, others = np.full(len(asked), np.nan), np.full(len(asked), np.inf)
                continue
            held = doubles.reshape(-1, axes + 2)
            if kind != at_part:
                if at_part:
                    close()
                at_part, n, total = kind, held[0, axes + 1], np.zeros(len(asked))
            for at in range(0, len(held), SOURCES):
                part = held[at : at + SOURCES]
                total += np.sqrt(squares(asked[:, :axes], part[:, :axes])) @ part[:, axes]
        if asked is not None:
            yield answer()

    return streamed(packets.select("packet", "data"), met, add_up, ", ".join(["part long", *[f"{c} double" for c in names[1:]]]))


def kernel_sums(
    queries: DataFrame,
    sources: DataFrame,
    values: Sequence[str] = (),
    dims: Sequence[str] = ("x", "y"),
    tolerance: float = 1e-12,
    crowded: int = 1024,
) -> DataFrame:
    """For each distinct (coordinates, bandwidth) of ``queries``: ``mass`` = sum of kernel weights over all
    sources and, for each value, ``sum_<value>`` = the weighted sum. Missing values count as 0.

    ``mass_error`` is a proven bound of what ``mass`` misses: the sources beyond the radius, and the interpolation of
    the mass that a lattice stood in for. A weighted sum misses at most that times the largest absolute value."""
    dims, cells = list(dims), cell_names(dims)
    values = list(values)
    places = (
        sources.na.drop(subset=dims)
        .groupBy(*dims)
        .agg(
            F.count(F.lit(1)).cast("double").alias("mass"),
            *[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"sum_{v}") for v in values],
        )
    )
    places = cut(places)
    measures = ["mass", *[f"sum_{v}" for v in values]]
    total = places.agg(F.sum("mass")).first()[0] or 0.0
    asked = cut(queries.select(*dims, "bandwidth").na.drop().distinct())
    grid = grid_over(asked.select(*dims).unionByName(places.select(*dims)), dims)
    packets = _packets(grid, asked, [*dims, "bandwidth"])
    factor = F.lit(radius_factor(int(total), tolerance))
    radius = F.col("hi_bandwidth") * factor
    pairs = cells_around(grid, packets.drop("data"), radius)
    key, done, lattice_pairs = ["level", *cells], None, None
    while True:
        counts = (
            cells_of(grid, places.select(*dims), levels_in_use(pairs)).groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
        )
        sized = cut(pairs.join(counts, key))
        small = grid.cell_side(F.col("level")) <= F.col("lo_bandwidth") * WIDEST
        heavy = (F.col("held") > crowded) & (F.col("level") < grid.deepest)
        light, dense = (sized.where(c).select("packet", *key, "held") for c in (~heavy, heavy & small))
        done = light if done is None else done.unionByName(light)
        lattice_pairs = dense if lattice_pairs is None else lattice_pairs.unionByName(dense)
        pairs = sized.where(heavy & ~small).drop("held")
        if pairs.isEmpty():
            break
        reach = radius + F.lit(grid.slack)
        pairs = children(grid, pairs).where(box_gap(grid, F.col("level")) <= reach * reach)
    axes, width, error = len(dims), len(measures), lattice_error(len(dims))
    names = [*dims, "bandwidth", *measures, "mass_error"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, sums, stood_in = None, None, 0.0

        def answer() -> pa.RecordBatch:
            beyond = np.where(asked[:, axes] > 0, tolerance, 0.0)
            rows = np.column_stack([asked, sums, beyond + stood_in * error])[sums[:, 0] > 0]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], names=names)

        for kind, doubles, _ in blocks(batches):
            if kind == 0:
                if asked is not None:
                    yield answer()
                asked, stood_in = doubles.reshape(-1, axes + 1), 0.0
                sums = np.zeros((len(asked), width))
                continue
            held = doubles.reshape(-1, axes + width)
            for at in range(0, len(held), SOURCES):
                part = held[at : at + SOURCES]
                sums += _weights(asked, part, axes) @ part[:, axes:]
            if kind == 2:
                stood_in += held[:, axes].sum()
        if asked is not None:
            yield answer()

    levels, some_dense = levels_in_use(done), not lattice_pairs.isEmpty()

    def stream(chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
        near = chosen(done)
        raw = cells_of(grid, places, levels).join(near.select(*key).distinct(), key, "left_semi")
        met = near.join(contents(raw, key, [*dims, *measures]), key).select("packet", F.lit(1).alias("kind"), "data")
        if some_dense:
            far = chosen(lattice_pairs)
            nodes = _lattice(grid, far.select(*key).distinct(), places, measures)
            nodes = contents(nodes, key, [*[f"t_{d}" for d in dims], *measures])
            met = met.unionByName(far.join(nodes, key).select("packet", F.lit(2).alias("kind"), "data"))
        return streamed(chosen(packets.select("packet", "data")), met, add_up, ", ".join(f"{n} double" for n in names))

    a_row = 8 * (axes + width)
    sent = done.select("packet", (F.col("held") * a_row).alias("bytes"))
    sent = sent.unionByName(lattice_pairs.select("packet", F.lit(a_row * NODES**axes).cast("long").alias("bytes")))
    return in_rounds(packets, sent, stream)


def kernel_average(
    queries: DataFrame,
    sources: DataFrame,
    values: Sequence[str],
    dims: Sequence[str] = ("x", "y"),
    tolerance: float = 1e-12,
    crowded: int = 1024,
) -> DataFrame:
    """``queries`` (with a ``bandwidth`` column) plus ``avg_<value>``, the kernel-weighted mean over all
    sources with weights that sum to 1 per query, and ``error_<value>``, a proven bound of what it is off by."""
    sums = kernel_sums(queries, sources, values, dims, tolerance, crowded)
    largest = sources.agg(F.struct(*[F.coalesce(F.max(F.abs(v)), F.lit(0.0)).cast("double").alias(v) for v in values])).scalar()
    sums = sums.withColumn("_largest", largest)
    average = {v: ratio(F.col(f"sum_{v}"), F.col("mass")) for v in values}
    sure = F.greatest(F.col("mass") - F.col("mass_error"), F.lit(0.0))
    means = sums.select(
        *dims,
        "bandwidth",
        *[a.alias(f"avg_{v}") for v, a in average.items()],
        *[ratio(F.col("mass_error") * (F.col(f"_largest.{v}") + F.abs(a)), sure).alias(f"error_{v}") for v, a in average.items()],
    )
    return queries.join(means, [*dims, "bandwidth"], "left")


def kernel_weights(
    queries: DataFrame,
    sources: DataFrame,
    minimum: float = 1e-6,
    dims: Sequence[str] = ("x", "y"),
    tolerance: float = 1e-12,
    crowded: int = 1024,
) -> DataFrame:
    """The row-normalised weights themselves as (id, source, weight), for every pair whose weight is at
    least ``minimum``. A weight is kernel / mass and the mass is known before the pairs are formed, so
    the radius that holds all such pairs is exact."""
    dims, cells = list(dims), cell_names(dims)
    sums = kernel_sums(queries, sources, (), dims, tolerance, crowded)
    asked = queries.select("id", *dims, "bandwidth").join(sums, [*dims, "bandwidth"])
    furthest = F.sqrt(F.greatest(F.lit(0.0), F.lit(-2.0) * F.log(F.lit(float(minimum)) * F.col("mass"))))
    asked = cut(
        asked.where(F.col("mass") * F.lit(float(minimum)) <= 1).select("id", *dims, "bandwidth", "mass", (F.col("bandwidth") * furthest).alias("radius"))
    )
    held = cut(sources.select(F.col("id").alias("source"), *dims).na.drop(subset=dims))
    grid = grid_over(asked.select(*dims).unionByName(held.select(*dims)), dims)
    packets = _packets(grid, asked, [*dims, "bandwidth", "mass", "radius"], "id")
    radius, key = F.col("hi_radius"), ["level", *cells]
    pairs, done = cells_around(grid, packets.drop("data", "ids"), radius), None
    while True:
        counts = cells_of(grid, held.select(*dims), levels_in_use(pairs)).groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
        sized = cut(pairs.join(counts, key))
        heavy = (F.col("held") > crowded) & (F.col("level") < grid.deepest)
        light = sized.where(~heavy).select("packet", *key)
        done = light if done is None else done.unionByName(light)
        pairs = sized.where(heavy).drop("held")
        if pairs.isEmpty():
            break
        reach = radius + F.lit(grid.slack)
        pairs = children(grid, pairs).where(box_gap(grid, F.col("level")) <= reach * reach)
    raw = cells_of(grid, held, levels_in_use(done)).join(done.select(*key).distinct(), key, "left_semi")
    met = done.join(contents(raw, key, dims, "source"), key).select("packet", F.lit(1).alias("kind"), "data", "sources")
    axes, least = len(dims), float(minimum)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids = None, None
        for kind, doubles, rows in blocks(batches):
            if kind == 0:
                asked, ids = doubles.reshape(-1, axes + 3), rows.column("ids").flatten()
                continue
            held, names = doubles.reshape(-1, axes), rows.column("sources").flatten()
            for at in range(0, len(held), SOURCES):
                weight = _weights(asked, held[at : at + SOURCES], axes) / asked[:, axes + 1, None]
                query, source = np.nonzero(weight >= least)
                if len(query):
                    columns = [ids.take(pa.array(query)), names.take(pa.array(source + at)), pa.array(weight[query, source])]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "source", "weight"])

    kinds = dict(asked.dtypes)["id"], dict(held.dtypes)["source"]
    return streamed(packets.select("packet", "data", "ids"), met, pick, f"id {kinds[0]}, source {kinds[1]}, weight double")


def fixed_bandwidth(queries: DataFrame, bandwidth: float) -> DataFrame:
    return queries.withColumn("bandwidth", F.lit(float(bandwidth)))
