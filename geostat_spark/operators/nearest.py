"""Functions of the k nearest rows of every place, worked out where the neighbours are found.

``neighbors`` gives the neighbours as rows; where only a few numbers of them are wanted (a distance, a small fit) no
list of neighbours needs to travel. Places go in packets of neighbouring ones (``packets``); joins of a row a packet
and cell decide which cells a packet meets, these cells' rows stream past it, and the task keeps the k nearest of each
place by (distance, id).

The k-th distance is bounded first, from the rows around a place in cell-code order; a cell that holds k rows bounds a
packet by its far corner. Packets hold places whose bounds are equal within a factor of two, in a box of about eight of
them. So what a packet meets is bounded by what its places need, and a place with many rows sends k of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from geostat_spark.operators.grid import Grid, cell_names, cells_of, children, grid_over
from geostat_spark.operators.neighbors import levels_in_use
from geostat_spark.operators.packets import blocks, box_gap, cells_around, contents, in_rounds, scaled_packets, squares, streamed
from geostat_spark.session import cut

# Places whose bound is taken at once, and rows that a packet's places are compared with at once.
TOGETHER, BUFFER = 256, 4_096


def _bounded(grid: Grid, places: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """Places with ``bound``, at least their k-th distance, and ``scale``, how far apart the rows around them lie (no less
    than the bound). Both come from the rows next to a place in code order; one without k of them starts unbounded."""
    dims, axes = list(grid.dims), len(grid.dims)
    rows = places.select(*dims, F.lit(True).alias("_q")).unionByName(held.select(*dims, F.lit(False).alias("_q")))
    rows = cut(rows.withColumn("_code", grid.code())).repartitionByRange("_code", *dims)
    rows = rows.sortWithinPartitions("_code", *dims).select(*dims, "_q")
    whole = grid.side * 2.0 * axes
    names = [*dims, "bound", "scale"]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.column_stack([batch.column(d).to_numpy() for d in dims])
            query = batch.column("_q").to_numpy(zero_copy_only=False)
            asked, target, before = at[query], at[~query], np.cumsum(~query)[query]
            most, scale = np.full(len(asked), whole), np.full(len(asked), whole)
            for a in range(0, len(asked), TOGETHER):
                b = min(a + TOGETHER, len(asked))
                near = target[max(0, before[a] - k) : before[b - 1] + k]
                if len(near) >= k:
                    square = np.sort(squares(asked[a:b], near), axis=1)
                    most[a:b] = np.sqrt(square[:, k - 1])
                    scale[a:b] = np.maximum(most[a:b], np.sqrt(square[:, len(near) // 2]) / 2)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in asked.T.copy()], pa.array(most), pa.array(scale)], names=names)

    return cut(rows.mapInArrow(bound, ", ".join(f"{n} double" for n in names)))


def _furthest(grid: Grid) -> Column:
    """The most by which a row of the cell can be away from a row of the packet's box."""
    h, parts = grid.cell_side(F.col("level")), []
    for o, d, c in zip(grid.origin, grid.dims, cell_names(grid.dims)):
        low = F.lit(o) + F.col(c) * h
        away = F.greatest(F.abs(F.col(f"hi_{d}") - low), F.abs(low + h - F.col(f"lo_{d}")))
        parts.append(away * away)
    return F.sqrt(reduce(lambda a, b: a + b, parts)) + F.lit(grid.slack)


def _cells_to_meet(grid: Grid, packets: DataFrame, held: DataFrame, k: int, crowded: int) -> DataFrame:
    """(packet, level, cell, held): small cells that come within the bound of a packet, crowded ones replaced by their halves."""
    key = ["level", *cell_names(grid.dims)]
    pairs, done = cells_around(grid, packets.withColumn("_reach", F.col("hi_bound")).drop("data"), F.col("hi_bound")), None
    while True:
        counts = cells_of(grid, held.select(*grid.dims), levels_in_use(pairs)).groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
        sized = cut(pairs.join(counts, key))
        tight = sized.groupBy("packet").agg(F.min(F.when(F.col("held") >= k, _furthest(grid))).alias("_far"))
        sized = sized.join(tight, "packet").withColumn("_reach", F.least("_reach", "_far")).drop("_far")
        reach = F.col("_reach") + F.lit(grid.slack)
        sized = cut(sized.where(box_gap(grid, F.col("level")) <= reach * reach))
        split = (F.col("held") > crowded) & (F.col("level") < grid.deepest)
        light = sized.where(~split).select("packet", *key, "held")
        done = light if done is None else done.unionByName(light)
        pairs = sized.where(split).drop("held")
        if pairs.isEmpty():
            return done
        pairs = children(grid, pairs)


class _Nearest:
    """The k nearest rows of each place of a packet among those that have come by."""

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k = asked, k
        self.row, self.dist, self.which = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.rows, self.ids, self.waiting, self.names = None, None, [], []

    def meet(self, rows: np.ndarray, ids: pa.Array) -> None:
        self.waiting.append(rows)
        self.names.append(ids)
        if sum(map(len, self.waiting)) >= BUFFER:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        axes, k, asked = self.asked.shape[1], self.k, self.asked
        new = np.concatenate(self.waiting)
        before = 0 if self.rows is None else len(self.rows)
        rows = new if self.rows is None else np.concatenate([self.rows, new])
        ids = pa.concat_arrays(([] if self.ids is None else [self.ids]) + self.names)
        self.waiting, self.names = [], []
        found = [(self.row, self.dist, self.which)]
        for a in range(0, len(asked), TOGETHER):
            dist = np.sqrt(squares(asked[a : a + TOGETHER], new[:, :axes]))
            if len(new) > k:
                row, which = np.nonzero(dist <= np.partition(dist, k - 1, axis=1)[:, k - 1, None])
            else:
                row, which = (c.ravel() for c in np.indices(dist.shape))
            found.append((row + a, dist[row, which], which + before))
        row, dist, which = (np.concatenate(c) for c in zip(*found))
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank[which], dist, row))
        row, dist, which = row[order], dist[order], which[order]
        first = np.searchsorted(row, np.arange(len(asked)))
        kept = np.arange(len(row)) - first[row] < k
        used, at = np.unique(which[kept], return_inverse=True)
        self.row, self.dist, self.which, self.rows, self.ids = row[kept], dist[kept], at, rows[used], ids.take(pa.array(used))

    def answer(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, k) distances in order and (places, k, columns) of what the neighbours carry."""
        self.settle()
        shape = len(self.asked), self.k
        return self.dist.reshape(shape), self.rows[self.which][:, self.asked.shape[1] :].reshape(*shape, -1)


def nearest(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    dims: Sequence[str],
    work: Callable[[np.ndarray, np.ndarray], Sequence[np.ndarray]],
    names: Sequence[str],
    carry: Sequence[str] = (),
    id_column: str = "id",
    crowded: int = 512,
) -> DataFrame:
    """(coordinates, ``names``) of every distinct place of ``queries``: what ``work`` makes, a column a name, of its k
    nearest rows of ``points`` by (distance, id). ``work`` gets (places, k) distances and (places, k, carried) numbers, a
    missing one as NaN; k is the number of points where there are fewer. Rows without coordinates take no part."""
    dims, carry, names = list(dims), list(carry), list(names)
    places = cut(queries.select(*dims).na.drop().distinct())
    held = points.select(F.col(id_column).alias("id"), *dims, *[F.col(c).cast("double").alias(c) for c in carry]).na.drop(subset=dims)
    own = Window.partitionBy(*dims).orderBy("id", *carry)
    held = cut(held.withColumn("_no", F.row_number().over(own)).where(F.col("_no") <= k).drop("_no"))
    grid = grid_over(places.unionByName(held.select(*dims)), dims)
    k, axes = min(k, held.count()), len(dims)
    out = [*dims, *names]
    schema = ", ".join(f"{n} double" for n in out)
    if not k:
        return places.limit(0).select(*dims, *[F.lit(None).cast("double").alias(n) for n in names])
    packets = scaled_packets(grid, _bounded(grid, places, held, k), [*dims, "bound"], "scale")
    pairs = _cells_to_meet(grid, packets, held, k, crowded)
    key, levels = ["level", *cell_names(dims)], levels_in_use(pairs)
    held = held.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in carry})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def answer() -> pa.RecordBatch:
            made = work(*state.answer())
            return pa.RecordBatch.from_arrays([pa.array(c) for c in [*state.asked.T.copy(), *made]], names=out)

        for kind, doubles, rows in blocks(batches):
            if kind == 0:
                if state is not None:
                    yield answer()
                state = _Nearest(doubles.reshape(-1, axes + 1)[:, :axes].copy(), k)
            else:
                state.meet(doubles.reshape(-1, axes + len(carry)), rows.column("sources").flatten())
        if state is not None:
            yield answer()

    def stream(chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
        near = chosen(pairs)
        raw = cells_of(grid, held, levels).join(near.select(*key).distinct(), key, "left_semi")
        met = near.join(contents(raw, key, [*dims, *carry], "id"), key)
        return streamed(chosen(packets.select("packet", "data")), met.select("packet", F.lit(1).alias("kind"), "data", "sources"), find, schema)

    return in_rounds(packets, pairs.select("packet", (F.col("held") * 8 * (axes + len(carry) + 1)).alias("bytes")), stream)
