"""Neighbouring queries in packets, so that a cell of sources is met once by a packet and not once by each query.

Queries are sorted by group and cell code and packed, up to ``PACKET`` rows of one group in a row. Which cells a packet
meets is decided by joins over its bounding box; the contents of these cells then stream past the packet, which
sums them as matrices. A task holds one packet and one batch of sources at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.operators.grid import Grid, cell_names
from geostat_spark.session import cut, shuffles_dropped

PACKET = 1_024
# Sources that travel in one row, and that a packet meets at once.
SOURCES = 128
# Bytes of sources that may lie in shuffle files at a time: packets beyond take further rounds.
ROUND_BYTES = 1 << 29


def packed(
    grid: Grid, rows: DataFrame, columns: Sequence[str], order: Sequence[str] = (), group: Column | None = None, id_column: str | None = None
) -> DataFrame:
    """(packet, lo_<column>..., hi_<column>..., data, [ids]): rows of doubles in packets that are contiguous in (``order``, cell
    code) and have one ``group``, written out. ``data`` holds the columns row by row."""
    columns, held = list(columns), [id_column] if id_column else []
    rows = rows.withColumns({"_code": grid.code(), "_group": F.lit(0).cast("long") if group is None else group})
    by = [*order, "_code", *columns]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("_group", *columns, *held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            changes = np.flatnonzero(np.diff(batch.column("_group").to_numpy())) + 1
            ends = np.concatenate((changes, [len(data)]))
            starts = np.concatenate([np.arange(a, b, PACKET) for a, b in zip(np.concatenate(([0], changes)), ends)])
            low, high = np.minimum.reduceat(data, starts), np.maximum.reduceat(data, starts)
            offsets = np.concatenate((starts, [len(data)])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets * len(columns)), pa.array(data.ravel()))]
            lists += [pa.ListArray.from_arrays(pa.array(offsets), batch.column(c)) for c in held]
            yield pa.RecordBatch.from_arrays([*map(pa.array, low.T.copy()), *map(pa.array, high.T.copy()), *lists], names=names)

    names = [*[f"lo_{c}" for c in columns], *[f"hi_{c}" for c in columns], "data", *["ids" for _ in held]]
    kinds = [*["double"] * (2 * len(columns)), "array<double>", *[f"array<{dict(rows.dtypes)[c]}>" for c in held]]
    out = rows.mapInArrow(pack, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return cut(out.withColumn("packet", F.monotonically_increasing_id()))


def scaled_packets(grid: Grid, rows: DataFrame, columns: Sequence[str], scale: str, id_column: str | None = None) -> DataFrame:
    """Queries in packets whose ``scale`` (a bandwidth, a radius) is equal within a factor of two and whose box is no larger
    than about eight of them, so what a packet meets is bounded by what its rows need."""
    rows = rows.withColumn("_scale", F.when(F.col(scale) > 0, F.floor(F.log2(scale))).otherwise(F.lit(-5_000)))
    level = F.floor(F.log2(F.lit(grid.side / 8.0)) - F.col("_scale"))
    rows = rows.withColumn("_up", F.lit(grid.deepest) - F.least(F.greatest(level, F.lit(0)), F.lit(grid.deepest)))
    box = F.expr(f"shiftright(_code, cast({len(grid.dims)} * _up as int))")
    return packed(grid, rows, columns, ["_scale"], F.xxhash64("_scale", box), id_column)


def box_gap(grid: Grid, level: Column) -> Column:
    """Squared distance between a packet's box and the row's cell (0 where they meet)."""
    h, parts = grid.cell_side(level), []
    for o, d, c in zip(grid.origin, grid.dims, cell_names(grid.dims)):
        low = F.lit(o) + F.col(c) * h
        away = F.greatest(low - F.col(f"hi_{d}"), F.col(f"lo_{d}") - (low + h), F.lit(0.0))
        parts.append(away * away)
    return reduce(lambda a, b: a + b, parts)


def extent(grid: Grid) -> Column:
    """The longest side of a packet's box."""
    return F.greatest(F.lit(0.0), *[F.col(f"hi_{d}") - F.col(f"lo_{d}") for d in grid.dims])


def cells_around(grid: Grid, packets: DataFrame, radius: Column) -> DataFrame:
    """One row per packet and cell that comes within ``radius`` of its box, on the level where that is a bounded number
    of cells."""
    size = F.greatest(radius, extent(grid), F.lit(grid.slack))
    level = F.floor(F.log2(F.lit(2.0 * grid.side) / size))
    level = F.least(F.greatest(level, F.lit(0)), F.lit(grid.deepest)).cast("int")
    out = packets.withColumns({"level": level, "_r": radius + F.lit(grid.slack)})
    for i, (d, c) in enumerate(zip(grid.dims, cell_names(grid.dims))):
        low = grid.index(i, F.col(f"lo_{d}") - F.col("_r"), F.col("level"))
        high = grid.index(i, F.col(f"hi_{d}") + F.col("_r"), F.col("level"))
        out = out.withColumn(c, F.explode(F.sequence(low, high)))
    return out.where(box_gap(grid, F.col("level")) <= F.col("_r") * F.col("_r")).drop("_r")


def contents(rows: DataFrame, key: Sequence[str], columns: Sequence[str], id_column: str | None = None) -> DataFrame:
    """(key..., data, [sources]): the rows of each cell, ``SOURCES`` of them in a row, their columns row by row."""
    row = F.struct(F.array(*[F.col(c).cast("double") for c in columns]).alias("row"), *([F.col(id_column).alias("source")] if id_column else []))
    cells = rows.groupBy(*key).agg(F.collect_list(row).alias("_held"))
    parts = F.transform(F.sequence(F.lit(1), F.size("_held"), F.lit(SOURCES)), lambda i: F.slice("_held", i, SOURCES))
    cells = cells.select(*key, F.explode(parts).alias("_part"))
    return cells.select(*key, F.flatten("_part.row").alias("data"), *([F.col("_part.source").alias("sources")] if id_column else []))


def streamed(packets: DataFrame, cells: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` over the Arrow batches of each packet (kind 0) followed by the rows of the cells it meets (kind 1 or more).
    cells: (packet, kind, data, ...)."""
    rows = packets.withColumn("kind", F.lit(0)).unionByName(cells, allowMissingColumns=True)
    return rows.repartition("packet").sortWithinPartitions("packet", "kind").mapInArrow(work, schema)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(kind, doubles, rows) of every stretch of rows of one packet and kind."""
    for batch in batches:
        packet, kind = batch.column("packet").to_numpy(), batch.column("kind").to_numpy()
        lists = batch.column("data")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        changes = np.flatnonzero((np.diff(packet) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows]):
            if b > a:
                yield int(kind[a]), values[offsets[a] : offsets[b]], batch.slice(a, b - a)


def in_rounds(packets: DataFrame, sent: DataFrame, stream: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """``stream`` of all packets, in rounds of neighbouring packets that are sent ``ROUND_BYTES`` or little more. ``stream``
    gets a filter for its tables with a packet; ``sent``: (packet, bytes). The shuffle files of a round go before the next
    one begins; what needs one round only is left to its reader."""
    block = F.shiftright("packet", 6)  # neighbouring packets have neighbouring numbers
    sums = sent.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes")).orderBy("block").collect()
    starts, held = [], 0
    for row in sums:
        if starts and held + row["bytes"] > ROUND_BYTES:
            starts.append(row["block"])
            held = 0
        starts = starts or [0]
        held += row["bytes"]
    if len(starts) <= 1:
        return stream(lambda df: df)
    parts, ends = [], [*starts[1:], 1 << 62]
    with shuffles_dropped(packets.sparkSession):
        for start, end in zip(starts, ends):
            parts.append(cut(stream(lambda df: df.where((block >= start) & (block < end)))))
    return reduce(DataFrame.unionByName, parts)


def squares(queries: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances between rows, summed in axis order."""
    out = queries[:, 0, None] - sources[None, :, 0]
    out *= out
    for axis in range(1, queries.shape[1]):
        away = queries[:, axis, None] - sources[None, :, axis]
        away *= away
        out += away
    return out
