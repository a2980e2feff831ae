"""Square cells at every power-of-two size over the bounding box of the points.

A cell of level ``l`` has the side ``side / 2**l``. Cells of different levels nest, because every level's
index is the finest index shifted right. Joins on (level, cell) are plain equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Bits per axis for 1, 2 and 3 axes, so that an interleaved code fits in 60 bits, and the
# usual shift-and-mask steps that spread an index for interleaving.
AXIS_BITS = {1: 60, 2: 30, 3: 20}
SPREAD = {
    1: [],
    2: [
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ],
    3: [
        (32, 0x001F00000000FFFF),
        (16, 0x001F0000FF0000FF),
        (8, 0x100F00F00F00F00F),
        (4, 0x10C30C30C30C30C3),
        (2, 0x1249249249249249),
    ],
}


@dataclass(frozen=True)
class Grid:
    dims: tuple[str, ...]
    origin: tuple[float, ...]
    side: float
    rows: int

    @property
    def deepest(self) -> int:
        # 2**deepest stays exact in a double
        return min(AXIS_BITS[len(self.dims)], 48)

    @property
    def slack(self) -> float:
        """Absolute allowance for the rounding of coordinates into cell indices."""
        return self.side * 2.0**-46

    def finest(self, dim: int, at: Column) -> Column:
        """Cell index on the deepest level of a coordinate, inside the box."""
        scaled = (at - F.lit(self.origin[dim])) * F.lit(2.0**self.deepest / self.side)
        top = F.lit(2**self.deepest - 1)
        return F.least(F.greatest(F.floor(scaled).cast("long"), F.lit(0).cast("long")), top)

    def index(self, dim: int, at: Column, level: Column) -> Column:
        return shift_down(self.finest(dim, at), F.lit(self.deepest) - level)

    def cell_side(self, level: Column) -> Column:
        return F.lit(self.side) / F.pow(F.lit(2.0), level)

    def gap(self, level: Column, point: Sequence[Column], cell: Sequence[Column]) -> Column:
        """Squared distance from a point to a cell (0 inside)."""
        h = self.cell_side(level)
        parts = []
        for o, p, c in zip(self.origin, point, cell):
            low = F.lit(o) + c * h
            away = F.greatest(low - p, p - (low + h), F.lit(0.0))
            parts.append(away * away)
        return reduce(lambda a, b: a + b, parts)

    def reach(self, level: Column, point: Sequence[Column], cell: Sequence[Column]) -> Column:
        """Squared distance from a point to the far corner of a cell."""
        h = self.cell_side(level)
        parts = []
        for o, p, c in zip(self.origin, point, cell):
            low = F.lit(o) + c * h
            away = F.greatest(F.abs(p - low), F.abs(p - (low + h)))
            parts.append(away * away)
        return reduce(lambda a, b: a + b, parts)

    def code(self) -> Column:
        """Interleaved finest indices: points close in code order are usually close in space."""
        n = len(self.dims)
        out = None
        for i, d in enumerate(self.dims):
            v = self.finest(i, F.col(d))
            for shift, mask in SPREAD[n]:
                v = (v.bitwiseOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask))
            v = F.shiftleft(v, i)
            out = v if out is None else out.bitwiseOR(v)
        return out


def shift_down(value: Column, by: Column) -> Column:
    """value // 2**by for non-negative longs with a per-row ``by``."""
    return F.floor(value / F.pow(F.lit(2.0), by)).cast("long")


def grid_over(df: DataFrame, dims: Sequence[str]) -> Grid:
    """Bounding box and row count: one small row on the driver."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(d).alias(f"lo_{d}") for d in dims],
        *[F.max(d).alias(f"hi_{d}") for d in dims],
    ).first()
    if row["n"] == 0:
        return Grid(tuple(dims), tuple(0.0 for _ in dims), 1.0, 0)
    side = max(row[f"hi_{d}"] - row[f"lo_{d}"] for d in dims)
    return Grid(tuple(dims), tuple(float(row[f"lo_{d}"]) for d in dims), float(side) or 1.0, row["n"])


def cell_names(dims: Sequence[str]) -> list[str]:
    return [f"c_{d}" for d in dims]


def cells_within(grid: Grid, queries: DataFrame, radius: Column, level: Column) -> DataFrame:
    """One row per query and cell of its ``level`` that comes within ``radius`` of it. The number of
    cells depends on radius over cell side only."""
    names = cell_names(grid.dims)
    out = queries.withColumns({"level": level.cast("int"), "_r": radius + F.lit(grid.slack)})
    for i, (d, c) in enumerate(zip(grid.dims, names)):
        low = grid.index(i, F.col(d) - F.col("_r"), F.col("level"))
        high = grid.index(i, F.col(d) + F.col("_r"), F.col("level"))
        out = out.withColumn(c, F.explode(F.sequence(low, high)))
    near = grid.gap(F.col("level"), [F.col(d) for d in grid.dims], [F.col(c) for c in names])
    return out.where(near <= F.col("_r") * F.col("_r")).drop("_r")


def cells_of(grid: Grid, points: DataFrame, levels: Sequence[int]) -> DataFrame:
    """One row per point and listed level, with the cell that holds it."""
    out = points.withColumn("level", F.explode(F.array(*[F.lit(int(v)) for v in levels])))
    return out.withColumns(
        {c: grid.index(i, F.col(d), F.col("level")) for i, (d, c) in enumerate(zip(grid.dims, cell_names(grid.dims)))}
    )


def children(grid: Grid, pairs: DataFrame) -> DataFrame:
    """Each cell row replaced by its 2**d halves on the next level."""
    out = pairs.withColumn("level", F.col("level") + 1)
    for c in cell_names(grid.dims):
        out = out.withColumn(c, F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)))
    return out
