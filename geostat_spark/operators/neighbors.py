"""Exact k-nearest-neighbour join without all pairs.

1. Rows at the same coordinates collapse to one location that keeps its k+1 smallest ids: at one distance
   no query can take more of them, so nothing is lost and a location shared by a third of the table costs
   one row.
2. Locations are put in the order of their interleaved cell code; the distance within which a location's
   neighbours in that order hold k rows bounds its true k-th distance from above. So the search around
   places with many copies goes no further than the copies.
3. Each location visits the cells that come within its bound. A cell with many locations is replaced by
   its halves, and the bound tightens from the cell counts, until every visited cell is small.
4. What is left is an equi-join on (level, cell), a distance and a top-k per location.

``by`` columns run the whole search separately inside each of their groups, in the same jobs. ``carry``
columns travel with the neighbours, so that lags need no join back on the neighbour's id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from geostat_spark.operators.grid import Grid, cell_names, cells_of, cells_within, children, grid_over
from geostat_spark.operators.ordering import bucket_bounds, bucket_of
from geostat_spark.session import cut


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean, summed in axis order."""
    return F.sqrt(reduce(lambda s, t: s + t, [(p - q) * (p - q) for p, q in zip(a, b)]))


def _locations(
    points: DataFrame, dims: Sequence[str], keep: int, by: Sequence[str] = (), carry: Sequence[str] = ()
) -> DataFrame:
    """Distinct coordinates with their ``keep`` smallest ids; ``loc`` is the smallest."""
    place = [*by, *dims]
    return (
        points.select("id", *place, *carry)
        .withColumn("_no", F.row_number().over(Window.partitionBy(*place).orderBy("id")))
        .where(F.col("_no") <= keep)
        .groupBy(*place)
        .agg(F.sort_array(F.collect_list(F.struct("id", *carry))).alias("held_rows"))
        .withColumn("loc", F.element_at("held_rows", 1)["id"])
    )


def _with_bound(
    queries: DataFrame, targets: DataFrame | None, grid: Grid, k: int, by: Sequence[str]
) -> DataFrame:
    """Upper bound of the k-th neighbour distance from the locations around each one in code order, each with the
    rows it holds. With separate targets only those count, and a query that has too few of them nearby starts unbounded.
    ``targets`` None means the queries are their own targets, each being its own first neighbour."""
    own, holds = targets is None, F.size("held_rows").alias("_n")
    coords = F.struct(*grid.dims, "_n")
    if own:
        rows, width, seen, rank = queries.select("*", holds), k, coords, k + 1
    else:
        rows = queries.select("loc", *by, *grid.dims, F.lit(0).alias("_n"), F.lit(True).alias("_q")).unionByName(
            targets.select("loc", *by, *grid.dims, holds, F.lit(False).alias("_q"))
        )
        width, seen, rank = 2 * k, F.when(~F.col("_q"), coords), k
    coded = rows.withColumn("_code", grid.code())
    bounds = bucket_bounds(coded.select("_code"), "_code")
    around = Window.partitionBy(*by, "_bucket").orderBy("_code", "loc").rowsBetween(-width, width)
    here = [F.col(d) for d in grid.dims]
    near = F.collect_list(seen).over(around)
    ranked = F.sort_array(F.transform(near, lambda e: F.struct(distance([e[d] for d in grid.dims], here).alias("dist"), e["_n"].alias("n"))))
    whole = F.lit(grid.side * 2.0 * len(grid.dims))
    enough = F.aggregate(
        ranked,
        F.struct(F.lit(0).alias("seen"), whole.alias("dist")),
        lambda s, e: F.when(s["seen"] >= rank, s).otherwise(F.struct((s["seen"] + e["n"]).alias("seen"), e["dist"].alias("dist"))),
        lambda s: F.when(s["seen"] >= rank, s["dist"]).otherwise(whole),
    )
    bounded = (
        coded.withColumn("_bucket", bucket_of(F.col("_code"), bounds))
        .withColumn("bound", enough)
        .drop("_code", "_bucket", "_n")
    )
    return bounded if own else bounded.where("_q").drop("_q")


def levels_in_use(pairs: DataFrame) -> list[int]:
    return [r[0] for r in pairs.select("level").distinct().collect()]


def _refine(
    grid: Grid, pairs: DataFrame, targets: DataFrame, needed: int, crowded: int, by: Sequence[str]
) -> DataFrame:
    """Replace pairs (query, crowded cell) by the cell's halves until none is crowded. A cell whose locations hold
    ``needed`` rows bounds the search by its far corner."""
    here, cells = [F.col(d) for d in grid.dims], cell_names(grid.dims)
    key = [*by, "level", *cells]
    done = None
    while True:
        counts = (
            cells_of(grid, targets.select(*by, *grid.dims, F.size("held_rows").alias("_n")), levels_in_use(pairs))
            .groupBy(*key)
            .agg(F.count(F.lit(1)).alias("held"), F.sum("_n").alias("_rows"))
        )
        sized = pairs.join(counts, key)
        far = F.sqrt(grid.reach(F.col("level"), here, [F.col(c) for c in cells])) + F.lit(grid.slack)
        tight = sized.groupBy("loc").agg(F.min(F.when(F.col("_rows") >= needed, far)).alias("_far"))
        sized = sized.join(tight, "loc").withColumn("bound", F.least("bound", "_far")).drop("_far", "_rows")
        reach = F.col("bound") + F.lit(grid.slack)
        sized = cut(sized.where(grid.gap(F.col("level"), here, [F.col(c) for c in cells]) <= reach * reach))
        split = (F.col("held") > crowded) & (F.col("level") < grid.deepest)
        light = sized.where(~split).drop("held")
        done = light if done is None else done.unionByName(light)
        pairs = sized.where(split).drop("held")
        if pairs.isEmpty():
            return done
        pairs = children(grid, pairs)


def _search(
    queries: DataFrame,
    targets: DataFrame | None,
    grid: Grid,
    k: int,
    take: int,
    crowded: int | None,
    by: Sequence[str],
) -> DataFrame:
    """(loc, near): the ``take`` nearest target rows of each query location, sorted by (dist, id)."""
    dims, cells = list(grid.dims), cell_names(grid.dims)
    bounded = cut(_with_bound(queries, targets, grid, k, by))
    targets = bounded if targets is None else targets
    level = F.floor(F.log2(F.lit(grid.side) / F.greatest("bound", F.lit(grid.slack))))
    level = F.least(F.greatest(level, F.lit(0)), F.lit(grid.deepest))
    pairs = cells_within(grid, bounded.select("loc", "bound", *by, *dims), F.col("bound"), level)
    pairs = _refine(grid, pairs, targets, take, crowded or max(256, 8 * take), by)
    held = cells_of(grid, targets.select("held_rows", *by, *dims), levels_in_use(pairs)).select(
        *by, "level", *cells, "held_rows", *[F.col(d).alias(f"t_{d}") for d in dims]
    )
    dist = distance([F.col(d) for d in dims], [F.col(f"t_{d}") for d in dims])
    return (
        pairs.join(held, [*by, "level", *cells])
        .withColumn("dist", dist)
        .where(F.col("dist") <= F.col("bound") + F.lit(grid.slack))
        .select("loc", "dist", F.explode("held_rows").alias("row"))
        .withColumn("_no", F.row_number().over(Window.partitionBy("loc").orderBy("dist", "row.id")))
        .where(F.col("_no") <= take)
        .groupBy("loc")
        .agg(F.sort_array(F.collect_list(F.struct("dist", "row.*"))).alias("near"))
    )


def _check(dims: Sequence[str]) -> list[str]:
    if not 1 <= len(dims) <= 3:
        raise ValueError("one to three coordinates")
    return list(dims)


def neighbours(
    points: DataFrame,
    k: int,
    dims: Sequence[str] = ("x", "y"),
    id_column: str = "id",
    carry: Sequence[str] = (),
    by: Sequence[str] = (),
    crowded: int | None = None,
) -> DataFrame:
    """One row per point: id, ``carry``, ``by``, coordinates and ``near``, its k nearest other points as an
    array of (dist, id, carry...) sorted by (dist, id). Rows without coordinates take no part."""
    dims, by, carry = _check(dims), list(by), list(carry)
    located = cut(points.select(F.col(id_column).alias("id"), *by, *dims, *carry).na.drop(subset=[*by, *dims]))
    grid = grid_over(located, dims)
    locations = cut(_locations(located, dims, k + 1, by, carry))
    lists = _search(locations, None, grid, k, k + 1, crowded, by)
    near = locations.select("loc", *by, *dims).join(lists, "loc").drop("loc")
    return located.join(near, [*by, *dims]).withColumn(
        "near", F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k)
    )


def edges(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The rows of ``neighbours`` as directed edges (src, dst, rank, dist), with carried columns of the
    far end as ``dst_<name>``."""
    return rows.select(F.col("id").alias("src"), F.posexplode("near").alias("pos", "e")).select(
        "src",
        F.col("e.id").alias("dst"),
        (F.col("pos") + 1).alias("rank"),
        F.col("e.dist").alias("dist"),
        *[F.col(f"e.{c}").alias(f"dst_{c}") for c in carry],
    )


def knn(
    points: DataFrame, k: int, dims: Sequence[str] = ("x", "y"), id_column: str = "id", crowded: int | None = None
) -> DataFrame:
    """Directed edges (src, dst, rank, dist) from every row to its k nearest other rows; equal distances
    go to the smaller id."""
    return edges(neighbours(points, k, dims, id_column, crowded=crowded))


def neighbours_between(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    dims: Sequence[str] = ("x", "y"),
    id_column: str = "id",
    carry: Sequence[str] = (),
    crowded: int | None = None,
) -> DataFrame:
    """One row per query: id, coordinates and ``near``, its k nearest rows of ``points``. A query that is
    itself one of the points finds itself first."""
    dims, carry = _check(dims), list(carry)
    asked = cut(queries.select(F.col(id_column).alias("id"), *dims).na.drop(subset=dims))
    held = cut(points.select(F.col(id_column).alias("id"), *dims, *carry).na.drop(subset=dims))
    grid = grid_over(asked.select(*dims).unionByName(held.select(*dims)), dims)
    places = cut(_locations(asked, dims, 1))
    lists = _search(places, cut(_locations(held, dims, k, carry=carry)), grid, k, k, crowded, [])
    near = places.select("loc", *dims).join(lists, "loc").drop("loc")
    return asked.join(near, dims)


def knn_between(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    dims: Sequence[str] = ("x", "y"),
    id_column: str = "id",
    crowded: int | None = None,
) -> DataFrame:
    """Edges (src, dst, rank, dist) from every query row to its k nearest rows of ``points``."""
    return edges(neighbours_between(queries, points, k, dims, id_column, crowded=crowded))
