"""Connected components by alternating star contractions on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geostat_spark.operators.attach import attach_counted
from geostat_spark.session import cut


def _large_star(links: DataFrame, n_links: int) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    up = attach_counted(both.where(F.col("v") > F.col("u")), low, ["u"], "n", "v", 2 * n_links)
    return up.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, n_links: int) -> DataFrame:
    down = links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    met = attach_counted(down, low, ["u"], "n", "v", n_links)
    moved = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(nodes: DataFrame, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): component is the smallest id reachable over the undirected links (src, dst).

    Every node ends up linked straight to its smallest reachable id; each round is a few aggregations by
    node, written out so that the plan does not grow. Stops when a round changes nothing. Most nodes of a large
    component link to its root, so rows return to their node's smallest by a join that deals hot nodes out."""
    current = cut(
        links.select(F.col("src").alias("u"), F.col("dst").alias("v")).where(F.col("u") != F.col("v")).distinct()
    )

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(current)
    for _ in range(max_rounds):
        wide = cut(_large_star(current, before[0]))
        current = cut(_small_star(wide, before[0]).distinct())
        after = mark(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _rooted(nodes, current)


def _rooted(nodes: DataFrame, current: DataFrame) -> DataFrame:
    roots = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_count(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(nodes, links)
    return found.agg(F.count_distinct("component").alias("n_components"))
