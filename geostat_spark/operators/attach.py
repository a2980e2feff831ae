"""Joining a table of groups back to its rows without shuffling the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from geostat_spark.session import cut

def attach(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of ``groups`` (one row per key combination).

    The group table is written out once, so that Spark knows its real size before it plans the join: a small one is
    broadcast and the rows of a hot group stay where they are; a large one is joined by shuffle."""
    return df.join(cut(groups), list(keys), how)


def attach_counted(
    df: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, spread: str, total: int, share: int = 1_000
) -> DataFrame:
    """``df`` left-joined with ``groups``: one row per key combination, ``size`` its number of rows in ``df``, which
    has ``total`` rows.

    Fewer than ``share`` keys can have more than ``total / share`` rows. Only these are broadcast, and their rows
    are dealt by the column ``spread``, as are rows with a null key; all others meet by key. Neither a hot key
    nor null fills one task. Columns named _hot, _cold and _salt are not allowed."""
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) * share > total).select(*keys, F.struct(*values).alias("_hot"))
    cold = groups.where(F.col(size) * share <= total).select(
        *keys, F.struct(*values).alias("_cold"), F.xxhash64(*keys).alias("_salt")
    )  # a constant would be folded out of the join's keys
    by_key = F.col("_hot").isNull()
    for key in keys:
        by_key &= F.col(key).isNotNull()
    salted = df.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", F.when(by_key, F.xxhash64(*keys)).otherwise(F.xxhash64(spread)))
    found = F.coalesce("_hot", "_cold")
    return salted.join(cold, [*keys, "_salt"], "left").select(*df.columns, *[found[v].alias(v) for v in values])
