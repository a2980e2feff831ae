"""Global order without a global sort in one task.

Every rank-based result in the library (Gini, Lorenz, quantiles, rank tests, folds) starts from
``value_ranks``: rows collapse to distinct values with counts (a value that fills a third of the table
becomes one row), the values are cut into equal-depth buckets, bucket totals are cumulated in a table of
a few rows, and only the inside of a bucket is ever sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from geostat_spark.session import cut, shuffle_width


def bucket_bounds(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Approximate equal-depth cut points. They steer balance only, never the result."""
    buckets = buckets or shuffle_width(df)
    probs = [i / buckets for i in range(1, buckets)]
    if not probs:
        return []
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 10_000)).first()[0]
    return sorted(set(found or []))


def bucket_of(value: Column, bounds: Sequence[float]) -> Column:
    """Number of bounds below the value, by a two-level search over about 2*sqrt(len(bounds)) cells."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    fine = F.array(*[F.lit(float(b)) for b in bounds])
    coarse = F.array(*[F.lit(float(b)) for b in bounds[step - 1 :: step]])
    x = value.cast("double")
    skipped = F.size(F.filter(coarse, lambda b: b < x)) * F.lit(step)
    rest = F.size(F.filter(F.slice(fine, skipped + 1, step), lambda b: b < x))
    return (skipped + rest).cast("int")


def value_ranks(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    weights: dict[str, Column] | None = None,
    copies: Column | None = None,
) -> DataFrame:
    """One row per distinct (keys, value), with

    * ``n``: rows holding the value, ``before``: rows of the same keys with a smaller value,
      ``total``: rows of the same keys;
    * for each extra weight ``w``: ``w`` (its sum over the value's rows), ``w_before``, ``w_total``.

    ``copies`` says how many rows an input row stands for. The input is read once: the collapsed table is
    written out before its bucket bounds are taken.
    """
    keys = list(keys)
    weights = dict(weights or {})
    present = df.where(F.col(value).isNotNull())
    count = F.count(F.lit(1)) if copies is None else F.sum(copies)
    sums = {"n": count, **{k: F.sum(c) for k, c in weights.items()}}
    per_value = cut(present.groupBy(*keys, value).agg(*[c.alias(k) for k, c in sums.items()]))
    # balance is about the distinct values: they are what the windows below sort
    bounds = bucket_bounds(per_value.select(value), value)
    per_value = per_value.withColumn("bucket", bucket_of(F.col(value), bounds))
    totals = per_value.groupBy(*keys, "bucket").agg(*[F.sum(k).alias(f"t_{k}") for k in sums])
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "bucket",
        *[F.coalesce(F.sum(f"t_{k}").over(earlier), F.lit(0)).alias(f"o_{k}") for k in sums],
        *[F.sum(f"t_{k}").over(whole).alias("total" if k == "n" else f"{k}_total") for k in sums],
    )
    if keys:
        same = [per_value[k].eqNullSafe(offsets[k]) for k in keys] + [per_value["bucket"] == offsets["bucket"]]
        joined = per_value.join(offsets, same).drop(*[offsets[k] for k in keys], offsets["bucket"])
    else:
        joined = per_value.join(offsets, "bucket")
    inside = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *keys,
        value,
        *sums,
        *[
            (F.col(f"o_{k}") + F.coalesce(F.sum(k).over(inside), F.lit(0))).alias(
                "before" if k == "n" else f"{k}_before"
            )
            for k in sums
        ],
        "total",
        *[f"{k}_total" for k in weights],
    )


def average_rank() -> Column:
    """Mean rank of a tied value, over the columns of ``value_ranks``."""
    return F.col("before") + (F.col("n") + F.lit(1)) / F.lit(2.0)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles per key: one output column per entry of ``probs``."""
    return quantiles_of_ranks(value_ranks(df, value, keys), value, probs, keys)


def quantiles_of_ranks(
    ranks: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    picks, outs = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before") <= pos) & (pos < F.col("before") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"{name}_{side}"))
        share = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        outs.append((lo + (hi - lo) * (share - F.floor(share))).alias(name))
    return ranks.groupBy(*keys).agg(F.max("total").alias("total"), *picks).select(*keys, *outs)


def with_row_number(df: DataFrame, key: Column, tie: str, name: str = "row_no") -> DataFrame:
    """1-based position in the order of (key, tie). ``key`` must be close to unique (an id, a hash of
    an id): its buckets are balanced because no single value of it is frequent."""
    keyed = cut(df.withColumn("_key", key))
    bounds = bucket_bounds(keyed.select("_key"), "_key")
    cut_up = keyed.withColumn("_bucket", bucket_of(F.col("_key"), bounds))
    sizes = cut_up.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy("_key", tie)
    return (
        cut_up.join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_key", "_bucket", "_offset")
    )


def seeded_hash(id_column: str, seed: int | str) -> Column:
    """Order-defining text hash of an id; the same hex digits in every engine."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))


def hash_position(id_column: str, seed: int | str) -> Column:
    """The leading 60 bits of ``seeded_hash`` as a number, ordered like the text."""
    return F.conv(F.substring(seeded_hash(id_column, seed), 1, 15), 16, 10).cast("long")


def every_rank(
    df: DataFrame, value: str, weights: dict[str, Column] | None = None, keep_every: Column | None = None
) -> DataFrame:
    """The columns of ``value_ranks`` for one row per ``rank`` 1..total (or per kept rank: multiples of
    ``keep_every`` and the last one). A frequent value covers a long run of ranks; runs are cut into
    pieces and spread before they are expanded, so no task expands more than a piece at a time."""
    piece = 10_000
    step = (F.lit(1) if keep_every is None else keep_every).cast("long")
    runs = value_ranks(df, value, weights=weights).withColumn("_step", step)
    first, last = F.col("before") + 1, F.col("before") + F.col("n")
    pieces = runs.withColumn("_from", F.explode(F.sequence(first, last, F.lit(piece).cast("long"))))
    if keep_every is None:
        pieces = pieces.repartition("_from")
    upto = F.least(F.col("_from") + F.lit(piece - 1), last)
    kept_from = (F.ceil(F.col("_from") / F.col("_step")) * F.col("_step")).cast("long")
    none = F.array().cast("array<bigint>")
    kept = F.when(kept_from <= upto, F.sequence(kept_from, upto, F.col("_step"))).otherwise(none)
    end = F.when((upto == F.col("total")) & (F.col("total") % F.col("_step") != 0), F.array("total")).otherwise(none)
    return pieces.withColumn("rank", F.explode(F.concat(kept, end))).drop("_from", "_step")
