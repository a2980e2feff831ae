"""Contiguous shards of the smallest possible capacity over ordered atomic groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from geostat_spark.session import cut


def greedy_ends(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Where each shard ends (position after its last item) when filled in order up to ``capacity``; None if
    more than ``shards`` are needed."""
    reach, ends, at = np.cumsum(sizes), [], 0
    for _ in range(shards):
        if at < len(sizes):
            done = int(reach[at - 1]) if at else 0
            after = int(np.searchsorted(reach, done + capacity, side="right"))
            if after == at:
                return None
            at = after
        ends.append(at)
    return ends if at == len(sizes) else None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity at which the items, kept in order and whole, fit into the shards."""
    if not len(sizes):
        return 0
    total = int(sizes.sum())
    low, high = max(int(sizes.max()), -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        if greedy_ends(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _range_sums(rows: DataFrame, bits: int) -> list[tuple[int, int, bool, int, int]]:
    """(first key, size, whether it is one group, bits, number) of the ranges of keys equal in ``bits`` bits."""
    at = F.shiftright("order", 64 - bits)
    found = rows.groupBy(at.alias("at")).agg(F.sum("size").alias("size"), F.min("order").alias("first"), F.max("order").alias("last"))
    return [(r["first"], int(r["size"]), r["first"] == r["last"], bits, r["at"]) for r in found.collect()]


def minimax_cuts(rows: DataFrame, shards: int, step_bits: int = 10) -> tuple[int, list[int]]:
    """(capacity, first order keys of shards 1..) for rows (order, size), order a signed 64-bit group key.

    The driver sees sums of key ranges only. It starts with 2^step_bits ranges; those in which a cut may fall
    are split again until they are single groups, so a round asks for a bounded number of sums whatever the
    number of groups. The greedy check and the binary search then give the exact optimum over all groups."""
    parts = sorted(_range_sums(rows, step_bits))
    if not parts:
        return 0, []
    while True:
        sizes = np.array([p[1] for p in parts], dtype=np.int64)
        reach = np.cumsum(sizes)
        high = smallest_capacity(sizes, shards)
        low = max([-(-int(reach[-1]) // shards), *[p[1] for p in parts if p[2]]])
        # The best capacity lies between them. With any of these, shard i ends no earlier than whole ranges
        # filled up to the lowest, and no later than i full shards of the highest.
        unsure, done = set(), 0
        for i in range(1, shards):
            first = int(np.searchsorted(reach, done + low, side="right"))
            done = max(done, int(reach[first - 1]) if first else 0)
            last = int(np.searchsorted(reach, i * high, side="left"))
            unsure.update(range(first, min(last + 1, len(parts))))
        split = [parts[k] for k in sorted(unsure) if not parts[k][2]]
        if not split:
            ends = greedy_ends(sizes, high, shards)
            return high, [parts[e][0] for e in ends[:-1] if e < len(parts)]
        left = [p for p in parts if p not in set(split)]
        for bits in {p[3] for p in split}:
            inside = rows.where(F.shiftright("order", 64 - bits).isin([p[4] for p in split if p[3] == bits]))
            left += _range_sums(inside, min(64, bits + step_bits))
        parts = sorted(left)


def shard_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = 8, rows_per_piece: int = 50_000
) -> DataFrame:
    """One row per document: the id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law`` ('bytes'), ``shard``,
    ``slot`` (0.. without gaps in a shard), ``grown_shard`` (null: this law has none).

    Equal texts are one atomic group. Groups are ordered by the text's 64-bit hash and cut into contiguous
    shards whose largest is as small as that order allows; groups that share a hash stay together too. A group
    larger than an even share sets the capacity, and later shards may then be empty.

    Null text has no bytes and is grouped with empty texts. Null ids and repeated rows are ordinary rows.
    Slots follow (hash, id) within pieces of about ``rows_per_piece`` rows; rows equal in all that are
    interchangeable. Other columns are ignored. No rows give no rows."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id).alias("id"),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.xxhash64(whole).alias("order"),
        )
    )
    _, cuts = minimax_cuts(rows.select("order", "size"), shards)
    shard = reduce(Column.__add__, [(F.col("order") >= c).cast("int") for c in cuts], F.lit(0))
    pieces = max(1, -(-rows.count() // (rows_per_piece * shards)))
    placed = rows.withColumn("shard", shard).withColumn("piece", F.pmod(F.xxhash64("id", "order"), F.lit(pieces)))
    counted = placed.groupBy("shard", "piece").count()
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counted.select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("shard", "piece").orderBy("order", "id")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "piece"])
        .select(
            F.col("id").alias(id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
