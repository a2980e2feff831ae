"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from geostat_spark.llm.text import fresh, in_place, n_words
from geostat_spark.session import cut

SETTLED = 1e-9
LARGEST, SPACED = 9, 5  # units of a source that land, beside the two that the last flight cannot decide


def targets(totals: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target
    stops at ``most`` times its source's size; what is above goes to the others by weight, until none is above."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(n)) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    rated = totals.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", cap)
    # Filling: by cap / weight, each source is full or is reached by the level that the rest then shares.
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / rest
    levelled = rated.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return levelled.withColumn("shared", shared).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise(F.col("shared") * F.col("weight")).cast("double").alias("target"),
    )


def flight(p: np.ndarray, sizes: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities after the flight phase: all but at most two are 0 or 1; the expected number and
    the expected total size of what is taken stay as they are.

    Three undecided units move along the direction in which neither total changes, until one is decided."""
    p = p.astype(float).copy()
    p[p < SETTLED], p[p > 1 - SETTLED] = 0.0, 1.0
    waiting = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))][::-1]
    draws = iter(random.random(3 * len(waiting) + 3))
    hand: list[int] = []
    while True:
        while len(hand) < 3 and waiting:
            hand.append(waiting.pop())
        if len(hand) == 3:
            a, b, c = (float(sizes[i]) for i in hand)
            move = (b - c, c - a, a - b)
            if move == (0.0, 0.0, 0.0):
                move = (1.0, -1.0, 0.0)
        elif len(hand) == 2 and sizes[hand[0]] == sizes[hand[1]]:
            move = (1.0, -1.0)
        else:
            return p
        top = max(abs(v) for v in move)
        move = [v / top for v in move]
        up = min(((1 - p[i]) if v > 0 else p[i]) / abs(v) for i, v in zip(hand, move) if v)
        down = min((p[i] if v > 0 else (1 - p[i])) / abs(v) for i, v in zip(hand, move) if v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(hand, move):
            p[i] += step * v
            if p[i] < SETTLED:
                p[i] = 0.0
            elif p[i] > 1 - SETTLED:
                p[i] = 1.0
        hand = [i for i in hand if 0 < p[i] < 1]


def landing(p: np.ndarray, sizes: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Decides the last few units (at most some 20): of all samples, the one of least imbalance; equals are drawn.

    The imbalance is how far the total size is from its expectation, and a tenth of a unit's mean size for each unit
    by which the number is more than one off its own."""
    if not len(p):
        return p
    samples = (np.arange(1 << len(p))[:, None] >> np.arange(len(p)) & 1).astype(float)
    beyond = np.maximum(np.abs(samples.sum(axis=1) - p.sum()) - 1, 0)
    off = np.abs(samples @ sizes - p @ sizes) + beyond * sizes.mean() / 10
    return random.choice(samples[off <= off.min() + SETTLED * (1 + sizes.sum())])


def _held_back(p: np.ndarray) -> np.ndarray:
    """Places of the undecided units that land instead of flying: the first, largest ones and some of evenly spaced
    ranks among the rest. Large units hardly move in a flight; landing them needs the others as change."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    rest = open_[LARGEST:]
    return np.concatenate((open_[:LARGEST], rest[np.unique(np.linspace(0, len(rest) - 1, min(SPACED, len(rest))).astype(int))]))


def _settle(last: bool, seed: int, round_number: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order", "row"], ascending=[False, True, True], kind="stable")
        random = np.random.default_rng([seed, round_number, zlib.crc32(repr(key).encode())])
        p, sizes = rows["p"].to_numpy().astype(float), rows["size"].to_numpy()
        p[p < SETTLED], p[p > 1 - SETTLED] = 0.0, 1.0
        fly = np.ones(len(p), bool)
        if last:
            fly[_held_back(p)] = False
        p[fly] = flight(p[fly], sizes[fly], random)
        if last:
            open_ = np.flatnonzero((p > 0) & (p < 1))
            p[open_] = landing(p[open_], sizes[open_].astype(float), random)
        return rows.assign(p=p)

    return run


def mix_sources(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3.0,
    block: int = 5_000,
    seed: int = 7,
    row: str | None = None,
) -> DataFrame:
    """One row per document: the id, ``size`` (words), ``source_size``, ``target``, ``times``, ``taken``.

    A document of a source is expected ``target / source_size`` times. The whole part is taken as it is; the
    fraction is an inclusion probability, and the cube method draws a sample whose number of documents and of
    words is as expected. Blocks of about ``block`` documents of one source fly apart, largest documents first;
    at most two documents of a block stay open and fly again in the next round, with those of other blocks, until
    one block is left. There the 9 largest documents and 5 of evenly spaced ranks do not fly; with the open two they
    land on the sample of least imbalance, first of words, then of number. ``row``: a column that numbers the rows
    and is returned too.

    Null text has no words; it is drawn like others and takes none. A null source is a source. Null ids and
    repeated rows are documents of their own. A mix of no words takes nothing. The same table gives the same
    sample under any partitioning, but for rows equal in id and text. No rows give no rows.

    Sources are aggregated to one row each, and those rows alone meet in one task to share the total."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    units = cut(
        docs.select(
            F.col(id).alias("id"),
            F.col(source).alias("source"),
            n_words(F.col(text)).alias("size"),
            F.xxhash64(id, text).alias("order"),
            number.alias("row"),
        )
    )
    totals = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    shares = cut(
        targets(totals.select("source", "source_size"), weights, most)
        .withColumnRenamed("source", "_source")
        .join(totals.select(F.col("source").alias("_s"), "n"), F.col("_source").eqNullSafe(F.col("_s")))
        .drop("_s")
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    flying = units.join(F.broadcast(shares), F.col("source").eqNullSafe(F.col("_source"))).select(
        "id", "source", "size", "order", "row", "source_size", "target",
        F.floor(ratio).cast("int").alias("base"), (ratio - F.floor(ratio)).alias("p"),
        F.pmod(F.xxhash64("order"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / block))).alias("block"),
    )
    settled, round_number = [], 0
    schema = flying.schema
    while True:
        # One block per source is left when as many blocks as sources are in use: the last round lands.
        used = flying.agg(F.max("block")).first()[0]
        last = not used
        flown = cut(flying.groupBy("source", "block").applyInPandas(_settle(last, seed, round_number), schema))
        decided = (F.col("p") == 0) | (F.col("p") == 1)
        settled.append(flown.where(decided))
        if last:
            break
        open_ = flown.where(~decided)
        sizes = open_.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        flying = open_.join(F.broadcast(cut(sizes)), F.col("source").eqNullSafe(F.col("_source"))).select(
            *[c for c in schema.names if c != "block"], F.pmod(F.xxhash64("order"), F.col("blocks")).alias("block")
        )
        round_number += 1
    everything = settled[0]
    for part in settled[1:]:
        everything = everything.unionByName(part)
    times = F.col("base") + F.col("p").cast("int")
    return everything.select(
        F.col("id").alias(id), *([F.col("row").alias(row)] if row else []), "size", "source_size", "target",
        times.alias("times"), (F.col("size") * times).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents, all columns, each as often as ``mix_sources`` takes it."""
    row, copy = fresh(docs, "_row", "_copy")
    rows = in_place(docs, row)
    times = cut(mix_sources(rows, id, text, source, row=row, **options).where("times > 0").select(row, F.col("times").alias(copy)))
    # A merge join at every size: what a document is worth is known for all documents, which is too much to broadcast.
    return rows.join(times.hint("merge"), row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*docs.columns)
