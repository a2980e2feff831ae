"""SimHash fingerprints and their near duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.llm.exact_dedup import without
from geostat_spark.llm.text import LOWERED, fresh, in_place, words_in
from geostat_spark.operators.attach import attach_counted
from geostat_spark.operators.components import connected_components
from geostat_spark.session import cut

BITS = 64


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """The majority of each bit over the XXH64 hashes of all word shingles; 0 for a text without words."""
    import xxhash

    if not text:
        return 0
    found = words_in(text.lower() if text.isascii() else text.translate(LOWERED))
    if not found:
        return 0
    line = " ".join(found).encode("utf-8", "surrogatepass")
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    digest = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1)).tolist()
    ends = np.concatenate((gaps, [len(line)])).tolist()[shingle - 1 :]
    ones, total = np.zeros(BITS, np.int64), len(ends)
    for at in range(0, total, 65536):
        hashes = np.array(
            [digest(line[a:b], seed) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536])], dtype="<u8"
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, row: str | None = None
) -> DataFrame:
    """(id, row, fp): the fingerprint of every document as a signed long; ``row``: a column that tells the rows apart,
    null without one."""
    number = F.col(row) if row else F.lit(None).cast("long")
    rows = docs.select(F.col(id).alias("id"), number.alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(found.view(np.int64))], names=["id", "row", "fp"]
            )

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "row")]
    return rows.mapInArrow(run, f"id {kinds[0]}, row {kinds[1]}, fp long")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def segments_for(max_bits: int) -> list[range]:
    """The fewest bit ranges of which one differs by at most one bit when the whole differs by ``max_bits``."""
    parts = max_bits // 2 + 1
    edges = [round(BITS * i / parts) for i in range(parts + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:])]


def _variants(classes: DataFrame, max_bits: int) -> DataFrame:
    """(bit, value, fp): each fingerprint's segments with one bit taken out, for every bit.

    Two segments that differ in at most one bit agree in at least one of these."""
    keys = []
    for part in segments_for(max_bits):
        mask = sum(1 << b for b in part)
        for bit in part:
            keys.append(
                F.struct(F.lit(bit).cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(mask & ~(1 << bit)))).alias("value"))
            )
    return classes.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.bit", "key.value", "fp")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _spanning(run: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what is reachable within one run: each step leaves out what is joined already, so no
    pair inside a joined set is looked at twice or returned."""
    links = []
    rest = run
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            one = frontier.pop()
            near = _distance(rest, one) <= max_bits
            if near.any():
                links.extend((int(one), int(x)) for x in rest[near])
                frontier.extend(rest[near])
                rest = rest[~near]
    return links


def _linker(max_bits: int):
    def run_links(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
        """Links of all runs of equal keys; the rows are sorted by key."""
        edge = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(fps)]))
        sizes = np.diff(edge)
        first = np.repeat(fps[edge[:-1]], sizes)
        near = _distance(fps, first) <= max_bits
        star = near & (fps != first)
        out = [np.stack([first[star], fps[star]], axis=1)]
        # Where all of a run is near its first member, the star joins it. The rest of longer runs is searched.
        missed = np.add.reduceat(~near, edge[:-1]) if len(fps) else np.zeros(0, int)
        for k in np.flatnonzero((missed > 0) & (sizes > 2)):
            found = _spanning(fps[edge[k] : edge[k + 1]], max_bits)
            if found:
                out.append(np.array(found, dtype=np.uint64).reshape(-1, 2))
        return np.unique(np.concatenate(out), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_keys, kept_fps = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)

        def answer(links: np.ndarray) -> pa.RecordBatch:
            signed = links.view(np.int64) if len(links) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["src", "dst"])

        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("bit", "value", "blocks")], axis=1)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            keys, fps = np.concatenate([kept_keys, keys]), np.concatenate([kept_fps, fps])
            if not len(fps):
                continue
            same_as_last = (keys == keys[-1]).all(axis=1)
            whole = len(fps) - int(same_as_last.sum())  # the last run may go on in the next batch
            kept_keys, kept_fps = keys[whole:], fps[whole:]
            if whole:
                yield answer(run_links(keys[:whole], fps[:whole]))
        if len(kept_fps):
            yield answer(run_links(kept_keys, kept_fps))

    return run


def fingerprint_links(classes: DataFrame, max_bits: int = 4, run_cap: int = 20_000) -> DataFrame:
    """(src, dst): links between different fingerprints, enough to join all that is reachable by links of at
    most ``max_bits`` differing bits. ``classes`` has one row per fingerprint ``fp``.

    Fingerprints meet where a one-wildcard variant of a segment agrees; each meeting is verified on all bits.
    A variant that more than ``run_cap`` fingerprints share is cut into blocks, and all pairs of blocks meet
    in tasks of their own, so none holds more than two blocks."""
    variants = _variants(classes, max_bits)
    crowded = cut(variants.groupBy("bit", "value").count().where(F.col("count") > run_cap))
    if crowded.isEmpty():
        met = variants.withColumn("blocks", F.lit(0).cast("long"))
    else:
        n = F.ceil(F.col("count") / run_cap).cast("long")
        own = F.pmod(F.xxhash64("fp"), F.col("n"))
        met = (
            variants.join(crowded.withColumn("n", n).drop("count"), ["bit", "value"], "left")
            .withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
            .select("bit", "value", "fp", (F.least("own", "other") * F.col("n") + F.greatest("own", "other")).alias("blocks"))
        )
    sorted_runs = met.repartition("bit", "value", "blocks").sortWithinPartitions("bit", "value", "blocks", "fp")
    return sorted_runs.mapInArrow(_linker(max_bits), "src long, dst long").distinct()


def simhash_near_dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    seed: int = 42,
    run_cap: int = 20_000,
) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits), ``component_id``, ``n_copies``.

    Two documents are linked when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is
    the smallest id reachable. Equal fingerprints form one class, so copies are never paired; ``n_copies`` is
    the number of documents of the class.

    Null, empty and blank texts have fingerprint 0 and are linked like others. A text of fewer words than the
    shingle is hashed whole. Rows with a null id are kept; they count as larger than any id, so
    ``component_id`` is null only where no id is reachable. Repeated rows stay repeated. Other columns are
    ignored. No rows give no rows."""
    marks = cut(fingerprints(docs, id, text, shingle, seed).drop("row"))
    resolved = _resolved(marks, F.min("id"), max_bits, run_cap)
    return attach_counted(marks, resolved, ["fp"], "n_copies", "id", marks.count()).select(
        F.col("id").alias(id),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least").alias("component_id"),
        "n_copies",
    )


def _resolved(marks: DataFrame, least: Column, max_bits: int, run_cap: int) -> DataFrame:
    """(fp, least, n_copies): one row per fingerprint, ``least`` being that minimum over its whole component."""
    classes = cut(marks.groupBy("fp").agg(least.alias("least"), F.count(F.lit(1)).alias("n_copies")))
    links = fingerprint_links(classes.select("fp"), max_bits, run_cap)
    joined = connected_components(classes.select(F.col("fp").alias("id")), links).withColumnRenamed("id", "fp")
    grouped = cut(classes.join(joined, "fp"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("members"))
    resolved = attach_counted(grouped.drop("least"), lowest, ["component"], "members", "fp", grouped.count())
    return cut(resolved.select("fp", F.col("lowest").alias("least"), "n_copies"))


def drop_near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    seed: int = 42,
    run_cap: int = 20_000,
) -> DataFrame:
    """The documents, all columns, with one row left of each component (see ``simhash_near_dedup``): that of the
    smallest id, of rows that share it any one. A null id is larger than any other.

    Rows are told apart by a number of their own, so null ids and ids that occur twice stand for nothing else."""
    (row,) = fresh(docs, "_row")
    numbered = in_place(docs, row)
    marks = cut(fingerprints(numbered, id, text, shingle, seed, row))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    resolved = _resolved(marks, F.min(first), max_bits, run_cap)
    found = attach_counted(marks, resolved, ["fp"], "n_copies", "row", marks.count())
    gone = cut(found.where(F.col("row") != F.col("least.row")).select(F.col("row").alias(row)))
    return without(numbered, gone, row).select(*docs.columns)
