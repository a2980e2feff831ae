"""Repeated passages by sparse suffix arrays in a logarithmic family of sorted tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from geostat_spark.llm.exact_dedup import sieved
from geostat_spark.llm.text import fresh, in_place
from geostat_spark.operators.attach import attach_counted
from geostat_spark.session import cut, cut_and_release, tables_so_far

ODD = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ODD, -1, 1 << 64)
STRETCH = 1 << 20  # positions that are hashed at a time


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """64-bit hashes of all strings of one length in a stretch of bytes."""

    def __init__(self, room: int):
        self.up, self.down = _powers(ODD, room + 1), _powers(INVERSE, room + 1)

    def grams(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
        return _mixed((sums[length:] - sums[:-length]) * self.up[: n - length + 1])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def zones(data: bytes, length: int, gram: int, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, last start, anchor) of the zones of a text, in stretches.

    The anchor of a string of ``length`` bytes is its gram of least hash, the leftmost of equals, hence the same
    wherever the string occurs. A zone is a run of starts that share an anchor."""
    whole = np.frombuffer(data, np.uint8)
    starts = len(whole) - length + 1
    width = length - gram + 1
    low = np.uint64((1 << 24) - 1)
    for begin in range(0, max(starts, 0), STRETCH):
        part = whole[begin : min(begin + STRETCH, starts) + length - 1]
        hashes = hasher.grams(part, gram)
        rated = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        anchors = (_sliding_least(rated, width) & low).astype(np.int64)
        edge = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]))
        yield edge[:-1] + begin, edge[1:] - 1 + begin, anchors[edge[:-1]] + begin


def zone_table(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(suffix, content, first, last, anchor, row): every zone of every text; rows: (row, text).

    ``suffix`` is the text from the anchor on, to a depth of ``gram`` bytes. ``content`` is a digest of all bytes that
    the zone's strings cover and of where the anchor lies in them, so zones of equal content hold the same strings."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(STRETCH + length)
        names = ["suffix", "content", "first", "last", "anchor", "row"]
        for batch in incoming:
            suffixes, contents, numbers = [], [], []
            size = 0

            def answer() -> pa.RecordBatch:
                first, last, anchor, place = (pa.array(np.concatenate(c)) for c in zip(*numbers))
                columns = [pa.array(suffixes, pa.binary()), pa.array(contents, pa.binary()), first, last, anchor]
                return pa.RecordBatch.from_arrays([*columns, batch.column("row").take(place)], names=names)

            for place, text in enumerate(batch.column("text")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for first, last, anchor in zones(data, length, gram, hasher):
                    suffixes.extend(data[c : c + gram] for c in anchor.tolist())
                    contents.extend(
                        hashlib.blake2b(data[a : b + length], digest_size=16, salt=(c - a).to_bytes(8, "little")).digest()
                        for a, b, c in zip(first.tolist(), last.tolist(), anchor.tolist())
                    )
                    numbers.append((first, last, anchor, np.full(len(first), place)))
                    size += len(first)
                if size > 20_000:
                    yield answer()
                    suffixes, contents, numbers, size = [], [], [], 0
            if size:
                yield answer()

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "text").mapInArrow(run, f"suffix binary, content binary, first long, last long, anchor long, row {kind}")


class SuffixFamily:
    """Suffix arrays in tables of a power of two of batches each; no two of equal size stay.

    An array holds the distinct suffixes of its batches in byte order, to the depth of the suffixes given, with their
    numbers of occurrences: equal neighbours of the order are one row. It is a table in ``shards`` sorted buckets, so
    that arrays are merged bucket by bucket without a shuffle. A new batch is scanned along every level for suffixes
    that both hold, that is for neighbours with a common prefix of the whole depth; then equal-sized levels are
    merged until all sizes differ. ``drop`` deletes the tables."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.shards = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []
        self.matches: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> None:
        """``suffixes``: one row with ``suffix`` for each sampled suffix of the batch."""
        name, size = self._written(suffixes.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))), 1
        scanned, times = self.spark.table(name), F.col("n")
        for number, (_, level) in enumerate(self.levels):
            other = self.spark.table(level).select("suffix", F.col("n").alias(f"n{number}"))
            scanned = scanned.join(other.hint("merge"), "suffix", "left")
            times += F.coalesce(f"n{number}", F.lit(0))
        self.matches.append(cut(scanned.select("suffix", times.alias("n")).where("n > 1")))
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            left, right = self.spark.table(level), self.spark.table(name).withColumnRenamed("n", "m")
            both = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            merged = self._written(left.join(right.hint("merge"), "suffix", "full_outer").select("suffix", both.alias("n")))
            self._gone(level)
            self._gone(name)
            name, size = merged, 2 * size
        self.levels.append((size, name))

    def _written(self, rows: DataFrame) -> str:
        name = f"suffix_array_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.shards, "suffix").sortBy("suffix").saveAsTable(name)
        return name

    def _gone(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")

    def matched(self) -> DataFrame:
        """(suffix, n): the suffixes that occur more than once, and how often. The last batch that holds a suffix has
        met all others."""
        found = self.matches[0]
        for part in self.matches[1:]:
            found = found.unionByName(part)
        return found.groupBy("suffix").agg(F.max("n").alias("n"))

    def drop(self) -> None:
        while self.levels:
            self._gone(self.levels.pop()[1])


def batches_for(rows: DataFrame) -> int:
    """Number of batches of a table of texts: three, and one more with every doubling from 1 GiB of text on. A batch is
    scanned along all before it, so the scans read each suffix half as often as there are batches."""
    bytes_ = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return 2 + (1 + (bytes_ >> 30)).bit_length()


def _windows(rows: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(key, row, first, shift, once, bytes): the bytes covered by each open zone; ``shift``: anchor - first."""
    wanted = cut(open_.groupBy("row").agg(F.collect_list(F.struct("key", "first", "last", "anchor", "once")).alias("zones")))
    joined = sieved(rows, wanted, "row").where("shared").join(wanted, "row").select("row", "text", "zones")
    kind = rows.schema["row"].dataType.simpleString()

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for place, (text, found) in enumerate(zip(batch.column("text"), batch.column("zones"))):
                data = text.as_py().encode("utf-8", "surrogatepass")
                z = found.values
                first, last, anchor = (z.field(c).to_numpy() for c in ("first", "last", "anchor"))
                covered = [data[a : b + length] for a, b in zip(first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        z.field("key"), batch.column("row").take(pa.array(np.full(len(z), place))), z.field("first"),
                        pa.array(anchor - first), z.field("once"), pa.array(covered, pa.binary()),
                    ],
                    names=["key", "row", "first", "shift", "once", "bytes"],
                )

    return joined.mapInArrow(run, f"key long, row {kind}, first long, shift long, once boolean, bytes binary")


def _starts(batch: pa.RecordBatch, length: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zone number in the batch, start in its zone, hash of key, offset from the anchor and string) of all starts."""
    pieces = [np.frombuffer(b.as_py(), np.uint8) for b in batch.column("bytes")]
    counts = np.array([len(p) - length + 1 for p in pieces], dtype=np.int64)
    zone = np.repeat(np.arange(len(pieces)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    strings = np.concatenate([hasher.grams(p, length) for p in pieces])
    shift = batch.column("shift").to_numpy()[zone] - within
    key = batch.column("key").to_numpy().view(np.uint64)[zone]
    return zone, within, _mixed(strings ^ _mixed(key + shift.astype(np.uint64) * np.uint64(ODD)))


def _as_runs(batch: pa.RecordBatch, zone: np.ndarray, within: np.ndarray) -> pa.RecordBatch:
    """(row, first, last): runs of consecutive marked starts, as starts in the text."""
    edge = np.flatnonzero((zone[1:] != zone[:-1]) | (within[1:] != within[:-1] + 1)) + 1
    a, b = np.concatenate(([0], edge)).astype(int), np.concatenate((edge, [len(zone)])).astype(int) - 1
    if not len(zone):
        a = b = np.zeros(0, int)
    first = batch.column("first").to_numpy()
    return pa.RecordBatch.from_arrays(
        [batch.column("row").take(pa.array(zone[a])), pa.array(first[zone[a]] + within[a]), pa.array(first[zone[a]] + within[b])], names=["row", "first", "last"]
    )


def _local_runs(length: int):
    """Marks the starts whose string another zone of the same key has too; rows come sorted by key."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(STRETCH + length)
        held: pa.Table | None = None

        def answer(table: pa.Table) -> pa.RecordBatch:
            batch = table.combine_chunks().to_batches()[0]
            zone, within, hashes = _starts(batch, length, hasher)
            _, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
            marked = (times[place] > 1) & batch.column("once").to_numpy(zero_copy_only=False)[zone]
            return _as_runs(batch, zone[marked], within[marked])

        for part in (batch.slice(at, 2_000) for batch in incoming for at in range(0, batch.num_rows, 2_000)):
            table = pa.Table.from_batches([part])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 2_000:
                continue
            keys = held.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1], side="left"))  # the last key may go on
            if whole:
                yield answer(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield answer(held)

    return run


def _spread_runs(windows: DataFrame, length: int) -> DataFrame:
    """The same for keys of very many zones: strings are counted by Spark, each start a row of its own."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(STRETCH + length)
        for batch in incoming:
            if batch.num_rows:
                zone, within, hashes = _starts(batch, length, hasher)
                at = batch.column("first").to_numpy()[zone] + within
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), batch.column("row").take(pa.array(zone)), pa.array(at), batch.column("once").take(pa.array(zone))],
                    names=["hash", "row", "first", "once"],
                )

    kind = windows.schema["row"].dataType.simpleString()
    starts = cut(windows.mapInArrow(run, f"hash long, row {kind}, first long, once boolean"))
    twice = cut(starts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    found = attach_counted(starts.where("once"), twice, ["hash"], "n", "first", starts.count()).where("n > 1")
    return found.select("row", "first", F.col("first").alias("last"))


def repeated_starts(rows: DataFrame, length: int = 400, gram: int = 64, batches: int | None = None, crowd: int = 2_000) -> DataFrame:
    """(row, first, last): runs of starts in a text whose string of ``length`` bytes also starts elsewhere.

    rows: (row, text). Exact: equal strings have equal suffixes at their anchors, and the suffix arrays tell which
    occur more than once. Zones whose content occurs twice are repeated whole. Where zones share a suffix but
    differ, one of each content is laid beside the others at the anchor and compared start by start; up to
    ``crowd`` zones of a suffix are compared in one task, those of more are counted over all tasks."""
    mark = tables_so_far()
    batches = batches or batches_for(rows)
    numbered = zone_table(rows, length, gram).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)))
    table = cut(numbered.withColumn("key", F.xxhash64("suffix")), "batch")
    family = SuffixFamily(rows.sparkSession)
    for number in range(batches):
        family.add(table.where(F.col("batch") == number))
    matched = cut(family.matched().groupBy(F.xxhash64("suffix").alias("key")).agg(F.sum("n").alias("n")))
    family.drop()
    places = table.select("key", "content", "first", "last", "anchor", "row")
    shared = sieved(places, matched, "key").where("shared").select(*places.columns)
    candidates = attach_counted(shared, matched, ["key"], "n", "row", places.count()).where("n > 1").drop("n")
    candidates = cut_and_release(candidates, mark)
    n_candidates = candidates.count()
    one = F.min(F.struct("row", "first", "last", "anchor")).alias("one")
    contents = cut(candidates.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), one))
    several = contents.groupBy("key").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    whole = attach_counted(
        candidates, contents.where("n > 1").select("key", "content", "n"), ["key", "content"], "n", "row", n_candidates
    ).where("n > 1")
    open_ = attach_counted(contents, cut(several), ["key"], "contents", "content", n_candidates).where("contents > 1")
    open_ = cut(open_.select("key", "one.*", (F.col("n") == 1).alias("once"), "contents"))
    runs = whole.select("row", "first", "last")
    few = _windows(rows, open_.where(F.col("contents") <= crowd), length)
    kind = rows.schema["row"].dataType.simpleString()
    marked = few.repartition("key").sortWithinPartitions("key").mapInArrow(_local_runs(length), f"row {kind}, first long, last long")
    runs = runs.unionByName(marked)
    crowded = open_.where(F.col("contents") > crowd)
    if not crowded.isEmpty():
        runs = runs.unionByName(_spread_runs(_windows(rows, crowded, length), length))
    return runs


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 400, gram: int = 64,
    batches: int | None = None, crowd: int = 2_000, with_text: bool = False,
) -> DataFrame:
    """One row per document: the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, ``with_text``,
    ``kept_text`` (its valid UTF-8; a character cut in two is dropped there).

    Removes each byte covered by a string of ``length`` bytes that also starts anywhere else, be it in the same
    text; all is judged on the input. Null text is empty; texts shorter than ``length`` keep all. Rows that
    repeat id and text are two occurrences of each other's strings; null ids are ordinary. Other columns are
    ignored. No rows give no rows."""
    if length <= gram or gram < 1:
        raise ValueError("the gram must be shorter than the string")
    (row,) = fresh(docs, "_row")
    own = in_place(docs, row).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(row).alias("row"))
    long_enough = own.where(F.octet_length("text") >= length).select("row", "text")
    runs = cut(repeated_starts(long_enough, length, gram, batches, crowd))
    spans = cut(runs.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    kind = own.schema["id"].dataType.simpleString()

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            out = []
            runs_ = batch.column("runs") if "runs" in batch.schema.names else [None] * batch.num_rows
            for text_, found in zip(batch.column("text"), runs_):
                data = np.frombuffer(text_.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                change = np.zeros(len(data) + 1, np.int64)
                if found is not None and found.is_valid:
                    ends = found.values.flatten()
                    np.add.at(change, ends[0].to_numpy(), 1)
                    np.add.at(change, ends[1].to_numpy() + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans_ = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                kept = data[~gone].tobytes()
                row = (len(data), int(gone.sum()), spans_, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            if out:
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: len(out[0])]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c) for c in zip(*out)]], names=["id", *names])

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    told = sieved(own, spans, "row")
    marked = told.where("shared").join(spans, "row", "left").select("id", "text", "runs")
    untouched = told.where(~F.col("shared")).select("id", "text")
    return marked.mapInArrow(run, schema).unionByName(untouched.mapInArrow(run, schema)).withColumnRenamed("id", id)
