"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.session import cut

# Byte of each A-Z to its small letter; the white space bytes.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_SPACE = np.isin(np.arange(256), (0x20, 9, 10, 11, 12, 13))
END = np.uint64(0x5851F42D4C957F2D)  # the hash that stands for the end of a text, and for its start as context
ODD = np.uint64(0x9E3779B97F4A7C15)
SLICE = 32 << 20  # bytes of a filter too large to broadcast that one task holds
QUESTIONS = 1 << 20  # n-grams that a task looks up at a time


@dataclass
class Settings:
    """``bits_per_entry`` of the filter for each (n-gram, level), at every size; ``most_filter_bytes`` bounds the
    broadcast: a larger filter stays in its table, and the n-grams of the texts are shuffled to its slices.
    ``hot_words`` bounds the exact counts that are broadcast; all other words are counted and joined by shuffle."""

    base: float = 2.0
    probes: int = 3
    bits_per_entry: int = 8
    most_filter_bytes: int = 64 << 20
    hot_words: int = 300_000
    weight: float = 5.0
    bytes_per_part: int = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * ODD)


def token_hashes(data: bytes, table: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every token of a UTF-8 text, A-Z lowered, the end token last.

    ``powers``: odd multipliers by place in the word; words longer than that start over with a changed sum."""
    raw = np.frombuffer(data.translate(LOWER_BYTES), np.uint8)
    inside = ~IS_SPACE[raw]
    if not inside.any():
        return np.array([END], np.uint64)
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & ~after) + 1
    sizes = ends - starts
    at = np.flatnonzero(inside)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    rounds = (place // len(powers)).astype(np.uint64)
    sums = np.add.reduceat((table[raw[at]] + rounds * ODD) * powers[place % len(powers)], firsts)
    return np.append(mixed(sums + sizes.astype(np.uint64) * ODD), END)


def _powers(n: int = 4096) -> np.ndarray:
    out = np.full(n, 0xD6E8FEB86659FD93, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """The hash of each token together with the one before it; the first follows the end token."""
    context = np.concatenate(([END], tokens[:-1]))
    return mixed(context * ODD + tokens + np.uint64(1))


def _text_bytes(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.binary()):
        yield text.as_py() or b""


def _groups(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[list[bytes]]:
    """Texts in groups of about ``most`` bytes."""
    held, size = [], 0
    for data in _text_bytes(batch):
        held.append(data)
        size += len(data)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def n_gram_counts(texts: DataFrame, parts: int) -> DataFrame:
    """(hash, pair, part, n): counts of single tokens (pair false) and of pairs, summed within groups of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, powers = _table(), _powers()
        for batch in batches:
            for group in _groups(batch):
                tokens = [token_hashes(d, table, powers) for d in group]
                for pair, all_ in ((False, tokens), (True, [pair_hashes(t) for t in tokens])):
                    grams, n = np.unique(np.concatenate(all_), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), pair)),
                            pa.array(_part_of(grams, parts).astype(np.int32)), pa.array(n.astype(np.int32)),
                        ],
                        names=["hash", "pair", "part", "n"],
                    )

    return texts.select("text").mapInArrow(run, "hash long, pair boolean, part int, n int")


def _part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return (grams >> np.uint64(40)) % np.uint64(parts)


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    """The quantised count: 1 + the whole part of its logarithm."""
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def middle(level: np.ndarray, base: float) -> np.ndarray:
    """The count that a level stands for; 0 for level 0."""
    return np.where(level > 0, (base ** (level - 1.0) + base ** level - 1) / 2, 0.0)


def _places(grams: np.ndarray, level: int, probe: int) -> np.ndarray:
    return mixed(grams + np.uint64(((level * 64 + probe + 1) * int(ODD)) & 0xFFFFFFFFFFFFFFFF))


def _segment(grams: np.ndarray, counts: np.ndarray, settings: Settings, bits_per_entry: float) -> np.ndarray:
    """The bits of one part's n-grams: each is entered once for every level up to its own."""
    height = levels(counts, settings.base)
    bits = max(64, int(math.ceil(height.sum() * bits_per_entry / 64)) * 64)
    flags = np.zeros(bits, bool)
    for level in range(1, int(height.max(initial=0)) + 1):
        reached = grams[height >= level]
        for probe in range(settings.probes):
            flags[(_places(reached, level, probe) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


class Filter:
    """All parts' bits in one array; ``level_of`` finds quantised counts by repeated membership probes."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, probes: int, most_level: int):
        self.bytes, self.sizes = bits, sizes
        self.begin = np.cumsum(sizes) - sizes
        self.bits = (sizes * 8).astype(np.uint64)
        self.probes, self.most_level = probes, most_level

    def level_of(self, grams: np.ndarray) -> np.ndarray:
        """The highest level of which, and of all below, every probe is set; 0 for unseen n-grams."""
        found = np.zeros(len(grams), np.int64)
        open_ = np.arange(len(grams))
        part = _part_of(grams, len(self.bits)).astype(np.int64)
        for level in range(1, self.most_level + 1):
            for probe in range(self.probes):
                if not len(open_):
                    return found
                bits = self.bits[part[open_]]
                at = (_places(grams[open_], level, probe) % bits).astype(np.int64)
                set_ = (self.bytes[self.begin[part[open_]] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1
                open_ = open_[set_ == 1]
            found[open_] = level
        return found


@dataclass
class Segments:
    """A filter too large for one broadcast: (part, bits) as a table, a slice being ``per_slice`` parts."""

    table: DataFrame
    parts: int
    per_slice: int
    probes: int
    most_level: int


@dataclass
class Model:
    filter: Filter | Segments
    hot: np.ndarray  # sorted hashes of the most frequent words
    hot_counts: np.ndarray
    tokens: int
    distinct: int
    settings: Settings

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def score(self, tokens: np.ndarray, pairs: np.ndarray, found: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each token after the one before it; ``tokens`` are whole texts, ends included.

        Counts come from the filter, or from ``found``: the levels of the distinct tokens, then of the distinct
        pairs. A pair's estimate is its count over its context's, smoothed towards the single token's, which
        carries ``weight`` counts."""
        s = self.settings
        words, place = np.unique(tokens, return_inverse=True)
        both, at = np.unique(pairs, return_inverse=True)
        if found is None:
            found = np.concatenate([self.filter.level_of(words), self.filter.level_of(both)])
        count = middle(found[: len(words)], s.base)
        single = ((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))[place]
        context = count[place]
        context = np.concatenate((count[words == END], context[:-1]))
        joint = np.minimum(middle(found[len(words) :], s.base)[at], context)
        return np.log10((joint + s.weight * single) / (context + s.weight))


def train(texts: DataFrame, settings: Settings) -> tuple[Model, DataFrame]:
    """The model of a table with a ``text`` column, and (hash, c) with the exact counts of all tokens.

    One shuffle brings each n-gram's counts together; a part of the filter is built where they meet."""
    total = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(1, -(-total // settings.bytes_per_part))
    counted = n_gram_counts(texts, parts).repartitionById(parts, "part")  # one part a task, so that sorts stay small
    kind = "part int, bits binary, entries long, most int, hashes array<long>, counts array<long>"

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        grams, place = np.unique(rows.column("hash").to_numpy().view(np.uint64), return_inverse=True)
        n = np.zeros(len(grams), np.int64)
        np.add.at(n, place, rows.column("n").to_numpy())
        single = np.zeros(len(grams), bool)
        single[place] = ~rows.column("pair").to_numpy()
        return pa.table(
            {
                "part": pa.array([key[0].as_py()], pa.int32()),
                "bits": pa.array([_segment(grams, n, settings, settings.bits_per_entry).tobytes()], pa.binary()),
                "entries": pa.array([int(levels(n, settings.base).sum())], pa.int64()),
                "most": pa.array([int(levels(n, settings.base).max(initial=0))], pa.int32()),
                "hashes": pa.array([grams[single].view(np.int64)], pa.list_(pa.int64())),
                "counts": pa.array([n[single]], pa.list_(pa.int64())),
            }
        )

    built = cut(counted.groupBy("part").applyInArrow(build, kind))
    known = cut(built.select(F.explode(F.arrays_zip("hashes", "counts")).alias("w")).select(F.col("w.hashes").alias("hash"), F.col("w.counts").alias("c")))
    whole = known.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    length = F.octet_length("bits")
    size = built.agg(F.max("most").alias("most"), F.sum(length).alias("all"), F.max(length).alias("largest")).first()
    most = size["most"] or 0
    hot = _hot_words(known, settings.hot_words)
    if (size["all"] or 0) > settings.most_filter_bytes:
        per_slice = max(1, min(settings.most_filter_bytes, SLICE) // size["largest"])
        filter_ = Segments(built.select("part", "bits"), parts, per_slice, settings.probes, most)
    else:
        segments = {r["part"]: np.frombuffer(r["bits"], np.uint8) for r in built.select("part", "bits").toLocalIterator()}
        filter_ = _joined(segments, range(parts), parts, settings.probes, most)
    model = Model(filter_, *hot, whole["n"] or 0, whole["v"], settings)
    return model, known


def _joined(segments: dict[int, np.ndarray], wanted: range, parts: int, probes: int, most_level: int) -> Filter:
    """The filter of the ``wanted`` ones of all ``parts``; those without a segment have no n-grams."""
    empty = np.zeros(8, np.uint8)
    found = [segments.get(p, empty) for p in wanted]
    sizes = np.zeros(parts, np.int64)
    sizes[wanted.start : wanted.stop] = [len(f) for f in found]
    return Filter(np.concatenate(found), sizes, probes, most_level)


def _hot_words(known: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, at most ``most``: those above a power-of-two count."""
    by_level = sorted(
        ((r["level"], r["n"]) for r in known.groupBy(F.floor(F.log2(F.col("c") + F.lit(0.5))).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()),
        reverse=True,
    )
    least, taken = None, 0
    for level, n in by_level:
        if taken + n > most:
            break
        least, taken = level, taken + n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = known.where(F.floor(F.log2(F.col("c") + F.lit(0.5))) >= least).toPandas()
    hashes = rows["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["c"].to_numpy(np.int64)[order]


def _slices_of(tokens: np.ndarray, pairs: np.ndarray, parts: int, per_slice: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, their slices, order by slice) of the distinct tokens, then the distinct pairs."""
    grams = np.concatenate([np.unique(tokens), np.unique(pairs)])
    slices = (_part_of(grams, parts) // np.uint64(per_slice)).astype(np.int32)
    return grams, slices, np.argsort(slices, kind="stable")


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``number`` of their group of about 2 MB of text, and ``place`` in it."""
    names = [*rows.columns, "number", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for group in _groups(batch):
                n = len(group)
                more = [pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.slice(done, n).columns, *more], names=names)
                done += n
                number += 1

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, number long, place int")


def _asked(numbered: DataFrame, parts: int, per_slice: int) -> DataFrame:
    """(slice, number, first, data): the distinct n-grams of each piece of a group, by slice of the filter.

    A piece begins at place ``first`` and holds what one scan has of the group; a file's edge may cut a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, powers = _table(), _powers()
        held, number, first = [], None, 0

        def answer() -> pa.RecordBatch:
            each = [token_hashes(d, table, powers) for d in held]
            grams, slices, order = _slices_of(np.concatenate(each), np.concatenate([pair_hashes(t) for t in each]), parts, per_slice)
            there, at = np.unique(slices[order], return_index=True)
            data = [part.tobytes() for part in np.split(grams[order], at[1:])]
            n = len(there)
            return pa.RecordBatch.from_arrays(
                [pa.array(there), pa.array(np.full(n, number)), pa.array(np.full(n, first, np.int32)), pa.array(data, pa.binary())],
                names=["slice", "number", "first", "data"],
            )

        for batch in batches:
            for text, k, place in zip(_text_bytes(batch), batch.column("number").to_pylist(), batch.column("place").to_pylist()):
                if held and (k != number or place != first + len(held)):
                    yield answer()
                    held = []
                if not held:
                    number, first = k, place
                held.append(text)
        if held:
            yield answer()

    return numbered.select("text", "number", "place").mapInArrow(run, "slice int, number long, first int, data binary")


def _looked_up(asked: DataFrame, segments: Segments) -> DataFrame:
    """(number, first, slice, data): the levels of the n-grams asked for, a byte each, in the order asked.

    Bits and questions meet by slice, the bits first; a task holds one slice and answers as questions pass."""
    parts, per_slice, probes, most = segments.parts, segments.per_slice, segments.probes, segments.most_level
    names = ["slice", "kind", "number", "first", "data"]
    bits = segments.table.select(
        (F.col("part") / per_slice).cast("int").alias("slice"), F.lit(0).alias("kind"), F.col("part").cast("long").alias("number"),
        F.lit(0).alias("first"), F.col("bits").alias("data"),
    )
    both = bits.unionByName(asked.withColumn("kind", F.lit(1)).select(*names))
    n_slices = -(-parts // per_slice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, found, filter_ = None, {}, None
        for batch in batches:
            slices, kinds, numbers = (batch.column(c).to_numpy() for c in ("slice", "kind", "number"))
            firsts, data = batch.column("first").to_numpy(), batch.column("data")
            at = 0
            while at < len(slices):
                if slices[at] != slice_:
                    slice_, found, filter_ = slices[at], {}, None
                if kinds[at] == 0:
                    found[int(numbers[at])] = np.frombuffer(data[at].as_py(), np.uint8)
                    at += 1
                    continue
                if filter_ is None:
                    first = int(slice_) * per_slice
                    filter_ = _joined(found, range(first, min(first + per_slice, parts)), parts, probes, most)
                    found = {}
                grams, end, size = [], at, 0
                while end < len(slices) and slices[end] == slice_ and size < QUESTIONS:
                    grams.append(np.frombuffer(data[end].as_py(), np.uint64))
                    size += len(grams[-1])
                    end += 1
                levels_ = filter_.level_of(np.concatenate(grams)).astype(np.uint8)
                edges = np.cumsum([len(g) for g in grams])[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers[at:end]), pa.array(firsts[at:end]), pa.array(slices[at:end]),
                        pa.array([x.tobytes() for x in np.split(levels_, edges)], pa.binary()),
                    ],
                    names=["number", "first", "slice", "data"],
                )
                at = end

    met = both.repartition(n_slices, "slice").sortWithinPartitions("slice", "kind")
    return met.mapInArrow(run, "number long, first int, slice int, data binary")


def _score_texts(rows: DataFrame, model: Model) -> DataFrame:
    """(row, id, held_out, n_tokens, hot_known, hot_base, score, rare, times): one row per text of (id, held_out,
    text), with the words whose exact counts are yet to be joined."""
    f = model.filter
    sliced = isinstance(f, Segments)
    # Plain values, so that a worker needs no import to read them; their sizes are bounded by the settings.
    shared = rows.sparkSession.sparkContext.broadcast(
        (
            None if sliced else (f.bytes, f.sizes, f.probes, f.most_level),
            (model.hot, model.hot_counts, model.tokens, model.distinct), asdict(model.settings),
        )
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, hot_known long, hot_base double, score double, rare array<long>, times array<int>"
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def scorer():
        filter_, values, settings = shared.value
        m = Model(Filter(*filter_) if filter_ else None, *values, Settings(**settings))
        table, powers = _table(), _powers()

        def scored_group(row: int, group: list[bytes], ids: pa.Array, held_out: pa.Array, levels_of=None) -> pa.RecordBatch:
            each = [token_hashes(d, table, powers) for d in group]
            sizes = np.array([len(t) for t in each])
            tokens, pairs = np.concatenate(each), np.concatenate([pair_hashes(t) for t in each])
            scored = m.score(tokens, pairs, levels_of(tokens, pairs) if levels_of else None)
            firsts = np.cumsum(sizes) - sizes
            spot = np.searchsorted(m.hot, tokens)
            spot[spot == len(m.hot)] = 0
            hot = (m.hot[spot] == tokens) if len(m.hot) else np.zeros(len(tokens), bool)
            value = np.where(hot, m.log_base(m.hot_counts[spot]) if len(m.hot) else 0.0, 0.0)
            ends = firsts + sizes
            rare = [np.unique(tokens[a:b][~hot[a:b]], return_counts=True) for a, b in zip(firsts, ends)]
            columns = [
                np.arange(row, row + len(group)), held_out, sizes,
                np.add.reduceat(hot.astype(np.int64), firsts), np.add.reduceat(value, firsts), np.add.reduceat(scored, firsts),
                [h.view(np.int64) for h, _ in rare], [n.astype(np.int32) for _, n in rare],
            ]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)]
            arrays.insert(1, ids)
            return pa.RecordBatch.from_arrays(arrays, names=[part.split()[0] for part in schema.split(", ")])

        return scored_group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored_group = scorer()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for group in _groups(batch):
                n = len(group)
                yield scored_group(row, group, batch.column("id").slice(done, n), batch.column("held_out").slice(done, n))
                done += n
                row += n

    if not sliced:
        return rows.mapInArrow(run, schema)
    parts, per_slice = f.parts, f.per_slice

    def run_answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group: the answers in order of piece and slice, then the texts by place."""
        scored_group = scorer()
        row = TaskContext.get().partitionId() << 40
        held, number = [], None

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal row
            whole = pa.Table.from_batches(held).combine_chunks()
            is_text = whole.column("kind").to_numpy() == 1
            first, data = whole.column("place").to_numpy(), whole.column("data")
            n_answers = int(np.count_nonzero(~is_text))
            pieces = np.unique(first[:n_answers], return_index=True)
            ends = np.append(pieces[1][1:], n_answers)
            texts = whole.slice(n_answers)
            for begin, a, b, stop in zip(pieces[0], pieces[1], ends, [*pieces[0][1:], texts.num_rows]):
                got = np.concatenate([np.frombuffer(data[k].as_py(), np.uint8) for k in range(a, b)])

                def levels_of(tokens: np.ndarray, pairs: np.ndarray) -> np.ndarray:
                    _, _, order = _slices_of(tokens, pairs, parts, per_slice)
                    out = np.empty(len(order), np.int64)
                    out[order] = got
                    return out

                some = texts.slice(begin, stop - begin).combine_chunks()
                column = lambda c: pa.concat_arrays(some.column(c).chunks)
                yield scored_group(row, [t.as_py() for t in some.column("data")], column("id"), column("held_out"), levels_of)
                row += some.num_rows

        for batch in batches:
            numbers = batch.column("number").to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1), len(numbers)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and numbers[a] != number:
                    yield from answer()
                    held = []
                number = numbers[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from answer()

    numbered = cut(_numbered(rows))
    levels_ = _looked_up(_asked(numbered, parts, per_slice), f).select(
        "number", F.lit(0).alias("kind"), F.col("first").alias("place"), "slice",
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("boolean").alias("held_out"), "data",
    )
    texts = numbered.select(
        "number", F.lit(1).alias("kind"), "place", F.lit(0).alias("slice"), "id", "held_out", F.col("text").cast("binary").alias("data")
    )
    met = levels_.unionByName(texts).repartition("number").sortWithinPartitions("number", "kind", "place", "slice")
    return met.mapInArrow(run_answered, schema)


def score_documents(
    docs: DataFrame, held_out: Column | None = None, id: str = "doc_id", text: str = "text", settings: Settings | None = None
) -> DataFrame:
    """One row per document: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from the rows that ``held_out`` leaves and scores all. ``score`` is the log10 probability of the text's
    tokens, its end included, under pairs of tokens with counts from the filter; ``base_score`` uses exact single
    counts. Tokens are told apart by 64-bit hashes.

    Null, empty and blank texts have the end token alone. A null ``held_out`` counts as false. Null ids and
    repeated rows are documents of their own. With nothing to learn from all counts are 0 and ``base_score`` is
    that of an empty model. Other columns are ignored. No rows give no rows."""
    settings = settings or Settings()
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id).alias("id"), out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    model, known = train(rows.where(~F.col("held_out")), settings)
    scored = cut(_score_texts(rows, model))
    rest = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("hash"), "w.times")
    total = F.lit(model.tokens + 0.5 * (model.distinct + 1))
    joined = rest.join(known, "hash", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / total)).alias("rare_base"),
    )
    return scored.join(sums, "row", "left").select(
        F.col("id").alias(id), "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
