"""Passages that an earlier document has too, found by windows at the places of a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.llm.exact_dedup import sieved
from geostat_spark.llm.word_arrays import ODD, OTHER_ODD, WordHashes, Windows, mixed, utf8, word_pieces
from geostat_spark.operators.attach import attach_counted
from geostat_spark.session import cut

# Perfect difference sets; every distance modulo the period is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
STRETCH = 1 << 18  # words whose windows are hashed at a time
MANY = 1 << 16  # words of short documents that are hashed together


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest period whose anchors, of ``length - period + 1`` words, have at least a third of the window."""
    periods = [v for v in COVERS if 3 * (length - v + 1) >= length]
    if not periods:
        raise ValueError("a window has at least 3 words")
    return max(periods), COVERS[max(periods)]


def _places(n: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    starts = (np.arange(0, n, period)[:, None] + np.array(sorted(cover))).reshape(-1)
    return starts[starts < n]


def _anchor_arrays(hashes: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, key, content) of the anchors of a document, in stretches; ``content``: of all windows around it."""
    period, cover = cover_for(length)
    reach, n = length - period + 1, len(hashes)
    around = period - 1  # words on either side that windows with this anchor reach
    if n < length:
        return
    at = _places(n - reach + 1, period, cover)
    for begin in range(0, n, STRETCH):
        own = at[np.searchsorted(at, begin) : np.searchsorted(at, begin + STRETCH)]
        if not len(own):
            continue
        low, high = max(0, begin - around), min(n, begin + STRETCH + reach + around)
        part = hashes[low:high]
        first, end = np.maximum(own - around, 0), np.minimum(own + reach + around, n)
        key = Windows(part).between(own - low, own - low + reach)
        yield own, key.view(np.int64), _surroundings(part, own, first, end, low, length)


def _surroundings(part: np.ndarray, own: np.ndarray, first: np.ndarray, end: np.ndarray, low, length: int) -> np.ndarray:
    """Hashes of the words [first, end) around the anchors ``own``, and of where they stand in them; ``low``: the place of
    ``part``'s first word."""
    content = Windows(part, OTHER_ODD).between(first - low, end - low)
    shape = ((own - first) * (4 * length) + (end - own)).astype(np.uint64)
    return mixed(content ^ mixed(shape * ODD)).view(np.int64)


def _anchors_of_many(documents: list[np.ndarray], length: int, with_content: bool) -> tuple[np.ndarray, ...]:
    """(document, place, key[, content]) of the anchors of documents of at most ``STRETCH`` words, all at a time: hashes of
    stretches do not depend on what stands before them."""
    period, cover = cover_for(length)
    reach, around = length - period + 1, period - 1
    sizes = np.array([len(d) for d in documents], np.int64)
    joined = np.concatenate(documents)
    at = _places(max(int(sizes.max()) - reach + 1, 0), period, cover)
    held = np.where(sizes >= length, np.searchsorted(at, sizes - reach + 1), 0)
    which = np.repeat(np.arange(len(documents)), held)
    own = at[np.arange(len(which)) - np.repeat(np.cumsum(held) - held, held)]
    low = -(np.cumsum(sizes) - sizes)[which]
    key = Windows(joined).between(own - low, own - low + reach).view(np.int64)
    if not with_content:
        return which, own, key
    first, end = np.maximum(own - around, 0), np.minimum(own + reach + around, sizes[which])
    return which, own, key, _surroundings(joined, own, first, end, low, length)


def _per_document(rows: DataFrame, of, fields: str, extra: tuple[str, ...] = (), of_many=None) -> DataFrame:
    """A row (id, mark, fields) for each element of the arrays that ``of(word hashes, extra values)`` yields; rows:
    (id, mark, text, extra). ``of_many(list of word hashes)``, if given, yields the same for many documents at a time, after
    the number of the document in the list."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "mark", *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            places: list[np.ndarray] = []
            found: list[tuple] = []
            size = 0
            waiting: list[np.ndarray] = []
            waiting_at: list[int] = []
            waiting_size = 0

            def answer() -> pa.RecordBatch:
                take = pa.array(np.concatenate(places))
                columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
                return pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("mark").take(take), *columns], names=names)

            def add_waiting() -> int:
                which, *arrays = of_many(waiting)
                places.append(np.array(waiting_at, np.int64)[which])
                found.append(tuple(arrays))
                return len(which)

            for place in range(batch.num_rows):
                hashes = memory.of(utf8(batch.column("text")[place].as_py()))
                if of_many is not None and len(hashes) <= STRETCH:
                    waiting.append(hashes)
                    waiting_at.append(place)
                    waiting_size += len(hashes)
                    if waiting_size >= MANY:
                        size += add_waiting()
                        waiting, waiting_at, waiting_size = [], [], 0
                else:
                    for arrays in of(hashes, *[batch.column(c)[place].values.to_numpy() for c in extra]):
                        if len(arrays[0]):
                            places.append(np.full(len(arrays[0]), place))
                            found.append(arrays)
                            size += len(arrays[0])
                if size > 100_000:
                    yield answer()
                    places, found, size = [], [], 0
            if waiting:
                size += add_waiting()
            if size:
                yield answer()

    return rows.mapInArrow(run, f"id {kind}, mark long, {fields}")


def _later(own: Column, least: Column) -> Column:
    """Whether an id is larger than the least of its group; null is larger than any other."""
    return F.coalesce(own > least, own.isNull() & least.isNotNull())


def anchors(rows: DataFrame, length: int = 50) -> DataFrame:
    """(id, mark, place, key): the anchors of every document with their hashes; rows: (id, mark, text)."""
    return _per_document(rows, lambda h: ((at, key) for at, key, _ in _anchor_arrays(h, length)), "place long, key long")


def _met(rows: DataFrame, length: int) -> DataFrame:
    """(id, mark, place, key, content): the anchors that documents of different ids share."""
    several = (F.min("id") < F.max("id")) | (F.max(F.col("id").isNull()) & F.min("id").isNotNull())
    keys = (
        _per_document(
            rows, lambda h: ((key,) for _, key, _ in _anchor_arrays(h, length)), "key long",
            of_many=lambda many: [a for i, a in enumerate(_anchors_of_many(many, length, False)) if i != 1],
        )
        .groupBy("key")
        .agg(several.alias("several"), F.count(F.lit(1)).alias("n"))
        .where("several")
        .select("key", "n")
    )
    keys = cut(keys)
    full = _per_document(
        rows, lambda h: _anchor_arrays(h, length), "place long, key long, content long",
        of_many=lambda many: _anchors_of_many(many, length, True),
    )
    return cut(full.join(keys.select("key"), "key", "left_semi").select("id", "mark", "place", "key", "content"))


def _same_document(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    named = b.withColumnRenamed("id", "_id").withColumnRenamed("mark", "_mark")
    return a.join(named, a["id"].eqNullSafe(named["_id"]) & (a["mark"] == named["_mark"]), how).drop("_id", "_mark")


def repeated_windows(rows: DataFrame, length: int = 50) -> DataFrame:
    """(id, mark, first, end): stretches of words of a document that windows of ``length`` words cover, each of
    which starts in a document of smaller id too. rows: (id, mark, text).

    Two equal windows agree, whatever their places, at one anchor of the cover: its words are equal and it stands
    at the same distance from both starts. Anchors of one document alone are dropped. The others are extended:
    those whose surroundings agree as far as any window reaches are one class, and but for the class's smallest id
    all its windows are covered. Between the classes of one anchor the windows themselves are compared, once for
    each class's smallest id. So a passage of m documents costs m rows, never pairs."""
    period, _ = cover_for(length)
    reach, around = length - period + 1, period - 1
    met = _met(rows, length)
    n_met = met.count()
    classes = cut(met.groupBy("key", "content").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n")).where("classes > 1")
    judged = attach_counted(met, classes, ["key", "content"], "n", "mark", n_met).drop("n")
    judged = cut(judged)
    whole = judged.where(_later(F.col("id"), F.col("least"))).select(
        "id", "mark", F.greatest(F.col("place") - around, F.lit(0)).alias("first"), (F.col("place") + reach + around).alias("end")
    )
    rest = judged.where(~_later(F.col("id"), F.col("least"))).drop("content", "least")
    open_ = attach_counted(rest, several.select("key", "classes", "n"), ["key"], "n", "mark", n_met).where("classes > 1")
    open_ = cut(open_.groupBy("id", "mark").agg(F.collect_set("place").alias("places")))
    texts = _same_document(sieved(rows, open_, "mark").where("shared").drop("shared"), open_, "inner")

    def starts(hashes: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        n = len(hashes)
        change = np.zeros(n + 2, np.int64)
        np.add.at(change, np.maximum(places - around, 0), 1)
        np.add.at(change, places + 1, -1)
        at = np.flatnonzero(np.cumsum(change[: max(n - length + 1, 0)]) > 0)
        for begin in range(0, n, STRETCH):
            own = at[np.searchsorted(at, begin) : np.searchsorted(at, begin + STRETCH)]
            if len(own):
                part = hashes[begin : begin + STRETCH + length]
                pair = (Windows(part, base).between(own - begin, own - begin + length).view(np.int64) for base in (ODD, OTHER_ODD))
                yield own, *pair

    compared = cut(_per_document(texts, starts, "first long, one long, other long", ("places",)))
    least = compared.groupBy("one", "other").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = attach_counted(compared, least, ["one", "other"], "n", "mark", compared.count()).where("n > 1")
    single = found.where(_later(F.col("id"), F.col("least"))).select("id", "mark", "first", (F.col("first") + length).alias("end"))
    return whole.unionByName(single)


def remove_earlier_passages(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50, with_text: bool = False
) -> DataFrame:
    """One row per document: the id, ``n_words``, ``n_removed``, ``kept_sha256`` and, ``with_text``, ``kept_text``.

    Removes each word that a window of ``length`` words covers whose words also start in a document of smaller id;
    all is judged on the input. Repeats within a document, and between rows of one id, stay. Words are compared as
    they are; the kept ones are joined by one space.

    Null, empty and blank texts have no words; texts of fewer words than a window keep all. A null id is larger than
    any other, and null ids are equal. Other columns are ignored. No rows give no rows. Documents are told apart by
    id and a 64-bit hash of the text, so rows that repeat both share their verdict; windows are compared by 128
    bits. A text is held whole and its words piece by piece, 8 bytes each as hashes."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).select("id", "mark", "text")
    spans = repeated_windows(rows, length).groupBy("id", "mark").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    spans = cut(spans)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def described(data: bytes, found) -> tuple:
        sha, at, removed, pieces = hashlib.sha256(), 0, 0, []
        change = None
        if found is not None:
            ends = found.values.flatten()
            change = np.zeros(int(ends[1].to_numpy().max()) + 1, np.int64)
            np.add.at(change, ends[0].to_numpy(), 1)
            np.add.at(change, ends[1].to_numpy(), -1)
            change = np.cumsum(change) > 0
        for words in word_pieces(data):
            kept = words
            if change is not None:
                gone = np.zeros(len(words), bool)
                own = change[at : at + len(words)]
                gone[: len(own)] = own
                kept = list(compress(words, (~gone).tolist()))
                removed += len(words) - len(kept)
            if kept:
                piece = (b" " if pieces else b"") + b" ".join(kept)
                pieces = [*pieces, piece] if with_text else [b""]
                sha.update(piece)
            at += len(words)
        return (at, removed, sha.hexdigest(), *([b"".join(pieces).decode("utf-8", "surrogatepass")] * with_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("spans") if "spans" in batch.schema.names else [None] * batch.num_rows
            out = [
                described(utf8(t.as_py()), s if s is not None and s.is_valid else None)
                for t, s in zip(batch.column("text"), found)
            ]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c) for c in zip(*out)]], names=names)

    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    told = sieved(rows, spans, "mark")
    marked = _same_document(told.where("shared").drop("shared"), spans, "left").select("id", "text", "spans")
    untouched = told.where(~F.col("shared")).select("id", "text")
    return marked.mapInArrow(run, schema).unionByName(untouched.mapInArrow(run, schema)).withColumnRenamed("id", id)
