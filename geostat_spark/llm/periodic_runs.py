"""Periodic runs of words, found by string synchronising sets at dyadic scales."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geostat_spark.llm.word_arrays import Windows, sliding_least, stretches, utf8, word_pieces

SMALL = 8  # periods up to here are found by comparing words at that distance
LEAST = 24  # words of the shortest run
GROUP = 1 << 17  # words of the documents that are searched together
NEVER = np.iinfo(np.uint64).max

Run = tuple[int, int, int]  # first word, end, period


class _Found:
    """Runs by place; of several periods of one stretch the smallest stays."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}

    def add(self, first: int, end: int, period: int) -> None:
        if end - first >= 3 * period and self.period.get((first, end), period) >= period:
            self.period[first, end] = period


def _small_periods(x: np.ndarray, found: _Found) -> None:
    for q in range(1, min(SMALL, len(x) // 3) + 1):
        first, end = stretches(x[q:] == x[:-q])
        long = end - first >= 2 * q
        for a, b in zip(first[long].tolist(), end[long].tolist()):
            found.add(a, b + q, q)


def synchronising_set(hashes: np.ndarray, tau: int, periodic: np.ndarray) -> np.ndarray:
    """Positions chosen by the ``2 * tau`` words that follow alone.

    ``hashes``: of every ``tau`` words; ``periodic``: which of these have a period of at most ``tau / 3``. A position
    is in the set when the least hash of the next ``tau + 1``, periodic ones left out, stands at their first or
    last. Any ``tau`` positions in a row hold one, unless the ``3 * tau - 1`` words from the first have a period of
    at most ``tau / 3``."""
    rated = np.where(periodic, NEVER, np.minimum(hashes, NEVER - np.uint64(1)))
    least = sliding_least(rated, tau + 1)
    n = len(least)
    return np.flatnonzero((least != NEVER) & ((least == rated[:n]) | (least == rated[tau : tau + n])))


def _extended(x: np.ndarray, first: int, end: int, period: int) -> tuple[int, int]:
    """The stretch of that period around one, as far as no neighbouring word can be added."""
    step = 64
    while end < len(x):
        block = x[end : end + step]
        same = block == x[end - period : end - period + len(block)]
        if not same.all():
            end += int(same.argmin())
            break
        end += len(block)
        step *= 4
    step = 64
    while first > 0:
        low = max(0, first - step)
        same = (x[low:first] == x[low + period : first + period])[::-1]
        if not same.all():
            first -= int(same.argmin())
            break
        first = low
        step *= 4
    return first, end


def _scale(x: np.ndarray, windows: Windows, top: int, found: _Found) -> None:
    """Runs of a period in (top / 2, top].

    With tau = top / 4, a run of three periods holds a synchronising position whose context (the 3 tau words from
    it for periods up to 3 tau, else 4 tau) lies in the run again one period on, and nowhere between, as the
    context is no shorter than the period. So positions of equal context that follow one another propose it."""
    tau = top // 4
    hashes = windows.all(tau)
    periodic = np.zeros(len(hashes) + 1, np.int64)
    for (first, end), period in found.period.items():
        if 3 * period <= tau and end - first >= tau:
            periodic[first] += 1
            periodic[end - tau + 1] -= 1
    positions = synchronising_set(hashes, tau, np.cumsum(periodic[:-1]) > 0)
    for low, high in ((2 * tau, 3 * tau), (3 * tau, 4 * tau)):
        at = positions[positions + high <= len(x)]
        context = windows.between(at, at + high)
        order = np.argsort(context, kind="stable")
        near = np.flatnonzero(context[order[1:]] == context[order[:-1]])
        begin = at[order[near]]
        period = at[order[near + 1]] - begin
        fits = (period > low) & (period <= high)
        begin, period = begin[fits], period[fits]
        order = np.lexsort((begin, period))
        begin, period = begin[order].tolist(), period[order].tolist()
        done = (0, 0)  # period and end of the last stretch looked at
        for a, p in zip(begin, period):
            if p == done[0] and a + p + high <= done[1]:
                continue
            if not np.array_equal(x[a : a + high], x[a + p : a + p + high]):
                continue  # equal hashes of different words
            first, end = _extended(x, a, a + p + high, p)
            done = (p, end)
            found.add(first, end, p)


def find_runs(x: np.ndarray, longest: int, least: int = LEAST) -> list[Run]:
    """The runs of a sequence of numbers with at least ``least`` elements and three periods, by place.

    ``longest``: no run is longer. Documents are searched together when numbers that occur once part them."""
    found = _Found()
    _small_periods(x, found)
    windows, top = Windows(x.astype(np.uint64)), 2 * SMALL
    while 3 * (top // 2 + 1) <= longest:
        _scale(x, windows, top, found)
        top *= 2
    return sorted((a, b, q) for (a, b), q in found.period.items() if b - a >= least)


Prepare = Callable[[object, np.ndarray], np.ndarray]


def _documents(batch: pa.RecordBatch, prepare: Prepare | None) -> Iterator[list[tuple[int, np.ndarray, dict]]]:
    """Groups of (place in the batch, word numbers, words by number), documents of like size together."""
    sizes = np.asarray([len(t.as_py() or "") for t in batch.column("text")])
    group, total = [], 0
    known: dict[bytes, int] = defaultdict(count().__next__)
    for place in np.argsort(sizes, kind="stable").tolist():
        data = utf8(batch.column("text")[place].as_py())
        parts = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in word_pieces(data)]
        numbers = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if prepare:
            numbers = numbers[prepare(batch.column("id")[place].as_py(), numbers)] if len(numbers) else numbers
        group.append((place, numbers))
        total += len(numbers)
        if total > GROUP:
            yield [(p, n, known) for p, n in group]
            group, total, known = [], 0, defaultdict(count().__next__)
    if group:
        yield [(p, n, known) for p, n in group]


def _group_runs(group: list[tuple[int, np.ndarray, dict]]) -> list[list[Run]]:
    """The runs of each document of a group; every document is followed by a number of its own."""
    least = -1 - len(group)
    parts = []
    for k, (_, numbers, _) in enumerate(group):
        parts += [numbers, np.array([least + k])]
    x = np.concatenate(parts)
    ends = np.cumsum([len(n) + 1 for _, n, _ in group])
    out: list[list[Run]] = [[] for _ in group]
    for a, b, q in find_runs(x, max(len(n) for _, n, _ in group)):
        k = int(np.searchsorted(ends, a, side="right"))
        base = int(ends[k - 1]) if k else 0
        out[k].append((a - base, b - base, q))
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay: those of no run, and of each run its first period unless another run drops it."""
    change = np.zeros(n + 1, np.int64)
    for a, b, q in runs:
        change[a + q] += 1
        change[b] -= 1
    return np.cumsum(change[:-1]) == 0


def _joined(words: list[bytes], numbers: np.ndarray, stays: np.ndarray | None) -> Iterator[bytes]:
    """The kept words with single spaces between, in pieces."""
    first = True
    for at in range(0, len(numbers), 1 << 16):
        piece = [words[i] for i in numbers[at : at + (1 << 16)].tolist()]
        if stays is not None:
            piece = list(compress(piece, stays[at : at + (1 << 16)].tolist()))
        if piece:
            yield (b"" if first else b" ") + b" ".join(piece)
            first = False


COLUMNS = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)


def periodic_runs(
    docs: DataFrame, id: str = "doc_id", text: str = "text", prepare: Prepare | None = None, with_text: bool = False
) -> DataFrame:
    """One row per document: the id, ``n_words``, ``n_runs``, the run of greatest length / period (``start``,
    ``length``, ``period``, ``exponent_milli``), ``runs_sha256``, ``collapsed_sha256`` and, ``with_text``,
    ``collapsed`` and ``runs`` (array of start, length, period).

    A run is a stretch of at least 24 words and three times its smallest period that no neighbouring word extends.
    The collapsed text leaves out what any run holds after its first period. Of equal exponents the run of smallest
    start, then period is given. ``prepare``: from a document's id and word numbers, the places of the words to take
    in their stead.

    Null, empty and blank texts have no words, no run (four nulls) and an empty collapsed text. Words are compared
    as they are. Null ids, repeated rows and other columns do not matter: every row stands for itself. No rows give
    no rows. A text's words are held as numbers: about 150 bytes a word of one text at a time."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for group in _documents(batch, prepare):
                words = list(group[0][2])
                for (place, numbers, _), runs in zip(group, _group_runs(group)):
                    stays = kept_words(len(numbers), runs) if runs else None
                    sha = hashlib.sha256()
                    pieces = []
                    for piece in _joined(words, numbers, stays):
                        sha.update(piece)
                        if with_text:
                            pieces.append(piece)
                    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs).encode()
                    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2])) if runs else None
                    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
                    row = (len(numbers), len(runs), *shown, hashlib.sha256(listed).hexdigest(), sha.hexdigest())
                    if with_text:
                        row += (b"".join(pieces).decode("utf-8", "surrogatepass"), [(a, b - a, q) for a, b, q in runs])
                    out[place] = row
            if out:
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                names = [c.split()[0] for c in COLUMNS.split(", ")]
                if with_text:
                    kinds += [pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))]
                    names += ["collapsed", "runs"]
                columns = [list(c) for c in zip(*out)]
                if with_text:
                    columns[-1] = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in columns[-1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["id", *names]
                )

    more = ", collapsed string, runs array<struct<start:long,length:long,period:long>>" if with_text else ""
    return rows.mapInArrow(run, f"id {kind}, {COLUMNS}{more}").withColumnRenamed("id", id)
