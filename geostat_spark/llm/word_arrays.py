"""Words of long texts as arrays of numbers, piece by piece, and hashes of their windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 22  # bytes whose words are Python objects at one time
REMEMBERED = 1 << 20  # distinct words a hasher keeps in mind

_space = re.compile(rb"[\x20\x09-\x0D]").search
ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
OTHER_ODD = np.uint64(0xD6E8FEB86659FD93)


def word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, each of about ``PIECE`` bytes: ``bytes.split`` parts at the same six characters."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            found = _space(data, end)
            end = found.start() if found else len(data)
        words = data[at:end].split() if at or end < len(data) else data.split()
        if words:
            yield words
        at = end


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """64-bit hashes of words, the same in every process; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 17)
        return found

    def of(self, data: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, words), np.uint64, len(words)) for words in word_pieces(data)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Windows:
    """Hashes of any stretch of a sequence of numbers, from sums of the numbers times powers of an odd base."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, numbers: np.ndarray, base: np.uint64 = ODD):
        self.up, down = self._powers(int(base), len(numbers) + 1)
        self.sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(mixed(numbers) * down[: len(numbers)], out=self.sums[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._tables or len(cls._tables[base][0]) < n:
            size = max(n, 1 << 16)
            tables = []
            for factor in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                tables.append(np.cumprod(steps, dtype=np.uint64))
            cls._tables[base] = (tables[0], tables[1])
        return cls._tables[base]

    def all(self, length: int) -> np.ndarray:
        """The hash of every stretch of ``length`` numbers."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[length:] - self.sums[:-length]) * self.up[:n])

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the stretches [begin, end)."""
        return mixed((self.sums[end] - self.sums[begin]) * self.up[begin])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.zeros(0, values.dtype)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of true values."""
    at = np.flatnonzero(marked)
    if not len(at):
        return at, at
    cuts = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate(([0], cuts + 1))], at[np.concatenate((cuts, [len(at) - 1]))] + 1
