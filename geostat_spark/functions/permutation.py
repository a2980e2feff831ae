"""Pseudo-random bijections and draws that any engine with 64-bit integers can repeat.

A permutation of 0..n-1 is a Feistel network over the pairs (l, r) of an a x b grid with a * b >= n, walked on until it
lands below n. Any index is mapped alone: nothing is sorted, stored or shipped.
"""

from __future__ import annotations

import math

import numpy as np

# A Mersenne prime and two multipliers of full period modulo it.
PRIME, FIRST, SECOND = 2147483647, 48271, 69621
ROUNDS = 10


def mixed(x, key):
    """31 pseudo-random bits of a non-negative x below 2**62 and a key below 2**31; numbers or arrays."""
    x = (x + key) % PRIME * FIRST % PRIME
    x = x ^ (x >> 16)
    x = (x * SECOND + key) % PRIME
    return x ^ (x >> 13)


def round_key(seed: int, number, turn: int):
    return mixed(mixed(number + 1, seed + 1), turn + 1)


def grid_sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def permuted(index: np.ndarray, n: int, seed: int, number: np.ndarray | int) -> np.ndarray:
    """Image of ``index`` (0..n-1) under permutation ``number``."""
    a, b = grid_sides(n)
    index, number = np.asarray(index, np.int64), np.asarray(number, np.int64)
    shape = np.broadcast_shapes(index.shape, number.shape)
    out = np.broadcast_to(index, shape).ravel()  # a copy, but for an array that needs no broadcast
    out = out.copy() if np.shares_memory(out, index) else out
    # a key belongs to a permutation, so it is worked out before it meets the places
    keys = [np.broadcast_to(round_key(seed, number, turn), shape).ravel() for turn in range(ROUNDS)]
    todo = None
    while todo is None or len(todo):
        at = slice(None) if todo is None else todo
        left, right = out[at] // b, out[at] % b
        for turn, key in enumerate(keys):
            if turn % 2 == 0:
                left = (left + mixed(right, key[at])) % a
            else:
                right = (right + mixed(left, key[at])) % b
        out[at] = left * b + right
        todo = np.flatnonzero(out >= n) if todo is None else todo[out[todo] >= n]
    return out.reshape(shape)


def sources(left: np.ndarray, right: np.ndarray, n: int, seed: int, number: int) -> np.ndarray:
    """The indices that permutation ``number`` sends to the places left * b + right: the network run backwards. A turn adds
    one of few numbers, which are worked out once for all places."""
    a, b = grid_sides(n)
    sides = (np.arange(b, dtype=np.int64), a), (np.arange(a, dtype=np.int64), b)
    tables = [mixed(sides[turn % 2][0], round_key(seed, number, turn)) % sides[turn % 2][1] for turn in range(ROUNDS)]

    def back(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right, step = left.copy(), right.copy(), np.empty_like(left)
        for turn in reversed(range(ROUNDS)):
            moved, other, side = (left, right, a) if turn % 2 == 0 else (right, left, b)
            np.take(tables[turn], other, out=step, mode="clip")
            moved -= step
            np.right_shift(moved, 63, out=step)  # -1 below zero
            step &= side
            moved += step
        left *= b
        left += right
        return left

    out = back(left, right)
    todo = np.flatnonzero(out >= n)
    while len(todo):
        out[todo] = back(out[todo] // b, out[todo] % b)
        todo = todo[out[todo] >= n]
    return out


def drawn(n: int, k: int, seed: int, numbers: int) -> np.ndarray:
    """``numbers`` draws of k different values from 0..n-1, each set equally likely, by Floyd's method: for each j of
    the last k values a value up to j is drawn, and j itself is taken where that one has been."""
    out = np.empty((numbers, k), np.int64)
    which = np.arange(numbers, dtype=np.int64)
    for place, j in enumerate(range(n - k, n)):
        t = mixed(np.full(numbers, j, np.int64), round_key(seed, which, 77)) % (j + 1)
        taken = (out[:, :place] == t[:, None]).any(axis=1)
        out[:, place] = np.where(taken, j, t)
    return out


def mixed_sql(x: str, key: str) -> str:
    """``mixed`` as DuckDB SQL over BIGINT expressions."""
    first = f"(({x} + {key}) % {PRIME} * {FIRST} % {PRIME})"
    second = f"((xor({first}, {first} >> 16) * {SECOND} + {key}) % {PRIME})"
    return f"xor({second}, {second} >> 13)"


def round_key_sql(seed: int, number: str, turn: int) -> str:
    return mixed_sql(mixed_sql(f"({number} + 1)", str(seed + 1)), str(turn + 1))
