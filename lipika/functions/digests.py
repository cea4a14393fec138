"""MD5 of many short numbered texts at once: what a hash order of units needs, without a call a text."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_MASK = (1 << 32) - 1
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [np.uint32(s) for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in row]
_BACK = [np.uint32(32 - s) for s in _TURNS]
#: Which of a block's 16 words a step takes.
_TAKES = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
#: Texts that go through the steps together.
TILE = 1 << 16


def _mixed(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    """The round's function of three words; at most three passes over them."""
    if i < 16:
        np.bitwise_and(np.bitwise_xor(c, d, out=out), b, out=out)
        np.bitwise_xor(out, d, out=out)
    elif i < 32:
        np.bitwise_and(np.bitwise_xor(b, c, out=out), d, out=out)
        np.bitwise_xor(out, c, out=out)
    elif i < 48:
        np.bitwise_xor(np.bitwise_xor(b, c, out=out), d, out=out)
    else:
        np.bitwise_or(np.invert(d, out=out), b, out=out)
        np.bitwise_xor(out, c, out=out)


def _leading(words: list[int | np.ndarray]) -> np.ndarray:
    """The digests' first 32 bits as numbers; a word of the blocks is an array, or a number where all have the same.

    The first word is done after 61 of the 64 steps.
    """
    a, b, c, d = (np.full(next(w.size for w in words if isinstance(w, np.ndarray)), x, np.uint32) for x in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(61):
        _mixed(i, b, c, d, f)
        w = words[_TAKES[i]]
        if isinstance(w, np.ndarray):
            np.add(f, w, out=f)
            w = 0
        np.add(f, np.uint32(_SINES[i] + w & _MASK), out=f)
        np.add(f, a, out=f)
        np.left_shift(f, _TURNS[i], out=turned)
        np.bitwise_or(np.right_shift(f, _BACK[i], out=f), turned, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return np.add(b, np.uint32(_START[0]), out=b).byteswap(inplace=True)


def _of_equal_length(lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(digits, from, to): the numbers from ``lo`` to below ``hi``, those of as many digits together."""
    while lo < hi:
        end = min(hi, 10 ** len(str(lo)))
        yield len(str(lo)), lo, end
        lo = end


def _digit_words(numbers: np.ndarray, digits: int, at: int) -> dict[int, np.ndarray]:
    """The words of a block to which the digits of ``numbers`` from byte ``at`` on belong."""
    words: dict[int, np.ndarray] = {}
    for j in range(digits):
        k, byte = divmod(at + j, 4)
        words[k] = words.get(k, 0) | (numbers // 10 ** (digits - 1 - j) % 10 + 48).astype(np.uint32) << np.uint32(8 * byte)
    return words


def leading_bits(seed: str, first: int, last: int, n: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows, columns, tile): the first 32 bits of MD5 of ``seed|draw|i``, a row for each draw from ``first`` to below ``last``, a column for each i from 1 to ``n``."""
    head = f"{seed}|".encode()
    for k, a, b in _of_equal_length(first, last):
        for m, lo, hi in _of_equal_length(1, n + 1):
            size, mid = len(head) + k + 1 + m, len(head) + k
            if size > 55:
                raise ValueError("seed, draw and number must fit one block of MD5")
            block = bytearray(64)
            block[: len(head)], block[mid], block[size], block[56:] = head, ord("|"), 0x80, (8 * size).to_bytes(8, "little")
            same = np.frombuffer(bytes(block), "<u4").tolist()
            wide = min(hi - lo, TILE)
            high = max(1, TILE // wide)
            for d in range(a, b, high):
                draws = np.arange(d, min(b, d + high))[:, None]
                of_draw = _digit_words(draws, k, len(head))
                for i in range(lo, hi, wide):
                    numbers = np.arange(i, min(hi, i + wide))
                    of_number = _digit_words(numbers, m, mid + 1)
                    words = [w if j not in of_draw and j not in of_number else np.broadcast_to(np.uint32(w) | of_draw.get(j, np.uint32(0)) | of_number.get(j, np.uint32(0)), (len(draws), len(numbers))).ravel() for j, w in enumerate(same)]
                    yield slice(d - first, d - first + len(draws)), slice(i - 1, i - 1 + len(numbers)), _leading(words).reshape(len(draws), len(numbers))


def hash_orders(seed: str, first: int, last: int, n: int) -> np.ndarray:
    """A row for each draw from ``first`` to below ``last``: the places 0..n-1 of the numbers 1..n by MD5 of ``seed|draw|number``.

    32 bits of the digest are sorted together with the place; where they are
    equal, whole digests decide.
    """
    keys = np.empty((last - first, n), np.uint64)
    for rows, columns, tile in leading_bits(seed, first, last, n):
        np.left_shift(tile, np.uint64(32), out=keys[rows, columns], dtype=np.uint64)
        keys[rows, columns] |= np.arange(columns.start, columns.stop, dtype=np.uint64)
    keys.sort(axis=1)
    bits = keys.view(np.uint32)[:, int(np.little_endian) :: 2]
    equal = bits[:, 1:] == bits[:, :-1]
    order = np.bitwise_and(keys, np.uint64(_MASK), out=keys).view(np.int64)
    for r in np.flatnonzero(equal.any(axis=1)):
        at = np.flatnonzero(np.r_[equal[r], False] | np.r_[False, equal[r]])
        order[r, at] = sorted(order[r, at].tolist(), key=lambda k: (hashlib.md5(f"{seed}|{first + r}|{k + 1}".encode()).digest(), k))
    return order
