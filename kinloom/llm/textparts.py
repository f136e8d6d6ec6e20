"""Texts in parts of bounded size, and the words and word hashes of a part in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PART = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def parts(texts: list[str | None], size: int = PART) -> Iterator[list[tuple[int, str]]]:
    """Lists of (number of the text, text or a part of it) with about `size` characters each, in order.

    Long texts are cut behind white space where there is some, so every part is whole but for words longer than `size`.
    """
    held, n = [], 0
    for number, text in enumerate(texts):
        at, end = 0, len(text or "")
        while at < end:
            cut = end
            if end - at > size:
                cut = 1 + max(text.rfind(c, at, at + size) for c in " \n\t")
                cut = cut if cut > at else at + size
            held.append((number, text[at:cut]))
            n += cut - at
            at = cut
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def _power_tables(size: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        size = max(size, 2 * PART)
        inverse = pow(_MULTIPLIER, -1, 2**64)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, m, np.uint64)))) for m in (_MULTIPLIER, inverse)]
    return _powers


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    inside = np.concatenate(([False], ~IS_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial from sums over prefixes, mixed."""
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)))
    found = (sums[ends] - sums[starts]) * inverse[starts]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ found >> np.uint64(32)


def joined(part: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a part's texts, a line feed after each, and where each begins."""
    coded = [t.encode() for _, t in part]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
    return np.frombuffer(b"\n".join([*coded, b""]), np.uint8), np.cumsum(lengths) - lengths
