"""Hashes of all words of a byte string at once.

A word's hash is a polynomial over its bytes modulo 2^64, each byte mapped to
a random odd number first, mixed at the end. The value depends on the word
alone, not on where it stands.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTES = np.random.default_rng(20).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True  # ASCII white space only
_BYTES[SPACE] = 0


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base, as many as asked for."""

    def __init__(self, base: int):
        self.base = np.uint64(base)
        self.table = np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.table):
            steps = np.full(max(n, 2 * len(self.table)), self.base)
            steps[0] = 1
            self.table = np.cumprod(steps, dtype=np.uint64)
        return self.table


_POWERS = Powers(0x9E3779B97F4A7C15)


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words among the bytes ``b``."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~SPACE[b]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, given the bounds of all words of ``b``."""
    if not len(starts):
        return np.empty(0, np.uint64)
    until = np.append(starts[1:], len(b))  # a word and the white space after it, which counts 0
    powers = _POWERS(int((until - starts).max()))
    place = np.arange(starts[0], len(b)) - np.repeat(starts, until - starts)
    sums = np.add.reduceat(_BYTES[b[starts[0]:]] * powers[place], starts - starts[0])
    return mix(sums + (ends - starts).astype(np.uint64))


def hashes_of(raw: bytes) -> np.ndarray:
    """Hash of each word of ``raw``, in order."""
    b = np.frombuffer(raw, np.uint8)
    return word_hashes(b, *word_bounds(b))


GROUP_BYTES = 1 << 18  # texts hashed together: arrays that stay in the cache


def groups(raws: list[bytes]):
    """Lists of neighbouring byte strings of about GROUP_BYTES."""
    held, size = [], 0
    for raw in raws:
        held.append(raw)
        size += len(raw)
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def hashes_by_text(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and how many each text has."""
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for group in groups(raws):
        b = np.frombuffer(b"\n".join(group), np.uint8)
        starts, ends = word_bounds(b)
        hashes.append(word_hashes(b, starts, ends))
        after = np.cumsum([len(raw) + 1 for raw in group])
        counts.append(np.bincount(np.searchsorted(after, starts, "right"), minlength=len(group)))
    return np.concatenate(hashes), np.concatenate(counts)
