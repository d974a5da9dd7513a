"""Hashes of all words of many texts at once.

A byte's value times a power of its place is summed up along the texts, so a word's hash is the
difference of two sums, moved to place 0 (arithmetic modulo 2**64, where odd numbers have an inverse), and mixed.
It depends on the word's bytes alone, and costs no Python step for a word.
"""

from __future__ import annotations

import functools

import numpy as np

from .common import mix

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: ASCII letters to lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: White space as in the contracts' words ``[^\x20\x09-\x0D]+``.
WHITE = frozenset(b" \t\n\x0b\x0c\r")

_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of BASE and of its inverse, kept for the next call."""
    if len(_powers[0]) < n:
        for k, x in enumerate((BASE, INVERSE)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """folded: each byte's stand-in; between: the bytes (after folding) that no word has."""

    def __init__(self, folded: bytes = LOWER, between: frozenset[int] = WHITE):
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.value = values[np.frombuffer(folded, np.uint8)]
        self.gap = np.array([folded[c] in between for c in range(256)])
        if not self.gap[10]:
            raise ValueError("texts are joined by line ends, which must not be in a word")

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in a row, and how many each text has."""
        data = np.frombuffer(b"\n".join([b"", *(t or b"" for t in texts), b""]), np.uint8)
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        gap = self.gap[data]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        begins, ends = edges[::2], edges[1::2]
        up, down = powers(len(data))
        sums = self.value[data]
        sums *= up
        np.cumsum(sums, out=sums)
        hashes = mix((sums[ends - 1] - sums[begins - 1]) * down[begins])
        last = np.searchsorted(begins, np.cumsum(sizes + 1))
        return hashes, np.diff(last, prepend=0)


@functools.cache
def plain() -> Words:
    return Words()


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text in a row, in the words' order (a text of fewer words, but not none: one of all its
    words), and how many each text has."""
    factors = mix(np.arange(1, width + 2, dtype=np.uint64))
    ends = np.cumsum(counts)
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    if not len(hashes):
        return np.zeros(0, np.uint64), n
    total = hashes * factors[0]
    for k in range(1, min(width, len(hashes) + 1)):
        total[: len(hashes) - k] += hashes[k:] * factors[k]
    there = np.ones(len(hashes), bool)
    for k in range(1, min(width, len(hashes) + 1)):
        there[ends[counts >= k] - k] = False
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begins = ends[short] - counts[short]
        sums = counts[short].astype(np.uint64) * factors[width]
        for k in range(width - 1):
            more = counts[short] > k
            sums[more] += hashes[begins[more] + k] * factors[k]
        total[begins], there[begins] = sums, True
    return mix(total[there]), n


def distinct(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's part of ``flat`` sorted and without repeats, and how many it has left."""
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        if b - a > 1:
            flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[(ends - counts)[counts > 0]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], before[ends] - before[ends - counts]
