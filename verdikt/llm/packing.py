"""Packing of token ids into windows by non-negative least squares.

Each partition packs its own documents, block by block (about ``block`` ids), so nothing is shuffled and
memory is bounded.  Of a document, each whole window is a sequence by itself.  The rests of a block are
counted by length in classes of ``unit`` ids; combinations of up to three classes that fill a window are
enumerated; repeat counts x >= 0 that best reproduce the histogram (least squares) are solved,
rounded down to what is there, and built.  What remains is cut: it fills the gaps of at least
``least_cut`` ids that the built sequences have, then whole windows; the rest goes on to the next
block.  A partition's last ids are cut into sequences whose lengths are powers of two, which need no padding.

Defined cases: null text: the end id alone.  Repeated rows and null doc_ids are documents of their own.  No
rows: no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import lean

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@functools.cache
def combinations(units: int) -> np.ndarray:
    """One column for each multiset of one to three classes 1..units that sums to ``units``."""
    found = [(units,)] + [(a, units - a) for a in range(1, units // 2 + 1)]
    found += [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    out = np.zeros((units + 1, len(found)), np.float64)
    for k, combination in enumerate(found):
        for c in combination:
            out[c, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 with the least |ax - b|, by active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, goal = a.T @ a, a.T @ b
    slope = goal.copy()
    for _ in range(rounds):
        if free.all() or (top := np.where(free, -np.inf, slope)).max() <= 1e-7 * max(1.0, np.abs(goal).max()):
            break
        free[int(top.argmax())] = True
        while True:
            some = np.flatnonzero(free)
            new = np.linalg.solve(gram[np.ix_(some, some)] + 1e-9 * np.eye(len(some)), goal[some])
            if (new > 0).all():
                x[:] = 0
                x[some] = new
                break
            below = new <= 0
            old = x[some]
            step = np.min(old[below] / np.maximum(old[below] - new[below], 1e-12))
            x[some] = np.maximum(0, old + step * (new - old))
            free[some[(x[some] <= 1e-12) & below]] = False
            x[~free] = 0
            if not free.any():
                break
        slope = goal - gram @ x
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often to build each; histogram[c]: rests of class c."""
    table = combinations(len(histogram) - 1)
    used = np.flatnonzero((table[histogram == 0] == 0).all(axis=0))  # no class that is not there
    if not len(used):
        return []
    there = np.flatnonzero(histogram)
    x, left, out = nnls(table[np.ix_(there, used)], histogram[there].astype(float)), histogram.astype(np.int64), []
    for k in np.argsort(-x, kind="stable"):
        need = table[:, used[k]].astype(np.int64)
        n = min(int(x[k] + 1e-6), int((left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left -= n * need
            out.append((tuple(np.repeat(np.arange(len(need)), need).tolist()), n))
    return out


class Packer:
    """Takes blocks of documents and gives pieces: (doc, from, to, sequence, offset)."""

    def __init__(self, window: int = 2048, unit: int = 16, least_cut: int = 8):
        self.window, self.unit, self.least_cut = window, unit, least_cut
        self.sequence, self.rests = 0, []  # rests: (doc, from, to)

    def next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def add(self, documents: list[tuple[object, int]]):
        """documents: (doc, number of ids)."""
        classes: list[list] = [[] for _ in range(self.window // self.unit + 1)]
        for doc, n in documents:
            for k in range(0, n - self.window + 1, self.window):
                yield doc, k, k + self.window, self.next(), 0
            if rest := n % self.window:
                classes[-(-rest // self.unit)].append((doc, n - rest, n))
        gaps = []
        for combination, times in plan(np.array([len(c) for c in classes])):
            for _ in range(times):
                sequence, offset = self.next(), 0
                for c in combination:
                    doc, a, b = classes[c].pop()
                    yield doc, a, b, sequence, offset
                    offset += b - a
                if self.window - offset >= self.least_cut:
                    gaps.append((sequence, offset))
        self.rests += [x for c in reversed(classes) for x in c]
        for sequence, offset in gaps:
            yield from self.fill(sequence, offset, self.window - offset)
        left, k = sum(b - a for _, a, b in self.rests), 0
        while left >= self.window:
            yield from self.fill(self.next(), 0, self.window)
            left -= self.window

    def fill(self, sequence: int, offset: int, n: int):
        """Up to n ids of the rests, last first."""
        while n and self.rests:
            doc, a, b = self.rests.pop()
            take = min(n, b - a)
            yield doc, a, a + take, sequence, offset
            if take < b - a:
                self.rests.append((doc, a + take, b))
            n, offset = n - take, offset + take

    def finish(self):
        left = sum(b - a for _, a, b in self.rests)
        while left:
            n = 1 << (left.bit_length() - 1)
            yield from self.fill(self.next(), 0, n)
            left -= n


def pack(documents: DataFrame, tokenizer: str, end: int, window: int = 2048, block: int = 4_000_000, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (``doc_id, text``); with_ids adds each piece's ids (binary, unsigned 32 bits, little-endian)."""

    def pieces(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, packer, store, have = TaskContext.get().partitionId() << 32, Packer(window), {}, []
        names = [x.split()[0] for x in PIECES.split(", ")]

        def rows(found):
            out = [[] for _ in names]
            raw = []
            for doc, a, b, sequence, offset in found:
                key, ids = store[doc]
                bits = ids[a:b].astype("<u4").tobytes()
                for column, x in zip(out, (key, a, b - a, zlib.crc32(bits), len(ids), base + sequence, offset)):
                    column.append(x)
                raw.append(bits)
            arrays = [pa.array(x, pa.int64()) for x in out] + ([pa.array(raw, pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        n = size = 0
        for keys, ids, at in bpe.documents_of(batches, tokenizer, end):
            for k, key in enumerate(keys):
                store[n] = (key, ids[at[k] : at[k + 1]].astype(np.uint32))
                have.append((n, int(at[k + 1] - at[k])))
                n += 1
            size += len(ids)
            if size >= block:
                yield rows(packer.add(have))
                store, have, size = {doc: store[doc] for doc, _, _ in packer.rests}, [], 0
        if have:
            yield rows(packer.add(have))
        yield rows(packer.finish())

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(pieces, keeps=True), PIECES + ", ids binary" * with_ids)
