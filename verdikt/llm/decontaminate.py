"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the training documents' postings: a table of segments, each of which covers some
documents and has their terms (64-bit hashes, sorted), and for each term its positions, in order.
Positions run through a segment's documents with one left out between two, so no phrase crosses.

``search`` looks for windows of ``width`` consecutive words of benchmark items.  In each segment a
window's lists are intersected from the rarest term on, each moved by its offset, which gives exact
phrase matches.  With ``slack`` it also counts windows whose terms all lie within ``width + slack`` words of
the rarest one (proximity matches).  Segments are independent, so nothing of the corpus is shuffled.
The benchmark is the stated query set: it is taken in blocks of bounded size, one after the other.

Words: lower-case A-Z, runs of ASCII letters, digits and bytes above 127.

Defined cases: null or empty text: no words, no windows.  An item of fewer words than ``width``, but not
none, is one window.  Items with a null id count under an empty id; rows with one id are one item.
An empty benchmark hits nothing.  Documents with null or repeated ids are documents of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, split_near, work_path, written

KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT = "part int, segment int, doc_ids array<bigint>, begins binary, terms binary, firsts binary, positions binary"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(KEPT).split()


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def build_index(documents: DataFrame, path: str, segment_bytes: int = 8_000_000) -> None:
    """Store postings of ``doc_id, text`` at ``path``."""

    def segments(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, segment = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts, first = batch.column(0).to_pylist(), batch.column(1), 0
            while first < len(keys):
                last, size, some = first, 0, []
                while last < len(keys) and size < segment_bytes:
                    text = texts[last].as_py()
                    size += len(text or b"") + 64
                    some.append(hashes(words_of(text)))
                    last += 1
                n = np.array([len(x) for x in some], np.int64)
                begins = np.concatenate([[0], np.cumsum(n + 1)])
                all_terms = np.concatenate(some) if some else np.zeros(0, np.uint64)
                at = np.arange(len(all_terms)) + np.repeat(np.arange(len(n)), n)
                order = np.argsort(all_terms, kind="stable")
                terms, firsts = np.unique(all_terms[order], return_index=True)
                row = [part, segment, keys[first:last], begins.astype(np.uint32).tobytes(), terms.tobytes(), np.append(firsts, len(order)).astype(np.uint32).tobytes(), at[order].astype(np.uint32).tobytes()]
                kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64())] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [x.split()[0] for x in SEGMENT.split(", ")])
                first, segment = last, segment + 1

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows.mapInArrow(lean(segments), SEGMENT).write.parquet(path)


class Queries:
    """Windows of a block of items."""

    def __init__(self, items: list[tuple[str, bytes | None]], width: int):
        self.width = width
        windows: dict[tuple, set[str]] = {}
        for item, text in items:
            h = hashes(words_of(text)).tolist()
            for k in range(max(0, len(h) - width) + 1 if h else 0):
                windows.setdefault(tuple(h[k : k + width]), set()).add(item)
        self.windows, self.items = list(windows), [sorted(x) for x in windows.values()]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.terms = np.unique(np.array([t for w in self.windows for t in w], np.uint64))
        grid = np.zeros((len(self.windows), width), np.int64)
        for k, w in enumerate(self.windows):
            ids = np.searchsorted(self.terms, np.array(w, np.uint64))
            grid[k] = np.concatenate([ids, np.full(width - len(ids), ids[0])])
        self.grid = grid

    def search(self, terms: np.ndarray, firsts: np.ndarray, positions: np.ndarray, slack: int | None):
        """(window, positions where it begins), and for slack (window, positions of its rarest term)."""
        at = np.minimum(np.searchsorted(terms, self.terms), max(0, len(terms) - 1))
        there = terms[at] == self.terms if len(terms) else np.zeros(len(self.terms), bool)
        counts = np.where(there, firsts[np.minimum(at + 1, len(firsts) - 1)].astype(np.int64) - firsts[at], 0)
        found, near = [], []
        for k in np.flatnonzero(counts[self.grid].min(axis=1) > 0) if len(self.grid) else ():
            n = int(self.lengths[k])
            ids = self.grid[k, :n]
            order = np.argsort(counts[ids], kind="stable")
            lists = [positions[firsts[at[i]] : firsts[at[i] + 1]].astype(np.int64) for i in ids]
            starts = lists[order[0]] - order[0]
            for j in order[1:]:
                if not len(starts):
                    break
                p = np.minimum(np.searchsorted(lists[j], starts + j), len(lists[j]) - 1)
                starts = starts[lists[j][p] == starts + j]
            if len(starts):
                found.append((k, starts))
            if slack is not None:
                middle = lists[order[0]]
                for j in order[1:]:
                    p = np.searchsorted(lists[j], middle - (n - 1 + slack))
                    q = np.searchsorted(lists[j], middle + (n + slack), side="left")
                    middle = middle[q > p]
                if len(middle):
                    near.append((k, middle))
        return found, near


def blocks(benchmark: DataFrame, block_bytes: int):
    """Items of the benchmark, some MB at a time; an item's id as a string."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        yield [(r.item, bytes(r.text) if r.text is not None else None) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def search(documents_index: DataFrame, benchmark: DataFrame, width: int = 10, slack: int | None = None, block_bytes: int = 4_000_000) -> DataFrame:
    """Per document of the index: part, segment, place, doc_id, n_words, n_hit, items (sorted ids), n_near."""
    out = None
    for items in blocks(benchmark, block_bytes):
        one = matches(documents_index, Queries(items, width), slack)
        out = one if out is None else out.union(one)
    base = counted(documents_index)
    if out is None:
        return base.select("*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_near"))
    spans = F.sort_array(F.flatten(F.collect_list("spans")))
    merged = out.groupBy("part", "segment", "place").agg(spans.alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"))
    step = lambda a, s: F.struct(
        F.greatest(a["stop"], s["stop"]).alias("stop"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], a["stop"]))).alias("n")
    )
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n")), step)["n"]
    hits = merged.select("part", "segment", "place", covered.alias("n_hit"), "items", "n_near")
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "n_near": F.lit(0).cast("long")}
    return base.join(hits, ["part", "segment", "place"], "left").select("part", "segment", "place", "doc_id", "n_words", *[F.coalesce(c, x).alias(c) for c, x in none.items()])


def counted(index: DataFrame) -> DataFrame:
    """part, segment, place, doc_id, n_words of each document of the index."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                begins = np.frombuffer(r["begins"], np.uint32).astype(np.int64)
                n = len(begins) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["segment"], np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(r["doc_ids"], pa.int64()), pa.array(np.diff(begins) - 1)], ["part", "segment", "place", "doc_id", "n_words"])

    return index.select("part", "segment", "doc_ids", "begins").mapInArrow(lean(rows), "part int, segment int, place int, doc_id bigint, n_words bigint")


def matches(index: DataFrame, queries: Queries, slack: int | None) -> DataFrame:
    """Documents of the index with a match: merged spans of hit words, items, proximity matches."""

    def rows(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [("part", pa.int32()), ("segment", pa.int32()), ("place", pa.int32()), ("spans", span), ("items", pa.list_(pa.string())), ("n_near", pa.int64())]
        for batch in batches:
            for r in batch.to_pylist():
                begins = np.frombuffer(r["begins"], np.uint32).astype(np.int64)
                found, near = queries.search(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["firsts"], np.uint32), np.frombuffer(r["positions"], np.uint32), slack)
                docs: dict[int, list] = {}
                cover = np.zeros(int(begins[-1]) + queries.width + 1, np.int32)
                for k, starts in found:
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + queries.lengths[k], -1)
                    for d in np.unique(np.searchsorted(begins, starts, side="right") - 1).tolist():
                        docs.setdefault(d, [set(), 0])[0].update(queries.items[k])
                for k, middle in near:
                    for d, n in zip(*np.unique(np.searchsorted(begins, middle, side="right") - 1, return_counts=True)):
                        docs.setdefault(int(d), [set(), 0])[1] += int(n)
                hit = np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]])
                change = np.flatnonzero(np.diff(hit))
                starts, stops = change[::2], change[1::2]
                owner = np.searchsorted(begins, starts, side="right") - 1
                spans = {d: [] for d in docs}
                for d, a, b in zip(owner.tolist(), starts.tolist(), stops.tolist()):
                    spans[d].append({"start": a, "stop": b})
                out = [(r["part"], r["segment"], d, spans[d], sorted(x[0]), x[1]) for d, x in docs.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return index.mapInArrow(lean(rows), "part int, segment int, place int, spans array<struct<start:bigint,stop:bigint>>, items array<string>, n_near bigint")


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``search`` over an index of the documents, built in the shared folder."""
    spark = documents.sparkSession
    path = work_path(spark, "postings")
    build_index(documents, path)
    return search(spark.read.schema(SEGMENT).parquet(path), benchmark, width)


def keep_clean(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without a window of the benchmark, with all their columns.  A doc_id with a hit goes with all its
    rows; rows with a null doc_id are judged by their text's hash."""
    own = fresh("contaminated_key", documents)
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    hit = decontaminate(documents.select(key.alias("doc_id"), "text"), benchmark, width).where("n_hit > 0").select(F.col("doc_id").alias(own)).distinct()
    hit = written(hit, "contaminated")
    stay, near = split_near(documents, key, hit)
    return stay.union(near.join(hit, key == F.col(own), "left_anti").select(documents.columns))
