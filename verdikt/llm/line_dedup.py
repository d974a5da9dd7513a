"""Fuzzy line deduplication by MinHash.

Lines are compared without case and outer or doubled white space.  A line's set: its shingles of eight
characters (a shorter line: the line).  MinHash: the shingles are dealt to ``bands * rows`` bins by their hash, of each bin the least hash is
its value, and an empty bin takes the value of the first bin with one in an order of its own (so that few shingles give values as
independent as many do).  Bands of ``rows`` values agree with a probability of the Jaccard coefficient to the power ``rows``.  Lines that share a band are candidates: all of a bucket are verified
exactly (Jaccard of the sets of code points, 80 % or more) against its smallest, then its hubs; those that stay in different components
are verified against each other in blocks, by exact counts over an inverted list.  Before exact counts, bit vectors of shingles rule out
pairs that cannot be similar (``rough``).  Distributed union-find then gives components, of which the first line
(by doc_id, then place) stays and all others are removed.

A task signs each line once; bands meet as in ``exchange``.  Line texts are fetched for candidates only, by a second scan of the documents with a filter of fixed
size (a bit vector of ``1 << 24`` bits: at most 2 MB), which lets some others through but loses none.  Only documents that may lose a line
are shuffled.

Lines of fewer than ``least_words`` words (default: none but blank ones) stay as they are.

Defined cases: null text: no lines, stays null.  A document may end up with an empty text; its row stays.
Rows with equal doc_id and text are one document with that result in each row.  Null doc_ids come first in the
order.  doc_id is a number (or text of one).  No rows: no rows.  All columns are carried along, whatever their names; ``n_chars``, if there, is the new length.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, fresh, lean, mix, parts, signed, split_near, written
from .exchange import Outbox, buckets_for, exchanged
from .ngram_join import NO_ID, buckets_of, resolve

SHINGLE = 8
EMPTY = np.uint32(0xFFFFFFFF)
FACTS = "doc_id bigint, document bigint, places array<int>, keys array<bigint>, signed array<bigint>"


def keyed_lines(text: bytes | None, least_words: int) -> tuple[list[int], list[bytes], list[int]]:
    """Places, normal forms and keys (unsigned) of the lines that take part."""
    import xxhash

    if not text:
        return [], [], []
    text = text.lower()
    odd = b"  " in text or any(c in text for c in (b"\t", b"\r", b"\x0b", b"\x0c"))
    forms = [b" ".join(x.split()) for x in text.split(b"\n")] if odd else [x.strip() for x in text.split(b"\n")]
    if least_words > 1:
        forms = [x if x.count(b" ") + 1 >= least_words else b"" for x in forms]
    places = [k for k, x in enumerate(forms) if x]
    forms = [x for x in forms if x]
    return places, forms, list(map(xxhash.xxh3_64_intdigest, forms))


def padded(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines with ``SHINGLE`` zeros after each, and how many each line has."""
    joined = (b"\0" * SHINGLE).join([*lines, b""])
    if joined.isascii():
        return np.frombuffer(joined, np.uint8), np.fromiter(map(len, lines), np.int64, len(lines))
    texts = [x.decode() for x in lines]
    return np.frombuffer(joined.decode().encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def codes_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``padded`` code points, the shingles' begins there, and how many shingles each line has."""
    codes, n = padded(lines)
    counts = np.maximum(1, n - SHINGLE + 1)
    begins = np.cumsum(n + SHINGLE) - n - SHINGLE
    return codes, np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum())), counts


def line_sets(lines: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each line's shingles of code points."""
    if not lines:
        return []
    codes, at, counts = codes_of(lines)
    codes = codes.astype(np.uint64)
    total = np.zeros(len(codes) - SHINGLE + 1, np.uint64)  # of each place, also of those between the lines
    for k, factor in enumerate(mix(np.arange(1, SHINGLE + 1, dtype=np.uint64))):
        total += codes[k : k + len(total)] * factor
    total = mix(total[at])
    ends = np.cumsum(counts)
    return [ascending(total[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]


def ascending(x: np.ndarray) -> np.ndarray:
    """Sorted in place, each value once."""
    x.sort()
    again = x[1:] == x[:-1]
    return np.delete(x, np.flatnonzero(again)) if again.any() else x


@functools.cache
def orders(bins: int) -> np.ndarray:
    """For each bin, all bins in an order of its own."""
    return np.argsort(mix(np.arange(1, bins * bins + 1, dtype=np.uint64)).reshape(bins, bins), axis=1)


def hashed(codes: np.ndarray) -> np.ndarray:
    """Of each place a hash of the ``SHINGLE`` code points there, by their low bytes."""
    if codes.dtype != np.uint8:  # equal shingles stay equal
        codes = (codes ^ (codes >> 8) ^ (codes >> 16)).astype(np.uint8)
    h = np.ndarray((len(codes) - SHINGLE + 1,), "<u8", codes.tobytes(), 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def rough(lines: list[bytes], percent: int):
    """A function of two arrays of places in ``lines``: which of the pairs may be similar.

    A line's bit vector has a bit for each shingle, so two vectors differ in no more bits than the sets do in elements, and similar sets
    differ in a share of their sizes at most.  Repeated shingles count in the sizes here, which lets more pairs through but loses none; pairs of
    lines of very different lengths go through as they are."""
    codes, at, counts = codes_of(lines)
    h = hashed(codes)[at]
    # Two bits or more for each shingle.
    wide = np.maximum(np.ceil(np.log2(counts)).astype(np.int64) + 3, 9)

    def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.abs(wide[a] - wide[b]) > 1
        width = np.where(out, 0, np.maximum(wide[a], wide[b]))
        for w in np.flatnonzero(np.bincount(width)).tolist():
            if w == 0:
                continue
            pairs, used = np.flatnonzero(width == w), np.zeros(len(lines), bool)
            used[a[pairs]] = used[b[pairs]] = True
            rank, n = np.cumsum(used) - 1, counts[used]
            bits = np.zeros(len(n) << w, bool)
            bits[(np.repeat(np.arange(len(n)), n) << w) + (h[np.repeat(used, counts)] >> np.uint64(64 - w)).astype(np.int64)] = True
            vectors = np.packbits(bits).view(np.uint64).reshape(len(n), -1)
            step = max(1, (1 << 24) >> w)
            for some in (pairs[k : k + step] for k in range(0, len(pairs), step)):
                x, y = a[some], b[some]
                differ = np.bitwise_count(vectors[rank[x]] ^ vectors[rank[y]]).sum(axis=1, dtype=np.int64)
                out[some] = differ * (100 + percent) <= (100 - percent) * (counts[x] + counts[y])
        return out

    return may


def minhashes(lines: list[bytes], bins: int) -> np.ndarray:
    """One row of values for each line."""
    codes, n = padded(lines)
    h = hashed(codes)  # also of places after a line's last shingle, which then count as empty
    value = h.astype(np.uint32)
    ends = np.cumsum(n + SHINGLE)
    for k in range(1, 2 * SHINGLE):
        last = ends - k
        after = last > ends - n - SHINGLE + np.maximum(n - SHINGLE, 0)
        value[last[after & (last < len(value))]] = EMPTY
    h >>= np.uint64(32)
    h *= np.uint64(bins)
    h >>= np.uint64(32)
    place = h.view(np.int64)
    place += np.repeat(np.arange(len(lines)) * bins, n + SHINGLE)[: len(h)]
    own = np.full(len(lines) * bins, EMPTY, np.uint32)
    np.minimum.at(own, place, value)
    out, left = own.copy(), np.flatnonzero(own == EMPTY)
    line, bin_, order = left // bins * bins, left % bins, orders(bins)
    for k in range(bins):
        value = own[line + order[bin_, k]]
        found = value != EMPTY
        out[left[found]] = value[found]
        left, line, bin_ = left[~found], line[~found], bin_[~found]
        if not len(left):
            break
    return out.reshape(len(lines), bins)


def band_hashes(lines: list[bytes], bands: int, rows: int) -> np.ndarray:
    """One row for each line, one column for each band."""
    out = np.zeros((len(lines), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    if not len(lines):
        return out
    values = minhashes(lines, bands * rows)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, r * bands : (r + 1) * bands])
    return out


def duplicates(documents: DataFrame, bands: int, rows: int, percent: int, least_words: int) -> DataFrame:
    """Lines to remove: ``document, removed`` (places) and ``kept_in`` (doc_ids that keep a line of the same component); documents: ``doc_id, document, text``."""
    base_rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "document", F.col("text").cast("binary").alias("text"))
    # A line has some hundred bytes.
    buckets = buckets_for(documents.sparkSession, int(base_rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * bands // 100)
    schema = f"bucket int, base bigint, sigs binary, owners binary, set bigint, uid bigint, {FACTS}"

    def signed_rows(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
        kinds = {x.split()[0]: kinds[x.split()[1]] for x in schema.split(", ")}
        outbox, seen = Outbox(TaskContext.get().partitionId(), buckets), set()

        def batch(n: int, **columns):
            columns["bucket"] = columns.get("bucket", np.arange(n, dtype=np.int32) % buckets)
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

        def flushed():
            messages, sets, uids = outbox.flush()
            if messages:
                yield batch(len(messages), **{c: [m[k] for m in messages] for k, c in enumerate(("bucket", "base", "sigs", "owners"))})
            if len(sets):
                yield batch(len(sets), set=sets, uid=uids)

        def listed(values: list, n: list[int], kind):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.array(values, kind).view(kind.replace("u", ""))))

        for given in batches:
            for part in parts(given, 2, 1 << 20):
                places, keys, counts, new, new_keys = [], [], [], [], []
                if len(seen) > 500_000:
                    seen.clear()
                for text in part.column(2).to_pylist():
                    at, forms, of = keyed_lines(text, least_words)
                    places += at
                    keys += of
                    counts.append(len(at))
                    for form, key in zip(forms, of):
                        if key not in seen:
                            seen.add(key)
                            new.append(form)
                            new_keys.append(key)
                yield batch(len(counts), doc_id=part.column(0), document=part.column(1), places=listed(places, counts, "int32"), keys=listed(keys, counts, "uint64"))
                for k in range(0, len(new), 1 << 14):
                    some = new[k : k + (1 << 14)]
                    if outbox.full(len(some)):
                        yield from flushed()
                    uids = outbox.add(band_hashes(some, bands, rows).ravel(), np.repeat(np.arange(len(some)), bands), len(some))
                    yield batch(1, uid=uids[:1], signed=listed(new_keys[k : k + len(some)], [len(some)], "uint64"))
        yield from flushed()

    base = written(exchanged(base_rows.mapInArrow(lean(signed_rows), schema), buckets, FACTS), "lines")
    owners = base.where("signed is not null").select("uid", F.posexplode("signed").alias("k", "key")).select((F.col("uid") + F.col("k")).alias("uid"), "key")
    sets = base.where("set is not null").select("set", "uid").distinct().join(owners, "uid").select("set", "key")
    candidates = written(buckets_of(sets), "buckets")
    texts = written(texts_of(candidates.select("key").distinct(), base_rows, least_words), "texts")
    roots = resolve(candidates, None, lambda wanted: texts, line_sets, percent, rough=functools.partial(rough, percent=percent))
    lines = base.where("places is not null").select("doc_id", "document", F.explode(F.arrays_zip("places", "keys")).alias("x")).select(F.col("x.keys").alias("key"), F.struct("doc_id", "document", F.col("x.places").alias("place")).alias("line"))
    by_key = lines.groupBy("key").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    rooted = by_key.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("root", "first")
    known = written(rooted.select("key", "root").join(first, "root").select("key", "first"), "first")
    gone = split_near(lines, F.col("key"), known.select("key"))[1].join(known, "key").where("line != first")
    # A document that comes in several equal rows has its lines several times, at the same places.
    return gone.groupBy("line.document").agg(F.sort_array(F.collect_set("line.place")).alias("removed"), F.sort_array(F.collect_set(F.when(F.col("first.doc_id") != NO_ID, F.col("first.doc_id")))).alias("kept_in"))


def texts_of(wanted: DataFrame, documents: DataFrame, least_words: int) -> DataFrame:
    """``key, text`` (normal form) of the wanted lines (``key``)."""
    wanted = written(wanted, "wanted")
    bit = F.pmod(F.col("key"), F.lit(1 << FILTER_BITS))
    words = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {1 << FILTER_BITS}) & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    told = words.toArrow()  # of a fixed size, whatever the number of lines
    table[told["word"].to_numpy()] = told["bits"].to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def rows(batches):
        import pyarrow as pa

        bits, told = shared.value, set()
        for batch in batches:
            for part in parts(batch, 0):
                lines = [keyed_lines(text, least_words)[1:] for text in part.column(0).to_pylist()]
                keys = np.array([k for _, some in lines for k in some], np.uint64)
                at = keys & np.uint64((1 << FILTER_BITS) - 1)
                near = np.flatnonzero(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).tolist()
                if len(told) > 500_000:
                    told.clear()
                forms, found = [x for some, _ in lines for x in some], {}
                for k in near:
                    if (key := int(keys[k])) not in told:
                        told.add(key)
                        found[key] = forms[k]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(list(found.values()), pa.binary())], ["key", "text"])

    near = documents.select("text").mapInArrow(lean(rows), "key bigint, text binary")
    return near.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def cleaned(documents: DataFrame, bands: int, rows: int, percent: int, least_words: int) -> tuple[DataFrame, dict[str, str]]:
    """The documents with duplicate lines removed from ``text``, and the names of further columns: n_lines, removed, kept_in."""
    names = {c: fresh(c, documents) for c in ("n_lines", "removed", "kept_in", "document")}
    named = documents.withColumn(names["document"], F.xxhash64("doc_id", "text"))
    gone = duplicates(named.select("doc_id", F.col(names["document"]).alias("document"), "text"), bands, rows, percent, least_words)
    gone = written(gone, "gone").toDF(names["document"], names["removed"], names["kept_in"])
    stay, near = split_near(named, F.col(names["document"]), gone.select(names["document"]))
    lines, removed = F.split("text", "\n"), F.col(names["removed"])
    left = F.array_join(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(removed, s["i"]))["x"], "\n")
    near = near.join(gone, names["document"], "left").withColumn("text", F.when(removed.isNull(), F.col("text")).otherwise(left))
    out = stay.withColumns({names["removed"]: F.lit(None).cast("array<int>"), names["kept_in"]: F.lit(None).cast("array<bigint>")}).unionByName(near)
    return out, names


def dedup(documents: DataFrame, bands: int = 20, rows: int = 4, percent: int = 80, least_words: int = 1) -> DataFrame:
    """``doc_id, n_lines`` (before), ``removed`` (places of removed lines), ``kept_in`` (documents that keep such a line) and ``text`` of each row of ``doc_id, text``."""
    n_lines = F.size(F.split("text", "\n")).cast("long").alias("n_lines")
    out, names = cleaned(documents.select("doc_id", "text", n_lines), bands, rows, percent, least_words)
    return out.select("doc_id", "n_lines", *[F.coalesce(F.col(names[c]), F.array().cast(t)).alias(c) for c, t in (("removed", "array<int>"), ("kept_in", "array<bigint>"))], "text")


def dedup_documents(documents: DataFrame, bands: int = 20, rows: int = 4, percent: int = 80, least_words: int = 1) -> DataFrame:
    """The documents with duplicate lines removed from ``text``."""
    out, _ = cleaned(documents, bands, rows, percent, least_words)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(documents.columns)
