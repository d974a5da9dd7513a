"""Token ids in binary shards with a minimal perfect hash index.

``write`` encodes texts in ascending order of ``doc_id`` and writes a table of shards.  A shard holds:

``part``, ``shard``      its place: parts are ranges of doc_id, shards of a part are in order
``first_key, last_key``  smallest and largest doc_id, for pruning
``n_docs, n_tokens``
``width``                bytes an id (2 or 4), little-endian, unsigned
``ids``                  all ids in a row, each document's end id last
``keys``                 doc_ids in order, int64 little-endian; ``nulls``: one byte each, 1 for a null id
``bits, ranks, levels``  the minimal perfect hash: for each level a bit vector of 64-bit words
                         (``levels`` has their numbers of bits), and set bits before each word
``rest``                 hashes that no level placed, in order (normally none)
``prints``               a 32-bit fingerprint for each slot
``begins, lengths``      first id and number of ids of each slot's document (uint32; a shard has fewer ids)

A key's slot is the number of set bits before its own bit, so access takes constant time: a few hashes, a
fingerprint to reject keys that are not there, and a slice of ``ids``.  Shards hold about ``shard_ids``
ids (a longer document has a shard of its own), so no task holds more than a shard besides its input batch.
Shards are a Parquet table: any file system that Spark writes to will do, and lost tasks are repeated.

Defined cases: null text: no ids but the end id.  Null doc_ids come first, and repeated doc_ids keep their
rows: the key is (doc_id, its how-manieth row).  No rows: no shards.  Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import mix

SHARD = (
    "part int, shard int, first_key bigint, last_key bigint, n_docs bigint, n_tokens bigint, width int, ids binary, keys binary, nulls binary, bits binary, ranks binary, levels binary, rest binary, prints binary, begins binary, lengths binary"
)


def key_hash(keys: np.ndarray, nulls: np.ndarray, turn: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(keys.view(np.uint64) + nulls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64(level + 1) * np.uint64(0xA0761D6478BD642F)) % np.uint64(size)).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)


def build(h: np.ndarray, gamma: float = 2.0, most: int = 32) -> dict:
    """Levels of bit vectors: a key alone at its place stays, the others try the next level."""
    words, levels, left = [], [], h
    for level in range(most):
        if not len(left):
            break
        size = -(-int(gamma * len(left) + 64) // 64) * 64
        at = place(left, level, size)
        count = np.bincount(at, minlength=size)
        bits = count == 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        levels.append(size)
        left = left[~bits[at]]
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    ones = np.bitwise_count(bits).astype(np.uint32)
    return {"bits": bits, "ranks": np.cumsum(ones, dtype=np.uint32) - ones, "levels": np.array(levels, np.uint32), "rest": np.sort(left)}


def slots(h: np.ndarray, made: dict) -> np.ndarray:
    """Slots of keys; -1 where a key can't be there."""
    out, base, left = np.full(len(h), -1, np.int64), 0, np.arange(len(h))
    for level, size in enumerate(made["levels"].tolist()):
        at = place(h[left], level, size)
        word, bit = made["bits"][base // 64 + at // 64], (at % 64).astype(np.uint64)
        there = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        out[left[there]] = (made["ranks"][base // 64 + at // 64].astype(np.int64) + below)[there]
        left, base = left[~there], base + size
    if len(left) and len(made["rest"]):
        k = np.minimum(np.searchsorted(made["rest"], h[left]), len(made["rest"]) - 1)
        placed = int(made["ranks"][-1]) + int(np.bitwise_count(made["bits"][-1]))
        out[left] = np.where(made["rest"][k] == h[left], placed + k, -1)
    return out


def turns_of(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """For ordered keys, the how-manieth row of its key each row is."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return np.arange(len(keys)) - start


def shard_row(part: int, shard: int, keys: list, ids: np.ndarray, bounds: np.ndarray, width: int) -> dict:
    nulls = np.array([k is None for k in keys], np.uint8)
    numbers = np.array([k or 0 for k in keys], np.int64)
    h = key_hash(numbers, nulls, turns_of(numbers, nulls))
    made = build(h)
    at = slots(h, made)
    prints, begins, lengths = np.zeros(len(h), np.uint32), np.zeros(len(h), np.uint32), np.zeros(len(h), np.uint32)
    prints[at], begins[at], lengths[at] = fingerprint(h), bounds[:-1], np.diff(bounds)
    real = [k for k in keys if k is not None]
    row = {"part": part, "shard": shard, "first_key": min(real, default=None), "last_key": max(real, default=None), "n_docs": len(keys), "n_tokens": int(bounds[-1]), "width": width}
    row |= {k: v.tobytes() for k, v in {"ids": ids.astype(f"<u{width}"), "keys": numbers, "nulls": nulls, "prints": prints, "begins": begins, "lengths": lengths, **made}.items()}
    return row


def write(documents: DataFrame, path: str, tokenizer: str, end: int, shard_ids: int = 2_000_000) -> None:
    """Write the shards of ``doc_id, text`` to ``path``.  tokenizer: path of a tokenizer file."""
    arrow = shard_schema()

    def shards(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        keys, ids, bounds = [], [], [np.zeros(1, np.int64)]
        width = 2 if bpe.encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4

        def row():
            return pa.RecordBatch.from_pylist([shard_row(part, shard, keys, np.concatenate(ids), np.concatenate(bounds), width)], schema=arrow)

        have = 0
        for some, more, at in bpe.documents_of(batches, tokenizer, end):
            keys += some
            ids.append(more)
            bounds.append(at[1:] + have)
            have += int(at[-1])
            if have >= shard_ids:
                yield row()
                shard, have, keys, ids, bounds = shard + 1, 0, [], [], [np.zeros(1, np.int64)]
        if keys:
            yield row()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(shards, SHARD).write.parquet(path)


def shard_schema():
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SHARD.split(", "))])


def opened(row: dict) -> dict:
    """A shard's index and ids as arrays, without copies."""
    kinds = {"bits": np.uint64, "ranks": np.uint32, "levels": np.uint32, "rest": np.uint64, "prints": np.uint32, "begins": np.uint32, "lengths": np.uint32, "keys": np.int64, "nulls": np.uint8, "ids": f"<u{row['width']}"}
    return {k: np.frombuffer(row[k], v) for k, v in kinds.items()}


def find(shard: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, first id, number of ids) of hashed keys."""
    at = slots(h, shard)
    found = (at >= 0) & (shard["prints"][at] == fingerprint(h)) if len(shard["prints"]) else np.zeros(len(h), bool)
    return found, shard["begins"][at].astype(np.int64), shard["lengths"][at].astype(np.int64)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the shards, by way of their index: doc_id, start, n_tokens, ids_crc32."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                s = opened(row)
                found, begin, length = find(s, key_hash(s["keys"], s["nulls"], turns_of(s["keys"], s["nulls"])))
                if not found.all():
                    raise ValueError(f"shard {row['part']}-{row['shard']}: the index lacks keys of its shard")
                crc = [zlib.crc32(s["ids"][b : b + n].astype("<u4").tobytes()) for b, n in zip(begin.tolist(), length.tolist())]
                keys = pa.array(s["keys"], mask=s["nulls"].astype(bool))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(crc), row["part"], np.int32)), pa.array(np.full(len(crc), row["shard"], np.int32)), pa.array(begin), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "part", "shard", "local_start", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARD).parquet(path)
    docs = shards.select("part", "shard", "width", "ids", "keys", "nulls", "bits", "ranks", "levels", "rest", "prints", "begins", "lengths").mapInArrow(rows, "doc_id bigint, part int, shard int, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(starts(shards), ["part", "shard"]).select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard.  One row a part goes through the only window that has no key."""
    from pyspark.sql import Window as W

    each = shards.select("part", "shard", "n_tokens")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = each.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return each.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("inside")).alias("first"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents (doc_id, ids): shards are pruned by their key range, then hashed access."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                s = opened(row)
                some = wanted[(wanted >= row["first_key"]) & (wanted <= row["last_key"])]
                out, turn, left = [], 0, some
                while len(left):
                    found, begin, length = find(s, key_hash(left, np.zeros(len(left), np.uint8), np.full(len(left), turn)))
                    out += [{"doc_id": int(k), "ids": s["ids"][b : b + n].tolist()} for k, f, b, n in zip(left, found, begin, length) if f]
                    left, turn = left[found], turn + 1
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    near = F.lit(False)
    for k in wanted.tolist():
        near = near | ((F.col("first_key") <= k) & (F.col("last_key") >= k))
    return spark.read.schema(SHARD).parquet(path).filter(near).mapInArrow(rows, "doc_id bigint, ids array<bigint>")
