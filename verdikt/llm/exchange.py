"""Which owners share a signature: a shuffle of packed arrays instead of a row for each signature.

Owners (classes, lines) have a ``uid``: a block's ``base`` and a place in the block.  A block sends its signatures
(of ``BITS`` bits) sorted, as differences, to buckets that are ranges of signatures: one row for each block and bucket, some five
bytes a signature.  A bucket sorts what it gets and tells of each signature of two or more owners a set ``(set, uid)``.  Signatures of the same
owners are one set.  Signatures that agree in ``BITS`` bits by accident only give a set more to verify.

Owners of a block that share a signature in great number (``HOT`` or more: copies with small changes, or a common phrase) are told at once, and only one of them
goes to the bucket, so a signature takes at most ``HOT`` places of each block there, however many owners have it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix, packed, signed, unpacked

BITS = 48
HOT = 16
#: A block's most owners: places have 15 bits, beside one that marks a signature told at once.
OWNERS = 1 << 15
ENTRIES = 1 << 19


def buckets_for(spark, entries: int) -> int:
    """About two million entries a bucket, but no fewer buckets than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries >> 21)


class Outbox:
    """Takes owners with their signatures and gives rows: messages (bucket, base, sigs, owners) and sets told at once (set, uid)."""

    def __init__(self, partition: int, buckets: int):
        self.base, self.buckets = partition << 36, buckets
        self.sigs: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.n = self.entries = 0

    def add(self, sigs: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """n owners, numbered from 0 in ``owners``; their uids.  Ask ``full`` before."""
        self.sigs.append(sigs)
        self.owners.append(owners + self.n)
        uids = self.base + self.n + np.arange(n)
        self.n, self.entries = self.n + n, self.entries + len(sigs)
        return uids

    def full(self, more: int) -> bool:
        return self.n + more > OWNERS or self.entries > ENTRIES

    def flush(self) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """(messages, sets, uids)"""
        if not self.n:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.uint64(64 - BITS)
        both = np.concatenate(self.sigs) >> low << low | np.concatenate(self.owners).astype(np.uint64) << np.uint64(1)
        both.sort()  # np.unique puts them into a hash table first, which takes several times as long
        both = np.delete(both, np.flatnonzero(both[1:] == both[:-1]))
        sig = both >> low
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        begins = np.flatnonzero(new)
        size = np.diff(np.append(begins, len(sig)))
        hot = np.repeat(size >= HOT, size)
        sets, uids = signed(mix(sig[hot])), self.base + (both[hot] >> np.uint64(1) & np.uint64(OWNERS - 1)).astype(np.int64)
        sent = both[~hot | new]
        sent |= hot[~hot | new].astype(np.uint64)
        sig = sent >> low
        of = (sig >> np.uint64(BITS - 32)) * np.uint64(self.buckets) >> np.uint64(32)
        some, first = np.unique(of, return_index=True)
        rows = []
        for b, k in zip(some.tolist(), np.split(np.arange(len(sig)), first[1:]) if len(some) else ()):
            rows.append((b, self.base, packed(np.diff(sig[k], prepend=np.uint64(0))), packed((sent[k] & np.uint64(2 * OWNERS - 1)).astype(np.uint16))))
        self.base, self.n, self.entries, self.sigs, self.owners = self.base + self.n, 0, 0, [], []
        return rows, sets, uids


def shared(messages: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(set, uid) of a bucket's messages (base, sigs, owners)."""
    sig, own, uid = [], [], []
    for base, x, y in messages:
        sig.append(np.cumsum(unpacked(x, np.uint64), dtype=np.uint64))
        own.append(unpacked(y, np.uint16))
        uid.append(base + (own[-1] >> 1).astype(np.int64))
    if not sig:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sig = np.concatenate(sig)
    order = np.argsort(sig)
    s = sig[order]
    same = s[1:] == s[:-1]
    many = np.zeros(len(s), bool)
    many[1:] |= same
    many[:-1] |= same
    s, order = s[many], order[many]
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot, uid = np.concatenate(own)[order] & 1, np.concatenate(uid)[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    begins = np.flatnonzero(new)
    size = np.diff(np.append(begins, len(s)))
    name = mix(np.add.reduceat(mix(uid.view(np.uint64) + np.uint64(1)), begins) + size.astype(np.uint64))
    told = np.maximum.reduceat(hot, begins) > 0  # more of the set is told elsewhere, by the signature
    name[told] = mix(s[begins[told]])
    _, first = np.unique(name, return_index=True)
    kept = np.zeros(len(begins), bool)
    kept[first] = True
    return signed(np.repeat(name[kept], size[kept])), uid[np.repeat(kept, size)]


def exchanged(sent: DataFrame, buckets: int, facts: str) -> DataFrame:
    """sent: rows of ``bucket, base, sigs, owners`` (messages), of ``set, uid`` (told at once), and others, with columns ``facts`` (DDL); all with a bucket.
    Gives ``set, uid`` and the others' columns; sets may come more than once."""
    names = [x.split()[0] for x in facts.split(", ")]

    def rows(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        messages = []
        for batch in batches:
            is_message = pc.is_valid(batch.column(batch.schema.get_field_index("sigs")))
            rest = batch.filter(pc.invert(is_message)).select(["set", "uid", *names])
            if rest.num_rows:
                yield rest
            some = batch.filter(is_message)
            messages += zip(*(some.column(some.schema.get_field_index(c)).to_pylist() for c in ("base", "sigs", "owners")))
        sets, uids = shared(messages)
        for k in range(0, len(sets), 100_000):
            columns = {"set": pa.array(sets[k : k + 100_000]), "uid": pa.array(uids[k : k + 100_000])}
            n = len(columns["set"])
            yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in rest_schema(batch.schema, names)], ["set", "uid", *names])

    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(rows), f"set bigint, uid bigint, {facts}")


def rest_schema(schema, names: list[str]):
    return [schema.field(c) for c in ("set", "uid", *names)]
