"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only white space of the word rules here.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where that setting is missing the context's checkpoint folder is used.  A local master, which has one machine,
    may do without both and gets a folder below the warehouse; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/verdikt/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.  Shuffle files of its making go as soon as it is there."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = work_path(spark, name), spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that have had their last reader."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Bits of the filter of ``split_near``.
FILTER_BITS = 24


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has (names are the same without case)."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_near(df: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` (bigint) is surely none of ``wanted`` (one bigint column), and all others.

    The filter is a bit vector of ``1 << FILTER_BITS`` bits, dealt out as a table of at most ``1 << (FILTER_BITS - 6)`` rows (4 MB), so
    it may be broadcast whatever ``wanted`` holds.  With very many wanted keys it lets more rows through, but loses none.
    """
    word, bits = fresh("near_word", df), fresh("near_bits", df)
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << FILTER_BITS))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), place(k).bitwiseAND(F.lit(63)).cast("int"))
    own = F.col(wanted.columns[0])
    words = wanted.groupBy(F.shiftright(place(own), 6).alias(word)).agg(F.bit_or(bit(own)).alias(bits))
    told = df.withColumn(word, F.shiftright(place(key), 6)).join(F.broadcast(words), word, "left")
    near = F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False)) & key.isNotNull()
    return told.where(~near).select(df.columns), told.where(near).select(df.columns)


def packed(x: np.ndarray) -> bytes:
    """An array's bytes by planes (all first bytes, all second ones and so on) without the high planes of nothing but 0, compressed."""
    import pyarrow as pa

    if not len(x):
        return b""
    wide = x.itemsize if x.dtype.kind == "f" or x.dtype.kind == "i" and x.min() < 0 else max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)[:, :wide].T).tobytes()
    return wide.to_bytes(1, "little") + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(x: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    kind = np.dtype(kind)
    if not x:
        return np.zeros(0, kind)
    wide, size = x[0], int.from_bytes(x[1:9], "little")
    planes = np.frombuffer(pa.decompress(x[9:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8).reshape(wide, -1)
    out = np.zeros((planes.shape[1], kind.itemsize), np.uint8)
    out[:, :wide] = planes.T
    return out.view(kind).ravel()


#: What a Python worker keeps from task to task, by name.
_kept: dict = {}


def kept(name, make):
    """``make()``, which this Python worker keeps for later tasks, until one comes that has no use for it (``lean``)."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """Drop all that is ``kept``.  (A function of the module, since a closure would reach the executors with a ``_kept`` of its own.)"""
    if _kept:
        _kept.clear()
        returned()


def returned() -> None:
    """Give freed memory back to the system.  Where the C library has no call for it, it stays with the process."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(rows, keeps: bool = False):
    """``rows`` for ``mapInArrow``, for Python workers that tasks of other operators had before and will have again: what those have
    ``kept`` goes first, unless this one ``keeps`` such things too, and what the task has freed goes at its end."""

    def alone(batches):
        if not keeps:
            let_go()
        yield from rows(batches)
        returned()

    return alone


def held_out(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``, is 2.  A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 2, F.lit(False))


def parts(batch, column: int, most: int = 2 << 20, rows: int = 1 << 14):
    """Slices of an Arrow batch with about ``most`` bytes in a text or binary column each (a longer text stands alone), and no more than ``rows`` rows."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64) + 64)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(first, last - first)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
