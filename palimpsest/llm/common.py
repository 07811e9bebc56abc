"""Shared pieces of the text operators: scratch tables, Arrow text buffers, hashing kernels.

Everything here runs either on the driver (plans, scratch tables) or inside one Arrow
batch on an executor (numpy kernels over the raw UTF-8 buffer, no per-word objects).
"""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers on other hosts need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# ---------------------------------------------------------------- scratch tables


class Scratch:
    """Tables written to cut lineage, under the folder named by ``spark.checkpoint.dir``.

    Written tables survive the loss of any executor. A folder of our own is made only
    where the setting is absent (tests on one machine).
    """

    _own: str | None = None

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if Scratch._own is None:
                Scratch._own = tempfile.mkdtemp(prefix="palimpsest-")
            root = Scratch._own
        self.spark, self.root, self.n = spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Write and read again; ``by``: columns whose values get a folder each."""
        return self._written(df, name, by, {})

    def write_hashes(self, df: DataFrame, name: str) -> DataFrame:
        """As :meth:`write`, without dictionaries: they cost time and save nothing where most values are hashes."""
        return self._written(df, name, (), {"parquet.enable.dictionary": "false"})

    def _written(self, df: DataFrame, name: str, by: tuple, options: dict) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        # shuffle files of the plan go as soon as its result is written, not when the driver collects garbage
        key, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", self.spark.conf
        before = conf.get(key, "false")
        conf.set(key, "true")
        try:
            df.write.options(compression="zstd", **options).partitionBy(*by).parquet(path)
        finally:
            conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a written table that no later plan reads."""
        self._delete(df._scratch_path)

    def remove(self, name: str) -> None:
        """Delete what was put under the folder by that name."""
        self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession, df: DataFrame) -> int:
    """Number of shuffle buckets: at least the configured shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner release shuffle files of plans no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


FAN_IN = 64


def packed(v: np.ndarray) -> bytes:
    """An int64 vector, compressed (counts are mostly small)."""
    raw = v.astype(np.int64).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little")), np.int64)


def sum_vectors(df: DataFrame, label: str) -> dict[int, np.ndarray]:
    """Element-wise sums of packed int64 vectors: rows (part int, piece int, cells binary) -> {piece: sum}.

    Vectors have a fixed length. They are summed in a tree of fan-in 64, so no task gets the
    vectors of all parts; only one vector for each piece comes to the driver.
    """

    def total(t: pa.Table) -> pa.Table:
        acc = None
        for x in t.column("cells"):
            v = unpacked(x.as_py())
            acc = v.copy() if acc is None else acc + v
        return pa.table({"part": t.column("part")[:1], "piece": t.column("piece")[:1], "cells": pa.array([packed(acc)], pa.binary())})

    tmp = Scratch(df.sparkSession, label)
    level = tmp.write(df, "parts")
    tasks = (level.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // FAN_IN)
        level = tmp.write(level.withColumn("part", (F.col("part") % tasks).cast("int")).groupBy("part", "piece").applyInArrow(total, "part int, piece int, cells binary"), "sums")
        if tasks == 1:
            break
    out = {r.piece: unpacked(bytes(r.cells)) for r in level.collect()}
    tmp.clear()
    return out


# ---------------------------------------------------------------- column helpers


#: A letter other than A-Z that has another lower case.
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower``, the faster one, is used where the text is pure ASCII or has no other letter to change."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).when(~c.rlike(OTHER_UPPER), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(c: Column, remainder: int, modulus: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``modulus``, equal to ``remainder``; null id: false."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


# ---------------------------------------------------------------- Arrow text buffers

SLICE_BYTES, BATCH_BYTES = 2 << 20, 8 << 20


def settle_memory() -> None:
    """Give freed memory back to the system: workers are kept and would hold on to their peak."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # arrays of a megabyte and more are mapped, and unmapped when freed
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so that long texts don't make large ones."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        settle_memory()
        yield from fn(batches)
        settle_memory()

    return df.mapInArrow(run, schema)


def group_arrow(grouped, fn, schema) -> DataFrame:
    """``applyInArrow`` of a group or cogroup, with memory given back after each."""

    def run(table: pa.Table) -> pa.Table:
        out = fn(table)
        settle_memory()
        return out

    def run_both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left, right)
        settle_memory()
        return out

    return grouped.applyInArrow(run if fn.__code__.co_argcount == 1 else run_both, schema)


def text_slices(batch: pa.RecordBatch, col: str = "text", limit: int = SLICE_BYTES):
    """Yield (first row, data, offsets) for runs of rows of about ``limit`` bytes of UTF-8.

    A row longer than ``limit`` is a run of its own: texts are never cut. Null is empty.
    """
    arr = batch.column(batch.schema.get_field_index(col))
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_binary()) if not pa.types.is_large_binary(arr.type) else arr
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, len(arr))
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


# ---------------------------------------------------------------- hashing kernels

_B = np.uint64(0x9E3779B97F4A7C55 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_pow = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """b**i and b**-i modulo 2**64 for i < n."""
    if _pow["n"] < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            a = np.full(n, _B, np.uint64)
            a[0] = 1
            b = np.full(n, _BINV, np.uint64)
            b[0] = 1
            _pow.update(n=n, a=np.multiply.accumulate(a), b=np.multiply.accumulate(b))
    return _pow["a"], _pow["b"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, or over the values of the bytes; see :func:`range_hash`."""
    a, _ = powers(len(data) + 1)
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    x = data.astype(np.uint64) + np.uint64(1) if values is None else values[data]
    np.cumsum(x * a[: len(data)], out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, independent of where the range lies."""
    _, b = powers(len(h))
    return mix((h[end] - h[start]) * b[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32
SPACE_SEP = np.zeros(256, bool)
SPACE_SEP[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of non-separator bytes within a document."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(sep[data], out=inside[:n])
    first = np.zeros(n + 1, bool)
    first[offs] = True  # a document border ends a word
    start = inside[:n].copy()
    start[1:] &= ~inside[: n - 1] | first[1:n]
    end = inside[:n] & (~inside[1:] | first[1:])
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(offs, s, side="right") - 1
    return s, e, doc


def word_hashes(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE_SEP):
    """(hash, document, start, end) of the words of a lower-cased slice."""
    s, e, doc = word_spans(data, offs, sep)
    return range_hash(prefix_hash(data), s, e), doc, s, e


def shingle_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``n`` words inside one document."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + h[k : k + m])
    ok = doc[:m] == doc[n - 1 :]
    return out[ok], doc[:m][ok]


def positional(docs: DataFrame, keep: tuple[str, ...] = ("text",)):
    """``docs`` under names that clash with nothing, and the way back to its own columns."""
    names = [c if c in keep else f"_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)
