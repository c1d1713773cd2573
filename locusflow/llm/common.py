"""Shared pieces: tables in the shared folder, fixed-size id filters, text to words in numpy."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of all contracts here: space and the controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Kinds of bytes, for shares of a text.
KINDS_OF_BYTES = {name: np.isin(np.arange(256), [ord(c) for c in chars]) for name, chars in {"upper": UPPER, "digit": "0123456789", "mark": "!\"#$%&'()*+-/:;<=>?@[\\]^_`{}~|", "bar": "|", "stop": ".?!"}.items()}

#: Tables that materialise() wrote: the session, the folder, and a weak reference of the JVM to the list of its files.
_written: list[tuple] = []


# -- tables in the shared folder ----------------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all
    runs in one process, as in tests, a new one; on a cluster that is an error, as executors could
    not see a folder of the driver's machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="locusflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs don't recompute it, and a lost
    executor can't lose it. The table is deleted when no plan can read it any more; see sweep()."""
    spark = df.sparkSession
    sweep()
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation().location()
    _written.append((spark, path, spark.sparkContext._jvm.java.lang.ref.WeakReference(files)))
    return out


def sweep(collect: bool = False) -> None:
    """Delete the tables of materialise() that nothing refers to: every DataFrame over a table, lazy,
    running or derived from another, holds the JVM's list of the table's files, so a table whose
    list is gone has no reader left. collect: ask the JVM to look for garbage first."""
    if collect and _written:
        gc.collect()
        with contextlib.suppress(Exception):
            _written[-1][0].sparkContext._jvm.java.lang.System.gc()
    rest = []
    for spark, path, files in _written:
        try:
            if files.get() is not None:
                rest.append((spark, path, files))
            else:
                _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            continue
    _written[:] = rest


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for spark, path, _ in _written:
        with contextlib.suppress(Exception):
            _delete(spark, path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- fixed-size filters -------------------------------------------------------------------------
def bitmap_of(df: DataFrame, hashed, expected: int = 1 << 20) -> np.ndarray:
    """A bitmap of a column of hashes (long), of 16 bits for each expected row, but of 4 MB at least
    and 32 MB at most.

    It is made with Spark's bitmap aggregates, 4 KB a bucket. It may say yes to a few values that
    are not in it, never no to one that is, so it only saves work: what passes is joined."""
    bits = min(1 << 28, max(1 << 25, 1 << (16 * max(expected, 1) - 1).bit_length()))
    slot = F.pmod(hashed, F.lit(bits))
    rows = (
        df.select((slot / 32768).cast("long").alias("bucket"), (slot % 32768).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("part"))
        .collect()
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in rows:
        if row["bucket"] is not None:
            out[row["bucket"] * 4096 : row["bucket"] * 4096 + 4096] = np.frombuffer(row["part"], np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the int64 hashes may be in the bitmap."""
    slot = (hashes.astype(np.int64, copy=False) % np.int64(bitmap.size * 8)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


# -- texts in numpy -----------------------------------------------------------------------------
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def in_slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """A batch in slices of up to `most` bytes of text, or one row: numpy needs some 30 times that."""
    _, ends = texts_of(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without white space. Returns their bytes end to end, their offsets in these
    (one more than words), and how many words each text has."""
    inside = ~_IS_SPACE[data]
    starts = inside.copy()
    if data.size:
        opens = np.zeros(data.size, dtype=bool)
        opens[offsets[:-1][offsets[:-1] < data.size]] = True
        starts[1:] &= ~inside[:-1] | opens[1:]
    at = np.flatnonzero(starts)
    before = np.cumsum(inside, dtype=np.int32 if data.size < 1 << 31 else np.int64)
    where = np.append(before[at] - 1, before[-1] if data.size else 0).astype(np.int64)
    return data[inside], where, np.diff(np.searchsorted(at, offsets))


def hash_words(data: np.ndarray, where: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (uint64), the same in every process."""
    global _POWERS
    n = where.size - 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = np.diff(where)
    if (longest := int(size.max())) > _POWERS.size:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, _P)]))
    place = np.arange(data.size, dtype=np.int64) - np.repeat(where[:-1], size)
    total = np.add.reduceat(np.append(_BYTES[data] * _POWERS[place], np.uint64(0)), where[:-1])
    total[size == 0] = 0
    return mix(total + size.astype(np.uint64))


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


def string_array(data: np.ndarray, where: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(where.size - 1, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x.tobytes())


def unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def pack_ints(x: np.ndarray, rising: bool = False) -> bytes:
    """Non-negative integers below 2**31, their lowest bytes first, then the next: small values take
    little room. rising: by their differences."""
    x = np.diff(x, prepend=0) if rising else x
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_ints(x: bytes, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    found = np.ascontiguousarray(planes.T).view("<i4").ravel()
    return np.cumsum(found, dtype=np.int32) if rising else found


def lean(run):
    """run for mapInArrow, after which its worker hands freed memory back to the system. Workers stay
    idle for a minute, beside those and the JVM of the next stage."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return wrapped


def quiet_threads() -> None:
    """Executor slots are the unit of parallelism; libraries must not add threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
