"""Shared pieces of the corpus operators: shared storage, Arrow buffers, packed integers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word definitions: blank and U+0009 to U+000D, which is what ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
NO_ID = np.iinfo(np.int64).max


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a session that is all on this machine, as in tests,
    gets a temporary one; on a cluster that is an error, since executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ontoloom-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python a thousand at a time, unless the session has a limit of its own."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that lost executors cost no earlier work."""
    small_batches(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and their n + 1 bounds; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, bounds, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def tidy() -> None:
    """Gives freed memory back to the system, so that an idle worker holds little. Without glibc it does nothing."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def longs(column) -> np.ndarray:
    """An integer column as int64; nulls become NO_ID, which orders after every id."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def texts(column) -> Iterator[bytes]:
    """Each value's bytes, one copy at a time."""
    data, at = buffers(column)
    raw = memoryview(data)
    return (bytes(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def chunk_bytes(total: int, least: int, most: int) -> int:
    """The size of a chunk of ``total`` bytes: it grows from ``least`` to ``most`` once there would be over a million
    chunks, since what every chunk has is one entry of each chunk in some group."""
    return min(most, max(least, total >> 20))


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes what shared_path() named, wherever it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tree_sums(parts: DataFrame, keys: list[str], value: str, add, ends: int = 1, fan_in: int = 64) -> DataFrame:
    """``parts`` with what partitions have in ``value`` summed by ``keys``, level by level over the numbers of the
    partitions, until ``ends`` rows a key are left at most. ``add`` takes a list of up to ``fan_in`` blobs to one, so no
    group grows with the number of partitions."""
    now = parts.select(*keys, value, F.spark_partition_id().cast("long").alias("part"))
    schema = now.schema

    def run(group: pa.Table) -> pa.Table:
        total = pa.array([add([x.as_py() for x in group.column(value)])], pa.binary())
        return pa.table([group.column(c)[:1] if c != value else total for c in group.column_names], names=group.column_names)

    while True:
        now = cut(now.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy(*keys, "part").applyInArrow(run, schema))
        if (now.agg(F.max("part")).first()[0] or 0) < ends:
            return now.drop("part")


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each unsigned 64-bit value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()
