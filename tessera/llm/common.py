"""Helpers shared by the corpus operators: column picking, Arrow slicing, checkpoints."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a kernel expands into numpy arrays at once (a single longer text is taken whole).
CHUNK_BYTES = 1 << 20
#: Rows under which a side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of rows that Spark hands to a kernel at once (a single longer row is taken whole), unless the session names its own limit.
BATCH_BYTES = 4 << 20
#: Bytes from which an array has pages of its own, which the system gets back when the array goes.
OWN_PAGES = 1 << 20


@cache
def give_back() -> None:
    """From now on this process holds the arrays in use, not the most that it ever held: a worker lives through many tasks.

    By default the C library keeps freed arrays of up to 32 MB once it has seen one of that size, and Arrow's own pool keeps
    some of its pages. Kernels call this; it costs them CPU time for fresh pages. Where the C library has no such settings,
    only the pool changes.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    set_ = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_ is not None:
        for name in (-3, -1):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            set_(name, OWN_PAGES)


def small_batches(spark: SparkSession) -> None:
    """Kernels of this session get rows by BATCH_BYTES: neither the executor nor its workers then hold 10,000 texts at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns cannot clash."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def scratch(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session, whose executors are this process, may have none set: it gets one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a stage's rows to the shared folder and reads them back: lost executors then cost no recomputation."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table of short rows for broadcast if it has few rows; else the join shuffles, and Spark splits its skew."""
    return F.broadcast(df) if df.count() <= rows else df


def discard(df: DataFrame) -> None:
    """Deletes what `written` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, seen = spark._jvm, set()
    for name in df.inputFiles():
        folder = name.rpartition("/")[0]
        if folder not in seen:
            seen.add(folder)
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and int64 offsets of a string array; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize) if len(column) else np.zeros(1, kind)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), ends.astype(np.int64)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): runs of whole texts of about `limit` bytes."""
    data, offsets = string_buffer(column)
    first, rows = 0, len(column)
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def packed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers as byte planes, compressed."""
    size = np.dtype(kind).itemsize
    return zstandard.compress(np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)
