"""Tables in the shared folder, and word arithmetic over Arrow text columns."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where none is named, a local master gets a temporary folder; a cluster is refused, because
    its machines would not see each other's files.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(f"file://{named}")
        named = context.getCheckpointDir()
    return named


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there, so a lost
    executor costs a reread and no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by ``save`` once nothing reads it any more."""
    delete(df.sparkSession, df._saved_at)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fold(column: str, parts: int):
    """Remainder of crc32 of an id written as text."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row starts; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text, or list elements, so that arrays derived from a
    batch stay small. A longer text makes a slice of its own."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = SPACE[data]
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, space[:-1]
    before[at[:-1][at[:-1] < len(data)]] = True
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    after[at[1:][at[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    return starts, np.flatnonzero(~space & after) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time for all words together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left, where = (ends - starts).astype(np.int64), starts.copy()
    h = mix(left.astype(np.uint64) + np.uint64(1))
    live = np.arange(len(starts))
    while len(live):
        chunk = eight[where[live]] & _MASK[np.minimum(left[live], 8)]
        h[live] = mix(h[live] ^ chunk)
        left[live] -= 8
        where[live] += 8
        live = live[left[live] > 0]
    return h


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position; the last ``n - 1`` positions have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    h = np.zeros(size, np.uint64)
    for i in range(n):
        h = h * _C1 + words[i:i + size]
        h ^= h >> np.uint64(32)
    return mix(h)


def batches(columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()],
        names=list(columns))


def by_group(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from batches sorted by it, one group in memory at a time."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
