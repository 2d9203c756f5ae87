"""Shared plumbing of the training-data operators: Arrow batches cut into bounded pieces, and whole-text word hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_dir  # noqa: F401

#: Bytes of text that one numpy step holds at a time (temporaries take some 40 times that).
CHUNK_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at a time. At its own 64 MB a task's whole input is one batch, which the
#: JVM holds in buffers of up to twice that, kept for reuse, and the worker holds beside what it makes of it.
BATCH_BYTES = 1 << 21
#: Rows that Spark decodes of a Parquet file at a time; a text column of its own 4096 is one array of several MB.
COLUMN_ROWS = 512

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def text_docs(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; other columns, clashing names included, do not reach the operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES (a longer row goes alone) and what is decoded of Parquet at a time to
    COLUMN_ROWS, or to the session's own limits where those are less."""
    arrow, parquet = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(arrow)) > BATCH_BYTES:
        spark.conf.set(arrow, f"{BATCH_BYTES}b")
    if int(spark.conf.get(parquet)) > COLUMN_ROWS:
        spark.conf.set(parquet, str(COLUMN_ROWS))


def shrink_heaps(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage, one task each, and with it give back the room it took; they else let the
    heap grow to its limit, however little of it is in use."""
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is counted
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def give_back() -> None:
    """Returns to the system what this process has freed; workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def freed(body: Callable) -> Callable:
    """A mapInArrow body that gives memory back once it has ended."""

    @wraps(body)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from body(batches)
        give_back()

    return run


def one_row_each(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, text) of some keys, one row each: of several texts the one with the least digest.

    ``wanted`` is a bounded sample, broadcast and, with a digest for each, collected. Texts are shuffled only if a key repeats."""
    own = rows.join(F.broadcast(wanted.select(*keys)), keys)
    found = own.select(*keys, F.xxhash64("text").alias("digest")).groupBy(*keys).agg(F.min("digest").alias("digest"), F.count("*").alias("n")).collect()
    if all(r["n"] == 1 for r in found):
        return own
    picked = rows.sparkSession.createDataFrame([tuple(r)[:-1] for r in found], rows.select(*keys, F.lit(0).cast("long").alias("digest")).schema)
    same = own.withColumn("digest", F.xxhash64("text")).join(F.broadcast(picked), [*keys, "digest"])
    return same.groupBy(*keys).agg(F.min("text").alias("text"))


def fold_mod(column: str, k: int):
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(k)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that a piece holds at most ``limit`` bytes of text or one row."""
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.maximum(_lengths(col), 1))
    at, n = 0, len(ends)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _lengths(col: pa.Array) -> np.ndarray:
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) else np.int32)
    off = off[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.diff(off)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows together and the row offsets in them (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) else np.int32)
    off = off[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if col.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x += _GOLD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = np.cumprod(out, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+``; no word crosses a row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


#: Words of this many bytes or more are hashed by BLAKE2: words can be made whose sums of powers are equal, and all
#: that are known to be are longer.
LONG_WORD = 256


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True):
    """64-bit hashes of all words, and the row of each."""
    if lower:
        data = _LOWER[data]
    starts, ends, rows = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_BASE_INV, len(data))[starts]
    h = mix64(h + (ends - starts).astype(np.uint64) * _GOLD)
    for i in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h, rows


class SpanHasher:
    """64-bit hashes of any byte spans of one piece of text, from its prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), dtype=np.uint64, out=self.sums[1:])
        self.inverse = _power(_BASE_INV, max(len(data), 1))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[np.minimum(starts, len(self.inverse) - 1)]
        return mix64(h + (ends - starts).astype(np.uint64) * _GOLD)
