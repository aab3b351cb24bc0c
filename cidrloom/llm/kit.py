"""Shared helpers: table access, staged tables, and numpy work on the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BLOCK_BYTES = 2_000_000  # texts are worked on in runs of whole rows of about this size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; the session must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors, has a known size."""
    spark, schema, path = df.sparkSession, df.schema, new_path(df.sparkSession, name)
    df.write.parquet(path)
    del df
    release_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Spark drops shuffle files once the plan that made them is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def limit_batches(spark: SparkSession) -> None:
    """From here on tables of this session pass Python in Arrow batches of `BATCH_BYTES`, not in 10,000 rows of whatever length.

    A batch is held by the JVM and by the Python worker of every running task. A smaller setting of the session stays.
    """
    before = spark.conf.get(_BATCH, None)
    limit = int(before) if before and before.isdigit() else BATCH_BYTES
    spark.conf.set(_BATCH, str(min(limit, BATCH_BYTES) if limit > 0 else BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """`limit_batches` for the tables written here. The session's setting comes back after."""
    before = spark.conf.get(_BATCH, None)
    limit_batches(spark)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def release_memory() -> None:
    """Hands freed memory back at the end of a task: Spark keeps the Python worker, which would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


class Tables:
    """Stored intermediate tables of one job; `drop` deletes those that a later stored table has replaced."""

    def __init__(self, spark: SparkSession):
        self.spark, self._path = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors, has a known size."""
        schema, path = df.schema, new_path(self.spark, name)
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._path[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self._path.pop(id(df))
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


# ---- UTF-8 blocks ---------------------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets (null rows are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    raw = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of whole rows of `column` of about `limit` bytes; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = utf8(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi
    release_memory()


def rows_of(at: np.ndarray) -> np.ndarray:
    """The row of each byte (or item) under the offsets `at`."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of `values` between neighbouring offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


# ---- hashing --------------------------------------------------------------------------------------------------------

_A = np.uint64(0x9E3779B97F4A7C15 | 1)
_A_INV = np.uint64(pow(int(_A), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (new array)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _A), ("down", _A_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashes:
    """Hashes of any stretch of a sequence of 64-bit codes, from prefix sums of a polynomial modulo 2**64.

    For stretches of a few hundred codes: modulo a power of two, two letters in Thue-Morse order collide from 1,024 codes
    on, whatever the codes. `stretch_hashes` and `PrimeHashes` have no such weakness.
    """

    def __init__(self, codes: np.ndarray):
        up, self._down = _powers(len(codes) + 1)
        self._sum = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sum[end] - self._sum[start]) * self._down[start]


_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x1D2C3B4A59687F6D % ((1 << 61) - 1)


def _folded(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo the prime."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 31 and 30 bits."""
    low31, low30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    al, ah, bl, bh = a & low31, a >> np.uint64(31), b & low31, b >> np.uint64(31)
    middle = al * bh + ah * bl
    return _folded(ah * bh * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & low30) << np.uint64(31)) + al * bl)


def _prime_powers(n: int) -> np.ndarray:
    if len(_POWERS.get("prime", ())) < n:
        out = np.array([1], np.uint64)
        while len(out) < max(n, 1 << 16):
            step = np.uint64(pow(_BASE, len(out), int(_PRIME)))
            out = np.concatenate((out, _times(out, np.broadcast_to(step, out.shape))))
        _POWERS["prime"] = out
    return _POWERS["prime"][:n]


class PrimeHashes:
    """Hashes of stretches of any length of a sequence of codes: a polynomial modulo the prime 2**61 - 1.

    Hashes of one object may be compared with each other.
    """

    def __init__(self, codes: np.ndarray):
        self._n = len(codes)
        up = _prime_powers(self._n + 1)
        terms = _times(_folded(codes), up[: self._n])
        # Sums of the upper and lower 30 bits stay below 2**64.
        upper = np.cumsum(terms >> np.uint64(30), dtype=np.uint64) % _PRIME
        lower = np.cumsum(terms & np.uint64((1 << 30) - 1), dtype=np.uint64) % _PRIME
        self._sum = np.zeros(self._n + 1, np.uint64)
        self._sum[1:] = _folded(_times(upper, np.broadcast_to(np.uint64(1 << 30), upper.shape)) + lower)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        rest = _folded(self._sum[end] + _PRIME - self._sum[start])
        return _times(rest, _prime_powers(self._n + 1)[self._n - start])


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def stretch_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes: each eight bytes are scrambled with their number, and summed up."""
    size = end - start
    count = np.maximum((size + 7) // 8, 1)
    last = np.cumsum(count)
    owner = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(owner)) - (last - count)[owner]
    words = np.ndarray((len(raw) + 1,), "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))
    value = words[np.minimum(start[owner] + 8 * number, len(raw))] & _MASKS[np.clip(size[owner] - 8 * number, 0, 8)]
    total = np.zeros(len(owner) + 1, np.uint64)
    np.cumsum(mix(value + mix(number.astype(np.uint64) + np.uint64(1))), out=total[1:])
    return mix(total[last] - total[last - count] + mix(size.astype(np.uint64)))


def chained(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` neighbouring hashes from each index."""
    out = np.full(len(first), width, np.uint64)
    for k in range(width):
        out = mix(out * _A + hashes[first + k])
    return out


# ---- words ----------------------------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word `[^\\x20\\x09-\\x0D]+`; rows never share a word."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~SPACE[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edges = at[(at > 0) & (at < n)]
    first[edges] = ink[edges]
    last[edges - 1] = ink[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return stretch_hashes(raw, start, end)


def windows(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of each run of `width` words that lies in one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.flatnonzero(row[:n] == row[width - 1 :])
    return chained(hashes, start, width), start


def text_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, so that further columns, whatever their names, never travel."""
    return docs.select(F.col(key), F.col(text))
