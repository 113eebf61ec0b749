"""Shared plumbing of the corpus operators: scratch tables in the cluster's shared folder, Arrow access, byte kernels."""

from __future__ import annotations

import gc
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.scratch import shared_dir

#: Bytes of text that a numpy kernel works on at once; temporaries take some 60 times as much.
CHUNK_BYTES = 1 << 20

_U = np.uint64


#: Tables written and not yet forgotten, with the number of each.
_WRITTEN: dict[int, DataFrame] = {}
_NUMBERS = itertools.count(1)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends here and a lost executor costs nothing.

    Its shuffle files are done with then and are cleaned up at once.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/quillon/{uuid.uuid4().hex}"
    clean, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._quillon_path = at
    out._quillon_number = next(_NUMBERS)
    _WRITTEN[out._quillon_number] = out
    return out


def forget(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing that is still to run reads it."""
    _WRITTEN.pop(df._quillon_number, None)
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._quillon_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def marked() -> int:
    """A number past which tables yet to be written are counted: where ``swept`` is to begin."""
    return next(_NUMBERS)


def swept(mark: int, *keep: DataFrame) -> None:
    """Deletes the tables written since ``mark`` but for ``keep``: for callers that have stored or read all results."""
    for df in [x for n, x in _WRITTEN.items() if n > mark and not any(x is k for k in keep)]:
        forget(df)


def ids_serve(docs: DataFrame, id_col: str) -> bool:
    """Whether ids are set and unique."""
    return docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("m")).where("m > 1 or id is null").isEmpty()


def with_uid(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, text) with one uid for every distinct text of an id.

    Ids that are set and unique serve as they are. Otherwise (null ids, or an id with several rows) rows are numbered and
    stored, since numbers given anew at each reading need not agree.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if ids_serve(rows, "id"):
        return rows.select(F.col("id").alias("uid"), "id", "text")
    return stored(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "text"))


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the bytes of an Arrow batch, so that very long texts do not meet in one batch by the thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def released() -> None:
    """Gives back what a task's buffers held; workers live on between tasks and their sums count."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array (null: none) and where each value begins and ends."""
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone and whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(33))
        x = x * _U(0xFF51AFD7ED558CCD)
        x ^= x >> _U(33)
        x *= _U(0xC4CEB9FE1A85EC53)
        x ^= x >> _U(33)
    return x


def firsts(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by row (one of ``n``), value and place, and where in it a value of a row stands for the first time."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]
    r, v = rows[order], values[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return new, order


#: Modulus of the range hashes, a Mersenne prime: no text makes two ranges equal by its structure alone.
P61 = _U((1 << 61) - 1)
_R61, _LOW32, _LOW29 = _U(61), _U(0xFFFFFFFF), _U((1 << 29) - 1)
_BASE = 0x1A3F6C58D7E9B241 % ((1 << 61) - 1)


def mod61(x: np.ndarray) -> np.ndarray:
    x = (x & P61) + (x >> _R61)
    return np.minimum(x, x - P61)  # below zero it wraps to the far end


def _by_2_32(x: np.ndarray) -> np.ndarray:
    """x * 2**32 modulo 2**61 - 1, for x below the modulus: a rotation."""
    return ((x & _LOW29) << _U(32)) | (x >> _U(29))


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of values below it, from halves of 29 and 32 bits."""
    a1, a0, b1, b0 = a >> _U(32), a & _LOW32, b >> _U(32), b & _LOW32
    low = a0 * b0
    return mod61((low & P61) + (low >> _R61) + _by_2_32(mod61(a1 * b0 + a0 * b1)) + ((a1 * b1) << _U(3)))


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, mul61(out, np.full(1, pow(base, len(out), (1 << 61) - 1), _U))])
    return out


class Ranges:
    """Polynomial hashes, modulo 2**61 - 1, of any range of a sequence from one prefix sum."""

    _powers = (np.ones(1, _U), np.ones(1, _U))
    _KEPT, _BLOCK = 1 << 22, 1 << 13  # powers kept between buffers; values that stay in the cache

    def __init__(self, values: np.ndarray) -> None:
        """``values`` of 61 bits, or bytes."""
        n = len(values)
        up, self.down = self._grown(n + 1)
        self.sums = np.zeros(n + 1, _U)
        narrow = values.dtype == np.uint8
        for i in range(0, n, self._BLOCK):
            j = min(n, i + self._BLOCK)
            power = up[i:j]
            if narrow:  # at most 2**9 * 2**32 * 2**13
                own = values[i:j].astype(_U) + _U(1)
                high, low = own * (power >> _U(32)), own * (power & _LOW32)
            else:
                own = mul61(mod61(values[i:j]), power)
                high, low = own >> _U(32), own & _LOW32
            total = mod61(mod61(np.cumsum(low)) + _by_2_32(mod61(np.cumsum(high))))
            self.sums[i + 1 : j + 1] = mod61(total + self.sums[i])

    @classmethod
    def _grown(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = cls._powers
        if len(up) < n:
            size, p = 1 << (n - 1).bit_length(), (1 << 61) - 1
            up, down = _powers_of(_BASE, size), _powers_of(pow(_BASE, -1, p), size)
            if size <= cls._KEPT:
                Ranges._powers = (up, down)
        return up, down

    def _hashed(self, sums_b: np.ndarray, sums_e: np.ndarray, down: np.ndarray, size) -> np.ndarray:
        own = mul61(mod61(sums_e + (P61 - sums_b)), down)
        with np.errstate(over="ignore"):
            return mixed(own + size * _U(0xA0761D6478BD642F))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges from ``begin`` to ``end``."""
        out = np.empty(len(begin), _U)
        for i in range(0, len(begin), self._BLOCK):
            b, e = begin[i : i + self._BLOCK], end[i : i + self._BLOCK]
            out[i : i + self._BLOCK] = self._hashed(self.sums[b], self.sums[e], self.down[b], (e - b).astype(_U))
        return out

    def every(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size``, the same as ``of`` gives."""
        n = max(len(self.sums) - size, 0)
        out = np.empty(n, _U)
        for i in range(0, n, self._BLOCK):
            j = min(n, i + self._BLOCK)
            out[i:j] = self._hashed(self.sums[i:j], self.sums[i + size : j + size], self.down[i:j], _U(size))
        return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

#: Bytes that part words: blank and the five control blanks.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def words_of(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every word (maximal run of bytes not in ``apart``); words never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    begin = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, begin, "right") - 1
    return begin, end, row


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``: the fold of a row, by rule of the id alone."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
