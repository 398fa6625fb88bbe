"""Shared helpers of the training-data operators: shared storage and byte arrays.

Everything a job keeps between its steps goes through :func:`written`: a Parquet table
in the folder that the cluster names in ``spark.checkpoint.dir``.  That cuts lineage and
survives the loss of any executor.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import storage
from folioscope.storage import shared_dir  # noqa: F401

#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
#: Arrays from this size on have memory of their own, which goes back when they do.
MAPPED = 4 << 20



def released(run):
    """``run`` for ``mapInArrow``, with freed memory given back: that of large arrays at once, the rest after the task, as the worker stays for the next."""

    def whole(batches):
        library = ctypes.CDLL(None)
        if hasattr(library, "mallopt"):
            library.mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(library, "malloc_trim"):
                library.malloc_trim(0)

    return whole


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers hold ``BATCH_BYTES``, so that neither side buffers more."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back; readers see one fixed state."""
    small_batches(df.sparkSession)
    return storage.written(df, name)


def ascii_lower(col):
    """A-Z to a-z and nothing else, as a Column.

    ``lower`` is fast but also folds other letters, so texts that hold such letters, or
    characters that the regex engine doesn't know yet, take ``translate``.
    """
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    other = col.rlike(r"[[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}]&&[^\x00-\x7F]]")
    return F.when(other, F.translate(col, upper, low)).otherwise(F.lower(col))


# --- numpy over Arrow text columns -------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def row_chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges ``(i, j)`` of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; uint64 in, uint64 out."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i below n, at least."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        have = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            step = np.uint64(pow(base, filled, 1 << 64))
            take = min(filled, size - filled)
            have[filled : filled + take] = have[:take] * step
            filled += take
        _pow[base] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] == sum of byte(k) * B**k for i <= k < j, modulo 2**64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    term = _BYTE[buf]
    term *= _powers(_BASE, len(buf))
    np.cumsum(term, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings ``[start, end)``; equal strings, equal hashes."""
    inv = _powers(_INV, len(prefix))
    h = (prefix[end] - prefix[start]) * inv[start]
    return mix64(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def every_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """What :func:`span_hash` gives for the strings of ``size`` bytes at all positions, without gathering them."""
    h = prefix[size:] - prefix[: len(prefix) - size]
    h *= _powers(_INV, len(prefix))[: len(h)]
    h ^= np.uint64(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    return mix64(h)


def word_spans(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE):
    """Starts and ends of the words in the rows, and the row of each word."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~sep[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE):
    """Hashes of the lower-cased words, and the row of each."""
    low = LOWER[buf]
    start, end, row = word_spans(low, off, sep)
    return span_hash(prefix_hash(low), start, end), row
