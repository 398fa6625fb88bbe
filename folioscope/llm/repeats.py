"""Repeated passages: bytes covered by a string of ``LENGTH`` bytes that starts elsewhere too.

**Method.**  Bucket-pointer refinement, on sampled suffixes.  Every position has an
initial bucket, the fingerprint of the ``Q`` bytes that start there.  A window of
``LENGTH`` bytes is told apart by the bucket identifiers at later offsets; only buckets
that can still split are refined.  Unlike a full suffix sort, identifiers are
fingerprints of content, so that those of later offsets need no table, and one round is
enough, as those of every Q-th offset and of the last cover a window:

1. Each string of SHARED bytes picks the position in it whose Q-byte bucket has the
   smallest fingerprint (its anchor).  Equal strings pick equal anchors at equal
   offsets, so neighbours that pick the same anchor form a run, and a window can repeat
   only within its anchor's bucket.  There are about ``2 / (SHARED - Q)`` runs a byte.
2. A window is a candidate only if the buckets of all anchors in it, those at later
   offsets too, hold several.  Runs are grouped by anchor bucket and by the fingerprint of all bytes that their
   windows cover.  A run alone in its bucket has no repeat; runs with the same cover
   repeat wholly.
3. Where one bucket holds different covers, each cover's windows are refined one by one:
   their bucket identifiers are sorted and counted.

``n_shared`` counts the bytes of all anchors (Q bytes each) that also occur elsewhere.
It is above 0 wherever a passage of SHARED bytes or more repeats, also where it is too
short for a window: a passage of 50 words has some 240 to 350 bytes.

Rows that share no anchor keep everything; Spark's own functions give their results.

Buckets, covers and rows with several runs are marked in bitmaps built by Spark, of LOAD bits a key and at
most ``MOST_BITS`` (32 MB, beyond which more and more marks are false); a false mark costs rows, never results.  Equality is that of fingerprints of 64 bits within
one anchor bucket, itself of 64 bits; of a cover's, the last 8 bits give way to a
window's place in its run, which is below SHARED - Q + 1 <= 256.

Defined cases: null text is empty; texts below LENGTH bytes keep everything; matches
never cross rows; equal rows, even with one ``doc_id``, are each other's copies.  A null
``doc_id`` stays null.  No other column is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as WindowSpec
from pyspark.sql import functions as F

from .common import every_hash, mix64, prefix_hash, released, row_chunks, span_hash, table, text_bytes, written

LENGTH, SHARED, Q = 400, 240, 140
#: Bits of a bitmap: LOAD for each key, between these bounds.
LOAD, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
_BLOCK = 32768
_CHUNK = 1 << 18
_INDEX = np.uint64(0xFFFFFFFF)


def runs(buf: np.ndarray, off: np.ndarray, length: int, shared: int, q: int, bitmap: np.ndarray | None = None):
    """Per run: row, first window, number of windows of ``length`` that can repeat, anchor, bucket and cover; and the bucket of every position.

    bitmap: the buckets that hold several.  A window can repeat only if all anchors of the
    strings of ``shared`` bytes in it are in such buckets: of each run, the first so many.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < shared:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    prefix = prefix_hash(buf)
    buckets = every_hash(prefix, q)
    least = buckets & ~_INDEX
    least |= np.arange(len(buckets), dtype=np.uint64)
    wide, have = shared - q + 1, 1
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    # a run begins where the anchor changes, at a row's start, and ends at the last string of the row
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    long = np.diff(off) >= shared
    new[off[:-1][long]] = True
    past = off[1:][long] - shared + 1
    new[past[past < len(new)]] = True
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(least)))
    row = np.searchsorted(off, first, "right") - 1
    real = first + shared <= off[row + 1]
    row, first, size = row[real], first[real], size[real]
    anchor = (least[first] & _INDEX).astype(np.int64)
    bucket = buckets[anchor]
    size = np.clip(off[row + 1] - length - first + 1, 0, size)
    if bitmap is not None:
        alone = first[~marked(bitmap, bucket.view(np.int64))]
        following = np.append(alone, len(buf) + length)[np.searchsorted(alone, first)]
        size = np.clip(following - (length - shared) - first, 0, size)
    cover = span_hash(prefix, first, np.where(size > 0, first + size + length - 1, first))
    return row, first, size, anchor, bucket, mix64(cover ^ (anchor - first).astype(np.uint64)), buckets


def _rows(batch: pa.RecordBatch, length: int, shared: int, q: int, bitmap: np.ndarray | None = None):
    """For chunks of a batch: first row, then what :func:`runs` gives with buckets and classes as signed integers; class 0: no window."""
    buf, off = text_bytes(batch.column(batch.schema.get_field_index("text")))
    for i, j in row_chunks(off, _CHUNK):
        row, first, size, anchor, bucket, cover, buckets = runs(buf[off[i] : off[j]], off[i : j + 1] - off[i], length, shared, q, bitmap)
        class_ = np.where(size > 0, mix64(cover + bucket) & ~np.uint64(0xFF), np.uint64(0)).view(np.int64)
        yield i, off[i:j] - off[i], row, first, size, anchor, bucket.view(np.int64), class_, buckets


def mark_blocks(keys: DataFrame) -> tuple[DataFrame, int]:
    """Blocks (block, bits) of a bitmap in which every ``key`` is marked, and the bits of the whole."""
    keys = written(keys, "marked")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (LOAD * keys.count()).bit_length()))
    bit = F.pmod("key", F.lit(bits))
    blocks = keys.select(bit.alias("bit")).select(F.expr(f"bit div {_BLOCK}").alias("block"), (F.col("bit") % _BLOCK).alias("at"))
    return blocks.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")), bits


def marks(keys: DataFrame) -> np.ndarray:
    """The bitmap of :func:`mark_blocks` for tasks in Python; only its blocks come to the driver."""
    blocks, bits = mark_blocks(keys)
    out = np.zeros(bits // 8, np.uint8)
    for b in blocks.toLocalIterator():
        out[b["block"] * 4096 : (b["block"] + 1) * 4096] = np.frombuffer(b["bits"], np.uint8)
    return out


def with_marked(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` with a column ``marked``: whether the bitmap of ``keys`` marks their ``key``; told without Python."""
    blocks, bits = mark_blocks(keys)
    blocks = written(blocks, "blocks")  # so that the broadcast reads them only, within its timeout
    told = rows.join(F.broadcast(blocks), F.expr(f"pmod({key}, {bits}) div {_BLOCK}") == F.col("block"), "left")
    byte = F.expr(f"conv(hex(substring(bits, cast(pmod({key}, {_BLOCK}) div 8 + 1 as int), 1)), 16, 10)").cast("int")
    own = F.getbit(byte, F.pmod(key, F.lit(8)).cast("int")) == 1
    return told.select(*rows.columns, F.coalesce(own, F.lit(False)).alias("marked"))


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & (8 * len(bitmap) - 1)
    return ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def repeated_runs(docs: DataFrame, length: int, shared: int, q: int) -> tuple[DataFrame, Broadcast]:
    """doc_id, mark, first, size, anchor, bucket and class of the runs whose bucket holds several (and a few others); and the bitmap of buckets."""

    def count(batches):
        for batch in batches:
            for *_, bucket, _, _ in _rows(batch, length, shared, q):
                key, n = np.unique(bucket, return_counts=True)
                yield pa.record_batch([pa.array(key), pa.array(n)], ["key", "n"])

    buckets = docs.select("text").mapInArrow(released(count), "key long, n long")
    several = buckets.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    bitmap = docs.sparkSession.sparkContext.broadcast(marks(several.select("key")))

    def run(batches):
        for batch in batches:
            for i, start, row, first, size, anchor, bucket, class_, _ in _rows(batch, length, shared, q, bitmap.value):
                keep = marked(bitmap.value, bucket)
                row, first, size, anchor = row[keep], first[keep], size[keep], anchor[keep]
                take = pa.array(row + i)
                columns = [pa.array(first - start[row]), pa.array(size), pa.array(anchor - start[row]), pa.array(bucket[keep]), pa.array(class_[keep])]
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), *columns], ["doc_id", "mark", "first", "size", "anchor", "bucket", "class"])

    return docs.select("doc_id", "mark", "text").mapInArrow(released(run), "doc_id long, mark long, first long, size long, anchor long, bucket long, class long"), bitmap


def refined(docs: DataFrame, classes: DataFrame, buckets: Broadcast, length: int, shared: int, q: int) -> DataFrame:
    """bucket, class and offsets: the windows that also start elsewhere, of classes marked for refinement."""
    # one run of a class is enough: that of its smallest mark
    key = F.col("class").bitwiseXOR(F.col("mark")).alias("key")
    bitmap = docs.sparkSession.sparkContext.broadcast(marks(classes.select(key)))

    def run(batches):
        for batch in batches:
            mark = batch.column(0).to_numpy()
            for i, _, row, first, size, _, bucket, class_, at_all in _rows(batch, length, shared, q, buckets.value):
                at = np.flatnonzero(marked(bitmap.value, class_ ^ mark[row + i]) & (size > 0))
                n = size[at]
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(first[at], n) + offset
                # the buckets at these offsets cover a window
                pair = at_all[start]
                for later in [*range(q, length - q, q), length - q]:
                    pair = mix64(pair * np.uint64(0x9E3779B97F4A7C15) + at_all[start + later])
                pair = pair.view(np.int64)
                yield pa.record_batch([pa.array(np.repeat(bucket[at], n)), pa.array(pair), pa.array(np.repeat(class_[at], n) | offset)], ["bucket", "pair", "window"])

    # dealt out by pair once, counted where they are; equal rows may send the same window twice
    same = WindowSpec.partitionBy("bucket", "pair")
    pairs = docs.select("mark", "text").mapInArrow(released(run), "bucket long, pair long, window long")
    pairs = pairs.select("bucket", "window", F.min("window").over(same).alias("low"), F.max("window").over(same).alias("high"))
    windows = pairs.filter("low <> high")
    offset = F.col("window").bitwiseAND(F.lit(255)).cast("int")
    return windows.groupBy("bucket", (F.col("window") - offset).alias("class")).agg(F.array_sort(F.collect_set(offset)).alias("offsets"))


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Row, start and end of the maximal runs that intervals of rows cover."""
    order = np.argsort(start, kind="stable")
    row, start, reach = row[order], start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = (start[1:] > reach[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], reach[np.append(first[1:], len(order)) - 1] if len(order) else reach


def judged(doc_id: pa.Array, buf: np.ndarray, off: np.ndarray, windows: pa.Array, length: int, q: int, texts: bool) -> pa.RecordBatch:
    """The result of some rows: their bytes lie in ``buf`` from ``off`` on."""
    n = len(doc_id)
    given = windows.flatten()
    row = np.repeat(np.arange(n), windows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    first, size, anchor = (given.field(k).to_numpy(zero_copy_only=False) for k in ("first", "size", "anchor"))
    offsets = given.field("offsets")
    each = np.repeat(np.arange(len(row)), offsets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    single = first[each] + offsets.flatten().to_numpy(zero_copy_only=False) + off[row[each]]
    whole = np.flatnonzero(size > 0)
    begin = first[whole] + off[row[whole]]
    cut, start, end = merged(np.concatenate([row[whole], row[each]]), np.concatenate([begin, single]), np.concatenate([begin + size[whole] + length - 1, single + length]))
    near, low, high = merged(row, anchor + off[row], anchor + off[row] + q)
    total = lambda at, some: np.bincount(at, some, n).astype(np.int64)
    spans = np.bincount(cut, minlength=n)
    to = np.concatenate([[0], np.cumsum(spans)])
    kept, hashes = [], []
    for r in range(n):
        edge = [off[r], *np.stack([start[to[r] : to[r + 1]], end[to[r] : to[r + 1]]], 1).ravel(), off[r + 1]] if spans[r] else off[r : r + 2]
        stay = b"".join(buf[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
        hashes.append(hashlib.sha256(stay).hexdigest())
        kept.append(stay if texts else None)
    struct = pa.StructArray.from_arrays([pa.array(start - off[cut]), pa.array(end - off[cut])], ["start", "end"])
    columns = {
        "doc_id": doc_id, "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(total(cut, end - start)), "n_spans": pa.array(spans), "kept_sha256": pa.array(hashes, pa.string()),
        "n_shared": pa.array(total(near, high - low)), "kept": pa.array(kept, pa.binary()), "spans": pa.ListArray.from_arrays(pa.array(to, pa.int32()), struct),
    }
    return pa.record_batch(columns)


def without_repeats(docs: DataFrame, length: int = LENGTH, shared: int = SHARED, q: int = Q, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, kept (the bytes that stay, if ``texts``) and spans (start, end)."""
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text")
    found, anchors = repeated_runs(docs, length, shared, q)
    found = written(found, "runs")
    key = ["bucket", "class"]
    classes = written(found.groupBy(*key).agg(F.count("*").alias("n"), F.min("mark").alias("mark")), "classes")
    buckets = classes.groupBy("bucket").agg(F.sum("n").alias("all"), F.count_if(F.col("class") != 0).alias("covers")).filter("all > 1")
    several = written(classes.join(buckets, "bucket"), "shared-classes")
    part = refined(docs, several.filter("covers > 1 and class != 0"), anchors, length, shared, q)
    # all runs of a bucket of several share their anchor; classes repeat wholly or in some of their windows
    verdict = several.select(*key, ((F.col("n") > 1) & (F.col("class") != 0)).alias("whole")).join(part, key, "left")
    verdict = written(verdict, "verdict")  # so that the next join stands alone, and Spark can split a class of many copies
    windows = found.join(verdict, key)
    windows = windows.select("doc_id", "mark", "anchor", "first", F.when(F.col("whole"), F.col("size")).otherwise(F.lit(0)).alias("size"), F.when(~F.col("whole"), F.col("offsets")).alias("offsets"))
    per = windows.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "size", "offsets", "anchor")).alias("windows"))
    per = written(per.withColumnsRenamed({"doc_id": "_d", "mark": "_m"}), "windows")
    # rows without any shared anchor need neither a shuffle of their texts nor Python
    docs = with_marked(docs, "mark", per.select(F.col("_m").alias("key")))
    some = docs.filter("marked")
    joined = some.join(per, some["doc_id"].eqNullSafe(F.col("_d")) & (some["mark"] == F.col("_m")), "left").select("doc_id", "text", "windows")

    def run(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            for i, j in row_chunks(off, _CHUNK):
                yield judged(batch.column(0).slice(i, j - i), buf, off[i : j + 1], batch.column(2).slice(i, j - i), length, q, texts)

    kind = "array<struct<start:long,end:long>>"
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, kept binary, spans {kind}"
    none, data = F.lit(0).cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    alone = docs.filter("not marked").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"),
        none.alias("n_shared"), (data if texts else F.lit(None).cast("binary")).alias("kept"), F.array().cast(kind).alias("spans"),
    )
    return joined.mapInArrow(released(run), schema).union(alone)


def op7_repeats(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")
