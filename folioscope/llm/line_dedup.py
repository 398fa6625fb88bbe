"""Line dedup that can be undone: an index of lines to which documents are added and from which they go.

**Method.**  Sharded cuckoo filters backed by exact reference-count tables.  A line's key
is the line stripped of ASCII white space and with A-Z lower-cased; keys of at least
``LEAST`` code points count and are known by 128 bits of hash.  An index holds

* ``postings``: key and document, a row for each row of text that holds the key;
* ``refs``: per key the number of such rows and its smallest and largest document, exact;
* ``filters``: per shard of the key space a cuckoo filter (buckets of four fingerprints of
  16 bits) of the keys that several documents hold.

:func:`added` merges new documents into the counts and inserts the keys that come to be
repeated; :func:`removed` takes documents out again, counts the keys they held anew from
the postings and deletes from the filters those that no longer repeat, which Bloom filters
could not.  Only shards with such keys change.  Adding and then removing
documents leaves the index as it was, so that a line comes back when its first document goes.

:func:`deduplicated` drops the lines of keys that several documents hold, except in the
smallest of them.  The filters sift the lines in the scan: rows without a hit are done
there, without any shuffle; hits meet ``refs`` in a join by key, which decides.  Filters
are broadcast up to ``SIEVE_BYTES`` (some eight million repeated keys); beyond that every
line meets ``refs``.  A key of more rows than a share of ``1 / HOT_KEYS`` of all (10,000 at least) goes with
the filters, as at most HOT_KEYS keys can have so many, so that no hot line gathers rows in one task.

Defined cases: null or empty text is one empty line; rows that repeat a ``doc_id`` are
parts of one document; a null ``doc_id`` is one document, larger than all.  Keys that
the index does not know stay.  No other column is read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, released, table, written

LEAST = 10
#: A filter has BUCKETS * SLOTS places for some SHARD_KEYS keys.
BUCKETS, SLOTS, SHARD_KEYS = 1 << 12, 4, 1 << 13
ROUNDS = 500
SIEVE_BYTES = 32 << 20
HOT_KEYS, HOT_ROWS = 1 << 16, 10_000
#: Stands for a null doc_id.
LAST = (1 << 63) - 1
_ROWS = 1 << 16


class Cuckoo:
    """A cuckoo filter over 64-bit hashes; a key lies in one of two buckets, each told from the other and the fingerprint."""

    def __init__(self, data: bytes | None = None):
        self.table = np.zeros((BUCKETS, SLOTS), np.uint16) if data is None else np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()

    @staticmethod
    def places(keys: np.ndarray):
        """Fingerprint (never 0) and first bucket."""
        keys = keys.view(np.uint64)
        return np.maximum(keys >> np.uint64(48), np.uint64(1)).astype(np.uint16), (keys & np.uint64(BUCKETS - 1)).astype(np.int64)

    @staticmethod
    def other(bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(mark.astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        mark, at = self.places(keys)
        draw = np.random.default_rng(len(keys))
        for _ in range(ROUNDS):
            if not len(at):
                return
            bucket, one = np.unique(at, return_index=True)  # one key a bucket in each round
            held = self.table[bucket]
            free = held == 0
            slot = np.where(free.any(axis=1), free.argmax(axis=1), draw.integers(SLOTS, size=len(bucket)))
            out = held[np.arange(len(bucket)), slot]
            self.table[bucket, slot] = mark[one]
            mark[one] = out  # what was there goes on to its other bucket, as do the keys that had no turn
            at = self.other(at, mark)
            at, mark = at[mark != 0], mark[mark != 0]
        raise ValueError("a shard holds more keys than its filter has places")

    def remove(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        mark, first = self.places(keys)
        left = np.arange(len(keys))
        for at in (first, self.other(first, mark)):
            missed = []
            while len(left):
                bucket, one = np.unique(at[left], return_index=True)
                same = self.table[bucket] == mark[left[one]][:, None]
                found = same.any(axis=1)
                self.table[bucket[found], same[found].argmax(axis=1)] = 0
                missed.append(left[one[~found]])
                left = np.delete(left, one)
            left = np.concatenate(missed) if missed else left

    def contains(self, keys: np.ndarray) -> np.ndarray:
        return _held(self.table, *self.places(keys), 0)


def _held(cells, mark, first, base) -> np.ndarray:
    second = Cuckoo.other(first, mark)
    return (cells[first + base] == mark[:, None]).any(axis=1) | (cells[second + base] == mark[:, None]).any(axis=1)


class Sieve:
    """What a scan knows of an index: all filters, or None where they are too large, and the hot keys with their smallest documents."""

    def __init__(self, filters: list[tuple[int, bytes]] | None, shards: int, hot: list[tuple[int, int, int]]):
        self.cells, self.base = None, np.full(shards, -1, np.int64)
        if filters is not None:
            for k, (shard, _) in enumerate(filters):
                self.base[shard] = k * BUCKETS
            self.cells = np.concatenate([np.frombuffer(data, np.uint16).reshape(-1, SLOTS) for _, data in filters] or [np.zeros((0, SLOTS), np.uint16)])
        self.hot = {(hi, lo): first for hi, lo, first in hot}

    def hits(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        if self.cells is None:
            return np.ones(len(hi), bool)
        base = self.base[hi & (len(self.base) - 1)]
        out = base >= 0
        mark, first = Cuckoo.places(lo[out])
        out[out] = _held(self.cells, mark, first, base[out])
        return out


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame  # hi, lo, doc_id
    refs: DataFrame  # hi, lo, n, first, last
    filters: DataFrame  # shard, cells
    shards: int


def line_keys(data: bytes) -> list[bytes | None]:
    """The 16 bytes that stand for each line's key; None if the key is too short."""
    out = []
    for line in data.split(b"\n"):
        key = line.strip().lower()  # of bytes: ASCII alone
        if len(key) < LEAST or len(key) < 4 * LEAST and len(key.decode("utf-8", "replace")) < LEAST:
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _data(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())


def _postings(docs: DataFrame) -> DataFrame:
    def packed(keys, ids):
        hi, lo = _halves(keys)
        return pa.record_batch([pa.array(hi), pa.array(lo), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"])

    def run(batches):
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _data(batch.column(1)), strict=True):
                own = {k for k in line_keys(text.as_py() or b"") if k}
                keys += own
                ids += [LAST if doc_id is None else doc_id] * len(own)
                if len(keys) > _ROWS:
                    yield packed(keys, ids)
                    keys, ids = [], []
            yield packed(keys, ids)

    return docs.select("doc_id", "text").mapInArrow(released(run), "hi long, lo long, doc_id long")


def _counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _repeated():
    """Of a row of refs: whether several documents hold the key."""
    return F.col("first") != F.col("last")


def empty(spark: SparkSession) -> LineIndex:
    frame = lambda schema: spark.createDataFrame([], schema)
    return LineIndex(frame("hi long, lo long, doc_id long"), frame("hi long, lo long, n long, first long, last long"), frame("shard long, cells binary"), 1)


def _refiltered(index: LineIndex, refs: DataFrame, changes: DataFrame) -> tuple[DataFrame, int]:
    """Filters after ``changes`` (hi, lo, change: 1 or -1); all built anew where shards would hold too many keys."""
    repeated = refs.filter(_repeated()).count()
    shards = index.shards
    while repeated > shards * SHARD_KEYS:
        shards *= 2
    filters = index.filters
    if shards != index.shards:
        changes, filters = refs.filter(_repeated()).select("hi", "lo", F.lit(1).alias("change")), filters.filter("false")

    def changed(old: pa.Table, new: pa.Table) -> pa.Table:
        cuckoo = Cuckoo(old.column("cells")[0].as_py() if old.num_rows else None)
        lo, change = new.column("lo").to_numpy(), new.column("change").to_numpy()
        cuckoo.remove(lo[change < 0])
        cuckoo.insert(lo[change > 0])
        shard = (old if old.num_rows else new).column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int64()), "cells": pa.array([cuckoo.table.tobytes()], pa.binary())})

    # a shard has some SHARD_KEYS keys at most, so a group is small
    changes = changes.select(F.pmod("hi", F.lit(shards)).alias("shard"), "lo", "change")
    grouped = filters.groupBy("shard").cogroup(changes.groupBy("shard"))
    return written(grouped.applyInArrow(changed, "shard long, cells binary"), "line-filters"), shards


def added(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with more documents."""
    new = written(_postings(docs), "line-postings")
    both = index.refs.withColumn("was", _repeated()).unionByName(_counts(new).withColumn("was", F.lit(False)))
    merged = both.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.bool_or("was").alias("was"))
    merged = written(merged, "line-refs")
    refs = merged.drop("was")
    filters, shards = _refiltered(index, refs, merged.filter(_repeated() & ~F.col("was")).select("hi", "lo", F.lit(1).alias("change")))
    return LineIndex(index.postings.unionByName(new), refs, filters, shards)


def removed(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of the ids (column doc_id; null: those without id)."""
    ids = ids.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id")).distinct()
    rest = written(index.postings.join(ids, "doc_id", "left_anti").select("hi", "lo", "doc_id"), "line-postings")
    touched = index.postings.join(ids, "doc_id", "left_semi").select("hi", "lo").distinct()
    again = _counts(rest.join(touched, ["hi", "lo"], "left_semi"))
    old = index.refs.join(touched, ["hi", "lo"], "left_semi").select("hi", "lo", _repeated().alias("was"))
    now = written(old.join(again, ["hi", "lo"], "left"), "line-changes")
    gone = F.col("was") & ~F.coalesce(_repeated(), F.lit(False))
    refs = index.refs.join(touched, ["hi", "lo"], "left_anti").unionByName(now.filter("n is not null").drop("was"))
    refs = written(refs, "line-refs")
    filters, shards = _refiltered(index, refs, now.filter(gone).select("hi", "lo", F.lit(-1).alias("change")))
    return LineIndex(rest, refs, filters, shards)


def sieve(index: LineIndex) -> Sieve:
    """What fits for a broadcast: the filters if they are small enough, and keys of very many rows (at most HOT_KEYS)."""
    fits = index.filters.select(F.sum(F.length("cells"))).first()[0] or 0
    filters = [tuple(r) for r in index.filters.select("shard", "cells").toLocalIterator()] if fits <= SIEVE_BYTES else None
    rows = index.refs.agg(F.sum("n")).first()[0] or 0
    hot = index.refs.filter(_repeated() & (F.col("n") > max(HOT_ROWS, rows // HOT_KEYS))).select("hi", "lo", "first")
    return Sieve(filters, index.shards, [tuple(r) for r in hot.toLocalIterator()])


def deduplicated(index: LineIndex, docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 and, if ``texts``, kept."""
    known = docs.sparkSession.sparkContext.broadcast(sieve(index))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text")

    def asked(batch):
        """Per row: its id, lines, their keys, and which of these the filters let through and are not hot."""
        for doc_id, text in zip(batch.column(0).to_pylist(), _data(batch.column(2)), strict=True):
            data = text.as_py() or b""
            keys = line_keys(data)
            own = list({k for k in keys if k})
            if own:
                hi, lo = _halves(own)
                hot = known.value.hot
                own = [k for k, h, a, b in zip(own, known.value.hits(hi, lo).tolist(), hi.tolist(), lo.tolist(), strict=True) if h and (a, b) not in hot]
            yield LAST if doc_id is None else doc_id, data, keys, own

    def judged(doc_id, data, keys, dropped):
        hot, lines = known.value.hot, data.split(b"\n")

        def stays(key):
            if key is None or key in dropped:
                return key is None
            return not hot or hot.get(tuple(int.from_bytes(key[k : k + 8], "little", signed=True) for k in (0, 8)), doc_id) >= doc_id

        keep = [line for line, key in zip(lines, keys, strict=True) if stays(key)]
        kept = b"\n".join(keep)
        return len(lines), len(lines) - len(keep), hashlib.sha256(kept).hexdigest(), kept if texts else None

    names, kinds = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"], [pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def result(ids, rows):
        return pa.record_batch([ids, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    def alone(batches):
        for batch in batches:
            rows = [(k, judged(doc_id, data, keys, ())) for k, (doc_id, data, keys, own) in enumerate(asked(batch)) if not own]
            yield result(batch.column(0).take(pa.array([k for k, _ in rows], pa.int64())), [r for _, r in rows])

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array([bool(own) for *_, own in asked(batch)], pa.bool_()))

    def hits(batches):
        for batch in batches:
            take, keys = [], []
            for k, (*_, own) in enumerate(asked(batch)):
                take += [k] * len(own)
                keys += own
            hi, lo = _halves(keys)
            take = pa.array(take, pa.int64())
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(hi), pa.array(lo)], ["doc_id", "mark", "hi", "lo"])

    def joined(batches):
        for batch in batches:
            rows = []
            for doc_id, text, dropped in zip(batch.column(0).to_pylist(), _data(batch.column(1)), batch.column(2), strict=True):
                data = text.as_py() or b""
                dropped = {k["hi"].to_bytes(8, "little", signed=True) + k["lo"].to_bytes(8, "little", signed=True) for k in dropped.as_py() or ()}
                rows.append(judged(LAST if doc_id is None else doc_id, data, line_keys(data), dropped))
            yield result(batch.column(0), rows)

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept binary"
    found = docs.mapInArrow(released(hits), "doc_id long, mark long, hi long, lo long")
    lost = found.join(index.refs.filter(_repeated()).select("hi", "lo", "first"), ["hi", "lo"]).filter(F.coalesce("doc_id", F.lit(LAST)) > F.col("first"))
    lost = lost.groupBy(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).agg(F.collect_set(F.struct("hi", "lo")).alias("dropped"))
    rest = docs.mapInArrow(released(some), "doc_id long, mark long, text string")
    rest = rest.join(lost, rest["doc_id"].eqNullSafe(F.col("_d")) & (rest["mark"] == F.col("_m")), "left").select("doc_id", "text", "dropped")
    out = rest.mapInArrow(released(joined), schema).union(docs.mapInArrow(released(alone), schema))
    return out.withColumn("kept", F.col("kept").cast("string")) if texts else out.drop("kept")


def op11_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return deduplicated(added(empty(spark), docs), docs, texts=False)


ORACLE = {
    "op11_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT k.doc_id, k.line, k.pos, r.first IS NULL OR r.first = k.doc_id AS stays FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM s GROUP BY doc_id"""
}
