"""MinHash near-duplicates with min-max hashing, confirmed on whole shingle sets.

Each permutation gives two signature values: the smallest and the largest hash of a
document's shingles, so ``PERMUTATIONS`` multiplications give twice as many values.
Both have the collision probability of the sets' Jaccard similarity.  Bands of
``BAND_ROWS`` values give candidates; every link is confirmed on the whole sets.

Steps: (1) documents with equal shingle sets become one class; (2) per band bucket the
members are compared with one representative, never with each other; (3) links make
components; (4) buckets that still hold several components get another
representative, and then (5) whatever pairs across components are left in a bucket are
compared outright, by tiers of set sizes, unless sizes or parity bitmaps of the sets rule a link out.  Pairs inside a component need no comparison, so a bucket of n near
copies costs about n comparisons, and no cap applies.

Missed links: two sets with similarity s share no band with probability
``(1 - s**BAND_ROWS)**BANDS``, below 4e-6 at 0.8.

Defined cases: null or empty text has no shingles, is linked with nothing, and is kept.
A null ``doc_id`` is linked with nothing and kept, with a null ``component_id``.  Rows
that repeat a ``doc_id`` with the same text all carry its component; with another text
they are judged by their own.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, released, row_chunks, table, text_bytes, word_hashes, written

PERMUTATIONS, BAND_ROWS = 48, 4
#: Tiers of set sizes are wider than the sizes of linked sets can differ, by this factor.
TIER = 1.04
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: Bits of the parity bitmap.  Two bitmaps differ in at most as many bits as their sets
#: differ in elements, so a larger distance rules a link out, exactly.
PARITY_BITS = 1024
_MULTIPLY = np.random.default_rng(7).integers(1, 2**62, PERMUTATIONS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(8).integers(1, 2**62, PERMUTATIONS, dtype=np.int64).astype(np.uint64)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of all rows, and the rows' offsets in them.

    A row with fewer than k words has its whole sequence as one shingle.
    """
    n = len(off) - 1
    word, row = word_hashes(buf, off)
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = word.copy()
    for i in range(1, k):
        h[: len(h) - i] = h[: len(h) - i] * np.uint64(0x9E3779B97F4A7C15) + word[i:]
    at = np.arange(len(word)) - first[row]
    whole = at <= count[row] - k
    sets = [mix64(h[whole])]
    rows = [row[whole]]
    for r in np.flatnonzero((count > 0) & (count < k)):
        x = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in word[first[r] : first[r + 1]]:
                x = x * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(1)
        sets.append(mix64(np.array([x])))
        rows.append(np.array([r]))
    h, row = np.concatenate(sets), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


def signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys (rows x BANDS) and two keys of the whole set, for rows with shingles."""
    start = at[:-1]
    values = np.empty((2 * PERMUTATIONS, len(start)), np.uint64)
    for p in range(PERMUTATIONS):
        x = h * _MULTIPLY[p] + _ADD[p]
        x ^= x >> np.uint64(32)
        values[2 * p] = np.minimum.reduceat(x, start)
        values[2 * p + 1] = np.maximum.reduceat(x, start)
    bands = np.zeros((len(start), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(start), b + 1, np.uint64)
        for v in values[b * BAND_ROWS : (b + 1) * BAND_ROWS]:
            key = mix64(key ^ v)
        bands[:, b] = key
    one = np.add.reduceat(mix64(h + np.uint64(1)), start)
    two = np.add.reduceat(mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
    return bands, one, two


def parities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bitmaps (rows x PARITY_BITS / 64 words): which cells hold an odd number of the set's hashes."""
    rows = len(at) - 1
    cell = np.repeat(np.arange(rows), np.diff(at)) * PARITY_BITS + (h & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=rows * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, PARITY_BITS), axis=1).view(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, key_1, key_2, bands and parity of each document."""

    def run(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            for i, j in row_chunks(off, 1 << 20):
                h, at = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                size = np.diff(at)
                has = np.flatnonzero(size)
                one, two = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                flat, lengths = np.zeros(0, np.uint64), np.zeros(j - i, np.int64)
                if len(has):
                    bands, one[has], two[has] = signatures(h, np.append(at[has], len(h)))
                    flat, lengths[has] = bands.ravel(), BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), _signed(flat))
                words = PARITY_BITS // 64
                parity = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * words, pa.int32()), pa.array(parities(h, at).ravel()))
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(size), _signed(one), _signed(two), lists, parity], ["doc_id", "key", "n_shingles", "key_1", "key_2", "bands", "parity"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(released(run), "doc_id long, key long, n_shingles long, key_1 long, key_2 long, bands array<long>, parity array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of ``percent`` or more."""

    def run(batches):
        for batch in batches:
            left, right = (text_bytes(batch.column(c)) for c in (2, 3))
            keep = np.zeros(batch.num_rows, bool)
            for i, j in row_chunks(left[1] + right[1], 1 << 20):
                (h, at), (g, bt) = (shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k) for buf, off in (left, right))
                for r in range(j - i):
                    x, y = h[at[r] : at[r + 1]], g[bt[r] : bt[r + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i + r] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    text = docs.select("doc_id", "text")
    whole = (
        pairs.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return whole.mapInArrow(released(run), "a long, b long").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours move to the smallest id around a node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    moved = near.filter("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns u and v: every node of the edges (u, v) but the smallest of its component, and that smallest.

    Alternating large and small stars; each round is a table in the shared folder.
    """
    edges = written(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        edges = written(_star(_star(edges, True), False), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges
        before = state


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, component_id and kept for each row of ``docs``."""
    sketches = written(sketch(docs, k), "sketch")
    key = ["key_1", "key_2", "n_shingles"]
    real = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = written(real.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.min_by(F.struct("bands", "parity"), "doc_id").alias("s")).select(*key, "class_id", "s.bands", "s.parity"), "classes")
    bucket = classes.select("class_id", F.explode("bands").alias("band"))
    shared = bucket.groupBy("band").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).filter("low <> high")
    bucket = written(bucket.join(shared.select("band"), "band"), "buckets")
    text = docs.filter("doc_id is not null")
    links = tried = label = None
    for step in range(rounds + 1):
        member = bucket.withColumn("comp", F.col("class_id"))
        if label is not None:
            member = bucket.join(label.select(F.col("u").alias("class_id"), F.col("v").alias("found")), "class_id", "left").select("band", "class_id", F.coalesce("found", "class_id").alias("comp"))
            open_ = member.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
            member = member.join(open_.select("band"), "band", "left_semi")
        if step < rounds:
            order = F.struct((F.col("class_id") if not step else F.xxhash64("class_id", F.lit(step))).alias("turn"), "class_id", "comp")
            other = member.groupBy("band").agg(F.min(order).alias("m")).select("band", F.col("m.class_id").alias("b"), F.col("m.comp").alias("comp_b"))
            pairs = member.join(other, "band").filter("comp <> comp_b")
        else:
            # each pair once, in the first band that it shares, and only if sizes and parities allow a link
            member = member.join(classes.select("class_id", "bands", "n_shingles", "parity"), "class_id")
            # sizes of a link lie in one tier or in neighbouring ones, so buckets are split by tiers
            member = member.withColumn("tier", F.floor(F.log("n_shingles") / F.lit(math.log(TIER * 100 / percent))))
            other = member.select("band", F.explode(F.array("tier", F.col("tier") - 1)).alias("tier"), *[F.col(c).alias(new) for c, new in (("tier", "tier_b"), ("class_id", "b"), ("comp", "comp_b"), ("bands", "bands_b"), ("n_shingles", "n_b"), ("parity", "parity_b"))])
            first = "element_at(bands, cast(array_position(zip_with(bands, bands_b, (x, y) -> x = y), true) as int)) = band"
            sizes = f"100 * least(n_shingles, n_b) >= {percent} * greatest(n_shingles, n_b)"
            # similarity s: the sets differ in (|a| + |b|) (1 - s) / (1 + s) elements at most
            distance = "aggregate(zip_with(parity, parity_b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"
            near = f"{100 + percent} * {distance} <= {100 - percent} * (n_shingles + n_b)"
            pairs = member.join(other, ["band", "tier"]).filter(f"comp <> comp_b and (tier < tier_b or class_id < b) and {sizes} and {near} and {first}")
        pairs = pairs.select(F.greatest("class_id", "b").alias("a"), F.least("class_id", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = written(confirmed(pairs, text, k, percent), "links")
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows = sketches.drop("bands", "parity").join(classes.drop("bands", "parity"), key, "left")
    if label is None:
        label = classes.limit(0).select(F.col("class_id").alias("u"), F.col("class_id").alias("v"))
    rows = rows.join(label.select(F.col("u").alias("class_id"), F.col("v").alias("found")), "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "class_id", "doc_id"))
    return rows.select("doc_id", "key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_near_dup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80).drop("key")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op2_near_dup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS id FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON a.id < b.id AND 100 * least(len(a.sh), len(b.sh)) >= 80 * greatest(len(a.sh), len(b.sh))
      WHERE 180 * len(list_intersect(a.sh, b.sh)) >= 80 * (len(a.sh) + len(b.sh))),
g AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT id AS u, id AS v FROM c UNION SELECT r.u, g.v FROM r JOIN g ON r.v = g.u),
m AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id,
       coalesce(m.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN m ON m.u = c.id""",
}
