"""Hard negatives: for an anchor and a positive, the most similar rows of other labels within a window of scores.

**Method.**  Product quantisation with stored residual norms.  Vectors become integers
(``floor(256 * x)``).  Their components are taken two by two; each pair is replaced by the nearest of up
to 256 centroids, themselves integers, fitted by k-means on at most ``SAMPLE`` rows (those
with the smallest hashes).  Every row is encoded: the codes, and the norm of what they leave.

An anchor looks its score with each centroid up once; the sum of a row's entries is the
score of the encoded row, exactly.  The true score differs by at most the product of the
anchor's norm and the row's residual norm (Cauchy-Schwarz), so each row has a lower and
an upper bound.  Rows go whose upper bound is below the k-th largest lower bound, or
whose bounds miss the window; integer products of the rest give the exact result, so recall is 1.

**Plan.**  The anchors, a hundredth of all rows, meet all rows in blocks: rows are dealt
into groups by a hash of their id, so that a hot label or vector is spread, and each
group gets every anchor.  A task keeps one group of rows (``BLOCK_BYTES`` of vectors at
most) and anchors stream past, ``ANCHORS`` at a time.  Only the best few of each group leave it, and a window
over anchor (and positive) keeps the best of all.  Positives are sought among rows of the
label, negatives among the others, so both passes together look at each pair once.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite
component, take no part.  Of rows that repeat a vec_id the least by label and vector counts.
Vectors of different lengths count as filled up with zeros.  ``floor(256 * x)`` is kept within
``+-LIMIT``, so that scores of up to 2,047 components are exact in 64 bits.  An anchor
without other rows of its label has no result, nor has a positive with a negative score.
No other column is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, table, written

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: Percentages of the positive's score between which that of a negative lies.
LOW, HIGH = 30, 90
LIMIT = 1 << 26
SAMPLE, CENTROIDS, STEPS, WIDTH = 4096, 256, 8, 2
BLOCK_BYTES = 8 << 20
ANCHORS = 32


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label and v (integers), a row for each vec_id; every seventh id has the next label."""
    good = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(256.0) * x.cast("double")))).cast("int"))
    label = F.col("label").cast("long")
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    rows = rows.select("vec_id", F.struct(F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.alias("v")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = column.flatten().to_numpy()
    return out


def fitted(vectors: DataFrame, dims: int) -> np.ndarray:
    """Integer centroids: parts x CENTROIDS x WIDTH."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    parts = -(-dims // WIDTH)
    x = np.zeros((sample.num_rows, parts * WIDTH))
    if sample.num_rows:
        x[:, :dims] = _matrix(sample.column("v"), dims)
    draw, out = np.random.default_rng(1), np.zeros((parts, CENTROIDS, WIDTH), np.int64)
    for p, points in enumerate(np.split(x, parts, axis=1)):
        distinct = np.unique(points, axis=0)
        if not len(distinct):
            continue
        if len(distinct) > CENTROIDS:
            centre = distinct[draw.choice(len(distinct), CENTROIDS, replace=False)]
            for _ in range(STEPS):
                near = nearest(points, centre)
                count = np.bincount(near, minlength=len(centre))
                for w in range(WIDTH):
                    centre[:, w] = np.where(count > 0, np.bincount(near, points[:, w], len(centre)) / np.maximum(count, 1), centre[:, w])
        else:
            centre = distinct
        out[p] = np.rint(centre[np.arange(CENTROIDS) % len(centre)])
    return out


def nearest(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(axis=1) - 2 * (points @ centre.T)).argmin(axis=1)


def encoded(vectors: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """vec_id, label, v, norm, codes and residual: the norm of what the codes leave of a row, never less."""
    books = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            parts = len(books.value)
            x = np.zeros((batch.num_rows, parts * WIDTH), np.int64)
            x[:, :dims] = _matrix(batch.column(2), dims)
            codes = np.zeros((len(x), parts), np.uint8)
            left = np.zeros(len(x))
            for p, centre in enumerate(books.value):
                mine = x[:, p * WIDTH : (p + 1) * WIDTH]
                codes[:, p] = nearest(mine.astype(float), centre.astype(float))
                left += ((mine - centre[codes[:, p]]).astype(float) ** 2).sum(axis=1)
            norms = [pa.array(np.sqrt(s) * (1 + 1e-9)) for s in ((x.astype(float) ** 2).sum(axis=1), left)]
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.record_batch([*batch.columns, norms[0], packed, norms[1]], ["vec_id", "label", "v", "norm", "codes", "residual"])

    return vectors.select("vec_id", "label", "v").mapInArrow(released(run), "vec_id long, label long, v array<int>, norm double, codes binary, residual double")


class Group:
    """The rows of one group, sorted by label."""

    def __init__(self, batches: list[pa.RecordBatch], dims: int, parts: int):
        rows = pa.Table.from_batches(batches)
        self.ids, label = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.v = _matrix(rows["v"], dims)
        self.codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(-1, parts)
        self.residual = rows["residual"].to_numpy()
        order = np.argsort(label, kind="stable")
        self.ids, self.v, self.codes, self.residual = self.ids[order], self.v[order], self.codes[order], self.residual[order]
        self.label = label[order]

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))


def bounds(books: np.ndarray, codes: np.ndarray, residual: np.ndarray, anchors: np.ndarray, norms: np.ndarray):
    """Lower and upper bounds of the scores of encoded rows (down) with anchors (across), from tables of the anchors' scores with centroids."""
    parts = len(books)
    wide = np.zeros((len(anchors), parts * WIDTH), np.int64)
    wide[:, : anchors.shape[1]] = anchors
    score = np.zeros((len(codes), len(anchors)), np.int64)
    for p, centre in enumerate(books):
        looked = centre @ wide[:, p * WIDTH : (p + 1) * WIDTH].T  # centroid x anchor
        score += looked[codes[:, p]]
    band = np.floor(residual[:, None] * norms * (1 + 1e-9)).astype(np.int64) + 1
    return score - band, score + band


def least_of_best(lower: np.ndarray, k: int, otherwise):
    """The k-th largest; ``otherwise`` where there are fewer."""
    return np.partition(lower, -k)[-k] if len(lower) >= k else otherwise


def _best(ids, score, k):
    return np.lexsort((ids, -score))[:k]


def positives_in(group: Group, books, anchors: pa.RecordBatch, dims: int):
    """anchor_id, vec_id and score of the best rows of the anchor's label in a group."""
    ids, label, norms = (anchors.column(n).to_numpy() for n in ("vec_id", "label", "norm"))
    v = _matrix(anchors.column("v"), dims)
    for one in np.unique(label):
        rows, mine = group.of(one), np.flatnonzero(label == one)
        for at in np.split(mine, range(ANCHORS, len(mine), ANCHORS)):
            lower, upper = bounds(books, group.codes[rows], group.residual[rows], v[at], norms[at])
            for k, a in enumerate(at):
                other = np.flatnonzero(group.ids[rows] != ids[a])
                some = other[upper[other, k] >= least_of_best(lower[other, k], POSITIVES, np.iinfo(np.int64).min)]
                score = group.v[rows][some] @ v[a]
                found = group.ids[rows][some]
                best = _best(found, score, POSITIVES)
                yield ids[a], found[best], score[best]


def negatives_in(group: Group, books, anchors: pa.RecordBatch, dims: int):
    """anchor_id, positive_id, positive score, vec_id and score of the best rows of other labels in a group, within each positive's window."""
    ids, label, norms = (anchors.column(n).to_numpy() for n in ("vec_id", "label", "norm"))
    v, positives = _matrix(anchors.column("v"), dims), anchors.column("positives").to_pylist()
    for one in np.unique(label):
        rows, mine = group.of(one), np.flatnonzero(label == one)
        other = np.concatenate([np.arange(rows.start), np.arange(rows.stop, len(group.ids))])
        codes, residual = group.codes[other], group.residual[other]
        for at in np.split(mine, range(ANCHORS, len(mine), ANCHORS)):
            lower, upper = bounds(books, codes, residual, v[at], norms[at])
            for k, a in enumerate(at):
                low, high = lower[:, k], upper[:, k]
                for p in positives[a]:
                    least, most = -(-LOW * p["score"] // 100), HIGH * p["score"] // 100
                    possible = (high >= least) & (low <= most)
                    inside = low[possible & (low >= least) & (high <= most)]
                    some = other[possible & (high >= least_of_best(inside, NEGATIVES, least))]
                    score = group.v[some] @ v[a]
                    fits = (score >= least) & (score <= most)
                    found, score = group.ids[some][fits], score[fits]
                    best = _best(found, score, NEGATIVES)
                    yield ids[a], p["id"], p["score"], found[best], score[best]


def _searched(index: DataFrame, anchors: DataFrame, groups: int, centroids: np.ndarray, dims: int, search, given: list[str]) -> DataFrame:
    """What ``search`` finds for all anchors in each group; ``given``: names of what it tells of an anchor."""
    books = index.sparkSession.sparkContext.broadcast(centroids)
    rows = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("g"), F.lit(0).alias("kind"), "*")
    asked = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(1).alias("kind"), "*")
    # rows first, then the anchors; a window deals out by group and sorts
    both = rows.unionByName(asked, allowMissingColumns=True)
    both = both.withColumn("_k", F.row_number().over(Window.partitionBy("g").orderBy("kind", "label", "vec_id")))

    def parts(batch):
        """A batch cut where group or kind changes."""
        key = batch.column("g").to_numpy() * 2 + batch.column("kind").to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for i, j in zip(edge, edge[1:], strict=False):
            if j > i:
                yield int(key[i]) // 2, int(key[i]) % 2, batch.slice(i, j - i)

    def run(batches):
        at, held, group = None, [], None
        for batch in batches:
            for g, kind, part in parts(batch):
                if g != at:
                    at, held, group = g, [], None
                if not kind:
                    held.append(part)
                    continue
                if held:
                    group, held = Group(held, dims, len(books.value)), []
                if group is None:
                    continue
                columns = [[] for _ in range(len(given) + 2)]
                for *told, found, score in search(group, books.value, part, dims):
                    for column, value in zip(columns, told, strict=False):
                        column.append(np.full(len(found), value, np.int64))
                    columns[-2].append(found)
                    columns[-1].append(score)
                if columns[0]:
                    yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], [*given, "vec_id", "score"])

    return both.mapInArrow(released(run), ", ".join(f"{n} long" for n in [*given, "vec_id", "score"]))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    spark = rows.sparkSession
    vectors = written(quantised(rows), "vectors")
    known = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims = max(1, known["dims"] or 0)
    centroids = fitted(vectors, dims)
    index = written(encoded(vectors, centroids, dims), "encoded")
    # as many groups as the session has tasks, or as keep a group small
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known["n"] * 8 * dims // BLOCK_BYTES))
    anchors = index.filter(F.col("vec_id") % EVERY == 0)
    best = _first(_searched(index, anchors, groups, centroids, dims, positives_in, ["anchor_id"]), ["anchor_id"], POSITIVES)
    best = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("positives"))
    anchors = written(anchors.join(best, anchors["vec_id"] == best["anchor_id"]).drop("anchor_id"), "anchors")
    found = _searched(index, anchors, groups, centroids, dims, negatives_in, ["anchor_id", "positive_id", "positive_score"])
    found = _first(found, ["anchor_id", "positive_id", "positive_score"], NEGATIVES)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op13_hard_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
}
