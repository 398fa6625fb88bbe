"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n documents, weight w and a corpus of ``total`` wanted documents has the
mean repetition rate ``total * w / sum(weights) / n``.  Each document inverts that
Poisson distribution at a uniform number hashed from seed and ``doc_id``, is exploded by
its count, and the copies are sorted by a hash over the whole cluster.

Rates are a small table of one row per source; it is broadcast only if it has at most
``BROADCAST_SOURCES`` rows, otherwise Spark joins it by shuffle and splits hot sources.
``exp(-rate)`` must not vanish, so a rate above ``RATE_STEP`` is the sum of independent
draws at equal shares of it, which has the same distribution.

Defined cases: a null source is a source of its own; a source without a weight, or with
weight zero, has rate zero; equal ``doc_id`` and source give equal counts, so repeated
rows are replicated alike; a null ``doc_id`` hashes as the empty string.  Text is never
read by the counts.  Clashing columns: working columns are prefixed ``_mix``, and the
names ``copy``, ``n_copies`` and ``shuffle_key`` replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_SOURCES = 10_000
RATE_STEP = 500.0
SEED = "mix-1"


def rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, power: float) -> tuple[DataFrame, int]:
    """_mix_source, _mix_pieces and _mix_cdf (chances of at most 0, 1, ... copies), and their number."""
    counts = docs.groupBy(F.col("source").alias("_mix_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        counts = counts.withColumn("_w", F.pow("_n", F.lit(power)))
    else:
        given = F.lit(0.0)
        for name, weight in weights.items():
            given = F.when(F.col("_mix_source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(given)
        counts = counts.withColumn("_w", given)
    whole = counts.agg(F.sum("_w").alias("w"), F.sum("_n").alias("n"), F.count("*").alias("sources")).first()
    scale = (float(whole.n or 0) if total is None else float(total)) / (whole.w or 1.0)
    table = (
        counts.withColumn("_rate", F.lit(scale) * F.col("_w") / F.col("_n"))
        .withColumn("_mix_pieces", F.greatest(F.lit(1), F.ceil(F.col("_rate") / RATE_STEP)).cast("int"))
        .withColumn("_r", F.col("_rate") / F.col("_mix_pieces"))
        .withColumn("_last", F.ceil(F.col("_r") + 12 * F.sqrt("_r") + 20).cast("int"))
        .withColumn(
            "_mix_cdf",
            F.expr(
                "aggregate(sequence(1, _last), named_struct('p', exp(-_r), 'cdf', array(exp(-_r))),"
                " (s, k) -> named_struct('p', s.p * _r / k, 'cdf', concat(s.cdf, array(element_at(s.cdf, -1) + s.p * _r / k))), s -> s.cdf)"
            ),
        )
    )
    return table.select("_mix_source", "_mix_pieces", "_mix_cdf"), whole.sources


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, power: float = 0.5, seed: str = SEED) -> DataFrame:
    """The columns of ``docs`` with copy, n_copies and shuffle_key, in shuffled order.

    weights: target weight by source; None takes ``n ** power``, which lifts small
    sources.  total: the expected number of rows, by default that of ``docs``.
    """
    table, sources = rates(docs, weights, total, power)
    if sources <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    docs = docs.drop("copy", "n_copies", "shuffle_key")
    joined = docs.join(table, F.col("source").eqNullSafe(F.col("_mix_source")))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = F.expr(
        "aggregate(sequence(1, _mix_pieces), 0, (n, i) -> n + size(filter(_mix_cdf, c -> c <="
        f" cast(conv(substr(md5(concat('{seed}', '|', i, '|', coalesce(cast(doc_id as string), ''))), 1, 13), 16, 10) as bigint) / 4503599627370496D)))"
    )
    return (
        joined.withColumn("n_copies", drawn.cast("long"))
        .filter("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
        .withColumn("shuffle_key", F.md5(F.concat(F.lit(seed + "|at|"), F.col("copy").cast("string"), F.lit("|"), ident)))
        .select(*docs.columns, "copy", "n_copies", "shuffle_key")
        .orderBy("shuffle_key")
    )


def op10_mix_sources(spark, sf_dir):
    return replicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op10_mix_sources": f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n)::DOUBLE FROM n) / (SELECT sum(w) FROM n) * w / n AS rate FROM n),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
d AS (SELECT *, ('0x' || substr(md5('{SEED}|1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
m AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) FILTER (c.cdf <= d.u) AS n_copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id, d.text, d.lang, d.source, d.n_chars, d.u)
SELECT doc_id, text, lang, source, n_chars, x.copy AS copy, n_copies, md5('{SEED}|at|' || x.copy || '|' || coalesce(doc_id::VARCHAR, '')) AS shuffle_key
FROM m, unnest(generate_series(1, n_copies)) AS x(copy)""",
}
