"""Whole plans: from layouts of two versions to diffs, classifications and summaries of all pairs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.config import LayoutConfig, MatchConfig
from folioscope.operators import classify, diffing, layout, matching, sections
from folioscope.plans import corpus
from folioscope.storage import written


def sections_of(lines: DataFrame, pages: DataFrame, cfg: LayoutConfig = LayoutConfig(), fuzzy: bool = True) -> DataFrame:
    """Cleaned and sectioned documents; doc_id doubles as pair_id."""
    # lines and pages are dealt out by document: joins by document and more must not deal them out anew
    lines.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    kept = layout.clean_lines(lines, pages, cfg, fuzzy, single=True).filter("reason is null")
    return sections.sections(kept, cfg, single=True).withColumn("pair_id", F.col("doc_id"))


def compare(lines_a: DataFrame, pages_a: DataFrame, lines_b: DataFrame, pages_b: DataFrame, cfg: LayoutConfig = LayoutConfig(), match_cfg: MatchConfig = MatchConfig(), fuzzy: bool = True, classifier: diffing.Hook | None = None, seconds: dict | None = None) -> dict[str, DataFrame]:
    """sections_a, sections_b, pairs, matches, texts and diffs of all pairs of documents with one doc_id.

    seconds: gets the seconds that the stages took over all pairs.
    """
    begun, seconds = time.perf_counter(), {} if seconds is None else seconds

    def timed(name: str) -> None:
        seconds[name] = round(time.perf_counter() - begun - sum(seconds.values()), 3)

    # each stage is read several times by the next
    a = written(sections_of(lines_a, pages_a, cfg, fuzzy), "sections-a")
    b = written(sections_of(lines_b, pages_b, cfg, fuzzy), "sections-b")
    timed("sectionize")
    pool_a, pool_b = written(matching.pool(a), "pool-a"), written(matching.pool(b), "pool-b")
    accepted = written(matching.assigned_lazily(pool_a, pool_b, match_cfg), "accepted")
    found = written(matching.matches(pool_a, pool_b, accepted, match_cfg), "matches")
    timed("match")
    pairs = pages_a.select(F.col("doc_id").alias("pair_id")).union(pages_b.select("doc_id")).distinct()
    return {"sections_a": a, "sections_b": b, "pairs": pairs, "matches": found, "texts": diffing.texts(found, a, b), "diffs": diffing.diffs(found, a, b, classifier)}


def backends(layouts: dict[str, tuple[DataFrame, DataFrame, DataFrame, DataFrame]], cfg: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Per backend and pair: summary, quality ratios, section counts, what extraction removed, and the seconds of the backend's stages.

    layouts: lines and pages of both sides by backend.  A backend that fails gives one row with its error.
    """
    out = None
    for name, sides in layouts.items():
        seconds: dict[str, float] = {}
        begun = time.perf_counter()
        try:
            sides = [written(side, "layout") for side in sides]
            seconds["extract"] = round(time.perf_counter() - begun, 3)
            stages: dict[str, float] = {}
            found = compare(*sides, cfg, seconds=stages)
            seconds |= stages
            total = written(diffing.quality(diffing.summary(found["diffs"], found["pairs"])), "summary")
            seconds["diff"] = round(time.perf_counter() - begun - sum(seconds.values()), 3)
            for s, k in (("a", 0), ("b", 2)):
                count = found[f"sections_{s}"].groupBy("pair_id").agg(F.count("*").alias(f"sections_{s}"))
                debug = layout.extraction_summary(layout.clean_lines(sides[k], sides[k + 1], cfg), sides[k + 1])
                debug = debug.select(F.col("doc_id").alias("pair_id"), F.struct("pages", "lines", "removed", "remaining").alias(f"extraction_{s}"))
                total = total.join(count, "pair_id", "left").join(debug, "pair_id", "left").fillna(0, [f"sections_{s}"])
            rows, error = written(total, "backend"), None
        except Exception as failure:  # one backend's failure is a finding of the comparison
            spark = next(s for s in sides).sparkSession
            rows, error = spark.range(1).select(F.lit(None).cast("string").alias("pair_id")), str(failure).splitlines()[0]
        seconds["total"] = round(time.perf_counter() - begun, 3)
        rows = rows.withColumn("backend", F.lit(name)).withColumn("ok", F.lit(error is None)).withColumn("error", F.lit(error).cast("string"))
        rows = rows.withColumn("timing_seconds", F.create_map(*[F.lit(x) for kv in seconds.items() for x in kv]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def corpus_comparison(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = corpus.documents(spark, sf_dir)
    return compare(*corpus.layout(docs, "a"), *corpus.layout(docs, "b"))


def corpus_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(corpus_comparison(spark, sf_dir)["texts"])
