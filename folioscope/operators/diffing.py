"""Differences of matched sections, as lines and as sentences."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folioscope.functions import text as T
from folioscope.functions.similarity import CHUNKS, structured_diff, unified_diff

_JOINED = r"(?iu)(?:^|[^\p{L}\p{N}_])(" + "|".join(T.CONNECTORS) + r")$"


def unwrapped(lines) -> F.Column:
    """Soft-wrapped lines joined again: one text per paragraph.

    Whether a line goes on depends on it and the line before alone, so each line gets its
    own mark of a beginning or of going on, and one split of the joined text follows.
    """
    clean = F.filter(F.transform(lines, lambda s: F.replace(F.trim(s), F.lit("\n"), F.lit(" "))), lambda s: s != "")

    def marked(last, line):
        fresh = last.rlike(r"[.?!:;]$") | line.rlike(r"^\d+[.)]\s+") | line.rlike(r"^[A-Z][A-Z0-9\s-]{3,}$") | ~(line.rlike(r"^[a-z(,;]") | last.rlike(_JOINED))
        return F.concat(F.when(fresh, "\n").otherwise(" "), line)

    def joined(clean):
        rest = F.greatest(F.size(clean) - 1, F.lit(0))
        more = F.zip_with(F.slice(clean, F.lit(1), rest), F.slice(clean, F.lit(2), rest), marked)
        text = F.array_join(F.concat(F.slice(clean, 1, 1), more), "")
        return F.when(F.size(clean) > 0, F.split(text, "\n")).otherwise(F.expr("cast(array() as array<string>)"))

    return T.once(clean, joined)


def section_lines(title, body_lines) -> F.Column:
    return F.filter(F.concat(F.array(title), body_lines), lambda s: F.trim(s) != "")


def statuses(pairs: DataFrame) -> DataFrame:
    """Adds status and semantic_status to rows with title_a/b and body_a/b and body_lines_a/b."""
    same_title = T.normalize_title(F.col("title_a")) == T.normalize_title(F.col("title_b"))
    same_body = T.normalize_body(F.col("body_a")) == T.normalize_body(F.col("body_b"))
    renumbered = ~same_title & (T.title_core(F.col("title_a")) == T.title_core(F.col("title_b")))
    whole = lambda s: T.normalize_body(F.concat_ws(" ", f"title_{s}", F.concat_ws(" ", f"body_lines_{s}")))
    status = F.when(same_title & same_body, "unchanged").when(same_body & renumbered, "renumbering_only").otherwise("modified")
    semantic = F.when(whole("a") == whole("b"), "unchanged").when(same_body & renumbered, "renumbering_only").otherwise("modified")
    return pairs.withColumn("status", status).withColumn("semantic_status", semantic)


def paired(matches: DataFrame, sections_a: DataFrame, sections_b: DataFrame) -> DataFrame:
    """Matches with title, body, body_lines, parent and pages of both sides; null where there is none."""
    cols = ["title", "body", "body_lines", "parent_id", "start_page", "anchor_type"]
    for s, df in (("a", sections_a), ("b", sections_b)):
        matches = matches.join(df.select("pair_id", F.col("section_id").alias(f"section_id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols]), ["pair_id", f"section_id_{s}"], "left")
    return matches


Hook = Callable[[pd.Series, pd.Series], pd.Series]


def texts(matches: DataFrame, sections_a: DataFrame, sections_b: DataFrame) -> DataFrame:
    """Matches with the lines and the semantic text of both sides: all that classification needs, inside the JVM."""
    p = paired(matches, sections_a, sections_b)
    for s in "ab":
        p = p.withColumn(f"section_lines_{s}", section_lines(F.col(f"title_{s}"), F.col(f"body_lines_{s}")))
        p = p.withColumn(f"semantic_text_{s}", F.array_join(unwrapped(F.col(f"section_lines_{s}")), "\n"))
    return p.withColumn("diff_no", F.col("match_no"))


def title_diffs(a, b, label_a, label_b) -> F.Column:
    """status, structured_diff (no equal chunk) and unified_diff of two titles."""
    changed = a != b
    chunk = F.array(F.struct(F.lit("replace").alias("tag"), F.array(a).alias("lines_a"), F.array(b).alias("lines_b"))).cast(CHUNKS)
    status = F.when(T.normalize_title(a) == T.normalize_title(b), "unchanged").otherwise("modified")
    # of one line each, the unified diff is fixed
    lines = [F.concat(F.lit("--- "), label_a), F.concat(F.lit("+++ "), label_b), F.lit("@@ -1 +1 @@"), F.concat(F.lit("-"), a), F.concat(F.lit("+"), b)]
    return F.struct(status.alias("status"), F.when(changed, chunk).otherwise(F.expr("array()").cast(CHUNKS)).alias("structured_diff"), F.when(changed, F.concat_ws("\n", *lines)).otherwise("").alias("unified_diff"))


def diffs(matches: DataFrame, sections_a: DataFrame, sections_b: DataFrame, classifier: Hook | None = None) -> DataFrame:
    """A row per match: statuses, chunks and unified diffs of body, whole section, sentences and title.

    classifier: gives change_classification for the bodies of ``modified`` rows, batch by
    batch; it takes two series of texts and returns one of labels or nulls.
    """
    p = texts(matches, sections_a, sections_b)
    for s in "ab":
        p = p.withColumn(f"units_{s}", T.semantic_units(F.col(f"semantic_text_{s}")))
    both = F.col("section_id_a").isNotNull() & F.col("section_id_b").isNotNull()
    hit = statuses(p.filter(both))
    for name, a, b, equal in (("structured_diff", "body_lines_a", "body_lines_b", False), ("section_diff", "section_lines_a", "section_lines_b", True), ("semantic_diff", "units_a", "units_b", True)):
        hit = hit.withColumn(name, structured_diff(F.col(a), F.col(b), equal))
    label = lambda s, kind: F.concat(F.col(f"section_id_{s}"), F.lit(":" + kind))
    hit = hit.withColumn("title_diff", title_diffs(F.col("title_a"), F.col("title_b"), label("a", "title_old"), label("b", "title_new")))
    hit = hit.withColumn("unified_diff", unified_diff(F.col("body_lines_a"), F.col("body_lines_b"), label("a", "old"), label("b", "new")))
    hit = hit.withColumn("semantic_unified_diff", unified_diff(F.col("units_a"), F.col("units_b"), label("a", "semantic_old"), label("b", "semantic_new")))
    told = F.lit(None).cast("string")
    if classifier is not None:

        @pandas_udf("string")
        def ask(x: pd.Series, y: pd.Series) -> pd.Series:
            asked = x.notna() & y.notna()
            out = pd.Series([None] * len(x), index=x.index, dtype=object)
            if asked.any():
                out[asked] = classifier(x[asked], y[asked])
            return out

        some = F.col("status") == "modified"
        told = F.when(some, ask(F.when(some, F.col("body_a")), F.when(some, F.col("body_b"))))
    hit = hit.withColumn("change_classification", told)
    alone = p.filter(~both).withColumn("status", F.when(F.col("section_id_b").isNull(), "removed").otherwise("added")).withColumn("semantic_status", F.col("status"))
    chunk = lambda n: F.array(F.struct(F.when(F.col("status") == "removed", "delete").otherwise("insert").alias("tag"), F.coalesce(f"{n}_a", F.expr("cast(array() as array<string>)")).alias("lines_a"), F.coalesce(f"{n}_b", F.expr("cast(array() as array<string>)")).alias("lines_b"))).cast(CHUNKS)
    none = F.expr("array()").cast(CHUNKS)
    alone = alone.withColumn("structured_diff", none).withColumn("section_diff", chunk("section_lines")).withColumn("semantic_diff", chunk("units")).withColumn("title_diff", F.lit(None).cast(hit.schema["title_diff"].dataType)).withColumn("change_classification", F.lit(None).cast("string"))
    alone = alone.withColumn("unified_diff", F.lit("")).withColumn("semantic_unified_diff", F.lit(""))
    every = hit.unionByName(alone)
    return every.withColumn("anchor_type", F.coalesce("anchor_type_a", "anchor_type_b")).withColumn("low_confidence", F.col("confidence") == "low-confidence matched")


def of_all(counts: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Counts by pair, with a row of zeros for each pair that has none."""
    if pairs is None:
        return counts
    every = pairs.select(F.col("pair_id").alias("_p")).distinct()
    joined = every.join(counts, F.col("_p").eqNullSafe(F.col("pair_id")), "left")
    return joined.select(F.col("_p").alias("pair_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "pair_id"])


def summary(diffs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Per pair: pool sizes and counts; ``modified`` is every match that is not unchanged.  ``pairs``: also those without any section."""
    a, b = F.col("section_id_a").isNotNull(), F.col("section_id_b").isNotNull()
    counts = diffs.groupBy("pair_id").agg(
        F.count_if(a).alias("total_sections_a"), F.count_if(b).alias("total_sections_b"), F.count_if(a & b).alias("matched"), F.count_if(a & ~b).alias("removed"), F.count_if(b & ~a).alias("added"),
        F.count_if(a & b & (F.col("status") == "unchanged")).alias("unchanged"), F.count_if(a & b & (F.col("status") != "unchanged")).alias("modified"),
    )
    return of_all(counts, pairs)


def quality(summary: DataFrame) -> DataFrame:
    """Ratios among the matches, 4 digits."""
    share = lambda c: F.round(F.col(c) / F.greatest(F.lit(1), F.col("matched")), 4)
    return summary.withColumn("modified_ratio_in_matches", share("modified")).withColumn("unchanged_ratio_in_matches", share("unchanged"))


def row_pairs(diffs: DataFrame, column: str = "section_diff") -> DataFrame:
    """pair_id, diff_no, chunk, tag, row, old and new: lines side by side, padded with empty ones."""
    rows = diffs.select("pair_id", "diff_no", F.posexplode(column).alias("chunk", "c"))
    rows = rows.select("pair_id", "diff_no", "chunk", F.col("c.tag").alias("tag"), F.posexplode_outer(F.arrays_zip(F.col("c.lines_a").alias("old"), F.col("c.lines_b").alias("new"))).alias("row", "r"))
    return rows.select("pair_id", "diff_no", "chunk", "tag", F.coalesce("row", F.lit(0)).alias("row"), F.coalesce("r.old", F.lit("")).alias("old"), F.coalesce("r.new", F.lit("")).alias("new"))


def side(rows: DataFrame, left: bool, changed_only: bool = False) -> DataFrame:
    """What one side shows: no inserts on the left, no deletes on the right."""
    rows = rows.filter(F.col("tag") != ("insert" if left else "delete"))
    return rows.filter(F.col("tag") != "equal") if changed_only else rows
