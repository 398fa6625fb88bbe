"""Reports over diffs: overlay of annotations, filtered lists, histograms, export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T


def full(c) -> F.Column:
    """Null for the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def with_diff_id(diffs: DataFrame) -> DataFrame:
    return diffs.withColumn("diff_id", F.concat(F.col("diff_no").cast("string"), F.lit(":"), F.coalesce(full("section_id_a"), F.lit("none")), F.lit("->"), F.coalesce(full("section_id_b"), F.lit("none"))))


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last entry (by call and its name, if there are any, ``seq``, then time, then content) of each key of an append log: an upsert without updates."""
    columns = [c for c in log.columns if c not in keys]
    first = [c for c in ("call", "batch", "seq", "updated_at") if c in columns]
    order = [*first, *(c for c in columns if c not in first)]
    last = log.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in columns])


def overlay(diffs: DataFrame, reviews: DataFrame, labels: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Diffs with the latest review and the label that counts: store, then payload, then external by B, then by A.

    reviews(pair_id, diff_id, validation_status, reviewer, note, seq), labels(pair_id,
    diff_id, classification, source, seq), external(pair_id, section_id, label).
    """
    diffs = with_diff_id(diffs)
    if "change_classification" not in diffs.columns:
        diffs = diffs.withColumn("change_classification", F.lit(None).cast("string"))
    key = ["pair_id", "diff_id"]
    out = diffs.join(latest(reviews, key).drop("seq"), key, "left")
    stored = latest(labels, key).select(*key, full("classification").alias("_stored"), F.col("source").alias("_source"))
    out = out.join(stored, key, "left")
    for s in "ba":
        if external is None:
            out = out.withColumn(f"_x{s}", F.lit(None).cast("string"))
        else:
            out = out.join(external.select("pair_id", F.col("section_id").alias(f"section_id_{s}"), F.col("label").alias(f"_x{s}")), ["pair_id", f"section_id_{s}"], "left")
    given = F.coalesce(full("_xb"), full("_xa"))
    source = F.when(F.col("_stored").isNotNull(), F.col("_source")).when(full("change_classification").isNotNull(), "diff_payload").when(given.isNotNull(), "classified_report")
    out = out.withColumn("classification_source", source).withColumn("change_classification", F.coalesce("_stored", full("change_classification"), given))
    return out.withColumn("validation_status", F.coalesce("validation_status", F.lit("needs_review"))).withColumn("reviewer", F.coalesce("reviewer", F.lit(""))).withColumn("note", F.coalesce("note", F.lit(""))).drop("_stored", "_source", "_xa", "_xb")


def last_labels(classifications: DataFrame) -> DataFrame:
    """pair_id, section_id and label of classified rows(pair_id, pos, section_id, final_classification and, of many files, file); the last one counts."""
    rows = classifications.filter((F.col("section_id") != "") & (F.col("final_classification") != ""))
    at = F.struct("file", "pos") if "file" in classifications.columns else F.col("pos")
    # dealt out by pair, so that what groups or joins by pair later needs no other shuffle
    rows = rows.select("pair_id", "section_id", "final_classification", at.alias("_at")).repartition("pair_id")
    return rows.groupBy("pair_id", "section_id").agg(F.max_by("final_classification", "_at").alias("label"))


def imported(diffs: DataFrame, external: DataFrame, source: str = "classified_import") -> DataFrame:
    """Label log entries for the diffs that an external label covers: by B's section, else by A's."""
    rows = with_diff_id(diffs).select("pair_id", "diff_id", "section_id_a", "section_id_b")
    # a pair's labels, of several of a section the least, meet its diffs in one join by pair
    own = external.filter("section_id is not null").groupBy("pair_id", "section_id").agg(F.min("label").alias("label"))
    own = own.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("section_id", "label"))).alias("_own"))
    rows = rows.join(own, "pair_id")
    told = [full(F.element_at("_own", F.col(f"section_id_{s}"))) for s in "ba"]
    rows = rows.withColumn("classification", F.coalesce(*told)).filter(F.col("classification").isNotNull())
    return rows.select("pair_id", "diff_id", "classification", F.lit(source).alias("source"))


def effective_status() -> F.Column:
    return F.coalesce(full("semantic_status"), F.col("status"))


def status_histogram(diffs: DataFrame) -> DataFrame:
    kinds = ("modified", "unchanged", "added", "removed", "renumbering_only")
    return diffs.groupBy("pair_id").agg(*[F.count_if(effective_status() == k).alias(k) for k in kinds])


def filtered(diffs: DataFrame, status: str = "all", text: str = "", window: int = 1000) -> DataFrame:
    """Diffs of a status whose titles or beginning of the unified diff hold a text, ignoring case."""
    if status != "all":
        diffs = diffs.filter(effective_status() == status)
    where = F.concat_ws(" ", F.coalesce("title_a", F.lit("")), F.coalesce("title_b", F.lit("")), F.left(F.coalesce(full("semantic_unified_diff"), "unified_diff", F.lit("")), F.lit(window)))
    return diffs.filter(F.lower(where).contains(text.lower())) if text else diffs


def point(diffs: DataFrame, pair_id, diff_id: str) -> DataFrame:
    return with_diff_id(diffs).filter((F.col("pair_id") == F.lit(pair_id)) & (F.col("diff_id") == diff_id))


def export_rows(diffs: DataFrame) -> DataFrame:
    """The seven columns of the tabular export, in order of the diffs."""
    cols = ["pair_id", "diff_no"]
    for s in "ab":
        text = F.coalesce(F.when(F.trim(F.col(f"semantic_text_{s}")) != "", F.col(f"semantic_text_{s}")), F.when(F.size(f"section_lines_{s}") > 0, F.array_join(f"section_lines_{s}", "\n")), F.col(f"title_{s}"), F.lit(""))
        cols += [F.coalesce(F.col(f"start_page_{s}").cast("string"), F.lit("")).alias(f"page_number_file_{s}"), T.section_number(F.col(f"title_{s}"), F.col(f"section_id_{s}")).alias(f"section_number_file_{s}"), text.alias(f"text_file_{s}")]
    return diffs.select(*cols, F.col("score").alias("diff_score"))


def numbered(log: DataFrame) -> DataFrame:
    """Entries of an append log in the order of their time, numbered by key."""
    rest = [c for c in log.columns if c not in ("pair_id", "diff_id", "updated_at", "seq")]
    return log.withColumn("seq", F.row_number().over(Window.partitionBy("pair_id", "diff_id").orderBy("updated_at", *rest)).cast("long"))
