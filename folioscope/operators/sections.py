"""Lines to labelled lines, and labelled lines to numbered sections.

Everything is a window or an aggregate by ``doc_id``: a section begins at each primary
heading, so its ordinal is a running sum, and its parts are ordered collections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.config import LayoutConfig
from folioscope.functions import text as T


def labelled(lines: DataFrame, single: bool = False) -> DataFrame:
    """Adds label and anchor_type (both by the first rule that fits) to lines.  single: their texts are single-spaced already."""
    t = F.col("text") if single else T.collapse(F.col("text"))
    flagged = F.col("is_header_footer") if "is_header_footer" in lines.columns else F.lit(False)
    label = (
        F.when(flagged, "footer_or_header")
        .when(T.toc_line(t), "reference_line")
        .when(T.begins(t, "[" + T.DIGITS) & t.rlike(r"^(\[\d+\]|\d+\)|\d+)\s*$"), "footnote_label")
        .when(T.begins(t, "rRsSbBaA\u017f") & t.rlike(r"(?iu)^(references?|source|bibliography|annex|appendix)(?![\p{L}\p{N}_])"), "reference_line")
        .when(T.begins(t, "IVXLCDM") & t.rlike(T.ROMAN), "major_heading")
        .when(T.begins(t, "pPaAsScCrR\u017f") & t.rlike("(?iu)" + T.NAMED), "named_numbered_heading")
        .when(T.begins(t, T.DIGITS) & t.rlike(T.NUMERIC), "numeric_heading")
        .when((F.substring(t, 2, 1) == ".") & t.rlike(T.LETTER), "letter_heading")
        .otherwise("body")
    )
    names = {"major_heading": "roman", "named_numbered_heading": "named_numbered", "numeric_heading": "numeric", "letter_heading": "letter"}
    anchor = F.lit(None).cast("string")
    for name, value in names.items():
        anchor = F.when(F.col("label") == name, value).otherwise(anchor)
    return lines.withColumn("text", t).withColumn("label", label).withColumn("anchor_type", anchor)


def leveled(lines: DataFrame, cfg: LayoutConfig = LayoutConfig(), single: bool = False) -> DataFrame:
    """Labelled, non-blank lines with ``level`` (null if not primary) and ``ordinal`` (0 before the first heading)."""
    level = F.when(F.col("label").isin("major_heading", "named_numbered_heading"), 1).when(F.col("label") == "letter_heading", 2)
    if cfg.numeric_is_primary:
        level = level.when(F.col("label") == "numeric_heading", 1)
    so_far = Window.partitionBy("doc_id").orderBy("line_no")
    lines = labelled(lines, single).filter(F.col("text") != "").withColumn("level", level)
    lines = lines.withColumn("ordinal", F.sum(F.col("level").isNotNull().cast("long")).over(so_far))
    return lines.filter((F.col("ordinal") > 0) | (F.col("label") != "reference_line"))


def sections(lines: DataFrame, cfg: LayoutConfig = LayoutConfig(), single: bool = False) -> DataFrame:
    """One row per section: ids, level, titles, pages, body, children, parent and order.

    The preamble takes its page from the document's first line, kept or not.
    """
    # in the one order of the lines, so that they are sorted once and read once
    every = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = leveled(lines.withColumn("_first_page", F.min_by("page", "line_no").over(every)), cfg, single)
    body = F.col("level").isNull()
    item = F.struct("line_no", "text")
    child = body & (F.col("label") == "numeric_heading")
    collect = lambda c: F.sort_array(F.collect_list(F.when(c, item)))
    s = rows.groupBy("doc_id", "ordinal").agg(
        F.max("level").alias("level"), F.max(F.when(~body, F.col("text"))).alias("raw_title"),
        F.max(F.when(~body, F.col("label"))).alias("debug_label"), F.max(F.when(~body, F.col("page"))).alias("start_page"), F.max_by("page", "line_no").alias("end_page"),
        collect(body).alias("_body"), collect(child & F.lit(not cfg.numeric_is_primary)).alias("_items"), F.max("_first_page").alias("_first_page"),
    ).filter("doc_id is not null")
    preamble = F.col("ordinal") == 0
    has_preamble = F.max(preamble.cast("long")).over(Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("section_no", F.col("ordinal") + has_preamble).withColumn("body_lines", F.transform("_body", lambda b: b["text"]))
    s = s.withColumn("title", F.when(preamble, "Preamble").otherwise(T.strip_toc(F.col("raw_title"))))
    s = s.withColumn("section_id", F.when(preamble, "preamble").otherwise(F.format_string("s%04d-%s", F.col("section_no"), F.left(T.slugify(F.col("title")), F.lit(40)))))
    # a wrapped title: its next line moves up
    goes_on = F.col("body_lines")[0]
    wrapped = F.col("debug_label").isin("major_heading", "named_numbered_heading") & (F.size("body_lines") > 0) & (F.size(F.split("title", " ")) >= 8) & goes_on.rlike(r"^[a-z(,;]") & ~F.col("title").rlike(r"[.?!]$")
    s = s.withColumn("wrapped", F.coalesce(wrapped, F.lit(False)))
    s = s.withColumn("title", F.when(F.col("wrapped"), F.concat_ws(" ", "title", F.col("body_lines")[0])).otherwise(F.col("title")))
    s = s.withColumn("body_lines", F.when(F.col("wrapped"), F.expr("slice(body_lines, 2, greatest(size(body_lines) - 1, 0))")).otherwise(F.col("body_lines")))
    children = F.transform("_items", lambda i: F.struct(F.regexp_extract(i["text"], r"^(\d+)\.", 1).alias("item_number"), F.regexp_replace(i["text"], r"^\d+\.\s+", "").alias("text")))
    s = s.withColumn("level", F.coalesce("level", F.lit(0))).withColumn("anchor_type", F.when(preamble, "preamble").otherwise(F.col("debug_label")))
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.when(F.col("level") >= 2, F.last(F.when(F.col("level") == 1, F.col("section_id")), ignorenulls=True).over(before))
    return s.select(
        "doc_id", "ordinal", "section_id", parent.alias("parent_id"), "level", "anchor_type", "title", T.normalize_title(F.col("title")).alias("title_normalized"),
        F.when(preamble, F.col("_first_page")).otherwise(F.col("start_page")).alias("start_page"), F.when(preamble, F.col("_first_page")).otherwise(F.col("end_page")).alias("end_page"),
        F.array_join("body_lines", "\n").alias("body"), "body_lines", children.alias("children"), "raw_title", "debug_label",
    )
