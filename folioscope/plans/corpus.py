"""A layout for ``documents``, which has none: positioned lines, pages and two versions.

Deterministic arithmetic on doc_id and line number injects headings, page furniture and
edits, the same in any engine: headings at every fifth line (one line later in every
fourth document, which so gets a preamble), a page of four lines, a page number on top
and a running footer.  Version B leaves out lines, renumbers headings and changes
amounts and dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

#: What version A and version B append where (doc_id + line_no) % 7 = 0.
EDIT_A = " The bank must not exceed USD 10,000 or 5% by 2025-01-01."
EDIT_B = " The bank may exceed USD 12,000 or 6% by 2026-01-01."
HEIGHT = 800.0
#: Which lines version B has.
IN_B = "(doc_id + line_no) % 23 != 0"


def _raw_lines(documents: DataFrame) -> DataFrame:
    """doc_id, source, line_no and raw: the lines as they are.

    Documents are dealt out by doc_id while they are whole: all that follows groups, orders
    and joins lines by document, and would shuffle the longer rows of lines.
    """
    return documents.repartition("doc_id").select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))


def _headed():
    """The text of a raw line, with headings injected."""
    t, n, k = T.collapse(F.col("raw")), F.col("line_no"), F.col("doc_id") + F.col("line_no")
    phase = F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    return (
        F.when(n % 5 == phase, F.concat(F.lit("Principle "), (F.floor(n / 5) + 1).cast("string"), F.lit(": "), F.left(t, F.lit(40))))
        .when(k % 17 == 0, F.concat(F.lit("IV. "), F.left(t, F.lit(30))))
        .when(k % 13 == 0, F.concat(F.lit("b. "), F.left(t, F.lit(30))))
        .when(k % 11 == 0, F.concat(F.lit("3. "), F.left(t, F.lit(30))))
        .when(k % 19 == 0, F.lit("References"))
        .otherwise(t)
    )


def body_lines(documents: DataFrame) -> DataFrame:
    """doc_id, source, line_no and text with headings injected."""
    return _raw_lines(documents).select("doc_id", "source", F.col("line_no").cast("long").alias("line_no"), _headed().alias("text"))


def _text(which: str):
    """The text of a line in a version."""
    k = F.col("doc_id") + F.col("line_no")
    text = F.concat(F.col("text"), F.when(k % 7 == 0, F.lit(EDIT_A if which == "a" else EDIT_B)).otherwise(""))
    renumbered = (F.col("doc_id") % 2 == 0) & F.col("text").startswith("IV. ") & F.lit(which == "b")
    return F.when(renumbered, F.concat(F.lit("V. "), F.substr(text, F.lit(5)))).otherwise(text)


def version(lines: DataFrame, which: str) -> DataFrame:
    if which == "b":
        lines = lines.filter(IN_B)
    return lines.withColumn("text", _text(which))


def both_versions(lines: DataFrame) -> DataFrame:
    """The lines that both versions have, side by side without a join: doc_id, line_no, text_a and text_b."""
    return lines.filter(IN_B).select("doc_id", "line_no", _text("a").alias("text_a"), _text("b").alias("text_b"))


def positioned(lines: DataFrame) -> DataFrame:
    """Body lines with page and box; line_no counts by tens a page so that furniture fits between."""
    page = (F.floor(F.col("line_no") / 4) + 1).cast("int")
    row = F.col("line_no") % 4
    y0 = (100 + 40 * row).cast("double")
    return lines.select("doc_id", (page * 10 + 1 + row).cast("long").alias("line_no"), page.alias("page"), F.lit(50.0).alias("x0"), y0.alias("y0"), (F.lit(50.0) + F.length("text")).alias("x1"), (y0 + 20).alias("y1"), "text", "source")


def layout(documents: DataFrame, which: str = "a") -> tuple[DataFrame, DataFrame]:
    """lines (with furniture) and pages of one version.

    The first line of a page brings the page's furniture with it: documents are read once, and
    lines stay dealt out by doc_id.
    """
    raw = _raw_lines(documents)
    if which == "b":
        raw = raw.filter(IN_B)
    own = Window.partitionBy("doc_id", "page")
    raw = raw.withColumn("line_no", F.col("line_no").cast("long")).withColumn("page", (F.floor(F.col("line_no") / 4) + 1).cast("int"))
    pages = raw.select("doc_id", "page").distinct().withColumn("height", F.lit(HEIGHT))
    raw = raw.withColumn("_first", F.row_number().over(own.orderBy("line_no")) == 1)
    raw = raw.withColumn("source", F.max("source").over(own.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = raw.withColumn("kind", F.explode(F.when(F.col("_first"), F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(F.lit(0)))))
    body, top = F.col("kind") == 0, F.col("kind") == 1
    rows = rows.withColumn("text", F.when(body, _headed())).withColumn("text", F.when(body, _text(which)))
    foot = F.concat(F.lit("Corpus review "), F.coalesce("source", F.lit("")), F.lit(" page "), F.col("page").cast("string"))
    text = F.when(body, F.col("text")).when(top, F.col("page").cast("string")).otherwise(foot)
    row = F.col("line_no") % 4
    y0 = F.when(body, (100 + 40 * row).cast("double")).when(top, 20.0).otherwise(760.0)
    place = F.when(body, 1 + row).when(top, 0).otherwise(9)
    x1 = F.when(body, F.lit(50.0) + F.length("text")).otherwise(200.0)
    lines = rows.select("doc_id", (F.col("page") * 10 + place).cast("long").alias("line_no"), "page", F.lit(50.0).alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 20).alias("y1"), text.alias("text"))
    return lines, pages


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
