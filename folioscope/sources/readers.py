"""Sources: page layouts and elements by adapter, JSON reports, labels, listings, settings."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.storage import exists

REPORT = (
    "pair_id string, pdf_a string, pdf_b string, diffs array<struct<section_id_a:string,section_id_b:string,title_a:string,title_b:string,semantic_text_a:string,semantic_text_b:string,"
    "section_lines_a:array<string>,section_lines_b:array<string>,page_no_in_a:int,page_no_in_b:int,match_score:double,status:string,semantic_status:string,anchor_type:string,"
    "low_confidence:boolean,unified_diff:string,semantic_unified_diff:string,change_classification:string>>"
)
CLASSIFIED = (
    "pair_id string, source_pdf_a string, source_pdf_b string, classifications array<struct<section_id:string,section_title:string,rule_classification:struct<label:string,confidence:double,triggered_rules:array<string>>,"
    "llm_classification:struct<label:string,confidence:double,rationale:string,model:string,prompt_version:string,stub:boolean>,disagreement_flag:boolean,override_candidate:string,final_classification:string>>"
)

#: The part of a classified report that labels are read from.
LABELLED = "pair_id string, source_pdf_a string, source_pdf_b string, classifications array<struct<section_id:string,final_classification:string>>"

Extractor = Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]
_extractors: dict[str, Extractor] = {}


def register_extractor(name: str, extractor: Extractor) -> None:
    """extractor: takes a session and a path and returns lines and pages."""
    _extractors[name.strip().lower()] = extractor


def extract(spark: SparkSession, path: str, backend: str = "tables") -> tuple[DataFrame, DataFrame]:
    name = backend.strip().lower()
    if name not in _extractors:
        raise ValueError(f"Unsupported extractor backend: {backend}")
    return _extractors[name](spark, path)


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """spans and pages tables under a folder."""
    from folioscope.operators.layout import lines_from_spans

    return lines_from_spans(spark.read.parquet(f"{path}/spans")), spark.read.parquet(f"{path}/pages")


def _elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    from folioscope.operators.layout import lines_from_elements

    return lines_from_elements(spark.read.parquet(f"{path}/elements"))


def _pdf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """PDF files in a folder."""
    from folioscope.sources.pdf import extractor

    return extractor(spark, path)


register_extractor("pdf", _pdf)
register_extractor("tables", _tables)
register_extractor("elements", _elements)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document in a ``.json`` file, printed in any way, or a folder of files with a document a line.

    Reports are compressed, and few of their fields are read: the bytes by which Spark decides to send a table to
    all tasks are a small part of its rows, so these are always merged.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("multiLine", path.lower().rstrip("/").endswith(".json")).json(path).hint("merge")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Diff reports as rows: pair_id (the report's own, else its file), diff_no and the fields of each diff."""
    rows = _json(spark, path, REPORT).select(F.coalesce("pair_id", F.input_file_name()).alias("pair_id"), F.posexplode("diffs").alias("diff_no", "d"))
    return rows.select("pair_id", F.col("diff_no").cast("long").alias("diff_no"), "d.*")


def report_sources(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, pdf_a and pdf_b of each report, those without any diff too."""
    return _json(spark, path, REPORT).select(F.coalesce("pair_id", F.input_file_name()).alias("pair_id"), "pdf_a", "pdf_b")


def classifications(spark: SparkSession, path: str, schema: str = CLASSIFIED) -> DataFrame:
    """Classified reports as rows: pair_id (null where a report names none), the documents compared, file, pos and the fields of each classification."""
    rows = _json(spark, path, schema).select("pair_id", "source_pdf_a", "source_pdf_b", F.input_file_name().alias("file"), F.posexplode("classifications").alias("pos", "c"))
    return rows.select("pair_id", "source_pdf_a", "source_pdf_b", "file", "pos", "c.*")


_LABELS = "pair_id string, section_id string, label string"


def labels(spark: SparkSession, path: str, pair_id: str) -> DataFrame:
    """Labels of a classified report of one pair; empty if the file is missing; the last of a section counts."""
    from folioscope.operators.report import last_labels

    if not exists(spark, path):
        return spark.createDataFrame([], _LABELS)
    return last_labels(classifications(spark, path, LABELLED).withColumn("pair_id", F.lit(pair_id)))


def all_labels(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Labels of classified reports of many pairs; empty if there is no such file; the last of a section counts.

    sources: pair_id, pdf_a and pdf_b of the reports that the labels are for.  A classified report belongs to the pair
    that it names; one that names none, to the only pair of its two documents, or to the only
    report there is.  Where that leaves a choice, nothing is guessed: ValueError.
    """
    from folioscope.operators.report import last_labels

    if not exists(spark, path):
        return spark.createDataFrame([], _LABELS)
    rows = classifications(spark, path, LABELLED)
    only = sources.select("pair_id").limit(2).collect()
    if len(only) == 1:
        return last_labels(rows.withColumn("pair_id", F.coalesce("pair_id", F.lit(only[0]["pair_id"]))))
    # most reports name their pair: only the rows of others meet the sources, by documents that may be null
    unnamed = rows.filter("pair_id is null")
    if unnamed.isEmpty():
        return last_labels(rows)
    documents = ["source_pdf_a", "source_pdf_b"]
    named = sources.groupBy(F.col("pdf_a").alias("source_pdf_a"), F.col("pdf_b").alias("source_pdf_b")).agg(F.min("pair_id").alias("pair_id"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    lost = unnamed.join(named, documents, "left_anti").select("file").distinct().limit(3).collect()
    if lost and only:
        raise ValueError(f"no pair is named, and there are several reports: {', '.join(r['file'] for r in lost)}")
    # a hint does not pass a union
    return last_labels(rows.filter("pair_id is not null").unionByName(unnamed.drop("pair_id").join(named, documents, "left")).hint("merge"))


def sibling_candidates(report: str) -> list[str]:
    """Where the classified report of a diff report may be, in order of preference."""
    folder, name = os.path.split(report)
    stem = name.removesuffix(".json")
    names = ([stem.replace("_diff", "_classified")] if "_diff" in stem else []) + [stem + "_classified"]
    return [os.path.join(folder, n + ".json") for n in dict.fromkeys(names)]


def sibling_labels(spark: SparkSession, report: str, pair_id: str) -> DataFrame:
    """The labels of the first candidate that has any."""
    for path in sibling_candidates(report):
        found = labels(spark, path, pair_id)
        if not found.isEmpty():
            return found
    return labels(spark, os.path.join(os.path.dirname(report), "-none-"), pair_id)


def _system(path: str):
    """A path as Hadoop sees it, and its file system."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(p), system


def listing(folder: str, suffix: str = ".json") -> list[str]:
    """The names in a folder of any store that Spark reads, sorted."""
    path, system = _system(folder)
    return sorted(name for status in system.listStatus(path) if (name := status.getPath().getName()).endswith(suffix))


def _resolved(path: str) -> str:
    """A full path without ``..``; on this machine's disks also without links."""
    p, system = _system(path)
    if p.toUri().getScheme() == "file":
        return "file:" + os.path.realpath(p.toUri().getPath())
    steps: list[str] = []
    for step in p.toUri().getPath().split("/"):
        if step == ".." and steps:
            steps.pop()
        elif step not in ("", ".", ".."):
            steps.append(step)
    return f"{p.toUri().getScheme()}://{p.toUri().getAuthority() or ''}/" + "/".join(steps)


def safe_path(base: str, requested: str, suffix: str, current: str = "") -> str:
    """A path of a suffix that exists below ``base``, in any store that Spark reads; an empty request is the current one."""
    if not requested:
        return current
    named = ":" in requested.split("/")[0] or requested.startswith("/")
    root, path = _resolved(base), _resolved(requested if named else f"{base.rstrip('/')}/{requested}")
    if not path.startswith(root.rstrip("/") + "/"):
        raise FileNotFoundError(f"outside of {base}: {requested}")
    p, system = _system(path)
    if not system.exists(p) or not path.lower().endswith(suffix):
        raise FileNotFoundError(requested)
    return path.removeprefix("file:")


def load_env(path: str, env=os.environ) -> None:
    """KEY=VALUE lines into an environment whose own values win."""
    if not os.path.exists(path):
        return
    for line in open(path, encoding="utf-8"):
        line = line.strip().removeprefix("export ")
        key, mark, value = line.partition("=")
        if mark and not line.startswith("#") and key.strip():
            env.setdefault(key.strip(), value.strip().strip("\"'"))
