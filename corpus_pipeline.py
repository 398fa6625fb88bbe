"""A corpus from documents to token ids: five stages, each one operator of ``folioscope.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep
the columns of ``documents``, and each result is a table in the shared folder before the
next stage reads it.  Every stage acts on all that its predecessor kept:

1. language: documents go that have no letter, or to which the model of every language
   learned from the input says no.
2. near_duplicates: of documents linked by 5-word shingles at a similarity of 0.8 or
   more, the one with the smallest doc_id stays, and one of rows that repeat it.
3. decontaminate: documents that hold a window of a benchmark item go.
4. mix_sources: documents are repeated, or left out, towards the target weights.
5. token_files: texts become blocks of token ids, in the shuffled order in which the stage
   before wrote its table; a row for each document comes back.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, language, mixing, near_dup, token_files
from folioscope.llm.common import small_batches, table, written
from folioscope.shipping import shipped


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = language.fit(docs, F.lit(True))
    found = language.predicted(docs, model, tuple(docs.columns))
    return found.filter("told").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(docs).groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.bool_and("kept").alias("_kept"), F.count("*").alias("_n"))
    found = written(found.filter("not _kept or _n > 1"), "not-alone")
    same = docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_k"))
    single = docs.join(found, same, "left_anti")
    if found.filter("_kept").isEmpty():
        return single.select(*docs.columns)
    # of rows that repeat doc_id and text the least one stays
    again = docs.join(found.filter("_kept"), same).groupBy("_d", "_k").agg(F.min(F.struct(*docs.columns)).alias("_r"))
    return single.select(*docs.columns).unionByName(again.select("_r.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    found = found.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_k"))
    return docs.join(found, same, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicated(docs).select(*docs.columns)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    try:  # the place of a row in the files of the stage before, which wrote them in shuffled order
        order = (docs["_metadata.file_name"], docs["_metadata.row_index"])
        docs.select(*order)
    except AnalysisException:  # rows of no file have no place
        order = ("doc_id",)
    return token_files.token_table(docs, order=order).drop("ids")


STAGES = [
    ("language", shipped(identify_language)),
    ("near_duplicates", shipped(drop_near_duplicates)),
    ("decontaminate", shipped(drop_contaminated)),
    ("mix_sources", shipped(mix_sources)),
    ("token_files", shipped(to_token_files)),
]

#: SQL can't express the language model or the token files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
