"""What the findings of round 3 say that steps cost."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.functions import similarity as S
from folioscope.operators import classify
from folioscope.plans import compare, corpus
from folioscope.sources import writers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_out_once_with_their_documents(spark):
    """F8 to F14: lines of text were shuffled three times a version, and documents read by eight branches."""
    docs = spark.createDataFrame([(k, "web", "One line here\nand another\n" * 6) for k in range(20)], "doc_id long, source string, text string")
    sides = corpus.layout(docs)
    with_joins = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in with_joins}
    try:
        for k, v in with_joins.items():
            spark.conf.set(k, v)
        plan = _plan(compare.sections_of(*sides))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # documents for lines, for edges and for pages; what is removable by its key and by document
    assert plan.count("Exchange hashpartitioning") <= 6


def test_furniture_of_pages_that_share_an_id(spark):
    """A page of several rows with one doc_id has one number and one footer, with the greatest source."""
    docs = spark.createDataFrame([(3, "a", "x\ny"), (3, "b", "z"), (None, "c", "w")], "doc_id long, source string, text string")
    lines, pages = corpus.layout(docs)
    got = sorted(r["text"] for r in lines.filter("doc_id = 3").collect() if r["y0"] in (20.0, 760.0))
    assert got == ["1", "Corpus review b page 1"] and pages.filter("doc_id = 3").count() == 1


def test_inline_differences_hold_few_tokens(spark):
    """F16: all tokens of a batch were Python objects at a time."""
    text = " ".join(f"word{k}" for k in range(200))
    x, y = pa.array([text] * 3000), pa.array([text + " more"] * 3000)
    tracemalloc.start()
    got = S.inline_spans(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # of 2.4 million tokens
    assert len(got) == 3000 and got[2999]["right"].as_py()[-2:] == [{"op": "add", "token": " "}, {"op": "add", "token": "more"}]
    empty = spark.createDataFrame([(None, None), ("a", None), ("", "b c")], "a string, b string").select(S.inline_diff(F.col("a"), F.col("b")).alias("d")).collect()
    assert [([tuple(t) for t in r["d"]["left"]], [tuple(t) for t in r["d"]["right"]]) for r in empty] == [([], []), ([("del", "a")], []), ([], [("add", "b"), ("add", " "), ("add", "c")])]


def test_equal_texts_are_not_searched(spark):
    """the patterns of numbers, dates and amounts ran over both texts of every row, also of equal ones."""
    rows = spark.createDataFrame([("In 2024 USD 5 must go", "In 2024 USD 5 must go"), (None, ""), ("pay 5", "pay 6%"), (None, "must")], "before_text string, after_text string")
    found = classify.value_features(rows)
    plan = found.select("numeric_changes_count")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and plan.index("CASE WHEN") < plan.index("regexp_extract_all")
    got = [tuple(r) for r in found.select("numeric_changes_count", "percentages_changed", "obligation_change", "token_jaccard", "sentence_overlap").collect()]
    assert got == [(0, 0, False, 1.0, 1.0), (0, 0, False, 1.0, 1.0), (2, 0, False, 0.333333, 0.0), (0, 0, True, 0.0, 0.0)]


def test_many_small_exports_are_written_by_many_tasks(spark, tmp_path):
    """a file a pair has few bytes, so that one task or two wrote the files of all pairs."""
    cells = ", ".join(f"{c} {'double' if c == 'diff_score' else 'string'}" for c in writers.EXPORT)
    rows = spark.createDataFrame([(f"p{k}", 0, *["x"] * 6, 0.5) for k in range(60)], f"pair_id string, diff_no long, {cells}")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writers.write_csv(rows, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("pair_id=*/part-*.csv"))
    assert len(files) == 60 and len({f.name.split("-")[1] for f in files}) > min(tasks, 60) // 2
