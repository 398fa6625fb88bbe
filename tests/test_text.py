"""Text functions against the values that the method fixes."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.similarity import sequence, token_set

CASES = [
    (T.collapse, " a  b\tc\x1c ", "a b c"),
    (T.header_footer_norm, "Policy Update 2024", "policy update <num>"),
    (T.strip_toc, "II. Scope of rules .......... 5", "II. Scope of rules"),
    (T.strip_toc, "Chapter one of the book 12", "Chapter one of the book"),
    (T.strip_toc, "Three words 12", "Three words 12"),
    (T.normalize_title, "Principle 5: Credit-Risk!", "principle 5 credit risk"),
    (T.slugify, "C. Maintaining — a Plan", "c-maintaining-a-plan"),
    (T.slugify, "...", "untitled"),
    (T.strip_heading, "c. maintaining x", "maintaining x"),
    (T.strip_heading, "principle 5 credit risk", "credit risk"),
    (T.title_core, "credit risk", "redit risk"),
    (T.title_core, "12. Scope", "scope"),
]


@pytest.mark.parametrize(("function", "given", "wanted"), CASES)
def test_text(spark, function, given, wanted):
    assert spark.range(1).select(function(F.lit(given)).alias("x")).first()["x"] == wanted


@pytest.mark.parametrize(("given", "wanted"), [("page 3/10", True), ("12", True), ("12 apples", False), ("", False)])
def test_page_numbers(spark, given, wanted):
    assert spark.range(1).select(T.is_page_number(F.lit(given)).alias("x")).first()["x"] is wanted


@pytest.mark.parametrize(("title", "wanted"), [("IV. Scope", "IV"), ("3. Scope", "3"), ("b. Scope", "b"), ("Rule 5bis now", "id"), ("Principle 7b: x", "7b"), (None, "id")])
def test_section_number(spark, title, wanted):
    assert spark.range(1).select(T.section_number(F.lit(title).cast("string"), F.lit("id")).alias("x")).first()["x"] == wanted


def test_sets_and_sentences(spark):
    row = spark.range(1).select(
        T.sentences(F.lit("One. Two?  three")).alias("s"), T.tokens(F.lit("A 5% b-c!")).alias("t"), T.jaccard(F.array(), F.array()).alias("j"), T.set_changes(T.found_in(F.lit("1 2 2"), r"\d"), T.found_in(F.lit("2 3"), r"\d")).alias("d")
    ).first()
    assert (row.s, row.t, row.j, row.d) == (["one.", "two?", "three"], ["a", "5%", "b-c"], 1.0, 2)


def test_metrics():
    assert token_set("a b", "b a c") == 1.0
    assert token_set("", "x") == 0.0
    assert sequence("tide", "diet") != sequence("diet", "tide")


def test_collapse_leaves_single_spaces_and_joins_all_other_white_space(spark):
    given = ["a b", " a  b ", "a\tb", "a \t", "\n", " ", "", "a b", "a\x1c\x1fb", " a　 b", "a​b", None]
    want = ["a b", "a b", "a b", "a", "", "", "", "a b", "a b", "a b", "a​b", None]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", T.collapse(F.col("t")).alias("c"))
    assert [r["c"] for r in rows.orderBy("i").collect()] == want
