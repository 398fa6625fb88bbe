"""Labels, sections, page furniture, spans."""

import pytest

from folioscope.config import LayoutConfig
from folioscope.operators import layout, sections

LINE = "doc_id long, line_no long, page int, x0 double, y0 double, x1 double, y1 double, text string"


def lines(spark, texts, doc=1, pages=None, y=100.0):
    return spark.createDataFrame([(doc, i, pages[i] if pages else 1, 0.0, y, 10.0, y + 20, t) for i, t in enumerate(texts)], LINE)


LABELS = {
    "I. Introduction": "major_heading", "Principle 7: This is a test": "named_numbered_heading", "1. How to report risk?": "numeric_heading", "a. types of risk": "letter_heading",
    "References": "reference_line", "II. Scope .......... 5": "reference_line", "[1]": "footnote_label", "IIII. odd": "major_heading", "Section 3 of the Act": "named_numbered_heading", "plain": "body",
}


def test_labels(spark):
    got = {r["text"]: r["label"] for r in sections.labelled(lines(spark, list(LABELS))).collect()}
    assert got == LABELS


def cut(spark, texts, cfg=LayoutConfig(), **k):
    return sections.sections(lines(spark, texts, **k), cfg).orderBy("ordinal").collect()


def test_children_and_ids(spark):
    s = cut(spark, ["Principle 5: A", "body", "28. first", "29. second", "b. Sub", "x", "Principle 6: B", "y"])
    assert [r["section_id"] for r in s] == ["s0001-principle-5-a", "s0002-b-sub", "s0003-principle-6-b"]
    assert [c["item_number"] for c in s[0]["children"]] == ["28", "29"]
    assert [r["parent_id"] for r in s] == [None, "s0001-principle-5-a", None]


def test_numeric_primary(spark):
    s = cut(spark, ["1. Overview", "body", "2. Scope"], LayoutConfig(numeric_is_primary=True))
    assert [r["title"] for r in s] == ["1. Overview", "2. Scope"]


def test_preamble_and_reference_lines(spark):
    s = cut(spark, ["I. Contents .......... 3", "body"], pages=[3, 4])
    assert [(r["title"], r["start_page"]) for r in s] == [("Preamble", 3)]
    assert cut(spark, ["References", "I. Contents .......... 3"]) == []


def test_wrapped_title(spark):
    s = cut(spark, ["Principle 4: one two three four five six basis. In", "line goes on", "third"])
    assert s[0]["title"].endswith("In line goes on") and s[0]["body_lines"] == ["third"]


@pytest.mark.parametrize("texts", [["Policy Update 2024", "Policy Update 2025", "Policy Update 2026"], ["1", "2", "3"], [f"Consultation on the Principles for Banking {n}" for n in (11, 12, 13)]])
def test_page_furniture(spark, texts):
    foot = lines(spark, texts, pages=[1, 2, 3], y=760.0)
    body = spark.createDataFrame([(1, 10 + p, p, 0.0, 300.0, 10.0, 320.0, "body text") for p in (1, 2, 3)], LINE)
    pages = spark.createDataFrame([(1, p, 800.0) for p in (1, 2, 3)], "doc_id long, page int, height double")
    got = layout.clean_lines(foot.union(body), pages).collect()
    assert {r["text"] for r in got if r["reason"] is None} == {"body text"}


def test_spans(spark):
    rows = [(1, 1, 0, k, t, x, y, x + 5, y + 8) for k, (t, x, y) in enumerate([("world", 20.0, 10.0), ("hello", 5.0, 10.4), ("next", 0.0, 14.5), ("  ", 0.0, 15.0)])]
    spans = spark.createDataFrame(rows, "doc_id long, page int, block int, span_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r["text"] for r in layout.lines_from_spans(spans).orderBy("line_no").collect()] == ["hello world", "next"]
