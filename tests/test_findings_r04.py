"""What the fourth round's review found, on small tables."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import similarity as S
from folioscope.functions import text as T
from folioscope.operators import classify, report, sections
from folioscope.sources import readers, writers


def test_compressed_reports_are_not_sent_to_all_tasks(spark, tmp_path):
    """by the bytes of compressed reports Spark sent the rows of all diffs through the driver."""
    pairs = spark.createDataFrame([(f"p{k}", f"{k}.pdf", None) for k in range(40)], "pair_id string, pdf_a string, pdf_b string")
    diffs = pairs.selectExpr("pair_id", "explode(sequence(0, 5)) AS diff_no").selectExpr("pair_id", "diff_no", "concat('s', diff_no) AS section_id_a", "cast(null AS string) AS section_id_b")
    writers.write_json(diffs, pairs.select("pair_id"), str(tmp_path / "reports"))
    one = '{{"pair_id": {pair}, "source_pdf_a": "{k}.pdf", "source_pdf_b": {b}, "classifications": [{{"section_id": "s1", "final_classification": "slight"}}]}}'
    (tmp_path / "named").mkdir()
    (tmp_path / "named" / "part.json").write_text("\n".join(one.format(pair=f'"p{k}"', k=k, b="null") for k in range(40)))
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "part.json").write_text("\n".join(one.format(pair=f'"p{k}"' if k else "null", k=k, b='"b"') for k in range(40)))
    rows, sources = readers.reports(spark, str(tmp_path / "reports")), readers.report_sources(spark, str(tmp_path / "reports"))
    for name, given in (("named", sources), ("mixed", pairs.selectExpr("pair_id", "pdf_a", "'b' AS pdf_b"))):
        labels = readers.all_labels(spark, str(tmp_path / name), given)
        for diffs_of in (rows, rows.unionByName(rows.limit(0))):  # the labels' own hint where the diffs have none
            found = report.imported(diffs_of, labels)
            assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, found.collect())) == sorted((f"p{k}", "1:s1->none", "slight", "classified_import") for k in range(40))


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ,.", "etaoin shrdlu ETAOIN0123456789.,xyzqjk", "é€🙂a b"])
def test_ratio_counts_as_the_library_does(letters):
    """texts are measured without looking at each character in each block; popular characters from 200 on."""
    r = random.Random(letters)
    for size in (0, 1, 30, 199, 200, 201, 700):
        for _ in range(12):
            a = "".join(r.choices(letters, k=size))
            i, j, k = sorted(r.randrange(size + 1) for _ in range(3))
            for b in (a[:i] + "".join(r.choices(letters, k=9)) + a[j:], a[k:] + a[:i], "".join(r.choices(letters, k=k)), a[i:j] * 3):
                assert S.sequence(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_long_equal_parts_are_compared_as_strings():
    """characters of a long match were compared one by one."""

    class Seen(str):
        looks = 0

        def __getitem__(self, at):
            Seen.looks += 1
            return str.__getitem__(self, at)

    text = "§" + "the same words over and over again, " * 300  # all others are popular
    assert S.matched(Seen(text), Seen("X" + text)) == len(text)
    assert Seen.looks < len(text) / 10


def test_parts_of_features_are_made_once(spark):
    """each set of a measure was made two or three times a row, and texts that are equal went to Python."""
    rows = spark.createDataFrame([("p", "a 5%  b. C", "a 6% b"), ("q", "x  y", "x  y"), ("r", "ΑΣ. ΑΣ", "Σ 1/2/2020\tx| K")], "pair_id string, before_text string, after_text string")
    found = classify.value_features(rows)
    calls = lambda name, what: found.select(name)._jdf.queryExecution().optimizedPlan().toString().count(what)
    assert calls("token_jaccard", "regexp_extract_all(") == 2 and calls("sentence_overlap", "split(") == 2 and calls("dates_changed", "regexp_extract_all(") == 2
    got = {r["pair_id"]: (r["token_jaccard"], r["sentence_overlap"], r["percentages_changed"], r["dates_changed"], r["change_ratio"]) for r in classify.features(rows).collect()}
    alike = lambda a, b: round(1 - difflib.SequenceMatcher(None, a, b).ratio(), 6)
    assert got == {"p": (0.166667, 0.0, 0, 0, alike("a 5% b. C", "a 6% b")), "q": (1.0, 1.0, 0, 0, 0.0), "r": (0.0, 0.0, 0, 1, alike("ΑΣ. ΑΣ", "Σ 1/2/2020 x| K"))}


@pytest.mark.parametrize("name", ["NUMBERS", "PERCENTS", "CURRENCIES", "DATES"])
def test_patterns_led_by_their_first_characters(spark, name):
    """a word end was told at every character; what is found stays."""
    texts = ["USD 5, usd5 xusd 6 ınr 7 İNR 8 5%6 % a5 5a 5.5 1,000,000.25", "Jan 3, 2020 ſep 4 2021 OCT\n5 1999 xmay 6 2000 2020-01-02 1/2/20 12020-01-02", "", "٣٤ % ٥-٦-٧٨ €5 £ 6 $x gbp 7 dec 1 2020 decade 1 2020", "K ﬁ eur ٣"]
    df, pattern = spark.createDataFrame([(t,) for t in texts], "t string"), getattr(classify, name)
    quick = classify._led(pattern)
    assert quick != pattern
    assert all(r["a"] == r["b"] for r in df.select(T.found_in(F.col("t"), pattern).alias("a"), T.found_in(F.col("t"), quick).alias("b")).collect())


def test_labels_and_white_space_by_first_characters(spark):
    """anchored patterns were tried at every character of every line; what they tell stays."""
    lines = ["Principle 1: x", "ſection 2 y", "Section 3", "IV. x", "ix. x", "b. x", "3. x", "[4]", "5)", "6", "References", "ſource x", "annex", "Ann", "Page 3 / 4", "page x", "", "٣. x", "Contents .... 12", "(a) x", "𝒳. x", "É. x", "rules 1a"]
    t = F.col("text")
    plain = F.when(T.toc_line(t), "r").when(t.rlike(r"^(\[\d+\]|\d+\)|\d+)\s*$"), "n").when(t.rlike(r"(?iu)^(references?|source|bibliography|annex|appendix)(?![\p{L}\p{N}_])"), "r").when(t.rlike(T.ROMAN), "m").when(t.rlike("(?iu)" + T.NAMED), "n").when(t.rlike(T.NUMERIC), "n").when(t.rlike(T.LETTER), "l").otherwise("b")
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    got = sections.labelled(df.withColumn("plain", plain)).withColumn("number", T.page_number(t)).collect()
    assert all(r["label"][0] == r["plain"] or (r["label"], r["plain"]) == ("footnote_label", "n") for r in got)
    assert [r["text"] for r in got if r["number"]] == ["6", "Page 3 / 4"]
    spaces = ["a  b", " a  b ", "a\x1cb", "a\u0085", " a\tb c", "a b", None]
    said = [r["c"] for r in spark.createDataFrame([(x,) for x in spaces], "t string").select(T.collapse(F.col("t")).alias("c")).collect()]
    assert said == [None if x is None else " ".join(x.split()) for x in spaces]


def test_prefixes_of_long_bodies(spark):
    """all of a body was lowered and collapsed for its first 240 characters."""
    texts = ["Ab  c " * 200, " " * 700 + "X" * 300, "x" * 238 + "ΑΣ" + "'" * 239 + "Σ" * 9, "İ" * 500, "a" * 480, None, "", "y\n" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.body_prefix(F.col("t")).alias("a"), F.left(T.normalize_body(F.col("t")), F.lit(240)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_labels_need_few_ratios(spark):
    """all texts that differ were aligned, also those whose label a hard signal decides."""
    said = [("must go", "may go"), ("one two", "one  two three"), ("same", "same"), ("pay 5", "pay 6"), (None, "x"), ("", "never none"), ("a b c", "z")]
    rows = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(said)], "pair_id long, diff_no long, semantic_text_a string, semantic_text_b string")
    for c in ("title_a", "title_b", "section_id_a", "section_id_b"):
        rows = rows.withColumn(c, F.lit("s"))
    rows = rows.withColumn("section_lines_a", F.array(F.lit("l"))).withColumn("section_lines_b", F.array(F.lit("l")))
    whole, few = classify.classified(rows).orderBy("diff_no").collect(), classify.classified(rows, ratios=False).orderBy("diff_no").collect()
    assert [r["rule_label"] for r in whole] == [r["rule_label"] for r in few] and [r["triggered_rules"] for r in whole] == [r["triggered_rules"] for r in few]
    assert [r["change_ratio"] for r in few] == [None if r["rule_confidence"] == 0.9 else r["change_ratio"] for r in whole] and 0 < sum(r["change_ratio"] is None for r in few) < len(said)
