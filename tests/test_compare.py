"""Matching, differences, classification, annotations, sources and sinks."""

import collections
import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.config import MatchConfig
from folioscope.functions import similarity as S
from folioscope.operators import classify, diffing, matching, report
from folioscope.sources import readers, writers

SECTION = "pair_id long, ordinal long, section_id string, parent_id string, level int, anchor_type string, title string, title_normalized string, start_page int, end_page int, body string, body_lines array<string>"


def side(spark, rows):
    return spark.createDataFrame([(1, i, sid, None, 1, "major_heading", t, t.lower(), 1, 1, "\n".join(b), b) for i, (sid, t, b) in enumerate(rows)], SECTION)


def test_match_and_diff(spark):
    a = side(spark, [("a1", "Principle 5: Credit risk", ["Banks act.", "More"]), ("a2", "C. Maintaining a plan", ["same"]), ("a3", "Gone entirely", ["zzz"])])
    b = side(spark, [("b1", "Principle 5 - Credit Risk", ["Banks act now.", "More"]), ("b2", "IV. Maintaining a plan", ["same"])])
    found = matching.match(a, b)
    ids = {(r["section_id_a"], r["section_id_b"]) for r in found.collect()}
    assert ids == {("a1", "b1"), ("a2", "b2"), ("a3", None)}
    rows = {r["section_id_a"]: r for r in diffing.diffs(found, a, b).collect()}
    assert rows["a2"]["status"] == "renumbering_only" and rows["a1"]["status"] == "modified" and rows["a3"]["status"] == "removed"
    assert [c["tag"] for c in rows["a1"]["structured_diff"]] == ["replace"]
    assert rows["a1"]["unified_diff"].splitlines()[0] == "--- a1:old"
    total = diffing.summary(diffing.diffs(found, a, b)).first()
    assert (total.matched, total.removed, total.added, total.modified, total.unchanged) == (2, 1, 0, 2, 0)


def test_greedy_equals_loop(spark):
    r = random.Random(3)
    rows = [(p, i, j, f"a{i}", f"b{j}", r.randrange(55, 70) / 100, "") for p in range(4) for i in range(9) for j in range(9)]
    got = matching.assigned(spark.createDataFrame(rows, "pair_id long, i_a long, i_b long, section_id_a string, section_id_b string, score double, reason string")).collect()
    for p in range(4):
        a, b, want = set(), set(), []
        for x in sorted((x for x in rows if x[0] == p), key=lambda x: (-x[5], x[1], x[2])):
            if x[1] not in a and x[2] not in b:
                a.add(x[1])
                b.add(x[2])
                want.append((x[1], x[2]))
        assert [(g["i_a"], g["i_b"]) for g in sorted((g for g in got if g["pair_id"] == p), key=lambda g: g["match_no"])] == want


def test_lazy_assignment_equals_that_of_all_scores(spark):
    """With ties, equal titles, empty bodies and every metric."""
    r = random.Random(8)
    words = ["risk", "credit", "bank", "plan", "act", "note"]
    row = lambda p, s, i: (p, f"{s}{i}", r.choice(["major_heading", "named_numbered_heading"]), t := " ".join(r.choices(words[:3], k=r.randrange(0, 3))), t, " ".join(r.choices(words, k=r.choice([0, 3, 40]))), i)
    cols = "pair_id long, section_id string, anchor_type string, title_normalized string, core string, prefix string, i long, n long"
    side = lambda s: spark.createDataFrame([(*row(p, s, i), n) for p in range(40) for n in [r.randrange(1, 9)] for i in range(n)], cols)
    a, b = side("a"), side("b")
    for metric in ("sequence", "token_set"):
        cfg = MatchConfig(metric=metric)
        want = {(x["pair_id"], x["match_no"], x["i_a"], x["i_b"]): x["score"] for x in matching.assigned(matching.scored(a, b, cfg)).collect()}
        got = {(x["pair_id"], x["match_no"], x["i_a"], x["i_b"]): x["score"] for x in matching.assigned_lazily(a, b, cfg).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want) and len(want) > 20
        wide = {(x["pair_id"], x["match_no"], x["i_a"], x["i_b"]): x["score"] for x in matching.assigned_widely(a, b, cfg).collect()}
        assert wide == got


def test_large_pairs_are_spread(spark, monkeypatch):
    """A pair of 300 sections by rounds equals the task's form; small pairs beside it stay with their tasks."""
    r = random.Random(4)
    words = ["risk", "credit", "bank", "plan", "act", "note", "liquidity", "board", "audit"]
    cols = "pair_id string, section_id string, anchor_type string, title_normalized string, core string, prefix string, i long, n long"
    texts = lambda: [(" ".join(r.choices(words, k=3)), " ".join(r.choices(words, k=25))) for _ in range(300)]
    one = texts()
    two = [(t if r.random() < 0.7 else t + " new", b) for t, b in one[5:]] + texts()[:40]
    side = lambda rows, s: [("big", f"{s}{i}", "m", t, t, b, i, len(rows)) for i, (t, b) in enumerate(rows)] + [("small", f"{s}{i}", "m", t, t, "", i, 3) for i, (t, _) in enumerate(rows[:3])] + [(None, "x", "m", "t", "t", "", 0, 1)]
    a, b = spark.createDataFrame(side(one, "a"), cols), spark.createDataFrame(side(two, "b"), cols)
    want = {tuple(x) for x in matching.assigned_lazily(a, b).collect()}
    assert len(want) > 290
    monkeypatch.setattr(matching, "LARGE", 1000)
    monkeypatch.setattr(matching, "BLOCK", 7000)
    assert {tuple(x) for x in matching.assigned_lazily(a, b).collect()} == want


def test_bounds_hold(spark, monkeypatch):
    """The bound is at least the score, of texts with characters that bags count together, and exact for anagrams."""
    r = random.Random(6)
    cols = "pair_id long, section_id string, anchor_type string, title_normalized string, core string, prefix string, i long, n long"
    text = lambda: "".join(r.choices("etaoz éß1 ", k=r.randrange(0, 12)))
    side = lambda s: spark.createDataFrame([(p, f"{s}{i}", r.choice("xy"), text(), text(), r.choice([None, text()]), i, 6) for p in range(30) for i in range(6)], cols)
    a, b = side("a"), side("b")
    cfg = MatchConfig(low=0.0)
    bound = {(x["pair_id"], x["i_a"], x["i_b"]): x["bound"] for x in matching.bounded(a, b, cfg).collect()}
    score = {(x["pair_id"], x["i_a"], x["i_b"]): x["score"] for x in matching.scored(a, b, cfg).collect()}
    assert len(score) == 1080 and all(bound[k] >= score[k] - 1e-12 for k in score)
    assert sum(bound[k] < 1.02 * score[k] for k in score) > 20
    monkeypatch.setattr(matching, "BLOCK", 10)
    assert {(x["pair_id"], x["i_a"], x["i_b"]): x["bound"] for x in matching.bounded(a, b, cfg).collect()} == bound
    assert not {"title_normalized_a", "prefix_a", "core_a"} & set(matching.bounded(a, b).columns)


def test_soft_wraps(spark):
    row = spark.range(1).select(diffing.unwrapped(F.array(*map(F.lit, ["Banks must", "report to", "The board.", "", "1. Next", "HEADING", "and on"]))).alias("x")).first()
    assert row.x == ["Banks must report to The board.", "1. Next", "HEADING and on"]


def test_difflib_parity(spark):
    r = random.Random(5)
    texts = [("".join(r.choices("ab c", k=r.randrange(0, 300))), "".join(r.choices("ab c", k=r.randrange(0, 300)))) for _ in range(20)]
    df = spark.createDataFrame(texts, "a string, b string").withColumn("x", S.change_ratio(F.col("a"), F.col("b")))
    for a, b, x in df.collect():
        assert x == pytest.approx(round(1 - difflib.SequenceMatcher(None, a, b).ratio(), 6), abs=1e-6)


def plain_inline(a, b):
    """Common subsequences by the whole table of lengths; of two equally good ways the old token goes first."""
    x, y = re.findall(r"\s+|\S+", a), re.findall(r"\s+|\S+", b)
    best = collections.defaultdict(int)
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            best[i, j] = 1 + best[i + 1, j + 1] if x[i] == y[j] else max(best[i + 1, j], best[i, j + 1])
    left, right, i, j = [], [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            left.append(("same", x[i]))
            right.append(("same", y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1, j] >= best[i, j + 1]:
            left.append(("del", x[i]))
            i += 1
        else:
            right.append(("add", y[j]))
            j += 1
    return left, right


def test_inline_diffs_equal_the_whole_table(spark):
    r = random.Random(6)
    texts = [("".join(r.choices(["a", "b", "cc", " ", "  "], k=r.randrange(0, 60))), "".join(r.choices(["a", "b", "cc", " ", "  "], k=r.randrange(0, 60)))) for _ in range(300)]
    texts += [("", ""), ("a b c", "a b c"), (None, "x"), (" ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(0, 900, 3)))]
    rows = spark.createDataFrame(texts, "a string, b string").withColumn("d", S.inline_diff(F.col("a"), F.col("b"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        left, right = plain_inline(r["a"] or "", r["b"] or "")
        assert [tuple(x) for x in r["d"]["left"]] == left and [tuple(x) for x in r["d"]["right"]] == right


def test_line_changes(spark):
    rows = [("a\nb\r\nc", "a\nx\ny\nc\n"), ("", "a"), (None, None), ("a\n\n", "a\n"), ("x\u2028y", "x\x0cz"), ("\n", "")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.line_changes(F.col("a"), F.col("b")).alias("c"), S.splitlines(F.col("a")).alias("l")).collect()
    for r in got:
        x, y = (r["a"] or "").splitlines(), (r["b"] or "").splitlines()
        codes = [c for c in difflib.SequenceMatcher(None, x, y).get_opcodes() if c[0] != "equal"]
        assert r["l"] == x
        assert tuple(r["c"]) == (sum(c[4] - c[3] for c in codes), sum(c[2] - c[1] for c in codes), sum(max(c[2] - c[1], c[4] - c[3]) for c in codes if c[0] == "replace"))


def test_classification(spark):
    cols = "pair_id long, diff_no long, section_id_a string, section_id_b string, title_a string, title_b string, semantic_text_a string, semantic_text_b string, section_lines_a array<string>, section_lines_b array<string>"
    before, after = "Banks pay by 2025-01-01 and keep USD 10,000 as required.", "Banks pay by 2026-01-01 and keep USD 12,000 as wished."
    rows = [(1, 0, "a", "b", "T", "T", before, after, [], []), (1, 1, "a", "b", "T", "T", before, before, [], []), (1, 2, "a", None, "T", "", "x y z", "", [], [])]
    got = {r["diff_no"]: r for r in classify.classified(spark.createDataFrame(rows, cols)).collect()}
    assert got[0]["triggered_rules"] == ["obligation_change", "numeric_changes", "date_changes", "currency_changes"]
    assert got[0]["override_candidate"] == "significant" and got[0]["final_classification"] == "slight" and got[0]["disagreement"]
    assert got[1]["rule_label"] == "editorial" and got[1]["change_ratio"] == 0.0
    assert got[2]["rule_label"] == "significant" and got[2]["triggered_rules"] == ["large_change_surface"]
    assert classify.summary(classify.classified(spark.createDataFrame(rows, cols))).first()["slight"] == 3
    told = spark.range(1).select(classify.parse_label(F.lit('well: {"label": "editorial", "confidence": 0.88} so')).alias("x")).first().x
    assert (told.label, told.confidence) == ("editorial", 0.88)


def test_annotations(spark):
    d = spark.createDataFrame([(1, 7, "a1", "b2", "T", "", ""), (1, 8, "a2", None, "", "", "x")], "pair_id long, diff_no long, section_id_a string, section_id_b string, title_a string, title_b string, change_classification string")
    reviews = spark.createDataFrame([(1, "7:a1->b2", "open", "", "", 1), (1, "7:a1->b2", "approved", "alice", "ok", 2)], "pair_id long, diff_id string, validation_status string, reviewer string, note string, seq long")
    labels = spark.createDataFrame([(1, "8:a2->none", "", "manual", 1)], "pair_id long, diff_id string, classification string, source string, seq long")
    external = spark.createDataFrame([(1, "b2", "significant")], "pair_id long, section_id string, label string")
    got = {r["diff_id"]: r for r in report.overlay(d, reviews, labels, external).collect()}
    assert got["7:a1->b2"]["validation_status"] == "approved" and got["7:a1->b2"]["classification_source"] == "classified_report"
    assert got["8:a2->none"]["validation_status"] == "needs_review" and got["8:a2->none"]["change_classification"] == "x"
    assert report.imported(d, external).first()["classification"] == "significant"


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported extractor backend"):
        readers.extract(spark, "x", " Other ")
    with pytest.raises(FileNotFoundError):
        readers.reports(spark, str(tmp_path / "none.json"))
    path = tmp_path / "x_diff.json"
    path.write_text('{"diffs": [{"section_id_a": "a", "title_a": "IV. T", "match_score": 0.5, "section_lines_a": ["l"]}]}')
    (tmp_path / "x_classified.json").write_text('{"classifications": [{"section_id": "a", "final_classification": "slight"}, {"section_id": "a", "final_classification": "editorial"}]}')
    rows = readers.reports(spark, str(path))
    assert readers.sibling_labels(spark, str(path), "p").first()["label"] == "editorial"
    assert readers.listing(str(tmp_path)) == ["x_classified.json", "x_diff.json"]
    with pytest.raises(FileNotFoundError):
        readers.safe_path(str(tmp_path), "../etc/passwd", ".json")
    out = report.export_rows(rows.withColumnsRenamed({"match_score": "score", "page_no_in_a": "start_page_a", "page_no_in_b": "start_page_b"}))
    assert out.first().asDict()["section_number_file_a"] == "IV"
    writers.write_csv(out.withColumn("pair_id", F.lit("p")), str(tmp_path / "csv"))
    assert "IV,l," in next((tmp_path / "csv" / "pair_id=p").glob("part*")).read_text()
    env = {"A": "1"}
    (tmp_path / "env").write_text("export A=2\nB='x'\n# c\n")
    readers.load_env(str(tmp_path / "env"), env)
    assert env == {"A": "1", "B": "x"}
