"""Whole comparisons over all documents of the smallest tables against plain Python."""

import collections
import difflib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope import catalog
from folioscope.config import LayoutConfig
from folioscope.operators import classify, diffing, layout, report
from folioscope.plans import compare

SF = "/root/testdata/sf0.001"
need_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def alike(a, b):
    return 0.0 if not a or not b else 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def single(text):
    return " ".join((text or "").split())


def toc_free(title):
    title = single(title)
    if m := re.match(r"^(.+?)\s*[.…·]{3,}\s*(\d{1,4})\s*$", title):
        return m[1].strip()
    m = re.match(r"^(.+?)\s+(\d{1,4})\s*$", title)
    if m and len(m[1].split(" ")) >= 4 and re.match(r"(?i)([ivxlcdm]+\.\s+|(chapter|section|part|annex)\b)", m[1]):
        return m[1].strip()
    return title


def plain_title(title):
    return single(re.sub(r"[^\w\s]", " ", toc_free(title).lower()))


NAMED = r"(?i)^(principle|article|section|chapter|standard|rule)\s+\d+[a-z]?\s*[:.-]?\s*"


@pytest.fixture(scope="module")
def found(spark):
    frames = compare.corpus_comparison(spark, SF)
    return {name: frames[name].toPandas().to_dict("records") for name in ("sections_a", "sections_b", "pairs", "matches", "diffs")} | {"frames": frames}


def pools(found, side):
    out = collections.defaultdict(list)
    for s in sorted(found[f"sections_{side}"], key=lambda s: s["ordinal"]):
        if s["level"] <= 1 and s["anchor_type"] != "preamble":
            out[s["pair_id"]].append(s)
    return out


def plain_matches(a, b):
    """Rows of one pair: ids, score, confidence, reason."""
    strip = lambda t: single(re.sub(NAMED, "", re.sub(r"(?i)^([ivxlcdm]+|\d+|[a-z])\s*[.)-]\s*", "", single(t))))
    prefix = lambda s: single(s["body"].lower())[:240]
    scored = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            raw, core = alike(x["title_normalized"], y["title_normalized"]), alike(strip(x["title_normalized"]), strip(y["title_normalized"]))
            title, body = 0.35 * raw + 0.65 * core, alike(prefix(x), prefix(y))
            anchor = 1.0 if x["anchor_type"] == y["anchor_type"] else 0.4
            order = max(0.0, 1 - abs(i - j) / max(1, max(len(a), len(b)) - 1))
            score = 0.65 * title + 0.25 * body + 0.05 * anchor + 0.05 * order
            if score >= 0.55:
                scored.append((-score, i, j, f"title_raw={raw:.3f}, title_core={core:.3f}, title={title:.3f}, body={body:.3f}, anchor={anchor:.3f}, order={order:.3f}"))
    rows, free_a, free_b = [], dict(enumerate(a)), dict(enumerate(b))
    for score, i, j, reason in sorted(scored):
        if i in free_a and j in free_b:
            rows.append((free_a.pop(i)["section_id"], free_b.pop(j)["section_id"], round(-score, 4), "matched" if -score >= 0.78 else "low-confidence matched", reason))
    rows += [(s["section_id"], None, 0.0, "unmatched", "No candidate passed threshold") for s in free_a.values()]
    return rows + [(None, s["section_id"], 0.0, "unmatched", "No candidate passed threshold") for s in free_b.values()]


@need_tables
def test_matches(found):
    a, b = pools(found, "a"), pools(found, "b")
    got = collections.defaultdict(list)
    for m in sorted(found["matches"], key=lambda m: m["match_no"]):
        got[m["pair_id"]].append((m["section_id_a"], m["section_id_b"], m["score"], m["confidence"], m["reason"]))
    assert set(got) == set(a) | set(b) and len(found["pairs"]) == 200
    for pair in got:
        want = plain_matches(a[pair], b[pair])
        assert [r[:2] + r[3:4] for r in got[pair]] == [r[:2] + r[3:4] for r in want]
        for g, w in zip(got[pair], want, strict=True):
            assert g[2] == pytest.approx(w[2], abs=1.1e-4) and [float(x) for x in re.findall(r"[\d.]+", g[4])] == pytest.approx([float(x) for x in re.findall(r"[\d.]+", w[4])], abs=1.1e-3)


def paragraphs(lines):
    out = []
    for line in filter(None, map(str.strip, lines)):
        goes_on = bool(out) and not re.search(r"[.?!:;]$", out[-1]) and not re.match(r"\d+[.)]\s+", line) and not re.fullmatch(r"[A-Z][A-Z0-9\s-]{3,}", line)
        if goes_on and (re.match(r"[a-z(,;]", line) or re.search(r"(?i)\b(and|or|to|of|in|for|with|on|at|by|from|under|within)$", out[-1])):
            out[-1] += " " + line
        else:
            out.append(line)
    return out


def plain_chunks(a, b, equal):
    return [(t, a[i:j], b[k:m]) for t, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes() if equal or t != "equal"]


def read_chunks(chunks):
    return [(c["tag"], list(c["lines_a"]), list(c["lines_b"])) for c in chunks]


def core(title):
    return re.sub(NAMED, "", re.sub(r"^(?:[ivxlcdm]+|\d+|[a-z])\s*", "", plain_title(title))).strip()


@need_tables
def test_diffs(found):
    ids = {s: {(x["pair_id"], x["section_id"]): x for x in found[f"sections_{s}"]} for s in "ab"}
    kinds = collections.Counter()
    for d in found["diffs"]:
        a, b = (ids[s].get((d["pair_id"], d[f"section_id_{s}"])) for s in "ab")
        lines = [[x for x in [s["title"], *s["body_lines"]] if x.strip()] if s else [] for s in (a, b)]
        texts = ["\n".join(paragraphs(x)) for x in lines]
        units = [[u for u in map(str.strip, re.split(r"(?<=[.?!])\s+", single(t))) if u] for t in texts]
        if a is None or b is None:
            kind, tag = ("added", "insert") if a is None else ("removed", "delete")
            assert (d["status"], d["semantic_status"], d["unified_diff"], d["title_diff"]) == (kind, kind, "", None) and not len(d["structured_diff"])
            assert read_chunks(d["section_diff"]) == [(tag, *lines)] and read_chunks(d["semantic_diff"]) == [(tag, *units)]
            kinds[kind] += 1
            continue
        same_title, same_body = plain_title(a["title"]) == plain_title(b["title"]), single(a["body"].lower()) == single(b["body"].lower())
        renumbered = same_body and not same_title and core(a["title"]) == core(b["title"])
        status = "unchanged" if same_title and same_body else "renumbering_only" if renumbered else "modified"
        semantic = "unchanged" if single(texts[0].lower()) == single(texts[1].lower()) else "renumbering_only" if renumbered else "modified"
        assert (d["status"], d["semantic_status"]) == (status, semantic)
        assert read_chunks(d["structured_diff"]) == plain_chunks(list(a["body_lines"]), list(b["body_lines"]), False)
        assert read_chunks(d["section_diff"]) == plain_chunks(*lines, True) and read_chunks(d["semantic_diff"]) == plain_chunks(*units, True)
        label = lambda x, y: {"fromfile": f"{a['section_id']}:{x}", "tofile": f"{b['section_id']}:{y}", "lineterm": ""}
        assert d["unified_diff"] == "\n".join(difflib.unified_diff(list(a["body_lines"]), list(b["body_lines"]), **label("old", "new")))
        assert d["semantic_unified_diff"] == "\n".join(difflib.unified_diff(*units, **label("semantic_old", "semantic_new")))
        title = d["title_diff"]
        assert title["status"] == ("unchanged" if same_title else "modified") and read_chunks(title["structured_diff"]) == plain_chunks([a["title"]], [b["title"]], False)
        assert title["unified_diff"] == "\n".join(difflib.unified_diff([a["title"]], [b["title"]], **label("title_old", "title_new")))
        kinds[status] += 1
    assert kinds["modified"] and kinds["unchanged"] and kinds["removed"]


@need_tables
def test_summaries_have_a_row_for_every_pair(spark, found):
    got = {r["pair_id"]: r for r in diffing.quality(diffing.summary(found["frames"]["diffs"], found["frames"]["pairs"])).collect()}
    assert len(got) == 200
    by = collections.defaultdict(list)
    for d in found["diffs"]:
        by[d["pair_id"]].append(d["status"])
    for pair, r in got.items():
        n = collections.Counter(by[pair])
        matched = len(by[pair]) - n["added"] - n["removed"]
        assert (r["matched"], r["added"], r["removed"], r["unchanged"], r["modified"]) == (matched, n["added"], n["removed"], n["unchanged"], matched - n["unchanged"])
        assert r["unchanged_ratio_in_matches"] == round(n["unchanged"] / max(1, matched), 4)
    rows = catalog.classification_summary(spark, SF).collect()
    assert {r["pair_id"]: r["total"] for r in rows} == {p: len(by[p]) for p in got}


def plain_features(before, after):
    sets = lambda p, t: {x.lower() for x in re.findall(p, t)}
    changed = lambda p: len(sets(p, before) ^ sets(p, after))
    has = lambda cues, t: any(c in t.lower() for c in cues)
    ratio = lambda x, y: round(len(x & y) / len(x | y), 6) if x | y else 1.0
    tokens = [{t.lower() for t in re.findall(r"[A-Za-z0-9%$€£.,/-]+", x)} for x in (before, after)]
    said = [{s.strip().lower() for s in re.split(r"(?<=[.?!])\s+", single(x)) if s.strip()} for x in (before, after)]
    hard = [n for n, c in (("obligation_change", classify.OBLIGATION), ("negation_change", classify.NEGATION), ("scope_change_cues", classify.SCOPE)) if has(c, before) != has(c, after)]
    hard += [n for n, p in (("numeric_changes", classify.NUMBERS), ("date_changes", classify.DATES), ("percentage_changes", classify.PERCENTS), ("currency_changes", classify.CURRENCIES)) if changed(p.replace("(?U)", "").replace("(?iU)", "(?i)"))]
    return round(1 - difflib.SequenceMatcher(None, single(before), single(after)).ratio(), 6), ratio(*tokens), ratio(*said), hard


@need_tables
def test_classification(spark, found):
    got = {(r["pair_id"], r["diff_no"]): r for r in catalog.change_classification(spark, SF).collect()}
    assert len(got) == len(found["diffs"])
    for d in found["diffs"]:
        before, after = (d[f"semantic_text_{s}"] or "\n".join(d[f"section_lines_{s}"] if d[f"section_lines_{s}"] is not None else []) for s in "ab")
        ratio, tokens, said, hard = plain_features(before, after)
        if hard:
            rule = "significant", ",".join(hard)
        elif ratio <= 0.03 and tokens >= 0.97 and said >= 0.95:
            rule = "editorial", "high_similarity_low_change_ratio"
        elif ratio >= 0.45 or tokens < 0.5:
            rule = "significant", "large_change_surface"
        else:
            rule = "slight", "default_small_semantic_change"
        r = got[d["pair_id"], d["diff_no"]]
        assert (r["change_ratio"], r["token_jaccard"], r["sentence_overlap"]) == pytest.approx((ratio, tokens, said), abs=2e-6)
        assert (r["rule_label"], r["rules"]) == rule and r["final_classification"] == "slight" and r["disagreement"] == (rule[0] != "slight")
        assert r["override_candidate"] == ("significant" if hard else None)


@need_tables
def test_export_and_row_pairs(spark, found):
    exported = {(r["pair_id"], r["diff_no"]): r for r in catalog.export_rows(spark, SF).collect()}
    rows = collections.defaultdict(list)
    for r in catalog.diff_rows(spark, SF).collect():
        rows[r["pair_id"], r["diff_no"]].append((r["chunk"], r["row"], r["tag"], r["old"], r["new"]))
    for d in found["diffs"]:
        key = d["pair_id"], d["diff_no"]
        want = []
        for c, (tag, old, new) in enumerate(read_chunks(d["section_diff"])):
            for k in range(max(len(old), len(new), 1)):
                want.append((c, k, tag, old[k] if k < len(old) else "", new[k] if k < len(new) else ""))
        assert sorted(rows[key]) == want
        e = exported[key]
        for s in "ab":
            text = d[f"semantic_text_{s}"] if (d[f"semantic_text_{s}"] or "").strip() else d[f"title_{s}"] or ""
            assert e[f"text_file_{s}"] == text and e["diff_score"] == d["score"]
            assert e[f"page_number_file_{s}"] == ("" if d[f"section_id_{s}"] is None else str(int(d[f"start_page_{s}"])))


def test_clusters_of_noisy_furniture(spark):
    """Running lines with scanning errors: who goes, against leader clustering by loops."""
    r = random.Random(9)
    noisy = lambda t: "".join(c if r.random() > 0.03 else r.choice("abcxyz") for c in t)
    lines, pages = [], []
    for doc in range(25):
        base = ["".join(r.choices("abcdefgh ij", k=40)) for _ in range(2)]
        n = r.randrange(1, 9)
        for page in range(1, n + 1):
            pages.append((doc, page, 800.0))
            rows = [(20.0, noisy(base[0])), (40.0, f"{noisy(base[1])} {page}"), (300.0, "body"), (760.0, r.choice([str(page), f"Consultation on principles for banks {page}", noisy(base[0]), "  "]))]
            lines += [(doc, 10 * page + k, page, 0.0, y, 9.0, y + 10, t) for k, (y, t) in enumerate(rows)]
    frame = spark.createDataFrame(lines, "doc_id long, line_no long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    heights = spark.createDataFrame(pages, "doc_id long, page int, height double")
    want = set()
    for doc in range(25):
        total = len({p for d, p, _ in pages if d == doc})
        for top in (True, False):
            edge = [(x[2], single(x[7]), re.sub(r"\b\d+\b", "<num>", single(x[7].lower()))) for x in lines if x[0] == doc and single(x[7]) and (x[6] <= 96 if top else x[4] >= 704)]
            forms = collections.Counter(f for _, _, f in edge)
            leaders, members = [], collections.defaultdict(list)
            for page, text, form in edge:
                k = next((k for k, leader in enumerate(leaders) if alike(form, leader) >= 0.92), len(leaders))
                leaders += [form] * (k == len(leaders))
                members[k].append((page, text, form))
                if forms[form] / total >= 0.6 or re.fullmatch(r"(?i)(?:page\s+)?\d+(?:\s*/\s*\d+)?", text):
                    want.add((doc, page, text))
            for group in members.values() if len(edge) > 1 else ():
                held = {p for p, _, _ in group}
                for page, text, form in group:
                    title = len(text) >= 20 and re.search(r"\b\d{1,4}\b$", text) and sum(map(str.isalpha, text)) >= 12 and re.search("[a-z]", form)
                    if len(held) / total >= 0.6 or len(held) >= 2 and title:
                        want.add((doc, page, text))
    got = layout.removable(frame, heights).collect()
    assert {(x["doc_id"], x["page"], x["text"]) for x in got} == want and len(got) == len(want)
    assert {x["reason"] for x in got} == set(layout.REASONS)
    # documents whose positions can't be relied on keep all but bare numbers
    off = layout.clean_lines(frame, heights.withColumn("reliable", F.col("doc_id") > 3)).filter("doc_id <= 3 and reason is not null")
    assert {x["reason"] for x in off.collect()} <= {"page_number", "blank"}
    assert layout.clean_lines(frame, heights, LayoutConfig(), fuzzy=False).count() == len(lines)


@pytest.mark.parametrize("least", [0.92, 0.8, 0.5, 1.0, 0.0])
def test_leaders_by_index_equal_those_by_loop(least):
    import difflib
    import random

    from folioscope.functions.similarity import Leaders

    r = random.Random(9)
    words = ["page", "report", "annual", "ß", "2024", "of", "the", "board", "<num>"]
    lines = [" ".join(r.choices(words, k=r.randrange(1, 9))) for _ in range(150)]
    for _ in range(150):  # misread, cut and grown forms
        text = list(r.choice(lines))
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(text) + 1)
            text[at : at + r.randrange(2)] = r.choice(["", "x", "yy"])
        lines.append("".join(text) or "z")
    lines += ["a" * 250, "a" * 240 + "b" * 10, "ab" * 120]
    leaders, plain = Leaders(least), []
    for line in lines:
        want = next((k for k, leader in enumerate(plain) if line == leader or difflib.SequenceMatcher(None, line, leader).ratio() >= least), None)
        assert leaders.first(line) == want
        if want is None:
            plain.append(line)
            assert leaders.add(line) == len(plain) - 1


def test_band_of_very_many_distinct_lines(spark):
    """20,000 lines in one band, all different: no line meets all leaders."""
    import random
    import time

    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 9))) for _ in range(3000)]
    texts = list(dict.fromkeys(" ".join(r.choices(words, k=6)) for _ in range(20_000)))
    # near copies of early lines, one character off, on pages of their own
    texts += [t[:5] + "~" + t[6:] for t in texts[:50]]
    lines = spark.createDataFrame([(1, k, k + 1, 0.0, 5.0, 9.0, 10.0, t) for k, t in enumerate(texts)], "doc_id long, line_no long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    pages = spark.range(1, len(texts) + 1).selectExpr("1L AS doc_id", "cast(id AS int) AS page", "1000.0D AS height")
    begun = time.time()
    # at two pages of a cluster the running titles of it would go; here none ends in a number
    assert layout.removable(lines, pages, LayoutConfig(repeat_ratio=1.5 / len(texts))).filter("reason = 'cluster'").count() == 100
    assert time.time() - begun < 60


def test_hooks(spark):
    """A classifier of modified sections only; a model that fails for one row."""
    cols = "pair_id long, ordinal long, section_id string, parent_id string, level int, anchor_type string, title string, title_normalized string, start_page int, end_page int, body string, body_lines array<string>"
    side = lambda rows: spark.createDataFrame([(1, i, sid, None, 1, "major_heading", t, t.lower(), 1, 1, b, [b]) for i, (sid, t, b) in enumerate(rows)], cols)
    a, b = side([("a1", "Principle 1: x", "old body"), ("a2", "Principle 2: y", "same")]), side([("b1", "Principle 1: x", "new body"), ("b2", "Principle 2: y", "same")])
    matches = spark.createDataFrame([(1, 0, "a1", "b1", 0.9, "matched", ""), (1, 1, "a2", "b2", 0.9, "matched", ""), (1, 2, "a1", None, 0.0, "unmatched", "")], "pair_id long, match_no long, section_id_a string, section_id_b string, score double, confidence string, reason string")
    got = diffing.diffs(matches, a, b, classifier=lambda x, y: x + ">" + y).orderBy("match_no").collect()
    assert [r["change_classification"] for r in got] == ["old body>new body", None, None]

    def model(frame):
        if (frame["before_text"] == "bad").any():
            raise RuntimeError("no answer")
        return frame.assign(label="editorial", confidence=3.0)

    rows = spark.createDataFrame([(1, "t", "x", "y"), (2, "t", "bad", "y"), (3, "t", "z", "y")], "pair_id long, section_title string, before_text string, after_text string").coalesce(1)
    got = {r["pair_id"]: r for r in classify.modelled(rows, model, retries=1, wait=0.01).collect()}
    assert [(got[k]["model_label"], got[k]["model_confidence"], got[k]["prompt_version"], got[k]["stub"]) for k in (1, 2, 3)] == [("editorial", 1.0, "v1", False), ("slight", 0.51, "v1-fallback", True), ("editorial", 1.0, "v1", False)]
    assert got[2]["rationale"] == "the model failed: no answer"


def test_unicode_digits(spark):
    row = spark.createDataFrame([("n ٣ ٣", "n ٤")], "before_text string, after_text string")
    assert classify.value_features(row).first()["numeric_changes_count"] == 2


@need_tables
def test_backends(spark):
    from folioscope.plans import corpus

    docs = corpus.documents(spark, SF)
    sides = (*corpus.layout(docs, "a"), *corpus.layout(docs, "b"))
    broken = (sides[0].drop("text"), *sides[1:])
    rows = compare.backends({"tables": sides, "broken": broken}).collect()
    good = [r for r in rows if r["backend"] == "tables"]
    assert len(good) == 200 and all(r["ok"] and set(r["timing_seconds"]) == {"extract", "sectionize", "match", "diff", "total"} for r in good)
    assert all(r["extraction_a"]["remaining"] >= r["sections_a"] for r in good)
    (bad,) = [r for r in rows if r["backend"] == "broken"]
    assert not bad["ok"] and bad["error"]


def test_reports_read_back(spark, tmp_path):
    from folioscope.sources import readers, writers

    rows = [(f"p{p}", i, f"a{i}", None if i else "b", "T", "x", 0.5 + i / 10, 3 + i, None) for p in range(3) for i in range(2)]
    diffs = spark.createDataFrame(rows, "pair_id string, diff_no long, section_id_a string, section_id_b string, title_a string, semantic_text_a string, score double, start_page_a int, start_page_b int")
    pairs = spark.createDataFrame([("p0",), ("p1",), ("p2",), ("p3",)], "pair_id string")
    writers.write_json(diffs, diffing.of_all(diffs.groupBy("pair_id").agg(F.count("*").alias("n")), pairs), str(tmp_path / "reports"))
    got = {(r["pair_id"], r["diff_no"]): r for r in readers.reports(spark, str(tmp_path / "reports")).collect()}
    assert set(got) == {r[:2] for r in rows}
    assert all((got[r[:2]]["match_score"], got[r[:2]]["page_no_in_a"], got[r[:2]]["page_no_in_b"], got[r[:2]]["section_id_b"]) == (r[6], r[7], None, r[3]) for r in rows)
    text = [line for f in (tmp_path / "reports").glob("part-*") for line in f.read_text().splitlines()]
    assert len(text) == 4 and all('"page_no_in_b":null' in line for line in text if "p3" not in line)
    # upserts: the later import wins, also within the same second
    for label in ("slight", "significant"):
        entries = spark.createDataFrame([("p0", "0:a0->b", label, "import")], "pair_id string, diff_id string, classification string, source string").withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
        writers.append_log(entries, str(tmp_path / "log"))
    assert report.latest(spark.read.parquet(str(tmp_path / "log")), ["pair_id", "diff_id"]).first()["classification"] == "significant"


def test_progress(spark):
    from pyspark.sql import Observation

    cols = "pair_id long, diff_no long, section_id_a string, section_id_b string, title_a string, title_b string, semantic_text_a string, semantic_text_b string, section_lines_a array<string>, section_lines_b array<string>, score double, start_page_a int, start_page_b int"
    rows = spark.createDataFrame([(1, i, "a", "b", "T", "T", "x", "x y" * i, [], [], 0.5, 1, 2) for i in range(5)], cols)
    seen = Observation()
    assert classify.classified(rows, None, seen).count() == 5
    assert seen.get == {"rows": 5, "answered": 0, "editorial": 0, "slight": 5, "significant": 0}

