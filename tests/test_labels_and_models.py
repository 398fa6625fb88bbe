"""Classified reports of many pairs, their import, and a model's answers kept in a table."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioscope.__main__ import main
from folioscope.operators import classify
from folioscope.sources import readers

DIFF = {"title_a": "3. T", "title_b": "3. T", "semantic_text_a": "Pay 5 now.", "semantic_text_b": "Pay 6 now.", "match_score": 0.9, "status": "modified", "anchor_type": "numeric_heading", "low_confidence": False}


def stored(folder, pairs):
    folder.mkdir()
    lines = [json.dumps({"pair_id": p, "pdf_a": f"{p}-a.pdf", "pdf_b": f"{p}-b.pdf", "diffs": [DIFF | {"section_id_a": f"a{k}", "section_id_b": None if k else "b0"} for k in range(n)]}) for p, n in pairs.items()]
    (folder / "part-0.json").write_text("\n".join(lines))
    return str(folder)


def test_labels_of_all_pairs_from_command_to_command(spark, tmp_path, capsys):
    reports = stored(tmp_path / "reports", {"p": 2, "q": 1, "empty": 0})
    main(["classify", reports, "--output", str(tmp_path / "out")], spark)
    got = {r["pair_id"]: r for r in spark.read.json(str(tmp_path / "out/reports")).collect()}
    assert set(got) == {"p", "q", "empty"}
    assert got["p"]["source_pdf_a"] == "p-a.pdf" and got["empty"]["classifications"] == []
    assert {k: got["empty"]["summary"][k] for k in ("total", "disagreements")} == {"total": 0, "disagreements": 0}
    first = got["p"]["classifications"][0]
    assert (first["section_id"], first["final_classification"], first["rule_classification"]["label"], first["llm_classification"]["stub"], first["features"]["numeric_changes_count"]) == ("b0", "slight", "significant", True, 2)
    assert [c["section_id"] for c in got["p"]["classifications"]] == ["b0", "a1"] and got["p"]["summary"]["total"] == 2
    main(["import-labels", reports, str(tmp_path / "out/reports"), "--log", str(tmp_path / "log")], spark)
    assert capsys.readouterr().out.strip() == "imported=3"
    log = {(r["pair_id"], r["diff_id"]): r["classification"] for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert log == {("p", "0:a0->b0"): "slight", ("p", "1:a1->none"): "slight", ("q", "0:a0->b0"): "slight"}


def test_labels_without_a_pair(spark, tmp_path):
    sources = readers.report_sources(spark, stored(tmp_path / "reports", {"p": 1, "q": 1}))
    path = tmp_path / "c.json"
    body = {"classifications": [{"section_id": "b0", "final_classification": "editorial"}, {"section_id": "b0", "final_classification": "slight"}, {"section_id": "b0", "final_classification": ""}, {"section_id": "", "final_classification": "slight"}]}
    path.write_text(json.dumps(body, indent=1))
    with pytest.raises(ValueError, match="no pair is named"):
        readers.all_labels(spark, str(path), sources)
    assert [tuple(r) for r in readers.all_labels(spark, str(path), sources.filter("pair_id = 'q'")).collect()] == [("q", "b0", "slight")]
    path.write_text(json.dumps(body | {"source_pdf_a": "p-a.pdf", "source_pdf_b": "p-b.pdf"}))
    assert [tuple(r) for r in readers.all_labels(spark, str(path), sources).collect()] == [("p", "b0", "slight")]
    assert readers.all_labels(spark, str(tmp_path / "none"), sources).count() == 0


COLUMNS = "pair_id long, section_id string, section_title string, before_text string, after_text string, diff_score double, rule_label string"


def rows_of(spark, n):
    return spark.createDataFrame([(k, f"s{k}", "t", f"text {k % 30}", "y", None, "slight") for k in range(n)], COLUMNS).repartition(4)


def test_answers_as_they_count(spark):
    def model(frame):
        kinds = {
            "0": {"label": " Significant\n", "confidence": None, "rationale": "because"}, "1": {"label": "unsure", "confidence": 7}, "2": {"label": "EDITORIAL", "confidence": -1.0, "rationale": None}, "3": {"confidence": 0.123456},
        }
        return frame.assign(**{c: [kinds[t].get(c) for t in frame["before_text"]] for c in ("label", "confidence", "rationale")})[["label", "confidence", "rationale"]]

    rows = spark.createDataFrame([(k, "s", "t", str(k), "y", 0.5, "slight") for k in range(4)], COLUMNS)
    got = {r["pair_id"]: r for r in classify.modelled(rows, model, model="m").collect()}
    assert [(got[k]["model_label"], got[k]["model_confidence"], got[k]["rationale"]) for k in range(4)] == [
        ("significant", 0.6, "because"), ("slight", 1.0, "Model classification."), ("editorial", 0.0, "Model classification."), ("slight", 0.1235, "Model classification."),
    ]
    assert {(r["model"], r["prompt_version"], r["stub"]) for r in got.values()} == {("m", "v1", False)}


def test_answers_in_words():
    read = classify.read_answer
    assert read('{"label": "slight"}') == read(' so {"label": "slight"} then') == {"label": "slight"}
    assert read("") == read(None) == read("no braces") == read("} {") == read("[1]") == read("{broken}") == {}
    assert read('a {"x": {"y": 1}} b') == {"x": {"y": 1}}


def test_errors_are_tried_again_by_their_class(spark, tmp_path):
    def model(frame):
        (word,) = frame["before_text"].unique()[:1]
        if len(frame) > 1:
            raise RuntimeError("one at a time")
        with open(f"{tmp_path}/{word}", "a") as f:
            f.write("x")
        if word == "later" and os.path.getsize(f"{tmp_path}/{word}") < 3:
            raise TimeoutError("busy")
        if word == "never":
            raise KeyError("bug")
        return frame.assign(text='{"label": "editorial", "confidence": "high"}' if word == "unread" else '{"label": "editorial"}')[["text"]]

    rows = spark.createDataFrame([(k, "s", "t", w, "y", None, "slight") for k, w in enumerate(["later", "never", "unread", "good"])], COLUMNS).coalesce(1)
    got = {r["before_text"]: (r["model_label"], r["stub"]) for r in classify.modelled(rows, model, retries=2, wait=0.01).collect()}
    assert got == {"later": ("editorial", False), "never": ("slight", True), "unread": ("slight", True), "good": ("editorial", False)}
    assert {w: os.path.getsize(f"{tmp_path}/{w}") for w in got} == {"later": 3, "never": 1, "unread": 3, "good": 1}


def test_a_killed_run_goes_on(spark, tmp_path):
    asked, store = tmp_path / "asked", str(tmp_path / "answers")
    asked.mkdir()

    def model(frame, broken=False):
        for text in frame["before_text"]:
            with open(asked / text, "a") as f:
                f.write("x")
        if broken and len(os.listdir(asked)) > 12:
            raise SystemExit("killed")  # no Exception: ends the job
        return frame.assign(label="editorial", rationale="for " + frame["before_text"])

    rows = rows_of(spark, 90).drop("section_id")  # 30 payloads, three rows each
    with pytest.raises(Exception, match="killed"):
        classify.modelled(rows, lambda f: model(f, True), store=store, wave=5).count()
    kept = {r["rationale"] for r in spark.read.parquet(store).collect()}
    assert 0 < len(kept) < 30
    for path in asked.iterdir():
        path.unlink()
    got = classify.modelled(rows, model, store=store, wave=5).collect()
    assert len(got) == 90 and all(r["rationale"] == f"for {r['before_text']}" and not r["stub"] for r in got)
    assert {f"for {name}" for name in os.listdir(asked)} == {f"for text {k}" for k in range(30)} - kept
    assert all(os.path.getsize(asked / name) == 1 for name in os.listdir(asked))
    # another model's answers are others; the same one is not asked again
    assert classify.modelled(rows, None, store=store).filter("stub").count() == 90
    for path in asked.iterdir():
        path.unlink()
    assert classify.modelled(rows, model, store=store).count() == 90 and not os.listdir(asked)
    assert classify.modelled(rows, model, store=store, model="other").filter("not stub").count() == 90 and len(os.listdir(asked)) == 30


def test_failures_are_not_stored(spark, tmp_path):
    store = str(tmp_path / "answers")

    def fails(frame):
        raise RuntimeError("down")

    rows = rows_of(spark, 8)
    got = classify.modelled(rows, fails, store=store).collect()
    assert all(r["stub"] and r["prompt_version"] == "v1-fallback" and r["rationale"] == "the model failed: down" for r in got)
    assert classify.modelled(rows, lambda f: f.assign(label="significant"), store=store).filter("model_label = 'significant'").count() == 8
    assert classify.modelled(rows.filter("false"), fails, store=store).count() == 0


def test_events_while_the_job_runs(spark, tmp_path):
    """A middle state: the second wave has begun, the first one's answers are told and stored, and the rest still wait."""
    store, seen = str(tmp_path / "answers"), []

    def listener(name, told):
        seen.append((name, told["section_id"], told.get("rule_label"), told.get("llm_label"), told.get("stub"), spark.read.parquet(store).count() if os.path.isdir(store) else 0))

    rows = rows_of(spark, 20)
    classify.modelled(rows, lambda f: f.assign(label="editorial"), store=store, wave=7, listener=listener).count()
    names = [s[0] for s in seen]
    assert names.count("pre_llm") == names.count("post_llm") == 20 and {s[1] for s in seen} == {f"s{k}" for k in range(20)}
    second = [k for k in range(1, 40) if names[k] == "pre_llm" and names[k - 1] == "post_llm"][0]
    assert 0 < seen[second][5] == names[:second].count("post_llm") < 20
    assert {s[2:5] for s in seen} == {("slight", None, None), (None, "editorial", False)}


def test_what_a_model_is_given(spark):
    cols = "pair_id long, diff_no long, section_id_a string, section_id_b string, title_a string, title_b string, semantic_text_a string, semantic_text_b string, section_lines_a array<string>, section_lines_b array<string>, match_score double, status string, semantic_status string, anchor_type string, low_confidence boolean"
    rows = spark.createDataFrame([(1, 0, "a", "b", "T", "", "x", "", [], ["l", "m"], 0.5, "modified", "renumbering_only", "major_heading", True), (1, 1, "a", None, "T", "", "x", "", [], [], None, "removed", None, None, None)], cols)
    given = classify.modelled(classify.payload(rows), lambda f: f.assign(label="slight", rationale=f.to_json(orient="records", lines=True).strip().split("\n")))
    got = [json.loads(r["rationale"]) for r in given.orderBy("diff_no").collect()]
    assert got[0] == {"section_id": "b", "section_title": "T", "before_text": "x", "after_text": "l\nm", "diff_score": 0.5, "status": "renumbering_only", "anchor_type": "major_heading", "low_confidence": True}
    assert got[1]["status"] == "removed" and got[1]["diff_score"] is None


def words(frame):
    return frame.assign(label="editorial", rationale="from a module")


def test_hook_on_the_command_line(spark, tmp_path, capsys):
    reports = stored(tmp_path / "reports", {"p": 2})
    run = lambda *more: main(["classify", reports, "--output", str(tmp_path / "out"), "--hook", f"{__name__}:words", "--model", "m1", "--answers", str(tmp_path / "answers"), *more], spark)
    run("--events")
    said = capsys.readouterr().out.splitlines()
    assert [line.split()[0] for line in said] == ["pre_llm", "pre_llm", "post_llm", "post_llm"] and "llm_label=editorial" in said[-1]
    run("--events")
    assert not capsys.readouterr().out
    told = spark.read.json(str(tmp_path / "out/reports")).select(F.explode("classifications.llm_classification").alias("c")).select("c.*").distinct().collect()
    assert [(r["label"], r["model"], r["rationale"], r["stub"]) for r in told] == [("editorial", "m1", "from a module", False)]
