"""The command line on small reports and layouts."""

import pytest

from folioscope import storage
from folioscope.__main__ import main

REPORT = '{"diffs": [{"section_id_a": "a1", "section_id_b": "b1", "title_a": "3. T", "title_b": "3. T", "semantic_text_a": "Pay 5 now.", "semantic_text_b": "Pay 6 now.", "match_score": 0.9, "semantic_status": "modified"}]}'


def test_reports(spark, tmp_path, capsys):
    (tmp_path / "r_diff.json").write_text(REPORT)
    (tmp_path / "r_classified.json").write_text('{"classifications": [{"section_id": "b1", "final_classification": "significant"}]}')
    report, classified = str(tmp_path / "r_diff.json"), str(tmp_path / "r_classified.json")
    main(["classify", report, "--output", str(tmp_path / "out")], spark)
    got = spark.read.json(str(tmp_path / "out/classifications")).first()
    assert got["rule_label"] == "significant" and got["final_classification"] == "slight"
    main(["export", report, "--csv", str(tmp_path / "csv")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["section_number_file_a"] == "3"
    main(["import-labels", report, classified, "--log", str(tmp_path / "log")], spark)
    assert capsys.readouterr().out.strip() == "imported=1"
    assert spark.read.parquet(str(tmp_path / "log")).first()["classification"] == "significant"
    main(["import-labels", report, str(tmp_path / "none.json"), "--log", str(tmp_path / "log")], spark)
    assert capsys.readouterr().out.strip() == "imported=0"
    with pytest.raises(SystemExit):
        main(["export", report], spark)


def test_layouts(spark, tmp_path):
    span = "doc_id long, page int, block int, span_no int, text string, x0 double, y0 double, x1 double, y1 double"
    for name, word in (("a", "act"), ("b", "react")):
        texts = ["Principle 1: Banks", f"They {word} now.", "Principle 2: More", "Same."]
        spark.createDataFrame([(1, 1, 0, i, t, 5.0, 200.0 + 20 * i, 50.0, 212.0 + 20 * i) for i, t in enumerate(texts)], span).write.parquet(str(tmp_path / name / "spans"))
        spark.createDataFrame([(1, 1, 800.0)], "doc_id long, page int, height double").write.parquet(str(tmp_path / name / "pages"))
    main(["extract", str(tmp_path / "a"), "--output", str(tmp_path / "x"), "--dump-intermediate"], spark)
    assert spark.read.json(str(tmp_path / "x/sections")).count() == 2
    main(["diff", str(tmp_path / "a"), str(tmp_path / "b"), "--output", str(tmp_path / "y"), "--dump-intermediate"], spark)
    got = spark.read.json(str(tmp_path / "y/reports")).first()
    assert storage.release(spark) == 0  # the command has cleaned up
    assert spark.read.json(str(tmp_path / "y/debug_b")).first()["remaining"] == 4
    assert got["summary"]["modified"] == 1 and [d["status"] for d in got["diffs"]] == ["unchanged", "modified"]
