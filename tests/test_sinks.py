"""Sinks of whole files and workbooks, the annotation log with several writers, and paths in any store."""

import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.__main__ import main
from folioscope.operators import report
from folioscope.sources import files, readers, sheets, writers

ROWS = "pair_id string, diff_no long, " + ", ".join(f"{c} {'double' if c == 'diff_score' else 'string'}" for c in writers.EXPORT)
ODD = ["", None, "plain", 'quote " & <tag> \'', " spaces \t\n\r lines ", "é 日本 😀  ", "=1+1", "0012", "x" * 40_000, "a\x00b\x0bc"]


def test_workbooks(spark, tmp_path):
    pairs = ["p/1", "p 2", "ä+%20", "..", "_x", "long" * 100]
    rows = [(p, k, text, str(k), text, None, "2", f"{p}{k}", None if k == 1 else k / 3) for p in pairs for k, text in enumerate(ODD)]
    out = str(tmp_path / "out")
    sheets.write_sheets(spark.createDataFrame(rows, ROWS).repartition(3), out)
    names = sorted(os.listdir(out))
    assert len([n for n in names if n.endswith(".xlsx")]) == 6 and "_temporary" not in names
    got = {(r["text_file_b"], r["row_no"]): r for r in sheets.read_sheets(spark, out).collect()}
    assert len(got) == len(rows)
    bare = lambda t: t if t is None else t.replace("\x00", "").replace("\x0b", "")[:32_767]
    for p, k, a, no, text, b, number, text_b, score in rows:
        r = got[text_b, k]
        assert (r["page_number_file_a"], r["section_number_file_a"], r["text_file_a"], r["page_number_file_b"], r["section_number_file_b"], r["diff_score"]) == (bare(a), no, bare(text), b, number, score)
        assert r["pair_id"] == p if len(p) < 100 else p.startswith(r["pair_id"].split("~")[0])
    with zipfile.ZipFile(os.path.join(out, "p%202.xlsx")) as parts:
        assert set(parts.namelist()) == {*sheets.PARTS, "xl/worksheets/sheet1.xml"} and parts.testzip() is None
    # written again with fewer pairs: the others are gone
    sheets.write_sheets(spark.createDataFrame(rows[:3], ROWS), out)
    assert [n for n in os.listdir(out) if n.endswith(".xlsx")] == ["p%2F1.xlsx"]
    sheets.write_sheets(spark.createDataFrame([], ROWS), out)
    assert sheets.read_sheets(spark, out).count() == 0


def test_failed_jobs_leave_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([("a", b"1"), ("b", b"2")], "name string, content binary")
    files.write_files(good, out)
    broken = good.withColumn("content", F.when(F.col("name") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        files.write_files(broken, out)
    with pytest.raises(Exception, match="one file name"):
        files.write_files(good.union(good), out)
    assert sorted(os.listdir(out)) == ["a", "b"] and open(f"{out}/b").read() == "2"
    files.register(spark)
    good.select(F.lit("c").alias("name"), "content").limit(1).write.format("folio_files").mode("append").save(out)
    assert sorted(os.listdir(out)) == ["a", "b", "c"]


def test_sheets_on_the_command_line(spark, tmp_path):
    path = tmp_path / "r_diff.json"
    path.write_text('{"pair_id": "p", "diffs": [{"section_id_a": "a", "title_a": "IV. T", "match_score": 0.5, "page_no_in_a": 3, "section_lines_a": ["l", "m"]}]}')
    main(["export", str(path), "--excel", str(tmp_path / "book")], spark)
    assert [tuple(r)[2:] for r in sheets.read_sheets(spark, str(tmp_path / "book")).collect()] == [("3", "IV", "l\nm", "", "", "", 0.5)]


def entry(spark, keys, value):
    return spark.createDataFrame([("p", k, value, 1) for k in keys], "pair_id string, diff_id string, classification string, n long").withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))


def test_two_writers_never_tie(spark, tmp_path, monkeypatch):
    """Both calls see the same log before either has written; one of them wins for every key."""
    path, keys = str(tmp_path / "log"), [f"k{i}" for i in range(40)]
    writers.append_log(entry(spark, keys, "first"), path)
    meet = threading.Barrier(2)
    number = writers.numbered
    monkeypatch.setattr(writers, "numbered", lambda log: (meet.wait(60), number(log))[1])
    calls = [threading.Thread(target=writers.append_log, args=(entry(spark, keys, who), path)) for who in ("left", "right")]
    for c in calls:
        c.start()
    for c in calls:
        c.join()
    monkeypatch.setattr(writers, "numbered", number)
    log = writers.read_log(spark, path)
    assert log.filter("call = 2").select("batch").distinct().count() == 2
    assert log.groupBy("pair_id", "diff_id", "call", "batch", "seq").count().filter("count > 1").isEmpty()
    last = lambda: {r["classification"] for r in report.latest(writers.read_log(spark, path), ["pair_id", "diff_id"]).collect()}
    won = last()
    assert len(won) == 1 and won <= {"left", "right"}
    writers.compact_log(spark, path)
    assert last() == won and writers.read_log(spark, path).count() == 40
    writers.compact_log(spark, path)
    assert writers.read_log(spark, path).count() == 40
    writers.append_log(entry(spark, keys, "later"), path)
    assert last() == {"later"}


def test_entries_added_while_a_log_is_compacted_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    writers.append_log(entry(spark, ["a", "b"], "old"), path)
    snapshot = writers.latest

    def meanwhile(log, keys):
        monkeypatch.setattr(writers, "latest", snapshot)
        writers.append_log(entry(spark, ["b"], "new"), path)
        return snapshot(log, keys)

    monkeypatch.setattr(writers, "latest", meanwhile)
    writers.compact_log(spark, path)
    got = {r["diff_id"]: r["classification"] for r in report.latest(writers.read_log(spark, path), ["pair_id", "diff_id"]).collect()}
    assert got == {"a": "old", "b": "new"} and writers.read_log(spark, path).count() == 3


def test_logs_without_calls_are_read(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([("p", "k", "old", 7)], "pair_id string, diff_id string, classification string, seq long").write.parquet(path)
    writers.append_log(entry(spark, ["k"], "new"), path)
    assert report.latest(writers.read_log(spark, path), ["pair_id", "diff_id"]).first()["classification"] == "new"


def test_paths_in_any_store(spark, tmp_path):
    base = tmp_path / "base"
    base.mkdir()
    (base / "sub").mkdir()
    for name in ("b_diff.json", "a.json", "c.txt", "sub/d.JSON"):
        (base / name).write_text("{}")
    (tmp_path / "secret.json").write_text("{}")
    (tmp_path / "base2").mkdir()
    (tmp_path / "base2" / "x.json").write_text("{}")
    os.symlink(tmp_path / "secret.json", base / "link.json")
    os.symlink(base / "a.json", base / "inner.json")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.paths.link./in", f"file://{tmp_path}")
    for root in (str(base), f"file://{base}", "viewfs://paths/in/base"):
        assert readers.listing(root) == ["a.json", "b_diff.json", "inner.json", "link.json"]
        assert readers.safe_path(root, "a.json", ".json").endswith("/base/a.json")
        assert readers.safe_path(root, "sub/../sub/d.JSON", ".json").endswith("/base/sub/d.JSON")
        assert readers.safe_path(root, "", ".json", "now") == "now"
        for bad in ("../secret.json", "sub/../../secret.json", "../base2/x.json", "c.txt", "none.json", "/etc/hosts.json", str(tmp_path / "secret.json"), "file:///etc/x.json", "..", "."):
            with pytest.raises(FileNotFoundError):
                readers.safe_path(root, bad, ".json")
    assert readers.safe_path(str(base), str(base / "a.json"), ".json") == str(base / "a.json")
    assert readers.safe_path(str(base), "inner.json", ".json") == str(base / "a.json")
    with pytest.raises(FileNotFoundError):
        readers.safe_path(str(base), "link.json", ".json")
    (base / "b_classified.json").write_text('{"classifications": [{"section_id": "s", "final_classification": "slight"}]}')
    assert readers.sibling_labels(spark, "viewfs://paths/in/base/b_diff.json", "p").first()["label"] == "slight"
