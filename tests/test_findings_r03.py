"""What the third round's review found, on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope import catalog
from test_queries import rows


def agree(spark, folder, name, **tables):
    """A query over tables gives the rows that DuckDB gives; returns them."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(folder)).toPandas()
    assert rows(got) == rows(con.execute(catalog.ORACLES[name]).df())
    return got


def test_running_titles_of_cut_lines(spark, tmp_path):
    """A heading is cut after a number and a space; a line of other letters and a number."""
    texts = ["x\n" + "about the words of the committee in 2024 and so on\n", "x\nabout the words of the committees in 2024 and so on", "Принципы надзора за рисками 17"]
    docs = spark.createDataFrame([(4 * k + r, t, "web") for k, t in enumerate(texts) for r in range(4)], "doc_id long, text string, source string")
    agree(spark, tmp_path, "running_titles", documents=docs)


def size(folder, suffix):
    return sum(p.stat().st_size for p in folder.rglob(f"*{suffix}"))


def test_classified_reports_in_one_shuffle(spark, tmp_path):
    """A pair's rows are shuffled once, and what is written is a small part of what is said."""
    from folioscope.sources import writers

    rows = catalog._by_order(spark, "/root/testdata/sf0.001")
    found = writers.classified_json(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    said = found.agg(F.sum(F.length("value"))).first()[0]
    writers.write_classified(rows, str(tmp_path / "out"))
    assert size(tmp_path / "out", "") < said / 8
    none = spark.createDataFrame([("none", "a.pdf", "b.pdf")], "pair_id string, pdf_a string, pdf_b string")
    empty = writers.classified_json(rows, none).collect()
    assert [r["pair_id"] for r in empty] == ["none"] and '"summary":{"total":0,"editorial":0,"slight":0,"significant":0,"disagreements":0},"classifications":[]' in empty[0]["value"]


def test_labels_of_named_pairs_meet_no_sources(spark, tmp_path, monkeypatch):
    """Reports that name their pair, of documents that nothing names: before, all their rows met in the one task of the null key."""
    from folioscope.operators import report
    from folioscope.sources import readers

    one = '{{"pair_id": {pair}, "source_pdf_a": {a}, "source_pdf_b": {a}, "classifications": [{{"section_id": "s1", "final_classification": "{label}"}}]}}'
    put = lambda name, *lines: (tmp_path / name).mkdir() or (tmp_path / name / "part.json").write_text("\n".join(lines))
    put("named", *[one.format(pair=f'"p{k}"', a="null", label="slight") for k in range(3)])
    put("mixed", one.format(pair='"p0"', a="null", label="slight"), one.format(pair="null", a='"x"', label="editorial"))
    put("lost", one.format(pair="null", a="null", label="slight"))
    sources = spark.createDataFrame([("p0", None, None), ("p1", "x", "x"), ("p2", "y", "y")], "pair_id string, pdf_a string, pdf_b string")
    found = readers.all_labels(spark, str(tmp_path / "named"), sources)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(f"p{k}", "s1", "slight") for k in range(3)]
    assert sorted(map(tuple, readers.all_labels(spark, str(tmp_path / "mixed"), sources).collect())) == [("p0", "s1", "slight"), ("p1", "s1", "editorial")]
    with pytest.raises(ValueError):
        readers.all_labels(spark, str(tmp_path / "lost"), sources)
    diffs = spark.createDataFrame([("p0", 0, "s1", None), ("p1", 0, "s9", "s1"), ("p2", 0, None, "s9")], "pair_id string, diff_no int, section_id_a string, section_id_b string")
    got = report.imported(diffs, readers.all_labels(spark, str(tmp_path / "mixed"), sources))
    assert sorted((r["diff_id"], r["classification"]) for r in got.collect()) == [("0:s1->none", "slight"), ("0:s9->s1", "editorial")]


def letters(spark, n):
    """Two sides of pairs of 1 to n sections."""
    cols = "pair_id long, section_id string, anchor_type string, title_normalized string, core string, prefix string, i long, n long"
    return [spark.createDataFrame([(p, f"{s}{i}", "xy"[i % 2], "pqr"[(p + i * k) % 3], "stuv"[(p * k + i) % 4], "wz"[i % 2], i, p) for p in range(1, n + 1) for i in range(p)], cols) for s, k in (("a", 1), ("b", 2))]


def test_matches_are_found_once(spark):
    """Matched and outer rows come from one pass over the tasks that match; sections that repeat a place stay."""
    from folioscope.operators import matching

    a, b = letters(spark, 6)
    found = matching.matches(a.union(a.filter("pair_id = 3")), b, matching.assigned_lazily(a, b))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    found = found.toPandas()
    hit = found[found.confidence != "unmatched"]
    assert len(found) - len(hit) == 2 * 21 - 2 * len(hit) + sum(f"a{i}" not in set(hit[hit.pair_id == 3].section_id_a) for i in range(3))


def test_rounds_keep_no_candidates(spark, monkeypatch):
    """Of pairs in many blocks the rounds store sections and their bests, not all candidates, and give what tasks give."""
    from folioscope.operators import matching

    a, b = letters(spark, 12)
    kept = []
    keep = matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    wide = {tuple(x) for x in matching.assigned_widely(a, b, block=4).select("pair_id", "match_no", "i_a", "i_b").collect()}
    assert wide == {tuple(x) for x in matching.assigned_lazily(a, b).select("pair_id", "match_no", "i_a", "i_b").collect()}
    pieces = sum(2 * p * -(-p // 2) for p in range(1, 13))  # sections by blocks of theirs
    assert len(kept) > 1 and max(t.count() for t in kept) <= pieces
    assert not {"candidates", "measured"} & {t.inputFiles()[0].split("/")[-2].rsplit("-", 1)[0] for t in kept if t.inputFiles()}


def test_spans_are_sorted_in_more_tasks(spark, tmp_path, monkeypatch):
    """The number of tasks that sort spans grows with the documents; lines are dealt out before they are cut."""
    docs = spark.createDataFrame([(k, f"one two three {k}\nfour five\n\nsix", "web") for k in range(9)], "doc_id long, text string, source string")
    monkeypatch.setattr(catalog, "SPAN_BYTES", 64, raising=False)
    agree(spark, tmp_path, "span_lines", documents=docs)
    plan = catalog.QUERIES["span_lines"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    stored = sum(p.stat().st_size for p in (tmp_path / "documents.parquet").iterdir() if p.suffix != ".crc")
    assert f", {stored // 64}), REPARTITION_BY_NUM" in plan
