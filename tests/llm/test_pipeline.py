"""The pipeline's stages against plain Python, each on its own input."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(60)]
    passage = " ".join(r.choices(words, k=30))
    texts[7] = texts[6] + " extra"
    texts[9] = texts[9] + " " + passage
    texts += ["12 -- 34", "", None]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 2}", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontaminate", "mix_sources", "token_files"]
    ids = lambda df: sorted(x["doc_id"] for x in df.collect())
    told = stages["language"](spark, docs, str(tmp_path))
    assert ids(told) == list(range(60)) and told.columns == docs.columns
    single = stages["near_duplicates"](spark, told, str(tmp_path))
    assert ids(single) == [i for i in range(60) if i != 7]
    clean = stages["decontaminate"](spark, single, str(tmp_path))
    assert ids(clean) == [i for i in range(60) if i not in (7, 9)]
    mixed = stages["mix_sources"](spark, clean, str(tmp_path))
    assert set(ids(mixed)) <= set(ids(clean)) and mixed.columns == docs.columns
    tokens = stages["token_files"](spark, mixed, str(tmp_path))
    assert ids(tokens) == ids(mixed)
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(mixed)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages_against_plain_python(spark, tmp_path):
    """Near copies, repeated rows, null ids, benchmark passages and clean documents, stage by stage."""
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(400)]
    texts = [" ".join(r.choices(words, k=r.randrange(40, 90))) for _ in range(50)]
    for i in range(0, 20, 2):  # a word changed in the middle, or none
        w = texts[i].split()
        w[len(w) // 2] = r.choice([w[len(w) // 2], "Changed"])
        texts[i + 1] = " ".join(w)
    passage = " ".join(r.choices(words, k=12))
    texts[30] += " " + passage.upper()
    rows = [(i, t, "en", f"src{i % 3}", i) for i, t in enumerate(texts)]
    rows += [rows[4], rows[25], rows[25], (None, "an id is missing here", "en", "src1", 7), (77, "\u4e2d\u6587", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(1, passage), (None, texts[35]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    listed = lambda df: sorted((x["doc_id"] is not None, x["doc_id"] or 0, x["text"]) for x in df.collect())
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [lower(t).split()] for i in range(max(1, len(w) - 4))}

    kept = []
    for i, t, *_ in sorted(set((r[0], r[1]) for r in rows if r[0] is not None)):
        kept.append((i, t))
    label = {i: i for i, _ in kept}
    for i, t in kept:
        for j, u in kept:
            if i < j and len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(t) | shingles(u)):
                label[j] = min(label[j], label[i])
    want = sorted([(True, i, t) for i, t in kept if label[i] == i] + [(False, 0, "an id is missing here")])
    single = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert listed(single) == want and single.columns == docs.columns

    clean = stages["decontaminate"](spark, single, str(tmp_path))
    assert listed(clean) == [x for x in want if x[1] != 30]
    mixed = stages["mix_sources"](spark, clean, str(tmp_path))
    mixed.write.parquet(f"{tmp_path}/mixed")
    stored = spark.read.parquet(f"{tmp_path}/mixed")
    tokens = stages["token_files"](spark, stored, str(tmp_path)).orderBy("start").collect()
    assert sorted(str(t["doc_id"]) for t in tokens) == sorted(str(x["doc_id"]) for x in stored.collect())
    order = [x["doc_id"] for x in stored.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert [t["doc_id"] for t in tokens] == order != sorted(order, key=lambda d: d or 0)


def test_stages_of_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    # without labels nothing is learned, and what has a letter stays
    some = spark.createDataFrame([(1, "abc", None, None, 3), (2, "12", None, None, 2), (3, None, None, None, None)], docs.schema)
    assert [r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, some, str(tmp_path)).collect()] == [1]
