"""The training-data operators against brute force, round trips and planted cases.

The fixture has null and empty texts, a null doc_id, a repeated row, exact and near
copies, texts without letters, a long text, and columns whose names the operators use
inside themselves.
"""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import context_tree, decontaminate, language, licenses, main_text, media, mixing, near_dup, repeats, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark long, bands string, key string, _w string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def made(seed=1):
    r = random.Random(seed)
    en, fr = ["the", "and", "thing", "with", "Other", "small", "house"], ["le", "une", "était", "maison", "Petit", "chose", "avec"]
    texts = [(" ".join(r.choices(w, k=r.randrange(5, 60))) + r.choice([".", "\n", ""]), lang) for _ in range(20) for w, lang in ((en, "en"), (fr, "fr"))]
    base = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(150))
    near = base.split()
    near[70] = "changed"
    texts += [(base, "en"), (base, "en"), (" ".join(near), "en"), ("Tail x. " + base + " Ende", "en"), (None, "en"), ("", None), ("12 34 !!", "en"), ("Ä\x00b <|endoftext|> c  d", None), ("abc " * 3000, "fr")]
    rows = [(i, t, lang, ["src0", "s1", None][i % 3], None, 7, "x", "k", "w") for i, (t, lang) in enumerate(texts)]
    return [*rows, (None, "no id here at all", "en", "s1", None, 7, "x", "k", "w"), rows[3]]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_media_round_trip(docs, rows, empty):
    got = counted(media.features(media.stored(docs)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        padded = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        want[doc_id, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])] += 1
    assert got == want
    assert media.features(media.stored(empty)).count() == 0
    copies = media.features(media.stored(docs.filter("doc_id in (40, 41)"))).select("media_sha256", "feature").distinct()
    assert copies.count() == 1


def test_media_feature_of_several_images(spark):
    head = "a" * (media.TILE_ROWS * 192)
    docs = spark.createDataFrame([(1, head + "b" * 500_000), (2, head + "~" * 900_000)], "doc_id long, text string")
    a, b = media.features(media.stored(docs)).orderBy("doc_id").collect()
    assert a["n_images"] > 1 and a["feature"] != b["feature"]
    assert int(a["feature"].split(":")[0].split("x")[1]) * int(a["feature"].split("x")[0]) >= 64 * len(head)


def test_media_reads_other_jpegs():
    """Two components, AC coefficients, no restarts: written bit by bit here."""
    codes = {0: "00", 3: "01", 5: "10"}
    bits = ""
    for _ in range(2):  # two units: luminance differences 5 and -4 with one AC value, chroma 0
        for size, extra, ac in ((3, "101" if not bits else "011", True), (0, "", False)):
            bits += codes[size] + extra + ("10" + "1" if ac else "") + "0"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    dht = lambda kind, lengths, symbols: media._segment(0xC4, bytes([kind, *lengths, *symbols]))
    two = [0, 3] + [0] * 14
    data = b"\xff\xd8" + media._segment(0xDB, bytes([0, 8, *[1] * 63])) + media._segment(0xC0, bytes([8, 0, 8, 0, 16, 2, 1, 0x11, 0, 2, 0x11, 0]))
    data += dht(0, two, [0, 3, 5]) + dht(0x10, [1, 1] + [0] * 14, [0, 1]) + media._segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    ((image, thumb),) = media.thumbnails([data])[0]
    assert (image["width"], image["height"]) == (16, 8) and thumb.tolist() == [[133, 129]]
    with pytest.raises(ValueError):
        media.thumbnails([b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00\xff\xd9"])


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, empty, k):
    sets = [(r[0], shingles(r[1], k)) for r in rows]
    label = {d: d for d, _ in sets if d is not None}
    for _ in range(len(sets)):
        for d, x in sets:
            for e, y in sets:
                if d is not None and e is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[d] = label[e] = min(label[d], label[e])
        break
    for d in sorted(label):
        while label[label[d]] != label[d]:
            label[d] = label[label[d]]
    want = collections.Counter((d, len(x), label.get(d), d is None or label[d] == d) for d, x in sets)
    assert counted(near_dup.near_duplicates(docs, k=k), "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_dup.near_duplicates(empty, k=k).count() == 0


def test_near_duplicates_of_many_variants(spark):
    """A chain and a crowd of near copies: one component each, whatever the representatives."""
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(400)]
    texts = []
    for i in range(60):  # each near copy differs from its base in up to 12 places
        w = words[:]
        for _ in range(r.randrange(12)):
            w[r.randrange(400)] = f"x{r.random()}"
        texts.append(" ".join(w))
    chain = [" ".join(f"c{j}" for j in range(20 * i, 20 * i + 400)) for i in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + chain)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, k=2).collect()}
    assert set(got.values()) == {0, 60}


def test_near_duplicates_find_links_just_above_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85, none of which shares words with another, and pairs just below."""
    r = random.Random(17)
    rows, want = [], {}
    for i in range(400):
        words = [f"{i}x{r.random()}" for _ in range(r.randrange(60, 160))]
        other = list(words)
        while True:
            other[r.randrange(1, len(words) - 1)] = f"{i}y{r.random()}"
            x, y = shingles(" ".join(words), 2), shingles(" ".join(other), 2)
            share = len(x & y) / len(x | y)
            if share < 0.85:
                break
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        want[2 * i], want[2 * i + 1] = 2 * i, 2 * i if share >= 0.8 else 2 * i + 1
    assert sum(want[2 * i + 1] == 2 * i for i in range(400)) > 300
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == want


def test_main_text(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class='cookie'>We use cookies.</div><article><h1>Head &amp; line</h1><p>One\n two.<p>Three.</p><aside class=ad>Buy this now!</aside></article><form>Mail me</form><div id=comments><p>Nice!</p></div><footer>&copy; x</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>"), (1, "u", page)], "page_id long, url string, html string")
    got = sorted((r["url"] or "", r["text"], r["n_chars"]) for r in main_text.main_text(pages).collect())
    want = "Head & line\n\nOne two.\n\nThree."
    assert got == sorted([("u", want, len(want)), ("u", want, len(want)), ("", "", 0), ("v", "", 0), ("w", "", 0)])
    deep = "<div>" * 3000 + "x"
    assert main_text.Model(60).extract([deep])[0] in ([], ["x"])


def test_main_text_of_empty_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>One", "x", 5, "y")], "page_id long, url string, html string, text string, n_chars long, n_blocks string")
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in main_text.main_text(pages).collect()] == [(1, "One", 3)]
    assert main_text.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html, want", [
    ("<article><p>One</p><svg class=i /><p>Two</p></article>", "One Two"), ("<p>One<svg><path d='x'><p>Two<svg>x</svg>", "One Two"), ("<p>One</p><button-group><p>Two</p>", "One Two"),
    ("<html><head><title>T</title><meta name=x><body><p>One", "One"), ("<head><title>T</title><p>One", "One"), ("<head><title>T</title></head><p>One", "One"), ("<p>One</p><button><p>Two", "One Two"),
    ("<p>One</p><button>x</button><p>Two", "One Two"), ("<p>One</p><script>x<p>Two", "One"), ("<p>One</p><svg><g>x</g></svg><p>Two", "One Two"), ("<p>One</p><script src=x", "One"),
])
def test_main_text_reads_on_after_elements_without_end(html, want):
    assert " ".join(t for _, t in main_text.Page(html).blocks) == want


def test_main_text_on_held_out_pages():
    model, right, both = main_text.Model(), 0, 0
    for seed in range(9000, 9060):
        page, inside = main_text.labels(main_text.training_page(seed))
        keep = main_text.decode(page, model.trees.odds(main_text.features(page, model.token_odds)))
        right += 2 * sum(len(t) for o, t in page.blocks if keep[o] and inside[o])
        both += sum(len(t) for o, t in page.blocks if keep[o]) + sum(len(t) for o, t in page.blocks if inside[o])
    assert right / both > 0.97


def ctw(train, text):
    """Sequential context-tree weighting by dictionaries, from the definition."""
    count, depth = collections.defaultdict(lambda: [0, 0]), context_tree.DEPTH

    def decisions(t):
        data = bytes([255]) * depth + lower(t).encode() + b"\xff"
        for i in range(depth, len(data)):
            for b in range(8):
                yield data[i - depth : i], (1 << b) | (data[i] >> (8 - b)), (data[i] >> (7 - b)) & 1

    for t in train:
        for c, p, bit in decisions(t):
            for d in range(depth + 1):
                count[c[depth - d :], p][bit] += 1
    children = collections.defaultdict(set)
    for c, p in count:
        if c:
            children[c[1:], p].add(c)
    memo = {}

    def logs(c, p):
        if (c, p) not in memo:
            a, b = count[c, p] if (c, p) in count else (0, 0)
            kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            below = sum(logs(x, p)[1] for x in children[c, p]) if len(c) < depth else None
            memo[c, p] = kt, kt if below is None else math.log(0.5) + np.logaddexp(kt, below)
        return memo[c, p]

    total = 0.0
    for c, p, bit in decisions(text):
        chance, rest = 0.0, 1.0
        for d in range(depth + 1):
            s = c[depth - d :]
            a, b = count[s, p] if (s, p) in count else (0, 0)
            kt, weighted = logs(s, p)
            share = 1.0 if d == depth else math.exp(math.log(0.5) + kt - weighted)
            chance += rest * share * ((b if bit else a) + 0.5) / (a + b + 1)
            rest *= 1 - share
        total += math.log10(chance)
    return total


@pytest.mark.parametrize("frequent", [1 << 20, 40])
def test_context_tree(docs, rows, frequent):
    apart = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\0end"]
    train = [r[1] or "" for r in rows if not apart(r[0])]
    c = collections.Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    got = collections.defaultdict(list)
    for r in context_tree.scored(docs, language.held_out(7, 2), frequent).collect():
        got[r["doc_id"]].append(r)
    for i, (doc_id, text, *_) in enumerate(rows):
        g = got[doc_id][0]
        w = words(text)
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (apart(doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        if i in (2, 3, 44, 47):
            assert g["score"] == pytest.approx(ctw(train, text), rel=1e-6)
    assert len(got[3]) == 2


def test_context_tree_learns_from_five_bytes_before(spark):
    apart = [d for d in range(900) if zlib.crc32(str(d).encode()) % 7 == 2]
    rows = [(d, ("1----x", "2----y")[i % 2]) for i, d in enumerate(x for x in range(240) if x not in apart)] + [(apart[0], "1----x"), (apart[1], "1----y")]
    got = {r["doc_id"]: r["score"] for r in context_tree.scored(spark.createDataFrame(rows, "doc_id long, text string"), language.held_out(7, 2)).collect()}
    assert got[apart[0]] > got[apart[1]] + 1


def test_context_tree_empty(empty):
    assert context_tree.scored(empty, language.held_out(7, 2)).count() == 0


def test_decontaminate(spark, docs, rows, empty):
    texts = [r[1] or "" for r in rows]
    items = [(1, texts[40][60:200]), (2, "Small house"), (3, None), (4, "..."), (5, " ".join(texts[2].split()[:15]).upper()), (None, "the and"), (6, texts[40][60:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        want[doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for marked, broadcast in ((decontaminate.MARKED, decontaminate.BROADCAST_BYTES), (decontaminate.MARKED, 0), (3, 0), (0, 1 << 20)):
        assert counted(decontaminate.contamination(docs, bench, marked, broadcast), *columns) == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_language(docs, rows, empty):
    got = collections.defaultdict(list)
    for r in language.predicted(docs, language.fit(docs, ~language.held_out(4, 2))).collect():
        got[r["doc_id"]].append(r)
    assert all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)
    for doc_id, text, lang, *_ in rows[:40]:
        assert got[doc_id][0]["lang_pred"] == lang
    for i in (44, 45, 46):
        assert got[i][0]["lang_pred"] == "und" and got[i][0]["score"] == 0
    assert not any(r["told"] for i in (44, 45, 46) for r in got[i]) and all(r["told"] for i in range(40) for r in got[i])
    assert language.predicted(empty, language.fit(empty, F.lit(True))).count() == 0
    assert {r["lang_pred"] for r in language.predicted(docs, language.fit(empty, F.lit(True))).collect()} == {"und"}


def test_language_tells_strange_texts(spark):
    """Texts of two made-up languages: of those not learned from nearly all are told; other words, scripts, code and tables of numbers are not."""
    rng = random.Random(3)
    parts = {"aa": ["lo", "mi", "ta", "ren", "sol", "ka"], "bb": ["ix", "ur", "gle", "ops", "and", "ef"]}

    def text(lang):
        return " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(2, 120)))

    rows = [(i, text(lang), lang) for i in range(400) for lang in ["aa" if i % 2 else "bb"]]
    strange = ["これは日本語の文章です。川は夜の間にゆっくりと増水しました。", "Река медленно поднималась ночью, и к утру поля были под водой.", "De rivier steeg die nacht langzaam en tegen de ochtend stonden de velden onder water.", "x 12.5 33.1 44.0 55.2 18.3 99.1 12 7 4 y 5 6 7 8 9", "def f(x):\n    for i in range(10):\n        if x[i] > 0: return x[i] + self.y"]
    learned = spark.createDataFrame(rows[:300], "doc_id long, text string, lang string")
    asked = spark.createDataFrame(rows[300:] + [(1000 + i, t, None) for i, t in enumerate(strange)] + [(2000, "mi", None), (2001, rows[0][1].upper(), None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["told"] for r in language.predicted(asked, language.fit(learned, F.lit(True))).collect()}
    assert sum(not got[i] for i in range(300, 400)) <= 1 and got[2000] and got[2001]
    assert not any(got[1000 + i] for i in range(len(strange)))


def test_language_of_many_labels_and_of_none(spark):
    """Every label is learned, also the 201st; and a text in a script that none of them uses is told by none."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    r = random.Random(4)
    rows = []
    for k in range(230):
        own = r.sample([x + y + z for x in alphabet[k % 26] for y in alphabet for z in alphabet], 30)
        rows += [(10 * k + i, " ".join(r.choices(own, k=25)), f"l{k:03}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("doc_id") % 10 < 3)
    assert len(model.names) == 230
    got = language.predicted(docs.filter("doc_id % 10 = 3"), model).collect()
    assert sum(rows[4 * (g["doc_id"] // 10)][2] == g["lang_pred"] for g in got) > 200
    other = language.predicted(spark.createDataFrame([(1, "и в не на что он как это по но", None)], "doc_id long, text string, lang string"), model).first()
    assert not other["told"] and other["lang_pred"] in model.names


def test_repeats(docs, rows, empty):
    data = [(r[1] or "").encode() for r in rows]
    for length, shared, q in ((400, 240, 140), (40, 28, 17), (40, 40, 20)):
        times = lambda k: collections.Counter(d[i : i + k] for d in data for i in range(len(d) - k + 1))
        seen, passages, anchors = times(length), times(shared), times(q)
        got = repeats.without_repeats(docs, length, shared, q)
        want = collections.Counter()
        most, some = collections.defaultdict(list), collections.defaultdict(list)
        for (doc_id, *_), d in zip(rows, data, strict=True):
            gone, near = np.zeros(len(d), bool), np.zeros(len(d), bool)
            for i in range(len(d) - length + 1):
                if seen[d[i : i + length]] > 1:
                    gone[i : i + length] = True
            for i in range(len(d) - q + 1):
                if anchors[d[i : i + q]] > 1:
                    near[i : i + q] = True
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            want[doc_id, len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()] += 1
            most[doc_id].append(int(near.sum()))
            some[doc_id].append(any(passages[d[i : i + shared]] > 1 for i in range(len(d) - shared + 1)))
        assert counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
        for r in got.collect():
            assert r["n_shared"] <= max(most[r["doc_id"]]) and (r["n_shared"] >= q or not any(some[r["doc_id"]]))
    assert repeats.without_repeats(empty).count() == 0


def test_repeats_of_passages_too_short_for_a_window(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (51, 60, 75, 120)]
    planted = [(4 * i + k, f"{text(40)} {p} {text(40)}") for i, p in enumerate(passages) for k in range(4)]
    docs = spark.createDataFrame(planted + [(100 + i, text(150)) for i in range(20)], "doc_id long, text string")
    for row in repeats.without_repeats(docs).collect():
        size = len(passages[row["doc_id"] // 4]) if row["doc_id"] < 100 else 0
        assert (row["n_shared"] > 0) == (row["doc_id"] < 100) and (row["n_removed"] > 0) == (size >= 398)
        assert row["n_removed"] in ((0,) if size < 398 else range(size, size + 8))


def test_licenses(spark, docs):
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "A driver has a license.", "the apache license plate fell off", None, ""]
    planted = spark.createDataFrame([(100 + i, t and f"some words\n{t}\nmore words") for i, t in enumerate(lines)], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(planted)
    model, least = licenses.fit(every)
    got = {r["doc_id"]: r["family"] for r in licenses.scan(every, model, least).collect()}
    assert got == {100: "MIT", 101: "Apache-2.0", 102: "CC-BY-NC", 103: "GPL"}
    # the classifier's own numbers by hand for one paragraph
    row = model.transform(licenses.hashed(spark.createDataFrame([(lines[0],)], "paragraph string"))).first()
    margin = model.coefficientMatrix.toArray()[:, row["features"].indices].sum(axis=1) + model.interceptVector.toArray()
    assert row["probability"].toArray() == pytest.approx(np.exp(margin - margin.max()) / np.exp(margin - margin.max()).sum())


def test_licenses_in_wrapped_notices_tags_and_headings(spark, docs):
    gpl = "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License as published by the Free Software Foundation."
    bsd = "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions\n// are met:"
    isc = "/*\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted.\n */"
    texts = {"GPL": gpl, "BSD": bsd, "ISC": isc, "MIT": "MIT License", "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0", "": "We chose\nthe MIT license\nas it is short.\n\nApache"}
    planted = spark.createDataFrame([(200 + i, f"some words\n\n{t}\n\nmore words") for i, t in enumerate(texts.values())], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(planted)
    got = collections.Counter((r["doc_id"], r["family"]) for r in licenses.scan(every, *licenses.fit(every)).collect())
    assert got == {(200 + i, f): 1 for i, f in enumerate(texts) if f}


def plain_notices(spark, rows, model, least):
    """(doc_id, block, at, family) by loops; the classifier's probabilities are its own."""
    candidates = []
    for doc_id, text in rows:
        clean = re.sub(licenses.MARKS, "", re.sub(licenses.CLOSING, "", text or ""))
        for b, block in enumerate(re.split(r"\n[\x00-\x20]*\n", clean)):
            lines = [x for x in block.split("\n") if re.search(r"[^\x00-\x20]", x)]
            candidates += [(doc_id, b, k, x) for k, x in enumerate(lines)] + [(doc_id, b, -1, " ".join(lines))] * (len(lines) > 1)
    given = licenses.hashed(spark.createDataFrame([(i, c[3]) for i, c in enumerate(candidates)], "i long, paragraph string"))
    chance = {r["i"]: r["probability"].toArray() for r in model.transform(given).select("i", "probability").collect()}
    names, found = ["unknown", *sorted(licenses.TEMPLATES)], set()
    for i, (doc_id, b, at, text) in enumerate(candidates):
        best = chance[i][1:].max()
        family = names[list(chance[i]).index(best)]
        words = [w for w in re.split(r"[\x00-\x2D\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"\.(?![0-9])", " ", text.lower())) if w]
        pairs, covered = {f"{x} {y}" for x, y in zip(words, words[1:], strict=False)}, 0.0
        for template in licenses.TEMPLATES[family]:
            w = template.replace("-", " ").split()
            own = {f"{x} {y}" for x, y in zip(w, w[1:], strict=False)} or set(w)
            share = len(own & pairs) / len(own)
            if template == "all rights reserved" and not (re.search(r"(?i)all rights reserved([.;!]|[\W_]*$)", text) or re.search(r"(?i)copyright|\(c\)|©", text)):
                share = 0.0
            covered = max(covered, share if share == 1 or not template.startswith("spdx ") else 0.0)
        line, small = " ".join(words), [w for w in re.findall(r"[^\W_]+", text) if w[0].islower() and w not in ("version", "of", "and")]
        if (at <= 0 or not small) and line in licenses.HEADINGS.get(family, []):
            covered = 1.0
        if re.match(r"(?i)[^a-z]*licen[sc]e[\"']?[ \t]*[:=]", text) and family in licenses.FIELD_WORDS and re.search(licenses.FIELD_WORDS[family], line):
            covered = 1.0
        if family.startswith("CC-BY"):
            marks = {m for m, p in licenses.MARKED.items() if re.search(p, line)}
            covered = covered if marks == set(family.split("-")[2:]) else 0.0
        if best >= least and covered >= licenses.COVERED:
            found.add((doc_id, b, at, family))
    return found


def wrapped(text, width, mark):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join(f"{mark}{x}" for x in [*out, line])


def test_licenses_of_all_families_against_loops(spark, rows):
    """Every template and heading, wrapped and behind comment marks, among all texts of the fixture."""
    r = random.Random(13)
    planted, plain = [], [(d, t) for d, t, *_ in rows if d is not None]
    for family, templates in sorted(licenses.TEMPLATES.items()):
        for t in templates:
            planted.append((1000 + len(planted), family, "Some words come first.\n\n" + wrapped(t if t.startswith("spdx") else t.capitalize() + ".", r.choice([40, 60, 76]), r.choice(["", "# ", "// ", " * "])) + "\n\nOther words follow."))
    every = spark.createDataFrame(plain + [(i, t) for i, _, t in planted], "doc_id long, text string")
    model, least = licenses.fit(every)
    got = {(x["doc_id"], x["block"], x["at"], x["family"]) for x in licenses.scan(every, model, least).collect()}
    assert got == plain_notices(spark, [(x["doc_id"], x["text"]) for x in every.collect()], model, least)
    assert not any(d < 1000 for d, *_ in got)
    right = sum(any(d == i and f == family for d, _, _, f in got) for i, family, _ in planted)
    assert right >= 0.9 * len(planted)


NOTICES = [
    ("MIT", "widget\nMIT License\nCopyright (c) 2020 A. Nobody"), ("MIT", '"license": "MIT",'), ("Apache-2.0", "License: Apache-2.0"), ("MIT", "License :: OSI Approved :: MIT License"), ("Apache-2.0", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("GPL", "license = 'GPL-3.0-or-later'"), ("BSD", "License: BSD-3-Clause"), ("CC-BY-NC-SA", "This work is licensed under CC BY-NC-SA 4.0."), ("CC-BY-ND", "This work is licensed under CC BY-ND 4.0."), ("CC-BY-NC", "Text licensed under CC BY-NC 4.0"),
    ("CC-BY-SA", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("CC-BY-NC-SA", "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."), ("CC-BY", "This page is licensed under CC BY 4.0."),
    ("Boost", "Distributed under the Boost Software License, Version 1.0."), ("Zlib", "Altered source versions must be plainly marked as such, and must not be\nmisrepresented as being the original software."), ("WTFPL", "Licensed under the WTFPL."),
    ("Proprietary", "Copyright 2019 Acme Inc. All rights reserved."), ("Proprietary", "All rights reserved."), ("GPL", "License :: OSI Approved :: GNU General Public License v3 (GPLv3)"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."),
    ("LGPL", "licensed under the GNU Lesser General Public License"), ("AGPL", "Licensed under the GNU Affero General Public License v3"), ("Unlicense", "This is free and unencumbered software released into the public domain."), ("ISC", "License: ISC"), ("CC0", "Released under CC0 1.0 Universal"),
    ("EPL", "made available under the terms of the Eclipse Public License 2.0"), ("MIT", "The project is MIT licensed."), ("Apache-2.0", "some title\nApache License, Version 2.0\nother words"),
]
CLEAN = [
    "All rights reserved seats were sold before noon.", "We chose\nthe MIT license\nas it is short.", "The license: a story of two drivers.", "The boost to software sales was public.", "License: to be decided", "She altered the source of the river.", "They apply for a fishing licence.",
    "The MIT students wrote about a public domain.", "Attribution is due to the creative team of the commons.",
]


def test_license_recall_and_false_alarms(spark, docs):
    planted = [(300 + i, f"some words\n\n{t}\n\nmore words") for i, (_, t) in enumerate(NOTICES)] + [(400 + i, f"some words\n\n{t}\n\nmore words") for i, t in enumerate(CLEAN)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = collections.defaultdict(set)
    for r in licenses.scan(every, *licenses.fit(every)).collect():
        got[r["doc_id"]].add(r["family"])
    missed = [(f, t, got[300 + i]) for i, (f, t) in enumerate(NOTICES) if got[300 + i] != {f}]
    print(missed)
    assert len(missed) <= 0.1 * len(NOTICES)
    assert not [t for i, t in enumerate(CLEAN) if got[400 + i]]


def test_license_query(spark, tmp_path):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "nothing"), (None, "Licensed under the Apache License, Version 2.0."), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r["doc_id"], r["n_notices"], r["families"], r["licensed"]) for r in licenses.op8_licenses(spark, str(tmp_path)).collect())
    assert got == {(1, 1, "MIT", True): 2, (1, 0, "", False): 1, (None, 1, "Apache-2.0", True): 1, (2, 0, "", False): 1, (3, 0, "", False): 1}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert licenses.op8_licenses(spark, f"{tmp_path}/none").count() == 0


def test_license_background_is_all_documents(spark):
    """Each of 600 documents adds its ordinary paragraph to the fit; near notices and paragraphs that nothing could confirm add none."""
    texts = [(i, f"The bar lost the license of zorgle{i} again.") for i in range(600)] + [(600, "Released under the MIT License."), (601, "Nothing to see.")]
    every = spark.createDataFrame(texts, "doc_id long, text string")
    model, least = licenses.fit(every)
    words = licenses.hashed(spark.createDataFrame([(f"zorgle{i}",) for i in range(600)], "paragraph string")).collect()
    weights = model.coefficientMatrix.toArray()[0]
    assert sum(weights[r["features"].indices[0]] == 0 for r in words) == 0 and 0.5 <= least < 1
    got = licenses.background(licenses.candidates(every)).collect()
    assert {r["paragraph"] for r in got} == {f"the bar lost the license of zorgle{i} again" for i in range(600)} and {r["fold"] for r in got} == {0, 1}


def test_license_anchors_lose_no_template():
    for t in [t for ts in licenses.TEMPLATES.values() for t in ts]:
        pairs = set(licenses._template_pairs(t))
        assert sum(any(a in p for a in licenses.ANCHORS) for p in pairs) > (1 - licenses.COVERED) * len(pairs), t
    assert all(any(a in t for a in licenses.ANCHORS) for ts in licenses.HEADINGS.values() for t in ts)


def test_token_files(docs, rows, empty):
    got = token_files.token_table(docs).orderBy("start").collect()
    path = token_files.default_tokenizer()
    tokenizer = token_files._loaded(path)[0]
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        want = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (at, len(want), want, zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert token_files.token_table(empty).count() == 0


def test_coder_round_trip():
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 5000, 70000):
        for ids in (rng.integers(0, 50257, n), rng.zipf(1.3, n) % 50257, np.full(n, 65535), np.arange(n) % 7):
            raw = ids.astype("<u2").tobytes()
            block = token_files.pack([5], [raw])
            assert token_files.unpack(block)[2].tobytes() == raw
    assert len(token_files.pack([5], [(np.arange(70000) % 7).astype("<u2").tobytes()])) < 30000
    with pytest.raises(ValueError, match="damaged"):
        token_files.unpack(block[:-1] + bytes([block[-1] ^ 1]))


def test_pieces_equal_whole_texts():
    path = token_files.default_tokenizer()
    tokenizer = token_files._loaded(path)[0]
    r = random.Random(6)
    parts = ["a", "B", " ", " ", "\n", "\t", "\r\n", "é", "×", "÷", "ß", "'s", "'", "'ll", "12", "½", "\xa0", "\x1c", "\x00", "日", "Ж", "ɿʀ", "\u0301", "—", "%", "<|endoftext|>", "...", "abcdefghijklmnopqrs"]
    texts = ["".join(r.choices(parts, k=r.randrange(0, 25))) for _ in range(4000)]
    ids, at = token_files.encoded(pa.array(texts), path)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_pieces_beyond_what_a_worker_keeps(monkeypatch):
    path = token_files.default_tokenizer()
    monkeypatch.setattr(token_files, "PIECES_KEPT", 64)
    monkeypatch.setattr(token_files, "LONG_KEPT", 3)
    monkeypatch.setattr(token_files, "_tokenizers", {})
    tokenizer, known = token_files._loaded(path)[0], token_files._loaded(path)[4]
    r = random.Random(7)
    for _ in range(12):
        texts = [" ".join("".join(r.choices("abcdeé", k=r.choice([2, 5, 20]))) for _ in range(r.randrange(0, 12))) for _ in range(30)]
        ids, at = token_files.encoded(pa.array([*texts, None]), path)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert 0 < known.count <= 64 and at[-1] == at[-2]


def test_mixing(docs, rows, empty):
    got = mixing.replicated(docs.drop("key"), weights={"src0": 3.0, "s1": 1.0}, total=4000.0)
    n = collections.Counter(r["source"] for r in got.collect())
    assert set(n) == {"src0", "s1"} and n["src0"] == pytest.approx(3000, rel=0.1) and n["s1"] == pytest.approx(1000, rel=0.15)
    assert got.columns[-3:] == ["copy", "n_copies", "shuffle_key"]
    keys = [r["shuffle_key"] for r in got.collect()]
    assert keys == sorted(keys)
    assert {r["doc_id"]: r["text"] for r in got.collect()}.items() <= {r[0]: r[1] for r in rows}.items()
    one = mixing.replicated(docs.select("doc_id", "source"))
    assert counted(one, *one.columns) == counted(mixing.replicated(docs.select("doc_id", "source").repartition(7)), *one.columns)
    heavy = mixing.replicated(docs.filter("doc_id = 1").select("doc_id", "source"), total=3000.0).count()
    assert heavy == pytest.approx(3000, rel=0.1)
    assert mixing.replicated(empty).count() == 0


def test_ascii_lower_touches_only_a_to_z(spark):
    from folioscope.llm.common import ascii_lower

    every = spark.range(1, 0x110000).filter("id < 55296 or id > 57343")
    other = every.select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c")).filter(ascii_lower(F.col("c")) != F.col("c"))
    assert sorted(r["id"] for r in other.collect()) == list(range(65, 91))
