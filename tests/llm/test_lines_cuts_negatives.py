"""Line dedup, fill-in-middle and hard negatives against plain Python, and the paths of large inputs forced on small ones."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from folioscope.llm import fill_in_middle, hard_negatives, line_dedup

SCHEMA = "doc_id long, text string, lang string, mark long, hi long, form string"
WHITE = " \t\n\x0b\x0c\r"


def made(seed=3):
    r = random.Random(seed)
    lines = ["  The same line HERE\t", "the same line here", "short", "ÄÖ ÜÄ ÖÜ Ä", "äö üä öü ä", "é" * 9, "É" * 10, "", "  keeps its space  ", "another line that repeats", "x" * 300, "AAAAAAAAAA", "aaaaaaaaaa"]
    rows = [(i, "\n".join(r.choice(lines) if r.random() < 0.7 else f"line {r.random()}" for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n"), (63, "The same line here\r\n" * 3000), (None, "the same line here\nno id, no repeat"), (64, "only twice\nonly TWICE "), (7, rows[7][1]), (8, "another line that repeats\nadded to 8"), (65, "a <P> here"), (66, "<S><M>")]
    return [(d, t, "en", 1, 2, "f") for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3).cache()


def counted(df, *names):
    return collections.Counter(tuple(r) for r in df.select(*names).collect())


LINES = ("doc_id", "n_lines", "n_dropped", "kept_sha256", "kept")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def without_lines(rows, known=None):
    """Counts of result rows, from the documents of ``known`` (all rows, if none are given)."""
    order = lambda d: float("inf") if d is None else d
    holders = collections.defaultdict(set)
    for d, t, *_ in rows if known is None else known:
        for line in (t or "").split("\n"):
            key = lower(line.strip(WHITE))
            if len(key) >= 10:
                holders[key].add(order(d))
    out = collections.Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(h := holders.get(lower(x.strip(WHITE)), ())) < 2 or min(h) >= order(d)]
        text = "\n".join(keep)
        out[d, len(lines), len(lines) - len(keep), hashlib.sha256(text.encode()).hexdigest(), text] += 1
    return out


def test_line_dedup(spark, docs):
    index = line_dedup.added(line_dedup.empty(spark), docs)
    want = without_lines(made())
    assert counted(line_dedup.deduplicated(index, docs), *LINES) == want
    assert sum(n for r, n in want.items() if r[2]) > 30
    nothing = docs.filter("false")
    assert line_dedup.deduplicated(index, nothing).count() == 0
    assert counted(line_dedup.deduplicated(line_dedup.added(line_dedup.empty(spark), nothing), docs), *LINES) == without_lines(made(), [])


@pytest.mark.parametrize("large", [{"SIEVE_BYTES": -1}, {"HOT_ROWS": 1, "HOT_KEYS": 1 << 30}, {"SHARD_KEYS": 1}, {"SIEVE_BYTES": -1, "HOT_ROWS": 3, "HOT_KEYS": 1 << 30, "SHARD_KEYS": 2}])
def test_line_dedup_of_large_inputs(spark, docs, monkeypatch, large):
    """Filters too large for a broadcast, hot keys and many shards give the same rows."""
    for name, value in large.items():
        monkeypatch.setattr(line_dedup, name, value)
    index = line_dedup.added(line_dedup.empty(spark), docs)
    assert ("SHARD_KEYS" in large) == (index.shards > 1)
    assert bool(line_dedup.sieve(index).hot) == ("HOT_ROWS" in large)
    assert counted(line_dedup.deduplicated(index, docs), *LINES) == without_lines(made())


def test_line_dedup_can_be_undone(spark, docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    rows = made()
    part = lambda test: docs.filter(test)
    index = line_dedup.added(line_dedup.empty(spark), part("doc_id % 3 = 0"))
    before = {tuple(r) for r in index.refs.collect()}
    index = line_dedup.added(index, part("doc_id % 3 <> 0 or doc_id is null"))
    assert counted(line_dedup.deduplicated(index, docs), *LINES) == without_lines(rows)
    # the first holders of most lines go, and the lines come back in others
    gone = [0, 1, 2, 3, None]
    less = line_dedup.removed(index, spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    rest = [r for r in rows if r[0] not in gone]
    assert counted(line_dedup.deduplicated(less, docs.filter("doc_id > 3")), *LINES) == without_lines(rest)
    # and without all that was added the index is what it was
    again = line_dedup.removed(index, docs.filter("doc_id % 3 <> 0 or doc_id is null").select("doc_id"))
    assert {tuple(r) for r in again.refs.collect()} == before
    assert counted(again.postings, "hi", "lo", "doc_id") == counted(line_dedup.added(line_dedup.empty(spark), part("doc_id % 3 = 0")).postings, "hi", "lo", "doc_id")
    known = line_dedup.sieve(again)
    some = again.refs.filter("first <> last").collect()
    assert known.hits(np.array([r["hi"] for r in some]), np.array([r["lo"] for r in some])).all()
    everything = line_dedup.removed(index, docs.select("doc_id"))
    assert everything.refs.count() == 0 and all(not any(r["cells"]) for r in everything.filters.collect())


def test_cuckoo_filter():
    keys = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 14_000, dtype=np.int64)
    keys[33:40] = keys[33] & ~0xFFF  # one bucket and one fingerprint: both buckets have eight places for them
    keys[33:40] += np.arange(7) << 20
    cuckoo = line_dedup.Cuckoo()
    cuckoo.insert(keys[3:9_000])
    cuckoo.insert(keys[9_000:])
    assert cuckoo.contains(keys[3:]).all()
    other = np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 100_000, dtype=np.int64)
    assert cuckoo.contains(other).mean() < 1e-3
    cuckoo.remove(keys[40:7_000])
    assert cuckoo.contains(keys[7_000:]).all() and cuckoo.contains(keys[40:7_000]).mean() < 1e-2
    cuckoo.remove(np.concatenate([keys[3:40], keys[7_000:]]))
    assert not cuckoo.table.any()
    with pytest.raises(ValueError):
        cuckoo.insert(np.random.default_rng(7).integers(0, 2**62, 20_000, dtype=np.int64))


def formed(d, t):
    t = t or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    size = (None, None) if form == "plain" else (len(p), len(m))
    return d, len(units), form, *size, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), out


CUTS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")


def test_fill_in_middle(spark):
    r = random.Random(2)
    texts = ["".join(r.choices(["word", "Ab", "é", "日本", "😀", " ", "\n", "1", "<", "S>", "P"], k=r.randrange(0, 200))) for _ in range(300)]
    rows = [(k, t, "en", 1, 2, "f") for k, t in enumerate(texts)] + made() + [(900, "ab" * 2_500_000 + " é" * 500_000, "en", 1, 2, "f")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = counted(fill_in_middle.transformed(docs), *CUTS)
    assert got == collections.Counter(formed(d, t) for d, t, *_ in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert "output" not in fill_in_middle.transformed(docs.filter("false"), texts=False).columns
    assert fill_in_middle.transformed(docs.filter("false")).count() == 0


def test_rank_and_select():
    draw = np.random.default_rng(3)
    for size in (0, 1, 511, 512, 513, 5_000):
        for share in (0.0, 0.01, 0.5, 1.0):
            plain = draw.random(size) < share
            bits = fill_in_middle.Bits(plain)
            assert bits.rank(np.arange(size + 1)).tolist() == np.concatenate([[0], np.cumsum(plain)]).tolist()
            if plain.any():
                assert bits.select(np.arange(plain.sum())).tolist() == np.flatnonzero(plain).tolist()


def test_outputs_are_rebuilt_across_cuts():
    for text in (b"<<P", b"P><S", b"<S" * 3, b"<P<S<M>"[:5]):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for form in ("plain", "psm", "spm"):
                    assert fill_in_middle.rebuilt(form, fill_in_middle.arranged(form, text[:a], text[a:b], text[b:])) == text


VECTORS = "vec_id long, embedding array<float>, label int, norm double, g long, kind string"


def vectors(seed=4, n=1200, dims=7):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(4, dims))
    rows = []
    for k in range(n):
        label = int(draw.integers(3)) if k % 3 else 9  # a third has one label
        v = centre[label % 4] + draw.normal(size=dims) * 0.7
        rows.append((k, [float(x) for x in np.round(v, 1)], label))  # rounded: many ties
    same = rows[300][1]
    rows = [(k, same if k % 4 == 1 else v, label) for k, v, label in rows]  # one vector holds a quarter
    rows += [(100, [float("nan")] * dims, 1), (200, None, 1), (-100, [0.5] * dims, 2), (-7, [0.25] * (dims - 3), 1), (-8, [], 2), (-9, [1.0, None], 2), (-10, [float("inf")] * dims, 2), (-11, [1.0] * dims, None), (None, [1.0] * dims, 1), (-12, [3e38] * dims, 1)]
    rows += [rows[400], (500, [9.0] * dims, 9)]
    return [(*r, 0.0, 5, "k") for r in rows]


def mined(rows, limit=1 << 26):
    kept = {}
    for k, v, label, *_ in rows:
        if k is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = int(np.fmod(label + 1, 10)) if k % 7 == 0 else label
        q = [max(-limit, min(limit, int(np.floor(256.0 * float(np.float32(x)))))) for x in v]
        kept[k] = min(kept.get(k, (label, q)), (label, q))
    out = []
    for a, (label, q) in kept.items():
        if a % 100:
            continue
        score = {k: sum(x * y for x, y in zip(q, w)) for k, (_, w) in kept.items() if k != a}  # noqa: B905
        ranked = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in ranked if kept[k][0] == label][:5]:
            fit = [k for k in ranked if kept[k][0] != label and 30 * score[p] <= 100 * score[k] <= 90 * score[p]][:10]
            out += [(a, p, rank, k, score[p], score[k]) for rank, k in enumerate(fit, 1)]
    return collections.Counter(out)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("block", [8 << 20, 4000])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    df = spark.createDataFrame(vectors(), VECTORS)
    got = hard_negatives.hard_negatives(df)
    want = mined(vectors())
    assert counted(got, *NEGATIVES) == want and len(want) > 300
    assert dict(got.dtypes)["rank"] == "int"
    assert hard_negatives.hard_negatives(df.filter("false")).count() == 0
    assert hard_negatives.hard_negatives(df.filter("vec_id = 300")).count() == 0


def test_bounds_hold_and_sift(spark):
    rows = [r for r in vectors(dims=16) if r[1] and len(r[1]) == 16 and r[0] is not None and r[0] >= 0 and r[2] is not None and np.isfinite(r[1]).all()]
    df = hard_negatives.quantised(spark.createDataFrame(rows, VECTORS))
    books = hard_negatives.fitted(df, 16)
    index = hard_negatives.encoded(df, books, 16).toArrow()
    v = np.array(index["v"].to_pylist())
    codes = np.frombuffer(b"".join(index["codes"].to_pylist()), np.uint8).reshape(len(v), -1)
    lower, upper = hard_negatives.bounds(books, codes, index["residual"].to_numpy(), v[:200], index["norm"].to_numpy()[:200])
    exact = v @ v[:200].T
    assert (lower <= exact).all() and (exact <= upper).all()
    fifth = np.partition(lower, -5, axis=0)[-5]
    assert (upper >= fifth).mean() < 0.4  # what is left to measure exactly, with a quarter of all rows equal
