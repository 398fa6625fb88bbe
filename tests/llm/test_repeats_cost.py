"""What op7_repeats does for each byte: texts that share nothing stay out of Python, arrays are few, and results are those of plain loops."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from folioscope.llm import repeats
from folioscope.llm.common import prefix_hash, span_hash


def _words(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 8))) for _ in range(n))


def test_only_rows_with_shared_anchors_reach_python_at_the_end(spark):
    """Before, every text went to Python twice in the last step, and those that share anchors a third time."""
    r = random.Random(3)
    passage = _words(r, 120)
    texts = [_words(r, 150) for _ in range(20)] + [f"{_words(r, 30)} {passage} {_words(r, 30)}" for _ in range(3)] + [None, "", "short", "é" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = repeats.without_repeats(docs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {x["doc_id"]: x for x in out.collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        data, x = (t or "").encode(), got[k]
        stays, at = b"", 0
        for a, b in x["spans"]:
            stays, at = stays + data[at:a], b
        stays += data[at:]
        assert bytes(x["kept"]) == stays and x["kept_sha256"] == hashlib.sha256(stays).hexdigest()
        assert (x["n_bytes"], x["n_removed"], x["n_spans"]) == (len(data), len(data) - len(stays), len(x["spans"]))
        assert (x["n_removed"] >= len(passage), x["n_shared"] > 0) == ((True, True) if 20 <= k < 23 else (k >= 26, k >= 26)) or k == 26
    short = repeats.without_repeats(docs, texts=False).select("doc_id", "kept", "kept_sha256").collect()
    assert {x["doc_id"]: x["kept_sha256"] for x in short} == {k: x["kept_sha256"] for k, x in got.items()} and not any(x["kept"] for x in short)


def test_runs_hold_few_arrays():
    """Hashes of all positions are made in place: some 4 arrays of 64 bits at once (32 bytes a byte of text), where there were 7 (57)."""
    buf = np.random.default_rng(1).integers(97, 123, 1 << 18).astype(np.uint8)
    off = np.linspace(0, len(buf), 101).astype(np.int64)
    repeats.runs(buf, off, 400, 240, 140)
    tracemalloc.start()
    repeats.runs(buf, off, 400, 240, 140)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 42 * len(buf)


def test_runs_are_those_of_plain_loops():
    r = np.random.default_rng(5)
    for alphabet in (2, 26):
        off = np.concatenate([[0, 0], np.cumsum(r.integers(0, 90, 30)), [0]])
        off[-1] = off[-2]
        buf = r.integers(97, 97 + alphabet, off[-1]).astype(np.uint8)
        prefix = prefix_hash(buf)
        for length, shared, q in ((40, 28, 17), (40, 40, 20), (30, 30, 30)):
            want = {}
            for row in range(len(off) - 1):
                for w in range(off[row], off[row + 1] - shared + 1):
                    at = np.arange(w, w + shared - q + 1)
                    h = span_hash(prefix, at, at + q)
                    best = int(np.argmin(h >> np.uint64(32)))
                    key = (row, int(at[best]))
                    if key not in want:
                        want[key] = [w, 0, int(h[best])]
                    want[key][1] += w + length <= off[row + 1]
            row, first, size, anchor, bucket, *_ = repeats.runs(buf, off, length, shared, q)
            assert list(zip(row.tolist(), anchor.tolist(), first.tolist(), size.tolist(), bucket.tolist(), strict=True)) == [(*k, *v) for k, v in want.items()]


def test_rows_are_judged_as_by_plain_loops():
    r = random.Random(8)
    for _ in range(40):
        n, length, q = 6, 12, 5
        texts = [bytes(r.choices(b"abcdef", k=r.choice([0, 11, 12, 30, 60]))) for _ in range(n)]
        windows, want = [], []
        for t in texts:
            rows, gone, near = [], [False] * len(t), [False] * len(t)
            for _ in range(r.randrange(4) if len(t) >= length else 0):
                first = r.randrange(len(t) - length + 1)
                room = len(t) - length + 1 - first
                size = r.randrange(room + 1)
                offsets = sorted(r.sample(range(room), r.randrange(room + 1))) if not size else None
                anchor = r.randrange(len(t) - q + 1)
                rows.append({"first": first, "size": size, "offsets": offsets, "anchor": anchor})
                for w in [*range(first, first + size), *(first + o for o in offsets or ())]:
                    gone[w : w + length] = [True] * length
                near[anchor : anchor + q] = [True] * q
            windows.append(rows or None)
            edge = [i for i in range(len(t) + 1) if (i > 0 and gone[i - 1]) != (i < len(t) and gone[i])]
            stays = bytes(b for b, g in zip(t, gone, strict=True) if not g)
            spans = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            want.append({"n_bytes": len(t), "n_removed": sum(gone), "n_spans": len(spans), "kept_sha256": hashlib.sha256(stays).hexdigest(), "n_shared": sum(near), "kept": stays, "spans": spans})
        kind = pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64()), ("offsets", pa.list_(pa.int32())), ("anchor", pa.int64())]))
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        for i, j in ((0, n), (2, 5)):  # a slice too
            got = repeats.judged(pa.array(range(i, j)), buf, off[i : j + 1], pa.array(windows, kind).slice(i, j - i), length, q, True)
            assert got.drop_columns(["doc_id"]).to_pylist() == want[i:j] and got.column(0).to_pylist() == list(range(i, j))
