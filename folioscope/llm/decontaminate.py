"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

Words are hashed, K consecutive hashes make a k-gram, and the smallest k-gram hash of
every ``WINDOW - K + 1`` consecutive k-grams is kept as the fingerprint of those WINDOW
words.  A shared span of WINDOW words has equal k-grams, hence equal fingerprints, so
none is missed.  Fingerprints that documents and benchmark share select the documents'
windows; these are joined with the benchmark's on fingerprint and words, and consecutive
hits extend to whole spans.

Up to ``MARKED`` fingerprints of the benchmark (of one window size) make a bitmap of 32
cells each, so that documents are sifted in the scan.  More are joined: the distinct
fingerprints of each document, some two of every WINDOW - K + 2 words, meet those of the benchmark
by shuffle.  The benchmark's windows are broadcast if their text is at most ``BROADCAST_BYTES``,
otherwise Spark shuffles both sides.

Defined cases: null or empty text, or text without words, has no words and no hits, and
a benchmark item without words, or with a null ``item_id``, has no window.  An item of
fewer than WINDOW words is one window.  Rows that repeat a ``doc_id`` are judged by
their own text.  A null ``doc_id`` is a value like any other.  No other column is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

K, WINDOW = 5, 10
MARKED, BROADCAST_BYTES = 1 << 17, 32 << 20
#: Everything but digits, a-z and characters outside ASCII parts words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(col):
    return F.filter(F.split(ascii_lower(F.coalesce(col, F.lit(""))), NOT_WORD), lambda w: w != "")


def _later(name: str, by: int) -> str:
    return f"slice({name}, {by + 1}, greatest(size({name}) - {by}, 0))"


def with_fingerprints(df: DataFrame) -> DataFrame:
    """Adds ``_f``: the fingerprint of the WINDOW words from each position of ``_words``."""
    grams = {1: "_h"}
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    have, name = 1, "_h"
    while have < K:
        step = min(have, K - have)
        part = grams[step] if step in grams else "_h"
        if step not in grams:
            step = 1
        new = f"_g{have + step}"
        df = df.withColumn(new, F.expr(f"zip_with({name}, {_later(part, have)}, (a, b) -> xxhash64(a, b))"))
        have, name = have + step, new
        grams[have] = name
    df = df.withColumn("_m1", F.expr(f"slice({name}, 1, greatest(size(_words) - {K - 1}, 0))"))
    have, name, wide = 1, "_m1", WINDOW - K + 1
    while have < wide:
        step = min(have, wide - have)
        new = f"_m{have + step}"
        df = df.withColumn(new, F.expr(f"zip_with({name}, {_later(name, step)}, (a, b) -> least(a, b))"))
        have, name = have + step, new
    return df.withColumn("_f", F.expr(f"slice({name}, 1, greatest(size(_words) - {WINDOW - 1}, 0))")).drop(*[c for c in df.columns if c.startswith(("_h", "_g", "_m"))])


def _text(start: str, length: int) -> str:
    """The words of a window; picked one by one, as ``slice`` would copy the whole array each time."""
    return "concat_ws(' ', " + ", ".join(f"get(_words, {start} + {i})" for i in range(length)) + ")"


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """item_id, size (words in a window), text and print (its fingerprint), without repeats."""
    item = bench.filter("item_id is not null").select("item_id", words(F.col("text")).alias("_words")).filter("size(_words) > 0")
    long = with_fingerprints(item.filter(f"size(_words) >= {WINDOW}")).select("item_id", F.lit(WINDOW).alias("size"), F.posexplode_outer("_f").alias("at", "print"), "_words")
    long = long.select("item_id", "size", F.expr(_text("at", WINDOW)).alias("text"), "print")
    short = item.filter(f"size(_words) < {WINDOW}").select("item_id", F.size("_words").alias("size"), F.array_join("_words", " ").alias("text"))
    return long.union(short.withColumn("print", F.xxhash64("text"))).distinct()


def _marked(prints: list[int], least: int = 1 << 16):
    """A Column function that tells whether a fingerprint's cell of the bitmap is marked."""
    size = least
    while size < 32 * len(prints):
        size *= 2
    cells = bytearray(size)
    for p in prints:
        cells[p % size] = 1
    bitmap = F.lit(bytes(cells))
    return lambda p: F.substring(bitmap, F.pmod(p, F.lit(size)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")


def shared_prints(found: DataFrame, prints: DataFrame) -> DataFrame:
    """``found`` with ``_own``: the fingerprints of each document that the benchmark holds too, by a join of fingerprints."""
    key = ["doc_id", "key"]
    own = found.select(*key, F.explode(F.array_distinct("_f")).alias("print")).distinct().join(prints, "print", "left_semi")
    own = own.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_set("print").alias("_own"))
    joined = found.join(own, found["doc_id"].eqNullSafe(F.col("_d")) & (found["key"] == F.col("_k")), "left")
    return joined.drop("_d", "_k").withColumn("_own", F.coalesce("_own", F.expr("cast(array() as array<bigint>)")))


def hits(docs: DataFrame, bench: DataFrame, marked_prints: int = MARKED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, key (hash of the text), n_words, and at, size and item_id: a row for each hit, and one of at -1 for the document itself."""
    bench_windows = benchmark_windows(bench)
    facts = bench_windows.groupBy("size").agg(F.sum(F.octet_length("text")).alias("n"), F.count_distinct("print").alias("prints")).collect()
    cells = {}
    few = [f["size"] for f in facts if f["prints"] <= marked_prints]
    if few:
        cells = {r["size"]: r["cells"] for r in bench_windows.filter(F.col("size").isin(few)).groupBy("size").agg(F.collect_set("print").alias("cells")).collect()}
    small = sum(f["n"] for f in facts) <= broadcast_bytes
    found = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("_words")).withColumn("n_words", F.size("_words").cast("long"))
    found = with_fingerprints(found)
    if WINDOW not in cells and any(f["size"] == WINDOW for f in facts):
        found = shared_prints(found, bench_windows.filter(F.col("size") == WINDOW).select("print").distinct())

    def sifted(col, name, test):
        return F.filter(col, lambda s: test(s[name]))

    parts = []
    for f in sorted(facts, key=lambda f: f["size"]):
        n = f["size"]
        marked = _marked(cells[n]) if n in cells else None
        if n == WINDOW:
            test = marked or (lambda p: F.array_contains("_own", p))
            at = sifted(F.transform("_f", lambda p, i: F.struct(i.alias("at"), p.alias("print"))), "print", test)
            found = found.withColumn(f"_at{n}", at)
            parts.append(F.expr(f"transform(_at{n}, w -> named_struct('at', w.at, 'size', {n}, 'print', w.print, 'text', {_text('w.at', n)}))"))
        else:
            every = F.expr(f"transform(transform(sequence(0, size(_words) - {n}), i -> named_struct('at', i, 'text', {_text('i', n)})), w -> named_struct('at', w.at, 'size', {n}, 'print', xxhash64(w.text), 'text', w.text))")
            kept = F.when(F.size("_words") >= n, every)
            kept = sifted(kept, "print", marked) if marked else kept
            parts.append(F.coalesce(kept, F.expr("array()").cast("array<struct<at:int,size:int,print:bigint,text:string>>")))
    # the document itself has its own key for a fingerprint, and so meets no one and goes anywhere
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("size"), F.col("key").alias("print"), F.lit("").alias("text")))
    # the outer form, since from the inner one Catalyst infers a filter that repeats all of _w
    rows = found.withColumn("_w", F.concat(itself, *parts)).select("doc_id", "key", "n_words", F.explode_outer("_w").alias("w"))
    rows = rows.select("doc_id", "key", "n_words", "w.at", "w.size", "w.print", "w.text")
    return rows.join(F.broadcast(bench_windows) if small else bench_windows, ["size", "print", "text"], "left").select("doc_id", "key", "n_words", "at", "size", "item_id")


def contamination(docs: DataFrame, bench: DataFrame, marked_prints: int = MARKED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; also spans (starts and lengths of the hit runs) and key."""
    found = hits(docs, bench, marked_prints, broadcast_bytes)
    hit = F.when(F.col("item_id").isNotNull(), F.struct("at", "size"))
    per = found.groupBy("doc_id", "key", "n_words").agg(F.collect_set(hit).alias("_s"), F.collect_set(F.col("item_id").cast("string")).alias("_items"), F.count_if(F.col("at") < 0).alias("_n"))
    # of windows sorted by start, each adds what reaches beyond all before it
    runs = F.expr(
        "aggregate(array_sort(_s), cast(array() as array<struct<at:int,end:int>>), (r, s) -> if(size(r) > 0 and element_at(r, -1).end >= s.at,"
        " concat(slice(r, 1, size(r) - 1), array(named_struct('at', element_at(r, -1).at, 'end', greatest(element_at(r, -1).end, s.at + s.size)))),"
        " concat(r, array(named_struct('at', s.at, 'end', s.at + s.size)))))"
    )
    per = per.withColumn("spans", runs).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.at)"))
    per = per.withColumn("n_items", F.size("_items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("_items"), ","), 256))
    per = per.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return per.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans", "key")


def op5_decontaminate(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "key")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS t
       FROM b, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS x(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS t FROM d, sizes, unnest(generate_series(1, len(ws) - n + 1)) AS x(i)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(generate_series(i, i + n - 1)) AS x(j) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(q.n_items, 0) AS n_items,
       sha256(coalesce(q.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id""",
}
