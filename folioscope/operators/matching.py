"""Alignment of the sections of two versions: candidates, scores, one-to-one assignment.

Tables: sides A and B are sections with ``pair_id``.  Candidates meet by ``pair_id`` only, as
numbers: bags of characters bound every score.  Plans assign lazily: texts
are measured only where a bound leaves a candidate the best, in one task a pair, or in
rounds over all tasks for a pair that is too large for one.  ``scored`` and ``assigned`` measure
all candidates; they are the plain form, and for scores that are given.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.config import MatchConfig
from folioscope.functions import text as T
from folioscope.functions.similarity import ceiling, measure, similarity, title_scores
from folioscope.storage import written


def pool(sections: DataFrame) -> DataFrame:
    """Sections that take part, with their position ``i`` and the pool's size ``n``."""
    own = Window.partitionBy("pair_id")
    kept = sections.filter((F.col("level") <= 1) & (F.col("anchor_type") != "preamble"))
    return kept.select(
        "pair_id", "section_id", "anchor_type", "title_normalized", T.strip_heading(F.col("title_normalized")).alias("core"), T.body_prefix(F.col("body")).alias("prefix"),
        (F.row_number().over(own.orderBy("ordinal")) - 1).cast("long").alias("i"), F.count("*").over(own).alias("n"),
    )


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every A with every B of one pair of documents."""
    side = lambda df, s: df.select("pair_id", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "pair_id"])
    return side(a, "a").join(side(b, "b"), "pair_id")


def plain_terms(c: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Adds anchor_score and order_score, which need no similarity."""
    anchor = F.when(F.col("anchor_type_a") == F.col("anchor_type_b"), 1.0).otherwise(cfg.anchor_mismatch)
    widest = F.greatest(F.lit(1), F.greatest("n_a", "n_b") - 1)
    return c.withColumn("anchor_score", anchor).withColumn("order_score", F.greatest(F.lit(0.0), 1 - F.abs(F.col("i_a") - F.col("i_b")) / widest))


def scored(a: DataFrame, b: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """pair_id, both ids and positions, score and reason, of candidates that reach the low threshold."""
    # few bytes and much work: as many tasks as the session says, not as many as the bytes fill
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = plain_terms(candidates(a.repartition(tasks, "pair_id"), b.repartition(tasks, "pair_id")), cfg)
    share = cfg.title_norm_share
    others = cfg.body_weight + cfg.anchor_weight * F.col("anchor_score") + cfg.order_weight * F.col("order_score")
    c = c.withColumn("_least", (F.lit(cfg.low) - others) / cfg.title_weight - 1e-4)
    c = c.withColumn("_t", title_scores(*[F.col(n) for n in ("title_normalized_a", "title_normalized_b", "core_a", "core_b", "_least")], share, cfg.metric)).filter("_t is not null")
    c = c.withColumn("title_raw", F.col("_t.raw")).withColumn("title_core", F.col("_t.core")).withColumn("title_score", share * F.col("title_raw") + (1 - share) * F.col("title_core"))
    c = c.withColumn("body_score", similarity(F.col("prefix_a"), F.col("prefix_b"), cfg.metric))
    score = cfg.title_weight * F.col("title_score") + cfg.body_weight * F.col("body_score") + cfg.anchor_weight * F.col("anchor_score") + cfg.order_weight * F.col("order_score")
    reason = F.format_string("title_raw=%.3f, title_core=%.3f, title=%.3f, body=%.3f, anchor=%.3f, order=%.3f", "title_raw", "title_core", "title_score", "body_score", "anchor_score", "order_score")
    return c.withColumn("score", score).filter(F.col("score") >= cfg.low).select("pair_id", "i_a", "i_b", "section_id_a", "section_id_b", "score", reason.alias("reason"))


def _by_pair(rows: DataFrame, by: str) -> DataFrame:
    """Each pair's rows in one partition, one after another by falling ``by``: a window asks for just that.

    After a join by pair no other shuffle is needed, and none can part a pair again.
    """
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc(by), "i_a", "i_b")))


def assigned(scores: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment by score, ties by position; adds match_no.

    Spark sorts each pair's candidates; a task walks through many pairs and holds the
    positions taken in the one at hand.
    """

    def run(batches):
        pair, used_a, used_b, no = None, set(), set(), 0
        for rows in batches:
            keep, numbers = [], []
            for k, (p, i, j) in enumerate(zip(rows["pair_id"], rows["i_a"], rows["i_b"], strict=True)):
                if p != pair:
                    pair, used_a, used_b, no = p, set(), set(), 0
                if i not in used_a and j not in used_b:
                    used_a.add(i)
                    used_b.add(j)
                    keep.append(k)
                    numbers.append(no)
                    no += 1
            yield rows.iloc[keep].drop(columns="_k").assign(match_no=numbers)

    kind = dict(scores.dtypes)["pair_id"]
    scores = scores.filter("pair_id is not null").select("pair_id", "i_a", "i_b", "section_id_a", "section_id_b", "score", "reason")
    return _by_pair(scores, "score").mapInPandas(run, f"pair_id {kind}, i_a long, i_b long, section_id_a string, section_id_b string, score double, reason string, match_no long")


#: Characters that a bag counts one by one; all others are counted together.
COUNTED = " etaoinsrhld"
#: Candidates of a pair up to which one task takes the pair; larger ones are spread.
LARGE = 4_000_000
#: Candidates in a block of a large pair.
BLOCK = 1_000_000
TEXTS = ("title_normalized", "core", "prefix")


def _bag(c: str) -> F.Column:
    """How often a text has each of COUNTED, how many other characters, and how many in all; nothing of null."""
    text = F.coalesce(F.col(c), F.lit(""))
    own = [F.length(text) - F.length(F.translate(text, ch, "")) for ch in COUNTED]
    rest = F.length(text)
    for n in own:
        rest = rest - n
    return F.array(*own, rest, F.length(text))


def _ceiling(a: F.Column, b: F.Column) -> F.Column:
    """The sequence measure's largest value for texts of these bags: matching blocks have no character that the other side lacks."""

    size = a[len(COUNTED) + 1] + b[len(COUNTED) + 1]
    # the last place holds the length, of which the smaller comes in as well
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x) - F.least(a[len(COUNTED) + 1], b[len(COUNTED) + 1])
    return F.when(size > 0, F.lit(2.0) * both / size).otherwise(0.0)


def _total(cfg: MatchConfig, raw, core, body, anchor, order):
    """The score of a candidate; of Columns or of numbers, with the same rounding."""
    share = cfg.title_norm_share
    return cfg.title_weight * (share * raw + (1 - share) * core) + cfg.body_weight * body + cfg.anchor_weight * anchor + cfg.order_weight * order


def bounded(a: DataFrame, b: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """pair_id, i_a, i_b, anchor_score, order_score and bound of the candidates that may reach the low threshold; no texts.

    bound: at least the score; by bags of characters for the sequence measure.  Inside the JVM.
    Blocks of side A meet side B, so that no task has more than some BLOCK candidates of one pair.
    """
    exact = cfg.metric == "sequence"
    light = lambda df: df.filter("pair_id is not null").select("pair_id", "i", "n", "anchor_type", *[_bag(c).alias(c) for c in TEXTS if exact])
    a, b = light(a), light(b)
    sizes = a.select("pair_id", F.col("n").alias("_n")).distinct().join(b.select("pair_id", F.col("n").alias("_m")).distinct(), "pair_id")
    sizes = sizes.select("pair_id", F.ceil(F.col("_n") * F.col("_m") / BLOCK).alias("_blocks"))
    a = a.join(sizes, "pair_id").withColumn("_at", F.pmod("i", "_blocks")).drop("_blocks")
    b = b.join(sizes, "pair_id").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    side = lambda df, s: df.select(*[F.col(c) if c in ("pair_id", "_at") else F.col(c).alias(f"{c}_{s}") for c in df.columns])
    c = plain_terms(side(a, "a").join(side(b, "b"), ["pair_id", "_at"]), cfg)
    terms = [_ceiling(F.col(f"{t}_a"), F.col(f"{t}_b")) if exact else F.lit(1.0) for t in TEXTS]
    c = c.withColumn("bound", _total(cfg, *terms, F.col("anchor_score"), F.col("order_score")))
    return c.filter(F.col("bound") >= cfg.low).select("pair_id", "i_a", "i_b", "anchor_score", "order_score", "bound")


ASSIGNED = "i_a long, i_b long, section_id_a string, section_id_b string, score double, reason string, match_no long"


def _reason(raw, core, body, anchor, order, cfg: MatchConfig) -> str:
    title = cfg.title_norm_share * raw + (1 - cfg.title_norm_share) * core
    return f"title_raw={raw:.3f}, title_core={core:.3f}, title={title:.3f}, body={body:.3f}, anchor={anchor:.3f}, order={order:.3f}"


def assigned_lazily(a: DataFrame, b: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """What ``assigned(scored(a, b))`` gives, with few texts compared.

    A task walks through many pairs.  Only sections are shuffled: the candidates of a pair
    arise in the task, as matrices of bounds of their scores by bags of characters.  It measures
    titles, then bodies, only of the candidate whose bound is the highest and whose
    sections are both free: once it is exact and still the highest, it is accepted.
    Pairs of more than LARGE candidates are taken by :func:`assigned_widely`.
    """
    sizes = a.select("pair_id", "n").distinct().join(b.select("pair_id", F.col("n").alias("m")).distinct(), "pair_id")
    large = sizes.filter(F.col("n") * F.col("m") > LARGE).select("pair_id")
    if large.isEmpty():
        return _assigned_by_task(a, b, cfg)
    few = [side.join(large, "pair_id", "left_anti") for side in (a, b)]
    many = [side.join(large, "pair_id", "left_semi") for side in (a, b)]
    return _assigned_by_task(*few, cfg).unionByName(assigned_widely(*many, cfg))


def _bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """How often each text has the characters of each of 64 classes, and its length."""
    out = np.zeros((len(texts), 64), np.int32)
    for k, text in enumerate(texts):
        if text:
            out[k] = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)
    return out, out.sum(axis=1)


def _ceilings(x: list, y: list) -> np.ndarray:
    """The sequence measure's largest values for two lists of texts: matching blocks have no character that the other side lacks."""
    (a, size_a), (b, size_b) = _bags(x), _bags(y)
    if a.size * len(b) <= 1 << 18:
        both = np.minimum(a[:, None], b[None]).sum(axis=2)
    else:
        both = np.zeros((len(a), len(b)), np.int32)
        for k in np.flatnonzero(a.any(axis=0) & b.any(axis=0)):
            both += np.minimum.outer(a[:, k], b[:, k])
    return 2.0 * both / np.maximum(size_a[:, None] + size_b, 1)


#: Candidates that a task bounds at a time.
TOGETHER = 1 << 15


def _bounded_groups(groups: list[tuple[list, list]], cfg: MatchConfig):
    """Of each group of rows of both sides its candidates that may reach the low threshold, best bound first: i, j, bound, anchor and order score, as lists.

    Many small groups are bounded at a time, each text once.
    """
    exact = cfg.metric == "sequence"
    x, y = ([row for group in groups for row in group[k]] for k in (0, 1))
    n, m = (np.array([len(group[k]) for group in groups]) for k in (0, 1))
    size = n * m
    g = np.repeat(np.arange(len(groups)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    i, j = place // m[g], place % m[g]
    p, q = (np.cumsum(n) - n)[g] + i, (np.cumsum(m) - m)[g] + j
    kinds = pd.factorize(np.array([row[3] for row in itertools.chain(x, y)], object), use_na_sentinel=False)[0]
    anchor = np.where(kinds[p] == kinds[len(x) + q], 1.0, cfg.anchor_mismatch)
    (at_a, widest_a), (at_b, widest_b) = (np.array([row[:2] for row in side], np.int64).T for side in (x, y))
    order = np.maximum(0.0, 1 - np.abs(at_a[p] - at_b[q]) / np.maximum(1, np.maximum(widest_a[p], widest_b[q]) - 1))

    def ceilings(c: int) -> np.ndarray:
        code, texts = pd.factorize(np.array([row[c] or "" for row in itertools.chain(x, y)], object))
        bags, sizes = _bags(texts)
        pairs, back = np.unique(code[p].astype(np.int64) * len(texts) + code[len(x) + q], return_inverse=True)
        out = np.empty(len(pairs))
        for k in range(0, len(pairs), TOGETHER):
            s, t = np.divmod(pairs[k : k + TOGETHER], len(texts))
            out[k : k + TOGETHER] = 2.0 * np.minimum(bags[s], bags[t]).sum(axis=1) / np.maximum(sizes[s] + sizes[t], 1)
        return out[back]

    bound = _total(cfg, *[ceilings(c) if exact else 1.0 for c in (4, 5, 6)], anchor, order)
    kept = np.flatnonzero(bound >= cfg.low)
    kept = kept[np.lexsort((-bound[kept], g[kept]))]
    cut = np.searchsorted(g[kept], np.arange(len(groups) + 1)).tolist()
    lists = [c[kept].tolist() for c in (i, j, bound, anchor, order)]
    for k in range(len(groups)):
        yield [c[cut[k] : cut[k + 1]] for c in lists]


def _bounded_group(x: list, y: list, cfg: MatchConfig) -> list[list]:
    """The same of one large group, with matrices."""
    exact = cfg.metric == "sequence"
    kind, at = ([np.array([row[c] for row in rows], dtype) for rows in (x, y)] for c, dtype in ((3, object), (0, np.int64)))
    anchor = np.where(kind[0][:, None] == kind[1], 1.0, cfg.anchor_mismatch)
    place = np.maximum(0.0, 1 - np.abs(at[0][:, None] - at[1]) / max(1, x[0][1] - 1, y[0][1] - 1))
    terms = [_ceilings([row[c] for row in x], [row[c] for row in y]) if exact else 1.0 for c in (4, 5, 6)]
    bound = _total(cfg, *terms, anchor, place).ravel()
    order = np.flatnonzero(bound >= cfg.low)
    order = order[np.argsort(-bound[order], kind="stable")]
    return [c.tolist() for c in (order // len(y), order % len(y), bound[order], anchor.ravel()[order], place.ravel()[order])]


def _measured_titles(p: tuple, q: tuple, cfg: MatchConfig) -> tuple[float, float, float]:
    """raw, core and a ceiling of body of two rows."""
    return measure(p[4], q[4], cfg.metric), measure(p[5], q[5], cfg.metric), ceiling(p[6], q[6]) if cfg.metric == "sequence" else 1.0


def _decided(x: list, y: list, found: list[list], cfg: MatchConfig) -> list[tuple]:
    """i, j, score, (raw, core, body), anchor and order score of the accepted candidates of a whole pair, in the greedy order."""
    heap, taken_a, taken_b, accepted, at = [], set(), set(), [], 0
    rows, columns, values, anchor, place = found
    while heap or at < len(rows):
        while at < len(rows) and (not heap or values[at] >= -heap[0][0]):
            if rows[at] not in taken_a and columns[at] not in taken_b:
                heapq.heappush(heap, (-values[at], 0, rows[at], columns[at], at, None))
            at += 1
        if not heap:
            break
        value, step, i, j, k, known = heapq.heappop(heap)
        if i in taken_a or j in taken_b:
            continue
        if step == 2:
            taken_a.add(i)
            taken_b.add(j)
            accepted.append((i, j, -value, known, anchor[k], place[k]))
            continue
        known = _measured_titles(x[i], y[j], cfg) if step == 0 else (*known[:2], measure(x[i][6], y[j][6], cfg.metric))
        score = _total(cfg, *known, anchor[k], place[k])
        if score >= cfg.low:
            heapq.heappush(heap, (-score, step + 1, i, j, k, known))
    return accepted


def _bests(x: list, y: list, found: list[list], cfg: MatchConfig) -> list[tuple]:
    """The same columns of the candidates that are the best of their row or of their column, in a block of a pair."""
    best_a, best_b, kept = {}, {}, {}
    for i, j, bound, anchor, place in zip(*found, strict=True):
        least = min(best_a.get(i, (cfg.low,))[0], best_b.get(j, (cfg.low,))[0])
        if bound < least:
            continue
        known = _measured_titles(x[i], y[j], cfg)
        if _total(cfg, *known, anchor, place) < least:
            continue
        known = *known[:2], measure(x[i][6], y[j][6], cfg.metric)
        score = _total(cfg, *known, anchor, place)
        if score < cfg.low:
            continue
        rank = score, -x[i][0], -y[j][0]
        for best, k in ((best_a, i), (best_b, j)):
            if k not in best or rank > best[k][:3]:
                best[k] = (*rank, i, j)
                kept[i, j] = (i, j, score, known, anchor, place)
    return [kept[k] for k in {best[3:] for best in itertools.chain(best_a.values(), best_b.values())}]


def _walk(batches, keys: list[str], names: list[str], cfg: MatchConfig, told):
    """Rows of ``told(key, x, y, candidates)`` for each group of rows that come by keys, then kind; small groups are bounded together."""
    held, weight = [], 0

    def done():
        for (key, x, y), found in zip(held, _bounded_groups([group[1:] for group in held], cfg), strict=True):
            yield from told(key, x, y, found)

    rows = (row for batch in batches for row in zip(*(batch[n].tolist() for n in [*keys, "kind", *names]), strict=True))
    width = len(keys)
    for key, group in itertools.groupby(rows, key=lambda row: row[:width]):
        sides = [], []
        for row in group:
            sides[row[width]].append(row[width + 1 :])
        size = len(sides[0]) * len(sides[1])
        if size > TOGETHER:
            yield from told(key, *sides, _bounded_group(*sides, cfg))
        elif size:
            held.append((key, *sides))
            weight += size
            if weight > TOGETHER:
                yield from done()
                held, weight = [], 0
    if held:
        yield from done()


def _frames(rows, columns: list[str]):
    while part := list(itertools.islice(rows, 10_000)):
        yield pd.DataFrame(part, columns=columns)


def _assigned_by_task(a: DataFrame, b: DataFrame, cfg: MatchConfig) -> DataFrame:
    names = ["i", "n", "section_id", "anchor_type", *TEXTS]
    side = lambda df, kind: df.filter("pair_id is not null").select("pair_id", F.lit(kind).alias("kind"), *names)
    order = F.row_number().over(Window.partitionBy("pair_id").orderBy("kind", "i"))
    rows = side(a, 0).unionByName(side(b, 1)).withColumn("_k", order)  # a window asks for just this order
    columns = ["pair_id", *(c.split()[0] for c in ASSIGNED.split(", "))]

    def told(key, x, y, found):
        for no, (i, j, score, known, anchor, place) in enumerate(_decided(x, y, found, cfg)):
            yield *key, x[i][0], y[j][0], x[i][2], y[j][2], score, _reason(*known, anchor, place, cfg), no

    def run(batches):
        yield from _frames(_walk(batches, ["pair_id"], names, cfg, told), columns)

    return rows.mapInPandas(run, f"pair_id {dict(a.dtypes)['pair_id']}, {ASSIGNED}")


def assigned_widely(a: DataFrame, b: DataFrame, cfg: MatchConfig = MatchConfig(), block: int | None = None) -> DataFrame:
    """What :func:`assigned_lazily` gives, for pairs too large for a task: a fixpoint of mutual bests.

    In each round free sections alone are shuffled, in blocks of some ``block`` candidates (BLOCK) of a pair.
    A task measures a block until it knows the best candidate of each section in it, and gives those; no
    candidate else leaves it.  One that is the best of both its sections over all blocks is the next of the greedy order
    for them, whatever else happens: it is accepted.  Sections without any candidate are done with, so what is left shrinks.
    A pair whose rest is one block is decided there.
    """
    width = max(1, math.isqrt(BLOCK if block is None else block))
    pair = f"pair_id {dict(a.dtypes)['pair_id']}"
    names = ["i", "n", "section_id", "anchor_type", *TEXTS]
    free = [side.filter("pair_id is not null").select("pair_id", *names) for side in (a, b)]
    told = f"{pair}, i_a long, i_b long, section_id_a string, section_id_b string, score double, reason string"
    columns = [c.split()[0] for c in told.split(", ")]

    def best(key, x, y, found):
        for i, j, score, known, anchor, place in (_decided if key[1] == 0 else _bests)(x, y, found, cfg):
            yield key[0], x[i][0], y[j][0], x[i][2], y[j][2], score, _reason(*known, anchor, place, cfg)

    def run(batches):
        yield from _frames(_walk(batches, ["pair_id", "_at"], names, cfg, best), columns)

    accepted = None
    while True:
        cuts = [side.groupBy("pair_id").agg(F.ceil(F.count("*") / width).alias(f"_{s}")) for side, s in zip(free, "ab", strict=True)]
        cuts = cuts[0].join(cuts[1], "pair_id").filter("_a * _b > 1")
        blocks = []
        for kind, (side, own, other) in enumerate(zip(free, ("_a", "_b"), ("_b", "_a"), strict=True)):
            # blocks count from 1; a pair that is in no list of cuts is one block, 0
            side = side.join(cuts, "pair_id", "left")
            own_at, other_at = F.pmod("i", own), F.col("_o")
            side = side.withColumn("_o", F.explode(F.when(F.col(own).isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))))
            at = (own_at * F.col("_b") + other_at if kind == 0 else other_at * F.col("_b") + own_at) + 1
            blocks.append(side.select("pair_id", F.coalesce(at, F.lit(0)).alias("_at"), F.lit(kind).alias("kind"), *names))
        place = F.row_number().over(Window.partitionBy("pair_id", "_at").orderBy("kind", "i"))
        found = blocks[0].unionByName(blocks[1]).withColumn("_k", place).mapInPandas(run, told).repartition("pair_id")
        # all bests of a pair are together: windows by section need no other shuffle
        for s in "ab":
            found = found.withColumn(f"_{s}", F.row_number().over(Window.partitionBy("pair_id", f"i_{s}").orderBy(F.desc("score"), "i_a", "i_b")) == 1)
        found = found.withColumn("chosen", F.col("_a") & F.col("_b"))
        for s in "ab":
            found = found.withColumn(f"_{s}", F.max("chosen").over(Window.partitionBy("pair_id", f"i_{s}")))
        found = written(found, "bests")
        chosen = found.filter("chosen").select(*columns)
        accepted = chosen if accepted is None else accepted.unionByName(chosen)
        rest = [found.filter(~F.col(f"_{s}")).select("pair_id", F.col(f"i_{s}").alias("i")).distinct() for s in "ab"]
        if any(side.isEmpty() for side in rest):
            break
        free = [written(side.join(left, ["pair_id", "i"], "left_semi").select("pair_id", *names), "free") for side, left in zip(free, rest, strict=True)]
    order = Window.partitionBy("pair_id").orderBy(F.desc("score"), "i_a", "i_b")
    return accepted.withColumn("match_no", (F.row_number().over(order) - 1).cast("long"))


def matches(a: DataFrame, b: DataFrame, found: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Matched rows in order of acceptance, then unmatched A, then unmatched B, each in its order."""
    band = F.when(F.col("score") >= cfg.matched, "matched").otherwise("low-confidence matched")
    none = F.lit(None).cast("string")
    # each match marks its place on both sides, of which the first is its row as well; marks and sections are shuffled once, by pair
    hit = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"i_{s}").alias("i"))
    marks = found.withColumn("_m", F.explode(F.array(hit("a"), hit("b"))))
    own = F.col("_m.side") == "a"
    marks = marks.select(
        "pair_id", "_m.side", "_m.i", F.lit(True).alias("hit"), F.when(own, F.col("match_no")).alias("at"), *[F.when(own, F.col(c)).alias(c) for c in ("section_id_a", "section_id_b")],
        F.when(own, F.round("score", 4)).alias("score"), F.when(own, band).alias("confidence"), F.when(own, F.col("reason")).alias("reason"),
    )
    every = marks
    for side, s in ((a, "a"), (b, "b")):
        ids = [F.col("section_id") if s == c else none for c in "ab"]
        every = every.unionByName(side.select(
            "pair_id", F.lit(s).alias("side"), "i", F.lit(False).alias("hit"), F.col("i").alias("at"), *[x.alias(f"section_id_{c}") for c, x in zip("ab", ids, strict=True)],
            F.lit(0.0).alias("score"), F.lit("unmatched").alias("confidence"), F.lit("No candidate passed threshold").alias("reason"),
        ))
    taken = F.max("hit").over(Window.partitionBy("pair_id", "side", "i"))
    every = every.repartition("pair_id").withColumn("_taken", taken).filter("if(hit, side = 'a', not _taken)")
    kind = F.when(F.col("hit"), 0).when(F.col("side") == "a", 1).otherwise(2)
    order = Window.partitionBy("pair_id").orderBy(kind, "at")
    return every.withColumn("match_no", (F.row_number().over(order) - 1).cast("long")).select("pair_id", "section_id_a", "section_id_b", "score", "confidence", "reason", "match_no")


def match(sections_a: DataFrame, sections_b: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    a, b = pool(sections_a), pool(sections_b)
    return matches(a, b, assigned_lazily(a, b, cfg), cfg)
