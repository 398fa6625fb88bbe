"""Scoring texts with context-tree weighting over bytes, and with a word unigram base.

**Model.**  A text is its UTF-8 bytes with A-Z lower-cased and an end symbol (byte 255,
which UTF-8 never holds); before its first byte stand end symbols.  Each byte is eight
binary decisions.  Every decision has a context tree over the ``DEPTH`` bytes before it:
a node counts the zeros and ones seen in training, its Krichevsky-Trofimov estimate is
``(n + 1/2) / (n0 + n1 + 1)``, and a node mixes that estimate with its children's by the
weights that context-tree weighting gives after the training data.  ``score`` is the sum
of log10 probabilities; code length per byte follows from it.

**Scale.**  Counts are sums over all training documents, by Spark, for each distinct
gram (``DEPTH`` bytes and the next, seven at most, as they are half of the positive longs) and word; grams that occur only in held-out texts are
carried with zero counts, so each gram that is asked for has a value.  Trees below the
last ``SPLIT`` bytes are built in the tasks that hold all grams with these bytes, the
depths from there to 2 in tasks by the two last bytes; only the sums for shorter
contexts (at most 256 x 255 nodes) come to the driver.  Values of the most frequent terms,
``FREQUENT`` grams and half as many words at most, go to the scoring tasks as a hash table; the other terms
are joined by shuffle, where no key can be hot any more.  Words are looked up by hashes of 62
bits, grams by their own bytes.

Defined cases: null or empty text is one end token and one end symbol.  Without training
rows every count is zero.  A null ``doc_id`` counts as the empty text in crc32.  Rows
that repeat a ``doc_id`` are scored by their own text.  No other column is read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix64, prefix_hash, released, row_chunks, span_hash, table, text_bytes, word_spans, written
from .language import held_out

DEPTH, SPLIT = 5, 4
FREQUENT = (1 << 21) - 1
#: Bytes of text at a time; words and grams that a task gathers before it passes their sums on.
CHUNK, HELD = 1 << 20, 4 << 20
WORD, GRAM, DOCUMENT = 0, 1, 2
#: A gram is one long: its context, the last byte on top, and above it the symbol.  Words' keys are from _WORDS to 2**63.
_CONTEXT, _GRAM, _WORDS = np.uint64((1 << 8 * DEPTH) - 1), np.uint64((1 << 8 * (DEPTH + 1)) - 1), np.uint64(1 << 62)
END_WORD = np.int64(0x656E64 | int(_WORDS))


def _terms(buf: np.ndarray, off: np.ndarray):
    """Word keys with their rows, grams with their rows, and hashes of the whole rows."""
    low = LOWER[buf]
    rows = len(off) - 1
    size = np.diff(off)
    prefix = prefix_hash(low)
    start, end, word_row = word_spans(low, off)
    words = np.concatenate([((span_hash(prefix, start, end) >> np.uint64(2)) | _WORDS).view(np.int64), np.full(rows, END_WORD)])
    word_row = np.concatenate([word_row, np.arange(rows)])
    # DEPTH end symbols, the text, an end symbol
    padded = np.full(len(low) + (DEPTH + 1) * rows + 8, 255, np.uint8)
    row = np.repeat(np.arange(rows), size)
    at = np.arange(len(low)) + (DEPTH + 1) * row + DEPTH
    padded[at] = low
    ends = off[1:] + (DEPTH + 1) * np.arange(rows) + DEPTH
    at, gram_row = np.concatenate([at, ends]), np.concatenate([row, np.arange(rows)])
    grams = (np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))[at - DEPTH] & _GRAM).view(np.int64)
    return words, word_row, grams, gram_row, span_hash(prefix_hash(buf), off[:-1], off[1:]).view(np.int64)


def _summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their numbers in training texts and in all; each entry is a key and, as last bit, whether it is from a training text."""
    entries = np.concatenate(held)
    held.clear()
    entries.sort()
    new = np.flatnonzero(_runs(entries))
    n, entries = np.diff(np.append(new, len(entries))), entries[new]
    key = entries >> np.uint64(1)
    first = np.flatnonzero(_runs(key))
    return key[first].view(np.int64), np.add.reduceat(np.where(entries & np.uint64(1), n, 0), first), np.add.reduceat(n, first)


def counts(docs: DataFrame, apart) -> DataFrame:
    """kind, key, train (occurrences in training texts) and total of each word and gram."""

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            key, train, total = _summed(held)
            for i in range(0, len(key), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.record_batch([pa.array(key[part]), pa.array(train[part]), pa.array(total[part])], ["key", "train", "total"])

        for batch in batches:
            buf, off = text_bytes(batch.column(0))
            learn = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in row_chunks(off, CHUNK):
                words, word_row, grams, gram_row, _ = _terms(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                known = learn[i:j].astype(np.uint64)
                for key, row in ((words, word_row), (grams, gram_row)):
                    held.append((key.view(np.uint64) << np.uint64(1)) | known[row])
                if sum(map(len, held)) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    found = docs.select("text", apart.alias("apart")).mapInArrow(released(run), "key long, train long, total long")
    found = found.groupBy("key").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))
    return found.select(F.when(F.col("key") < int(_WORDS), GRAM).otherwise(WORD).alias("kind"), "key", "train", "total")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 1/2: Stirling's series at x + 8."""
    y = x + 8.0
    back = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - back


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


_COUNTS = np.arange(1 << 16, dtype=np.float64)
_HALF, _ONE = log_gamma(_COUNTS + 0.5) - 0.5 * math.log(math.pi), log_gamma(_COUNTS + 1.0)


def _log_kt_of_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``log_kt``, by tables for counts that are not large."""
    both = zeros + ones
    large = np.flatnonzero(both >= len(_COUNTS))
    top = len(_COUNTS) - 1
    zero, one, sums = (np.minimum(x, top).astype(np.int64) for x in (zeros, ones, both))
    kt = _HALF[zero] + _HALF[one] - _ONE[sums]
    kt[large] = log_kt(zeros[large], ones[large])
    return kt


def _weighted(kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    return math.log(0.5) + np.logaddexp(kt, below)


def _level(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
    """Nodes, counts, log weighted probabilities, own share in the mixture, and each input's node."""
    node, at = np.unique(node, return_inverse=True)
    zeros, ones = (np.bincount(at, x, len(node)) for x in (zeros, ones))
    kt = log_kt(zeros, ones)
    weighted = _weighted(kt, np.bincount(at, below, len(node)))
    return node, zeros, ones, weighted, np.exp(math.log(0.5) + kt - weighted), at


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where another run of equal values begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _forest(context: np.ndarray, symbol: np.ndarray, train: np.ndarray):
    """Trees below the last SPLIT bytes, of grams in order: for each bit of a byte the SPLIT-level nodes
    (last bytes, prefix, zeros, ones, log weighted probability), each gram's node there, its bit and its bit's chance."""
    context, symbol, seen = context.view(np.uint64), symbol.astype(np.int64), train.astype(np.float64)
    path, levels = np.arange(len(symbol)), [(np.arange(len(symbol)), np.arange(len(symbol)), context, symbol, seen)]
    for _ in range(DEPTH - SPLIT):
        context = context >> np.uint64(8)
        key, first, at = np.unique((np.cumsum(_runs(context)) << 8) | symbol, return_index=True, return_inverse=True)
        context, symbol, seen = context[first], key & 255, np.bincount(at, seen, len(key))
        path = at[path]
        levels.append((path, at, context, symbol, seen))
    own_symbol = levels[0][3]
    for b in range(8):
        below, heads, chance = None, None, None
        bit = (own_symbol >> (7 - b)) & 1
        for path, at, context, symbol, seen in levels:  # from the deepest
            prefix = (1 << b) | (symbol >> (8 - b))  # decisions of a byte, 1 to 255
            new = _runs(context, prefix)
            start, node = np.flatnonzero(new), np.cumsum(new) - 1
            ones = np.add.reduceat(np.where((symbol >> (7 - b)) & 1, seen, 0.0), start)
            zeros = np.add.reduceat(seen, start) - ones
            kt = _log_kt_of_counts(zeros, ones)
            if below is None:
                weighted, share = kt, np.ones(len(kt))
            else:
                weighted = _weighted(kt, np.bincount(node[at[heads]], below, len(start)))
                share = np.exp(math.log(0.5) + kt - weighted)
            below, heads, mine = weighted, start, node[path]
            zero = ((zeros + 0.5) / (zeros + ones + 1.0))[mine]
            own, share = np.where(bit == 0, zero, 1.0 - zero), share[mine]
            chance = own if chance is None else share * own + (1 - share) * chance
        yield (context[start].view(np.int64), prefix[start], zeros, ones, weighted), mine, bit, chance


def _by_group(rows: DataFrame, order: list[str], function, schema: str) -> DataFrame:
    """``function`` of the columns, as arrays, of all rows of some groups (first column) at a time."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            parts.append([c.to_numpy() for c in batch.columns])
            held += batch.num_rows
            if held > 100_000:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                done = int(np.searchsorted(columns[0], columns[0][-1]))  # the last group may go on
                if done:
                    yield function(*(c[:done] for c in columns))
                parts, held = [[c[done:] for c in columns]], len(columns[0]) - done
        if held:
            yield function(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    return rows.repartition(rows.columns[0]).sortWithinPartitions(*order).mapInArrow(released(run), schema)


def gram_values(grams: DataFrame) -> DataFrame:
    """key, total and value: the log10 probability of each gram's last byte after the others."""
    names = ["pair", "last", "prefix", "zeros", "ones", "below"]
    key = F.col("key").bitwiseAND(F.lit(int(_CONTEXT)))
    grams = grams.select(key.alias("key"), F.shiftrightunsigned("key", 8 * DEPTH).cast("int").alias("symbol"), "train", "total")
    last = F.shiftrightunsigned("key", 8 * (DEPTH - SPLIT)).alias("last")

    def summary(last, context, symbol, train):
        found = [np.concatenate(c) for c in zip(*(nodes for nodes, *_ in _forest(context, symbol, train)), strict=True)]
        return pa.record_batch([pa.array(found[0] >> (8 * (SPLIT - 2))), *map(pa.array, found)], names)

    split = _by_group(grams.select(last, "key", "symbol", "train"), ["last", "key", "symbol"], summary, "pair long, last long, prefix long, zeros double, ones double, below double")
    split = written(split, "context-nodes")

    def upper(last, prefix, zeros, ones, below):
        """The levels between SPLIT and 2, the first with each input's node."""
        node, levels, path = (last << 8) | prefix, [], np.arange(len(last))
        for _ in range(SPLIT - 2):
            node, zeros, ones, below, share, at = _level(((node >> 16) << 8) | (node & 255), zeros, ones, below)
            path = at[path]
            levels.append((path, zeros, ones, share))
        return levels, node, below

    def pairs(pair, last, prefix, zeros, ones, below):
        levels, node, below = upper(last, prefix, zeros, ones, below)
        return pa.record_batch([pa.array(node >> 16), pa.array(node & 255), pa.array(levels[-1][1]), pa.array(levels[-1][2]), pa.array(below)], ["byte", "prefix", "zeros", "ones", "below"])

    top = _by_group(split, names[:3], pairs, "byte long, prefix long, zeros double, ones double, below double")
    top = top.groupBy("byte", "prefix").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas()
    # depths 1 and 0: counts, own shares
    one, zero = np.zeros((3, 256, 256)), np.zeros((3, 256))
    below = np.zeros((256, 256))
    for i, name in enumerate(("zeros", "ones")):
        one[i, top.byte, top.prefix] = top[name]
    below[top.byte, top.prefix] = top.below
    kt = log_kt(one[0], one[1])
    weighted = _weighted(kt, below)
    one[2] = np.exp(math.log(0.5) + kt - weighted)
    zero[:2] = one[:2].sum(axis=1)
    kt = log_kt(zero[0], zero[1])
    zero[2] = np.exp(math.log(0.5) + kt - _weighted(kt, weighted.sum(axis=0)))
    shared = grams.sparkSession.sparkContext.broadcast((one, zero))

    def shallow(pair, last, prefix, zeros, ones, below):
        """What depths above SPLIT give for a zero, and the weight that they leave to the depths from there."""
        one, zero = shared.value
        byte = last >> (8 * (SPLIT - 1))
        levels = [(z[path], o[path], share[path]) for path, z, o, share in upper(last, prefix, zeros, ones, below)[0]]
        chance, weight = np.zeros(len(last)), np.ones(len(last))
        for z, o, share in (*levels, tuple(x[byte, prefix] for x in one), tuple(x[prefix] for x in zero)):
            chance = share * (z + 0.5) / (z + o + 1.0) + (1 - share) * chance
            weight = (1 - share) * weight
        return pa.record_batch([pa.array(last), pa.array(prefix), pa.array(chance), pa.array(weight)], ["last", "prefix", "chance", "weight"])

    nodes = _by_group(split, names[:3], shallow, "last long, prefix long, chance double, weight double")
    none, zero_long = F.lit(0.0), F.lit(0).cast("long")
    nodes = nodes.select("last", F.lit(0).alias("grade"), zero_long.alias("key"), F.col("prefix").cast("int").alias("symbol"), zero_long.alias("train"), zero_long.alias("total"), "chance", "weight")
    rows = nodes.union(grams.select(last, F.lit(1), "key", "symbol", "train", "total", none, none))

    def values(last, grade, context, symbol, train, total, above, weight):
        gram = grade == 1
        node = (last[~gram] << 8) | symbol[~gram]
        above, weight = above[~gram], weight[~gram]
        context, symbol, total = context[gram], symbol[gram], total[gram]
        value = np.zeros(len(context))
        for (ends, prefix, *_), mine, bit, chance in _forest(context, symbol, train[gram]):
            at = np.searchsorted(node, (ends << 8) | prefix)[mine]
            value += np.log10(np.where(bit == 0, above[at], 1.0 - weight[at] - above[at]) + weight[at] * chance)
        return pa.record_batch([pa.array(context | (symbol.astype(np.int64) << 8 * DEPTH)), pa.array(total), pa.array(value)], ["key", "total", "value"])

    return _by_group(rows, ["last", "grade", "key", "symbol"], values, "key long, total long, value double")


class Table:
    """Values by 64-bit key: open addressing, probed by all queries at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.key, self.value = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, values.dtype)
        self.full = np.zeros(1 << self.bits, bool)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = ~self.full[at]
            slot, first = np.unique(at[free], return_index=True)
            chosen = left[free][first]
            self.key[slot], self.value[slot], self.full[slot] = keys[chosen], values[chosen], True
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[first]] = False
            left, at = left[stay], at[stay]
            at = np.where(self.full[at], (at + 1) & (len(self.key) - 1), at)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are known."""
        at = self._slot(keys)
        hit = self.full[at] & (self.key[at] == keys)
        value, known = np.where(hit, self.value[at], 0.0).astype(np.float64), hit
        left = np.flatnonzero(~hit & self.full[at])
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.key) - 1)
            hit = self.full[at] & (self.key[at] == keys[left])
            value[left[hit]], known[left[hit]] = self.value[at[hit]], True
            stay = ~hit & self.full[at]
            left, at = left[stay], at[stay]
        return value, known


def _frequent(terms: DataFrame, kind: int, most: int) -> Table:
    """The values of the terms of a kind that are used most, ``most`` at most."""
    own = terms.filter(F.col("kind") == kind)
    level = F.floor(F.log2("total") * 16).alias("level")
    found, least = 0, None
    for row in sorted(own.groupBy(level).count().collect(), key=lambda r: -r["level"]):
        if found + row["count"] > most:
            break
        found, least = found + row["count"], row["level"]
    some = own.filter(F.lit(False) if least is None else F.floor(F.log2("total") * 16) >= least).select("key", "value").toArrow()
    # a gram's value in single precision, as their table is the larger one; words' values make up base_score
    return Table(some["key"].to_numpy(), some["value"].to_numpy().astype(np.float32 if kind == GRAM else np.float64))


def scored(docs: DataFrame, apart, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_symbols (bytes and the end)."""
    seen = written(counts(docs, apart), "terms")
    facts = seen.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    bottom = facts.n + (facts.v + 1)
    words = seen.filter(F.col("kind") == WORD).withColumn("value", F.log10((F.col("train") + 1) / F.lit(float(bottom))))
    grams = gram_values(seen.filter(F.col("kind") == GRAM).drop("kind")).select(F.lit(GRAM).alias("kind"), "key", F.lit(0).cast("long").alias("train"), "total", "value")
    terms = written(words.select("kind", "key", "train", "total", "value").union(grams), "values")
    shared = docs.sparkSession.sparkContext.broadcast({k: _frequent(terms, k, frequent // 2 if k == WORD else frequent) for k in (WORD, GRAM)})
    unseen = math.log10(1.5 / bottom)  # above the value of a word that training texts lack
    names = ["kind", "key", "doc_id", "mark", "held", "times", "tokens", "known", "base", "score"]

    def run(batches):
        tables = shared.value
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            for i, j in row_chunks(off, CHUNK):
                words, word_row, grams, gram_row, mark = _terms(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                rows = j - i
                sums, rest = {}, []
                for kind, keys, row in ((WORD, words, word_row), (GRAM, grams, gram_row)):
                    value, hit = tables[kind].find(keys)
                    sums[kind] = np.bincount(row, value, rows)
                    if kind == WORD:
                        known = np.bincount(row, hit & (value > unseen), rows).astype(np.int64)
                    key, at = keys[~hit], row[~hit]
                    order = np.lexsort((key, at))
                    key, at = key[order], at[order]
                    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])])) if len(key) else np.zeros(0, np.int64)
                    rest.append((kind, key[new], at[new], np.diff(np.append(new, len(key)))))
                zero = lambda n: np.zeros(n)
                doc, held = batch.column(0).slice(i, rows), batch.column(2).slice(i, rows)
                parts = [(DOCUMENT, mark, np.arange(rows), np.diff(off[i : j + 1]) + 1, np.bincount(word_row, minlength=rows), known, sums[WORD], sums[GRAM])]
                parts += [(kind, key, at, times, zero(len(key)).astype(np.int64), zero(len(key)).astype(np.int64), zero(len(key)), zero(len(key))) for kind, key, at, times in rest]
                for kind, key, at, times, tokens, familiar, base, score in parts:
                    take = pa.array(at)
                    yield pa.record_batch([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), doc.take(take), pa.array(mark[at]), held.take(take), pa.array(times), pa.array(tokens), pa.array(familiar), pa.array(base), pa.array(score)], names)

    schema = "kind int, key long, doc_id long, mark long, held boolean, times long, tokens long, known long, base double, score double"
    parts = docs.select("doc_id", "text", apart.alias("held")).mapInArrow(released(run), schema)
    parts = parts.join(terms.select("kind", "key", "train", "value"), ["kind", "key"], "left")
    add = F.col("times") * F.coalesce("value", F.lit(0.0))
    own = F.col("kind") == DOCUMENT
    per = parts.groupBy("doc_id", "mark", "held").agg(
        F.count_if(own).alias("rows"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("known") + F.when((F.col("kind") == WORD) & (F.col("train") > 0), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.when(F.col("kind") == WORD, add).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(F.col("kind") == GRAM, add).otherwise(0.0)).alias("score"),
        F.sum(F.when(own, F.col("times"))).alias("symbols"),
    )
    # equal rows have added up to so many times their own sums
    per = per.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    whole = lambda c: F.expr(f"{c} div rows")
    return per.select(
        "doc_id", F.col("held").alias("held_out"), whole("tokens").alias("n_tokens"), whole("known").alias("n_known"), F.lit(facts.n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"), whole("symbols").alias("n_symbols"),
    )


def op4_context_tree(spark, sf_dir):
    found = scored(table(spark, sf_dir, "documents"), held_out(7, 2))
    return found.withColumn("bits_per_byte", -F.col("score") / F.lit(math.log10(2)) / F.col("n_symbols"))
