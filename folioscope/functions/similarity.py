"""Sequence alignment by ``difflib`` in Arrow UDFs, and inline differences by common subsequences.

``difflib`` with its popular-element rule is part of the method's results, so the library
itself is called on the workers, but for its ratio of two texts, which is counted here as it counts.
"""

from __future__ import annotations

import difflib
import itertools
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

#: Classes of characters in a bag: code points modulo this.
CLASSES = 64
CHUNKS = "array<struct<tag:string,lines_a:array<string>,lines_b:array<string>>>"


def token_set(a: str, b: str) -> float:
    """Token-set similarity from its definition, in [0, 1]; not compared with any library."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 1.0
    s, l_, r = len(" ".join(both)), " ".join(left), " ".join(right)
    k = 1 if s else 0
    row = [0] * (len(r) + 1)
    for ch in l_:
        before, diagonal = 0, 0
        for j, other in enumerate(r, 1):
            before, row[j] = row[j], diagonal + 1 if ch == other else max(row[j], row[j - 1])
            diagonal = before
    la, lb = s + k + len(l_), s + k + len(r)
    best = 1 - (len(l_) + len(r) - 2 * row[-1]) / (la + lb)
    if s:
        best = max(best, 1 - (k + len(l_)) / (s + la), 1 - (k + len(r)) / (s + lb))
    return best


def _places(text: str, chars) -> list[tuple[int, str]]:
    """Where a text has each of some characters, in order."""
    found = []
    for ch in chars:
        at = text.find(ch)
        while at >= 0:
            found.append((at, ch))
            at = text.find(ch, at + 1)
    found.sort()
    return found


#: Characters that are compared at a time where two texts go on being equal.
STRIDE = 64


def matched(a: str, b: str) -> int:
    """How many characters the matching blocks of ``difflib`` hold, with its rule of popular characters.

    The library looks at each character of ``a`` in each block again, and goes on from a match one by one; here
    popular characters, which begin no match, are passed over, and equal texts are compared as strings.
    """
    counts, most = Counter(b), len(b) // 100 + 1
    rare = [ch for ch, n in counts.items() if n <= most] if len(b) >= 200 else list(counts)
    where: dict[str, list[int]] = {}
    for j, ch in _places(b, rare):
        where.setdefault(ch, []).append(j)
    own = _places(a, where)
    starts = [i for i, _ in own]
    total, waiting = 0, [(0, len(a), 0, len(b))]
    while waiting:
        alo, ahi, blo, bhi = waiting.pop()
        x, y, size, last, runs = alo, blo, 0, -2, {}
        for k in range(bisect_left(starts, alo), bisect_left(starts, ahi)):
            i, ch = own[k]
            longer: dict[int, int] = {}
            if i != last + 1:
                runs = {}
            for j in where[ch]:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                n = longer[j] = runs.get(j - 1, 0) + 1
                if n > size:
                    x, y, size = i - n + 1, j - n + 1, n
            last, runs = i, longer
        # to both sides as far as the texts are equal
        while x - STRIDE >= alo and y - STRIDE >= blo and a[x - STRIDE : x] == b[y - STRIDE : y]:
            x, y, size = x - STRIDE, y - STRIDE, size + STRIDE
        while x > alo and y > blo and a[x - 1] == b[y - 1]:
            x, y, size = x - 1, y - 1, size + 1
        while x + size + STRIDE <= ahi and y + size + STRIDE <= bhi and a[x + size : x + size + STRIDE] == b[y + size : y + size + STRIDE]:
            size += STRIDE
        while x + size < ahi and y + size < bhi and a[x + size] == b[y + size]:
            size += 1
        if size:
            total += size
            if alo < x and blo < y:
                waiting.append((alo, x, blo, y))
            if x + size < ahi and y + size < bhi:
                waiting.append((x + size, ahi, y + size, bhi))
    return total


def sequence(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``."""
    whole = len(a) + len(b)
    return 2.0 * matched(a, b) / whole if whole else 1.0


METRICS = {"sequence": sequence, "token_set": token_set}


def similarity(a: Column, b: Column, metric: str = "sequence") -> Column:
    """0 if either side is empty or null, 1 if equal, else the metric."""
    measure = METRICS[metric]

    @pandas_udf("double")
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        found: dict = {}  # equal pairs of a batch are measured once
        for p, q in zip(x, y, strict=True):
            if (p, q) not in found:
                found[p, q] = measure(p, q) if p and q and p != q else 0.0
        return pd.Series([found[pq] for pq in zip(x, y, strict=True)], dtype=float)

    empty = a.isNull() | b.isNull() | (a == "") | (b == "")
    hard = ~empty & (a != b)
    return F.when(empty, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(udf(F.when(hard, a), F.when(hard, b)))


def _bounds(a: str, b: str):
    """Falling upper bounds of the sequence measure, then the measure itself."""
    if not a or not b:
        yield 0.0
    elif a == b:
        yield 1.0
    else:
        matcher = difflib.SequenceMatcher(None, a, b)
        yield matcher.real_quick_ratio()
        yield matcher.quick_ratio()
        yield matcher.ratio()


def measure(a: str, b: str, metric: str = "sequence") -> float:
    """0 if either side is empty or null, 1 if equal, else the metric."""
    return 0.0 if not a or not b else 1.0 if a == b else METRICS[metric](a, b)


def ceiling(a: str, b: str) -> float:
    """An upper bound of the sequence measure by lengths."""
    return 2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a and b else 0.0


def _titles(x: tuple, least: float, share: float, metric: str):
    """raw and core of (title a, title b, core a, core b), or nothing once ``least`` is out of reach."""
    if metric != "sequence":
        raw, core = (1.0 if p and p == q else METRICS[metric](p, q) if p and q else 0.0 for p, q in (x[:2], x[2:]))
        return {"raw": raw, "core": core} if share * raw + (1 - share) * core >= least else None
    raw = core = 1.0
    for core in _bounds(*x[2:]):
        if share * raw + (1 - share) * core < least:
            return None
    for raw in _bounds(*x[:2]):
        if share * raw + (1 - share) * core < least:
            return None
    return {"raw": raw, "core": core}


def title_scores(title_a: Column, title_b: Column, core_a: Column, core_b: Column, least: Column, share: float, metric: str) -> Column:
    """raw and core similarity, or null where ``share * raw + (1 - share) * core`` is below ``least``."""

    @pandas_udf("struct<raw:double,core:double>")
    def udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, m: pd.Series) -> pd.DataFrame:
        found = [_titles(x, y, share, metric) or {"raw": None, "core": None} for x, y in zip(zip(a, b, c, d, strict=True), m, strict=True)]
        return pd.DataFrame(found, columns=["raw", "core"], dtype="float64")

    told = udf(title_a, title_b, core_a, core_b, least)
    return F.when(told["raw"].isNotNull(), told)


class Leaders:
    """Texts in the order of their coming, asked for the first to which another has a sequence measure of ``least``.

    The measure counts characters of a common subsequence, so two texts that are close
    differ by at most ``(1 - least) * (la + lb)`` dropped and added characters.  A leader
    of length n, cut into one piece more than that can be at any length that is close, has a piece that the other
    text holds unbroken: leaders are indexed by their pieces.  Leaders with such a piece and
    a fitting length must then have enough characters in common, tested for all of them at a time;
    only what remains is aligned.  No text is compared with all leaders.
    """

    def __init__(self, least: float):
        self.least, self.texts = least, []
        self.pieces: dict[int, dict[str, list[int]]] = {}  # by size
        self.short: list[int] = []  # those that may be close without a piece in common
        self.bags, self.sizes = np.zeros((64, CLASSES), np.int32), np.zeros(64, np.int64)

    @staticmethod
    def bag(text: str) -> np.ndarray:
        return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES, minlength=CLASSES)

    def add(self, text: str) -> int:
        k, n = len(self.texts), len(text)
        self.texts.append(text)
        if k == len(self.sizes):
            self.bags, self.sizes = np.concatenate([self.bags, np.zeros_like(self.bags)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.bags[k], self.sizes[k] = self.bag(text), n
        # a close text has at most n * (2 - least) / least characters; a little more for rounding
        cuts = int(n * 2 * (1 - self.least) / self.least + 1e-6) + 1 if self.least > 0 else n + 1
        size = n // cuts
        if size == 0:
            self.short.append(k)
        else:
            own = self.pieces.setdefault(size, {})
            for at in range(cuts):
                own.setdefault(text[at * size : (at + 1) * size], []).append(k)
        return k

    def first(self, text: str) -> int | None:
        found: set[int] = set(self.short)
        for size, own in self.pieces.items():
            for at in range(len(text) - size + 1):
                found.update(own.get(text[at : at + size], ()))
        if not found:
            return None
        some = np.fromiter(found, np.int64, len(found))
        some.sort()
        whole = np.maximum(self.sizes[some] + len(text), 1)
        some, whole = some[keep := 2.0 * np.minimum(self.sizes[some], len(text)) / whole >= self.least], whole[keep]
        both = np.minimum(self.bags[some], self.bag(text).astype(np.int32)).sum(axis=1)
        for k in some[2.0 * both / whole >= self.least].tolist():
            if text == self.texts[k]:
                return k
            matcher = difflib.SequenceMatcher(None, text, self.texts[k])
            if matcher.quick_ratio() >= self.least and matcher.ratio() >= self.least:
                return k
        return None


def chunks(a: list[str], b: list[str], equal: bool) -> list[dict]:
    codes = difflib.SequenceMatcher(None, a, b).get_opcodes()
    return [{"tag": t, "lines_a": a[i:j], "lines_b": b[k:m]} for t, i, j, k, m in codes if equal or t != "equal"]


def structured_diff(a: Column, b: Column, equal: bool) -> Column:
    """Opcodes of two arrays of lines as chunks; with the equal ones or without.  Equal arrays never leave the JVM."""

    @pandas_udf(CHUNKS)
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else chunks(list(p), list(q), equal) for p, q in zip(x, y, strict=True)])

    none = F.expr("cast(array() as array<string>)")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    whole = F.array(F.struct(F.lit("equal").alias("tag"), a.alias("lines_a"), b.alias("lines_b"))).cast(CHUNKS)
    nothing = F.expr("array()").cast(CHUNKS)
    return F.when(a != b, udf(F.when(a != b, a), F.when(a != b, b))).when((F.size(a) > 0) & F.lit(equal), whole).otherwise(nothing)


def unified_diff(a: Column, b: Column, label_a: Column, label_b: Column) -> Column:
    @pandas_udf("string")
    def udf(x: pd.Series, y: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff([] if m is None else list(m), [] if n is None else list(n), fromfile=s or "", tofile=t or "", lineterm="")) for m, n, s, t in zip(x, y, p, q, strict=True)], dtype=object)

    return F.when(a == b, F.lit("")).otherwise(udf(a, b, label_a, label_b))


def change_ratio(a: Column, b: Column) -> Column:
    """1 - character ratio of the two texts, 6 digits."""

    @pandas_udf("double")
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1 - sequence(p, q) if p is not None and p != q else 0.0 for p, q in zip(x, y, strict=True)], dtype=float)

    return F.round(udf(a, b), 6)


def splitlines(c: Column) -> Column:
    """The lines of a text, as Python's ``str.splitlines`` cuts them."""
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    c = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?:{ends})\z", "\n")
    cut = F.split(c, ends)
    return F.when(c == "", F.expr("cast(array() as array<string>)")).otherwise(F.when(c.endswith("\n"), F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut))


def line_changes(a: Column, b: Column) -> Column:
    """added, removed and pairs: lines of the changed chunks of two texts, and the larger side of each replaced chunk."""
    chunk = structured_diff(splitlines(a), splitlines(b), False)
    left, right = F.transform(chunk, lambda c: F.size(c["lines_a"])), F.transform(chunk, lambda c: F.size(c["lines_b"]))
    total = lambda x: F.aggregate(x, F.lit(0), lambda n, k: n + k).cast("long")
    both = F.transform(chunk, lambda c: F.when(c["tag"] == "replace", F.greatest(F.size(c["lines_a"]), F.size(c["lines_b"]))).otherwise(0))
    return F.struct(total(right).alias("added"), total(left).alias("removed"), total(both).alias("pairs"))


class _Lengths:
    """Lengths of the longest common subsequence of ``old[i:]`` and ``new[j:]``, for every j at a time.

    A row is one integer: bit k stands for ``j = m - 1 - k`` and is set where dropping
    ``new[j]`` costs nothing.  Every ``step``-th row is kept; those between are made again
    when asked for, so about two square roots of the rows are held at a time.
    """

    def __init__(self, old: list[str], new: list[str]):
        self.old, self.m = old, len(new)
        self.full = (1 << self.m) - 1
        self.where: dict[str, int] = {}
        for k, token in enumerate(reversed(new)):
            self.where[token] = self.where.get(token, 0) | 1 << k
        self.step = max(1, math.isqrt(len(old)))
        self.kept, row = {len(old): self.full}, self.full
        for i in range(len(old) - 1, -1, -1):
            row = self._above(row, i)
            if i % self.step == 0:
                self.kept[i] = row
        self.block: dict[int, int] = {}

    def _above(self, row: int, i: int) -> int:
        hit = row & self.where.get(self.old[i], 0)
        return ((row + hit) | (row - hit)) & self.full

    def length(self, i: int, j: int) -> int:
        if i not in self.block:
            top = min(len(self.old), (i // self.step + 1) * self.step)
            row, self.block = self.kept[top], {top: self.kept[top]}
            for r in range(top - 1, i // self.step * self.step - 1, -1):
                row = self._above(row, r)
                self.block[r] = row
        left = self.m - j
        return left - (self.block[i] & ((1 << left) - 1)).bit_count()


def _inline_of(a: str, b: str) -> tuple[list, list]:
    """Tokens of both sides with what becomes of each; of two equally good ways the old token goes first."""
    old, new = (re.findall(r"\s+|\S+", s or "") for s in (a, b))
    same = 0
    while same < min(len(old), len(new)) and old[same] == new[same]:
        same += 1
    left = [("same", t) for t in old[:same]]
    right = list(left)
    old, new = old[same:], new[same:]
    lengths, i = _Lengths(old, new), 0
    for j, token in enumerate(new):
        # old tokens go as long as that costs no more than adding the new one
        while i < len(old) and old[i] != token and lengths.length(i + 1, j) >= lengths.length(i, j + 1):
            left.append(("del", old[i]))
            i += 1
        kept = i < len(old) and old[i] == token
        right.append(("same" if kept else "add", token))
        if kept:
            left.append(("same", token))
            i += 1
    left += [("del", t) for t in old[i:]]
    return left, right


def _spans(texts: list[list[tuple[str, str]]]) -> pa.Array:
    """Lists of op and token as an Arrow column."""
    flat = list(itertools.chain.from_iterable(texts))
    ends = pa.array(itertools.accumulate(map(len, texts), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in (0, 1)], ["op", "token"]))


#: Rows whose tokens a task holds as Python objects at a time.
TOKENIZED = 64


def inline_spans(x: pa.Array, y: pa.Array) -> pa.Array:
    """left and right of two columns of texts.  Few rows at a time are tokens in Python; what is done is kept as Arrow columns."""
    parts = []
    for k in range(0, max(len(x), 1), TOKENIZED):
        rows = [_inline_of(p, q) for p, q in zip(x[k : k + TOKENIZED].to_pylist(), y[k : k + TOKENIZED].to_pylist(), strict=True)]
        parts.append(pa.StructArray.from_arrays([_spans([r[s] for r in rows]) for s in (0, 1)], ["left", "right"]))
    return pa.concat_arrays(parts)


def inline_diff(a: Column, b: Column) -> Column:
    """left and right: tokens (words and white space) of each side with op ``same``, ``del`` or ``add``."""
    spans = "array<struct<op:string,token:string>>"

    @arrow_udf(f"struct<left:{spans},right:{spans}>")
    def udf(x: pa.Array, y: pa.Array) -> pa.Array:
        return inline_spans(x, y)

    return udf(a, b)
