"""Token ids in binary blocks, coded by an adaptive context-mixing range coder.

**Ids.**  Texts are cut where byte-level BPE never joins tokens, whatever follows: where a run
of letters, digits or punctuation ends.  Each distinct piece is encoded once per worker
by the tokenizers library; the ids of a text are those of its pieces in order, and an end id.
Texts that hold a special token, and all texts if the tokenizer's first step is another, stay whole.

**Blocks.**  Documents are sorted by ``doc_id``, or as the caller says; whole documents are packed into blocks of
about ``BLOCK_IDS`` ids.  A block is self-contained: magic, counts, the documents' ids
and lengths, checksums of the coded bytes and of the ids, then the code streams.

**Coder.**  A block's ids are cut into lanes that advance side by side and share one
model, reset for each block.  Order 2 and order 1 each predict one id from the ids
before, with a confidence; order 0 gives every id an adaptive frequency.  The mixing
weights of the three (order 2 right, order 1 right, neither) are adaptive too, learned
by pair of confidences.  Each lane has a carry-less range coder with 64 bits of state
and 32-bit output, so coding, its inverse and the model are numpy steps over all lanes.

Defined cases: null or empty text gives the end id alone; rows with a null ``doc_id``
come first; rows that repeat a ``doc_id`` follow one another in any order, each with its
own start.  Ids must be below 65,536.  Only ``doc_id`` and ``text`` are read.  A damaged
block raises ``ValueError``.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, released, row_chunks, shared_dir, table, text_bytes

BLOCK_IDS = 1 << 21
LANES, LANE_IDS = 8192, 64  # at most so many lanes, of at least so many ids
MAGIC = b"IDMX1\n"
#: Pieces of at most PIECE_BYTES bytes are kept by a worker, PIECES_KEPT at most, and LONG_KEPT longer ones.
PIECE_BYTES, PIECES_KEPT, LONG_KEPT = 16, 1 << 20, 1 << 16

# Classes of bytes.  Bytes of letters from U+00C0 to U+027F count as letters; all other bytes beyond ASCII, and controls, as OTHER.
OTHER, LETTER, DIGIT, MARK, BLANK, BREAK, QUOTE = range(7)
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = MARK
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58], _CLASS[32], _CLASS[9:14], _CLASS[39] = DIGIT, BLANK, BREAK, QUOTE
#: Between which classes a token always ends: where a run of letters, digits or marks ends.  A quote may begin a suffix.
_ENDS = np.zeros((8, 8), bool)
for _c in (LETTER, DIGIT, MARK):
    _ENDS[_c] = [d not in (OTHER, _c) for d in range(8)]
_ENDS[MARK, QUOTE] = False
_ENDS[QUOTE, [DIGIT, BLANK, BREAK]] = True
_KNOWN = np.array([c in (LETTER, DIGIT, MARK, QUOTE) for c in range(8)])
_tokenizers: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Pieces:
    """Ids of pieces of at most PIECE_BYTES bytes, by these bytes and their number: open addressing, all queries at a time."""

    def __init__(self):
        slots = 2 * PIECES_KEPT
        self.shift = np.uint64(65 - slots.bit_length())
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.n, self.at = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8), np.zeros(slots, np.int32)
        self.ids, self.used, self.count = np.zeros(1 << 16, np.uint16), 0, 0

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix64(low ^ mix64(high + np.uint64(0x9E3779B97F4A7C15))) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of each piece, or -1."""
        at = self.slots(low, high)
        out = np.where((self.low[at] == low) & (self.high[at] == high) & (self.size[at] == size), at, -1)
        left = np.flatnonzero((out < 0) & (self.size[at] > 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.size) - 1)
            hit = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (self.size[at] == size[left])
            out[left[hit]] = at[hit]
            stay = ~hit & (self.size[at] > 0)
            left, at = left[stay], at[stay]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
        """New pieces; each has n of the ids from where it begins."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint16)])
        self.ids[self.used : self.used + len(ids)] = ids
        begin = self.used + begin
        self.used, self.count = self.used + len(ids), self.count + len(n)
        left, at = np.arange(len(n)), self.slots(low, high)
        while len(left):
            free = self.size[at] == 0
            slot, first = np.unique(at[free], return_index=True)
            chosen = left[free][first]
            self.low[slot], self.high[slot], self.size[slot], self.n[slot], self.at[slot] = low[chosen], high[chosen], size[chosen], n[chosen], begin[chosen]
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[first]] = False
            left, at = left[stay], at[stay]
            at = np.where(self.size[at] > 0, (at + 1) & (len(self.size) - 1), at)


def _loaded(path: str) -> tuple:
    """The tokenizer, the byte length of each id, whether texts may be cut, patterns of special tokens, and the pieces known so far."""
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        if max(vocab.values(), default=0) >= 1 << 16:
            raise ValueError("ids of 65,536 and more are not supported")
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        length = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            length[i] = len(token.encode()) if token in special else len(token)
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        first = plan.get("pre_tokenizer") or {}
        cuts = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not plan.get("normalizer")
        _tokenizers[path] = tokenizer, length, cuts, sorted(special), Pieces(), {}
    return _tokenizers[path]


def _kinds(buf: np.ndarray) -> np.ndarray:
    kind = _CLASS[buf]
    wide = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC9))
    wide = wide[(buf[wide] > 0xC3) | ((buf[wide + 1] != 0x97) & (buf[wide + 1] != 0xB7))]  # the signs of multiplication and division
    kind[wide], kind[wide + 1] = LETTER, LETTER
    return kind


def _cut(kind: np.ndarray) -> np.ndarray:
    """Whether a token always begins at a byte, as those before it end there whatever follows."""
    cut = np.zeros(len(kind), bool)
    cut[1:] = _ENDS[kind[:-1], kind[1:]]
    one = np.flatnonzero(kind[1:-1] == BREAK) + 1  # a break alone is a token
    cut[one[_KNOWN[kind[one - 1]] & _KNOWN[kind[one + 1]]] + 1] = True
    return cut


def _encoded(buf: np.ndarray, other: np.ndarray, start: np.ndarray, size: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of some pieces of a text in a row, and where each piece's begin and how many they are; other: bytes before each that are no letters."""
    tokenizer, length, *_ = _loaded(path)
    blank = buf[start] == 32
    words = other[start + size] - other[start] == blank
    begin, count, out, used = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], 0

    def ids_of(texts):
        return [np.array(e.ids, np.uint16) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # words one after another are a text whose pieces they are again: each begins with a blank, or a line break is put before it
    at = np.flatnonzero(words)
    for i in range(0, len(at), 200):
        some = at[i : i + 200]
        gap = (~blank[some]).astype(np.int64)
        ends = np.cumsum(size[some] + gap)
        text = np.full(ends[-1], 10, np.uint8)
        inside = np.arange(size[some].sum()) + np.repeat(np.cumsum(gap), size[some])
        text[inside] = buf[np.arange(size[some].sum()) + np.repeat(start[some] - (np.cumsum(size[some]) - size[some]), size[some])]
        (ids,) = ids_of([text.tobytes().decode()])
        last = np.searchsorted(np.cumsum(length[ids]), ends) + 1
        first = np.concatenate([[0], last[:-1]]) + gap
        begin[some], count[some] = used + first, last - first
        out.append(ids)
        used += len(ids)
    at = np.flatnonzero(~words)
    if len(at):
        found = ids_of([buf[i : i + n].tobytes().decode() for i, n in zip(start[at].tolist(), size[at].tolist(), strict=True)])
        count[at] = list(map(len, found))
        begin[at] = used + np.cumsum(count[at]) - count[at]
        out += found
    return np.concatenate(out) if out else np.zeros(0, np.uint16), begin, count


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit ids of all texts, without end ids, and the texts' offsets in them; null is empty."""
    _, _, cuts, special, known, longs = _loaded(path)
    buf, off = text_bytes(texts)
    if not len(buf):
        return np.zeros(0, np.uint16), np.zeros(len(off), np.int64)
    whole = np.full(len(off) - 1, not cuts)
    for token in special:  # a text that holds one is a piece of its own
        whole |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
    kind = _kinds(buf)
    cut = _cut(kind) if cuts else np.zeros(len(buf), bool)
    other = np.zeros(len(buf) + 1, np.int32 if len(buf) < 1 << 31 else np.int64)
    np.cumsum(kind != LETTER, out=other[1:])
    for r in np.flatnonzero(whole):
        cut[off[r] : off[r + 1]] = False
    cut[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(buf)))
    padded = np.concatenate([buf, np.zeros(PIECE_BYTES, np.uint8)])
    words = np.ndarray(len(buf) + 8, "<u8", padded, strides=(1,))
    low, high = words[start] & _MASK[np.minimum(size, 8)], words[start + 8] & _MASK[np.clip(size - 8, 0, 8)]
    apart = size > PIECE_BYTES
    if whole.any():
        apart |= whole[np.searchsorted(off, start, "right") - 1]
    slot = known.find(low, high, size)
    slot[apart] = 0
    count, begin = known.n[slot].astype(np.int64), known.at[slot].astype(np.int64)
    pool = [known.ids[: known.used]]
    used = known.used
    new = np.flatnonzero(slot < 0)
    if len(new):
        new = new[np.argsort(mix64(low[new] ^ mix64(high[new])), kind="stable")]
        first = np.ones(len(new), bool)
        first[1:] = (low[new][1:] != low[new][:-1]) | (high[new][1:] != high[new][:-1]) | (size[new][1:] != size[new][:-1])
        one, each = new[first], np.cumsum(first) - 1
        ids, at, n = _encoded(buf, other, start[one], size[one], path)
        begin[new], count[new] = used + at[each], n[each]
        pool.append(ids)
        used += len(ids)
        room = PIECES_KEPT - known.count
        if room > 0:  # once full, those known stay
            one = one[:room]
            known.add(low[one], high[one], size[one], ids, at[:room], n[:room])
    at = np.flatnonzero(apart)
    if len(at):
        keys = [buf[i : i + n].tobytes() for i, n in zip(start[at].tolist(), size[at].tolist(), strict=True)]
        fresh = {k: i for i, k in zip(at.tolist(), keys, strict=True) if k not in longs}
        where = np.fromiter(fresh.values(), np.int64, len(fresh))
        ids, b, n = _encoded(buf, other, start[where], size[where], path)
        mine = {k: ids[i : i + m] for k, i, m in zip(fresh, b.tolist(), n.tolist(), strict=True)}
        found = [longs[k] if k in longs else mine[k] for k in keys]
        if len(longs) > LONG_KEPT:
            longs.clear()
        longs.update((k, v.copy()) for k, v in mine.items() if len(k) <= 8 * PIECE_BYTES)
        count[at] = list(map(len, found))
        begin[at] = used + np.cumsum(count[at]) - count[at]
        pool += found
    pool = np.concatenate(pool)
    ends = np.cumsum(count)
    ids = pool[np.arange(ends[-1]) + np.repeat(begin - (ends - count), count)]
    return ids, np.concatenate([[0], ends])[np.searchsorted(start, off)]


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


# --- the coder -----------------------------------------------------------------------

_U = np.uint64
_LOW32, _32 = _U(0xFFFFFFFF), _U(32)
ALPHABET = 1 << 16
ORDER2_BITS = 20
#: Together at most 2**31, so that a span of 2**32 or more is never split too finely.
FREQ_LIMIT, WEIGHT_LIMIT = 1 << 19, 1 << 11
GAIN0, REFRESH, GAIN, AGE = 12, 16, 6, 4


def _coded(lanes: int, steps: int, ids: np.ndarray | None, words: np.ndarray | None = None, counts: np.ndarray | None = None):
    """Codes ids (steps x lanes) into words and their counts by lane, or, with those, back into ids."""
    writing = ids is not None
    low, span = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    cursor = np.zeros(lanes, np.int64)
    if writing:
        out = np.zeros((steps + 4, lanes), np.uint32)
        size = int(ids.max(initial=0)) + 1
    else:
        ids = np.zeros((steps, lanes), np.uint16)
        size, words = int(words[0]), np.concatenate([words[1:], np.zeros(4, np.uint32)])
        cursor = np.cumsum(counts) - counts
        code = (words[cursor].astype(_U) << _32) | words[cursor + 1]
        cursor += 2
    freq = np.ones(size, np.int64)
    cum = np.arange(size + 1, dtype=np.uint32)
    owner = cum[:-1].copy()  # the id to which each unit of frequency belongs
    # a prediction and its confidence: id << 8 | 0 to 15
    order1, order2 = np.zeros(ALPHABET, np.uint32), np.zeros(1 << ORDER2_BITS, np.uint32)
    weight = np.ones((3, 512), np.int64)
    weight[2] = 4
    sums = weight.astype(_U)
    before, last = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    seen = np.zeros(1536, np.int64)
    for j in range(steps):
        if j % REFRESH == 0 and j:
            freq += GAIN0 * np.bincount(ids[j - REFRESH : j].ravel(), minlength=size)
            while freq.sum() > FREQ_LIMIT:
                freq = (freq + 1) >> 1
            np.cumsum(freq, out=cum[1:], dtype=np.uint32)
            if not writing:
                owner = np.repeat(np.arange(size, dtype=np.uint32), freq)
        if j % AGE == 0 and j:
            weight += GAIN * seen.reshape(3, 512)
            seen[:] = 0
            while (heavy := weight.sum(axis=0) > WEIGHT_LIMIT).any():
                weight[:, heavy] = (weight[:, heavy] + 1) >> 1
            sums = weight.astype(_U)
        whole = _U(cum[-1])
        key = ((before * np.uint32(0x9E3779B1)) ^ (last * np.uint32(0x85EBCA6B))) >> np.uint32(32 - ORDER2_BITS)
        p1, p2 = order1[last], order2[key]
        g1, g2, s1, s2 = p1 >> np.uint32(8), p2 >> np.uint32(8), p1 & np.uint32(15), p2 & np.uint32(15)
        mix = (s2 << np.uint32(5)) | (s1 << np.uint32(1)) | (g1 == g2)
        w0, w1, w2 = sums[0][mix], sums[1][mix], sums[2][mix]
        end0 = w0 * whole
        end1 = end0 + w1 * whole
        unit = span // (end1 + w2 * whole)
        if writing:
            now = ids[j].astype(np.uint32)
            two = now == g2
            one = (now == g1) & ~two
            none = ~(two | one)
            begin = cum[now]
            start, wide = end1 + w2 * begin, w2 * (cum[now + np.uint32(1)] - begin)
        else:
            value = (code - low) // unit
            two = value < end0
            one = (value < end1) & ~two
            none = ~(two | one)
            now = np.where(two, g2, g1)
            at = np.flatnonzero(none)
            now[at] = owner[np.minimum((value[at] - end1[at]) // w2[at], whole - _U(1)).astype(np.int64)]
            ids[j] = now
            begin = cum[now]
            start, wide = end1 + w2 * begin, w2 * (cum[now + np.uint32(1)] - begin)
        np.copyto(start, _U(0), where=two)
        np.copyto(start, end0, where=one)
        np.copyto(wide, end0, where=two)
        np.copyto(wide, end1 - end0, where=one)
        low += unit * start
        span = unit * wide
        at = np.flatnonzero(span <= _LOW32)
        if len(at):  # move out 32 bits; a span across their border ends there
            lo, sp = low[at], span[at]
            crosses = ((lo ^ (lo + sp - _U(1))) >> _32) != 0
            sp = np.where(crosses, (_LOW32 - (lo & _LOW32)) + _U(1), sp)
            if writing:
                out[cursor[at], at] = lo >> _32
            else:
                code[at] = (code[at] << _32) | words[cursor[at]]
            cursor[at] += 1
            low[at], span[at] = lo << _32, sp << _32
        seen += np.bincount(mix + one * np.uint32(512) + none * np.uint32(1024), minlength=1536)
        new = (now << np.uint32(8)) | np.uint32(1)
        for order, p, g, s, at in ((order1, p1, g1, s1, last), (order2, p2, g2, s2, key)):
            # right: surer by one; wrong: half as sure, and replaced once unsure
            order[at] = np.where(g == now, np.minimum(p + np.uint32(1), p | np.uint32(15)), np.where(s > 1, (p - s) | (s >> np.uint32(1)), new))
        before, last = last, now
    if not writing:
        return ids
    every = np.arange(lanes)
    for part in (low >> _32, low & _LOW32):
        out[cursor, every] = part
        cursor += 1
    used = np.arange(out.shape[0])[:, None] < cursor
    return np.concatenate([[np.uint32(size)], out.T[used.T]]), cursor


def pack(doc_ids: list, parts: list[bytes]) -> bytes:
    """One block of whole documents; parts: their ids as 16-bit integers."""
    ids = np.frombuffer(b"".join(parts), "<u2")
    lanes = max(1, min(LANES, len(ids) // LANE_IDS))
    steps = -(-len(ids) // lanes)
    grid = np.zeros(lanes * steps, np.uint16)
    grid[: len(ids)] = ids
    words, counts = _coded(lanes, steps, np.ascontiguousarray(grid.reshape(lanes, steps).T))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([len(p) // 2 for p in parts], "<u8").tobytes()
    body = index + counts.astype("<u4").tobytes() + words.astype("<u4").tobytes()
    return MAGIC + struct.pack("<QQQQII", len(doc_ids), len(ids), lanes, steps, zlib.crc32(body), zlib.crc32(ids.tobytes())) + body


def unpack(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and the ids of all documents of a block."""
    head = len(MAGIC) + 40
    if block[: len(MAGIC)] != MAGIC or len(block) < head:
        raise ValueError("not a block of token ids")
    docs, n, lanes, steps, crc, ids_crc = struct.unpack("<QQQQII", block[len(MAGIC) : head])
    if zlib.crc32(block[head:]) != crc:
        raise ValueError("damaged block")
    known = np.frombuffer(block, np.uint8, docs, head)
    at = head + docs
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    length = np.frombuffer(block, "<u8", docs, at + 8 * docs).astype(np.int64)
    at += 16 * docs
    counts = np.frombuffer(block, "<u4", lanes, at).astype(np.int64)
    words = np.frombuffer(block, "<u4", int(counts.sum()) + 1, at + 4 * lanes)
    ids = _coded(lanes, steps, None, words, counts).T.reshape(-1)[:n]
    if zlib.crc32(np.ascontiguousarray(ids, "<u2").tobytes()) != ids_crc:
        raise ValueError("block decodes to other ids")
    return [d if k else None for d, k in zip(doc_ids.tolist(), known, strict=True)], length, ids


# --- tables of blocks ----------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, order: tuple = ("doc_id",)) -> None:
    """The ids of all texts, ascending in ``order``, as a table of blocks at ``path``: part, first (ids before it in its part), n_ids, block."""
    tokenizer = tokenizer or default_tokenizer()
    end = struct.pack("<H", end_id)

    def run(batches):
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 0
        doc_ids, parts, size = [], [], 0

        def block():
            nonlocal first, doc_ids, parts, size
            out = pa.record_batch([pa.array([part], pa.int32()), pa.array([first]), pa.array([size]), pa.array([pack(doc_ids, parts)], pa.binary())], ["part", "first", "n_ids", "block"])
            first, doc_ids, parts, size = first + size, [], [], 0
            return out

        for batch in batches:
            for i, j in row_chunks(text_bytes(batch.column(1))[1]):
                ids, at = encoded(batch.column(1).slice(i, j - i), tokenizer)
                raw, at = ids.tobytes(), (2 * at).tolist()
                for k, doc_id in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    doc_ids.append(doc_id)
                    parts.append(raw[at[k] : at[k + 1]] + end)
                    size += len(parts[-1]) // 2
                    if size >= BLOCK_IDS:
                        yield block()
        if doc_ids:
            yield block()

    by = [F.col(c) if isinstance(c, str) else c for c in order]
    docs = docs.select("doc_id", "text", *[c.alias(f"_by{k}") for k, c in enumerate(by)])
    names = docs.columns[2:]
    ordered = docs.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")
    ordered.mapInArrow(released(run), "part int, first long, n_ids long, block binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a table of blocks: doc_id, start, n_tokens, ids_crc32 and ids (array<int>)."""
    blocks = spark.read.schema("part int, first long, n_ids long, block binary").parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, block = (batch.column(c)[i].as_py() for c in (0, 1, 2))
                doc_ids, length, ids = unpack(block)
                at = np.concatenate([[0], np.cumsum(length)])
                wide = np.ascontiguousarray(ids, "<u4")
                raw = wide.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(wide.view(np.int32)))
                yield pa.record_batch([pa.array([part] * len(crc), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + first), pa.array(length), pa.array(crc, pa.int64()), lists], ["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    rows = blocks.select("part", "first", "block").mapInArrow(released(run), "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids array<int>")
    return rows.join(bases, "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_table(docs: DataFrame, tokenizer: str | None = None, order: tuple = ("doc_id",)) -> DataFrame:
    """Writes ``docs`` as blocks in the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, order=order)
    return read(spark, path)


def op9_token_files(spark, sf_dir):
    return token_table(table(spark, sf_dir, "documents")).drop("ids")
