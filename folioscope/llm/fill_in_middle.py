"""Fill-in-middle: texts cut at two token boundaries and put in another order.

**Method.**  Succinct rank and select.  The tokens are ``[A-Za-z]+|[^A-Za-z]``; the bytes at
which one starts are the bits of a packed vector over all texts of a chunk, with a
directory that holds the number of set bits before each block of 512.  The number of
tokens of a text is the difference of two ranks, and each cut is one ``select``: the
directory finds the block, and only that block is unpacked.  A second vector of code
point starts turns byte cuts into counts of characters.

``h1`` to ``h4`` are the first four groups of 8 digits of the hex sha256 of ``SEED:doc_id``.
The prefix ends after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` tokens, the
middle after the larger.  A text stays plain if it is empty, holds a sentinel, or
``h3 % 100 >= FORMED``; else it is ``spm`` if ``h4 % 100 < SUFFIX_FIRST`` and ``psm`` if not.

Each row stands alone: no shuffle, nothing held but a chunk of rows (or one long text).

Defined cases: null text is empty, so plain with n = 0; a null ``doc_id`` hashes as the
empty string; rows that repeat an id are cut by the same hash, each by its own number
of tokens.  Bytes that are no UTF-8 are bytes of the code point before them.  No other
column is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released, row_chunks, table, text_bytes

SEED = "1"
FORMED, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK = 512

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Bits:
    """A packed bit vector with the number of set bits before each block."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(-(-len(bits) // BLOCK) * BLOCK // 8 + BLOCK // 8, np.uint8)  # and an empty block, for ranks at the end
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.blocks = packed.reshape(-1, BLOCK // 8)
        counts = np.bitwise_count(self.blocks.view(np.uint64)).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def _unpacked(self, block: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.blocks[block], axis=1, bitorder="little")

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        block = at // BLOCK
        inside = np.arange(BLOCK) < (at % BLOCK)[:, None]
        return self.before[block] + (self._unpacked(block) & inside).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the set bit that ``k`` others precede."""
        block = np.searchsorted(self.before, k, "right") - 1
        nth = np.cumsum(self._unpacked(block), axis=1, dtype=np.int64) == (k - self.before[block] + 1)[:, None]
        return block * BLOCK + nth.argmax(axis=1)


def draws(doc_id) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def cuts(buf: np.ndarray, off: np.ndarray, first: np.ndarray, second: np.ndarray):
    """Per row: number of tokens, byte cuts and the characters before each, for two draws a row."""
    letter, opens = _LETTER[buf], (buf & 0xC0) != 0x80
    starts = opens & ~letter
    starts |= letter & ~np.concatenate([[False], letter[:-1]])
    head = off[:-1][np.diff(off) > 0]
    starts[head] = opens[head] = True
    tokens, points = Bits(starts), Bits(opens)
    before = tokens.rank(off)
    n = np.diff(before)
    a, b = first % (n + 1), second % (n + 1)
    found, chars = [], []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at, within = off[1:].copy(), k < n  # after the last token a text ends
        at[within] = tokens.select((before[:-1] + k)[within])
        found.append(at - off[:-1])
        chars.append(points.rank(at) - points.rank(off[:-1]))
    return n, found, chars


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "plain":
        return prefix + middle + suffix
    parts = [PREFIX + prefix, SUFFIX + suffix]
    return b"".join(parts if form == "psm" else parts[::-1]) + MIDDLE + middle


def rebuilt(form: str, output: bytes) -> bytes:
    """The text of an output.  Formed texts hold no sentinel, and none can arise across a cut: each begins with its only ``<``."""
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE)
    head, tail = rest.split(SUFFIX if form == "psm" else PREFIX)
    prefix, suffix = (head[len(PREFIX) :], tail) if form == "psm" else (tail, head[len(SUFFIX) :])
    return prefix + middle + suffix


def transformed(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if ``texts``, output."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            buf, off = text_bytes(batch.column(1))
            for i, j in row_chunks(off):
                drawn = np.array([draws(d) for d in ids[i:j]], np.int64)
                chunk, start = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                n, at, chars = cuts(chunk, start, drawn[:, 0], drawn[:, 1])
                rows = []
                for r in range(j - i):
                    text = chunk[start[r] : start[r + 1]].tobytes()
                    p, m = int(at[0][r]), int(at[1][r])
                    plain = not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or drawn[r, 2] % 100 >= FORMED
                    form = "plain" if plain else "spm" if drawn[r, 3] % 100 < SUFFIX_FIRST else "psm"
                    output = arranged(form, text[:p], text[p:m], text[m:])
                    size = (None, None) if plain else (int(chars[0][r]), int(chars[1][r] - chars[0][r]))
                    digests = (hashlib.sha256(x).hexdigest() for x in (output, rebuilt(form, output)))
                    rows.append((ids[i + r], int(n[r]), form, *size, *digests, output if texts else None))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output binary"
    out = docs.select("doc_id", "text").mapInArrow(released(run), schema)
    return out.withColumn("output", out["output"].cast("string")) if texts else out.drop("output")


def op12_fill_in_middle(spark, sf_dir):
    return transformed(table(spark, sf_dir, "documents"), texts=False)


ORACLE = {
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
    WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT doc_id, t, n, form, array_to_string(u[:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c"""
}
