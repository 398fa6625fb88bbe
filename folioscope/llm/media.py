"""Media columns in baseline JPEG: payloads as DC coefficients, DC-only thumbnails.

A DC coefficient quantized by 8 is the mean of its 8 x 8 block exactly, so a grey image
whose blocks are flat keeps one byte per block without loss, and its DC-only luminance
thumbnail is the payload again.  :func:`stored` writes a text that way (192 blocks to a
row, one restart interval per row, the text's length in a comment segment; texts of
more than ``TILE_ROWS`` rows as several images one after another).  :func:`thumbnails`
reads any baseline JPEG, with several components and AC coefficients too: it parses the
markers, Huffman-decodes the scan and rebuilds the luminance DC values.  Restart
intervals are independent, so all intervals of many images are decoded side by side in
numpy, one symbol of each at a time.

Defined cases: null text is stored as empty text, which is one row of 192 spaces.  Equal
texts are stored alike.  Rows are independent; a null ``doc_id`` stays null.  Progressive
or 12-bit images, or bytes that are no JPEG, raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released, row_chunks, table, text_bytes

ROW = 192
TILE_ROWS = 8191  # 8 pixels each; a JPEG has at most 65,535

#: DC difference categories 0 to 8 by code length, the likely ones of text first.
DC_LENGTHS = {2: (4, 5, 6), 3: (3,), 4: (7,), 6: (0, 2), 7: (1, 8)}


def _canonical(lengths: dict[int, tuple[int, ...]]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length)."""
    out, code, last = {}, 0, 0
    for n in sorted(lengths):
        code <<= n - last
        last = n
        for symbol in lengths[n]:
            out[symbol] = (code, n)
            code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, tuple[int, ...]]) -> bytes:
    return _segment(0xC4, bytes([kind, *[len(lengths.get(n, ())) for n in range(1, 17)], *[s for n in sorted(lengths) for s in lengths[n]]]))


_TABLES = _segment(0xDB, bytes([0, 8, *[1] * 63]))
_CODES = _dht(0x00, DC_LENGTHS) + _dht(0x10, {1: (0,)}) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block, by its DC difference + 255: category, difference, end of block."""
    codes = _canonical(DC_LENGTHS)
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = codes[n]
        bits[d + 255] = ((code << n) | (d if d > 0 else d + (1 << n) - 1)) << 1
        size[d + 255] = length + n + 1
    return bits, size


_BITS, _SIZE = _block_codes()


def jpeg_rows(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all rows of ROW bytes, stuffed, and the rows' lengths; no markers."""
    rows = len(payload) // ROW
    value = payload.reshape(rows, ROW).astype(np.int16)
    diff = np.empty_like(value)
    diff[:, 0] = value[:, 0] - 128
    diff[:, 1:] = value[:, 1:] - value[:, :-1]
    diff += 255
    size = _SIZE[diff]
    end = np.cumsum(size, axis=1)
    bytes_ = (end[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(bytes_)])
    at = (end - size + (base[:-1] * 8)[:, None]).ravel()
    first, word = at >> 3, _BITS[diff].ravel() << (24 - size.ravel() - (at & 7)).astype(np.uint32)
    out = np.zeros(base[-1] + 2, np.uint8)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != first[:-1]
    new = np.flatnonzero(new)
    merged, cell = np.bitwise_or.reduceat(word, new), first[new]
    for k, shift in enumerate((16, 8, 0)):
        out[cell + k] |= (merged >> np.uint32(shift)).astype(np.uint8)
    out = out[: base[-1]]
    out[base[1:] - 1] |= ((1 << (bytes_ * 8 - end[:, -1])) - 1).astype(np.uint8)
    full = out == 255
    if full.any():
        before = np.concatenate([[0], np.cumsum(full)])
        stuffed = np.zeros(len(out) + before[-1], np.uint8)
        stuffed[np.arange(len(out)) + before[:-1]] = out
        return stuffed, np.diff(base + before[base])
    return out, bytes_


def encode(payload: np.ndarray, counts: list[int], lengths: list[int]) -> list[bytes]:
    """JPEG bytes for each of the payloads laid end to end; counts: their rows, lengths: their texts' bytes."""
    data, size = jpeg_rows(payload)
    data, ends = data.tobytes(), np.cumsum(size).tolist()
    out, row = [], 0
    for rows, length in zip(counts, lengths, strict=True):
        parts, left = [], rows
        while left:
            tile = min(left, TILE_ROWS)
            parts += [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", length)), _TABLES, _segment(0xC0, struct.pack(">BHHBBBB", 8, tile * 8, ROW * 8, 1, 1, 0x11, 0)), _CODES]
            for k in range(tile):
                parts += [data[ends[row - 1] if row else 0 : ends[row]], b"\xff\xd9" if k == tile - 1 else bytes([0xFF, 0xD0 + k % 8])]
                row += 1
            left -= tile
        out.append(b"".join(parts))
    return out


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """Length << 8 | symbol by the next 16 bits; 0 where there is no code."""
    table_, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            table_[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table_


_lookups: dict[bytes, np.ndarray] = {}


def parse(data: bytes, at: int) -> dict:
    """The markers of the image that begins at ``at``, up to its scan."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    quant, huff, out, at = {}, {}, {"interval": 0, "length": None}, at + 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if data[at : at + 1] != b"\xff" or at + 4 > len(data):
            raise ValueError("broken JPEG")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, out["height"], out["width"], n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError("not 8 bits a sample")
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            out["interval"] = int.from_bytes(body[:2], "big")
        elif marker == 0xFE and len(body) == 8:
            out["length"] = int.from_bytes(body, "big")
        elif marker == 0xDA:
            used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            parts = [p for p in out["parts"] if p[0] in used]
            if len(parts) == 1:
                parts = [(parts[0][0], 1, 1, parts[0][3])]
            out["scan"] = at
            # what two images must share to be decoded side by side
            out["kind"] = tuple((h, v, quant[q], huff[used[c] >> 4], huff[0x10 | used[c] & 15]) for c, h, v, q in parts)
            return out


def decode(data: bytes, images: list[dict]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail (rows x columns, uint8) of each parsed image in ``data``."""
    buf = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(buf[:-1] == 255)
    after = buf[ff + 1]
    restart = (after >= 0xD0) & (after <= 0xD7)
    stuffed, other = ff[after == 0] + 1, ff[(after != 0) & (after != 255) & ~restart]
    restart = ff[restart]
    keep = np.ones(len(buf), bool)
    keep[stuffed] = False
    plain = np.concatenate([buf[keep], np.full(8, 255, np.uint8)]).astype(np.uint32)
    word = (plain[:-2] << np.uint32(16)) | (plain[1:-1] << np.uint32(8)) | plain[2:]
    out: list = [None] * len(images)
    kinds: dict = {}
    for i, image in enumerate(images):
        kinds.setdefault((image["kind"], image["interval"]), []).append(i)
    for (kind, interval), members in kinds.items():
        scan = np.array([images[i]["scan"] for i in members])
        end = other[np.searchsorted(other, scan)]
        across, down = max(k[0] for k in kind), max(k[1] for k in kind)
        columns = np.array([-(-images[i]["width"] // (8 * across)) for i in members])
        units = columns * np.array([-(-images[i]["height"] // (8 * down)) for i in members])
        lo, hi = np.searchsorted(restart, scan), np.searchsorted(restart, end)
        lanes = hi - lo + 1
        owner = np.repeat(np.arange(len(members)), lanes)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.where(rank == 0, scan[owner], restart[np.minimum(np.repeat(lo, lanes) + rank - 1, max(len(restart) - 1, 0))] + 2 if len(restart) else scan[owner])
        todo = np.minimum(units[owner] - rank * interval, interval) if interval else units[owner]
        if (todo <= 0).any() or interval and (lanes != -(-units // interval)).any():
            raise ValueError("restart intervals don't match the size")
        pos = (start - np.searchsorted(stuffed, start)) * 8
        values = _scan(word, pos, todo, kind)
        first = np.concatenate([[0], np.cumsum(lanes)])
        h, v, quant = kind[0][:3]
        for m, i in enumerate(members):
            dc = np.concatenate([values[r][: todo[r]] for r in range(first[m], first[m + 1])]) if lanes[m] > 1 and interval != values.shape[1] or (todo[first[m] : first[m + 1]] != values.shape[1]).any() else values[first[m] : first[m + 1]].reshape(-1, h * v)
            grid = dc.reshape(-1, columns[m], v, h).transpose(0, 2, 1, 3).reshape(-1, columns[m] * h)
            image = images[i]
            height, width = -(-image["height"] * v // (8 * down)), -(-image["width"] * h // (8 * across))
            out[i] = np.clip(((grid[:height, :width] * quant + 4) >> 3) + 128, 0, 255).astype(np.uint8)
    return out


def _scan(word: np.ndarray, pos: np.ndarray, todo: np.ndarray, kind: tuple) -> np.ndarray:
    """DC values of the first component, lane x unit x block; every lane advances a symbol at a time."""
    tables = []
    for *_, dc, ac in kind:
        for spec in (dc, ac):
            if spec not in _lookups:
                _lookups[spec] = _lookup(spec[:16], spec[16:])
        tables.append((_lookups[dc], _lookups[ac]))
    most = int(todo.max())
    out = np.zeros((len(pos), most, kind[0][0] * kind[0][1]), np.int32)
    order = np.argsort(-todo, kind="stable")
    pos, active = pos[order], np.searchsorted(-todo[order], -np.arange(most), "left")
    values = np.zeros((most, out.shape[2], len(pos)), np.int32)
    last = np.zeros((len(kind), len(pos)), np.int32)

    def bits(p):
        return (word[p >> 3] >> (8 - (p & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    for unit in range(most):
        n = int(active[unit])
        p = pos[:n]
        for c, (h, v, *_) in enumerate(kind):
            dc, ac = tables[c]
            for block in range(h * v):
                code = dc[bits(p)]
                if not code.all():
                    raise ValueError("no such Huffman code")
                p = p + (code >> 8)
                size = code & 15
                extra = bits(p) >> (16 - size)
                p = p + size
                diff = extra - np.where(extra < (1 << size >> 1), (1 << size) - 1, 0)
                last[c, :n] += diff.astype(np.int32)
                if not c:
                    values[unit, block, :n] = last[c, :n]
                # AC: only their lengths matter
                code = ac[bits(p)]
                p = p + (code >> 8)
                if (code & 255).any():
                    k = np.ones(n, np.int64)
                    live = np.flatnonzero(code & 255)
                    code = code[live]
                    while len(live):
                        if not code.all():
                            raise ValueError("no such Huffman code")
                        p[live] += code & 15
                        k[live] += ((code >> 4) & 15) + 1
                        live = live[k[live] < 64]
                        code = ac[bits(p[live])]
                        p[live] += code >> 8
                        live, code = live[(code & 255) != 0], code[(code & 255) != 0]
        pos[:n] = p
    out[order] = values.transpose(2, 0, 1)
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are brighter than their mean."""
    rows, columns = thumb.shape
    cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), np.arange(8) * rows // 8, axis=0), np.arange(8) * columns // 8, axis=1)
    return np.packbits((cells * 64 > cells.sum()).ravel()).tobytes().hex()


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text of each row as JPEG bytes."""

    def run(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            for i, j in row_chunks(off, 2 << 20):
                size = np.diff(off[i : j + 1])
                rows = np.maximum(-(-size // ROW), 1)
                payload = np.full(int(rows.sum()) * ROW, 32, np.uint8)
                shift = np.repeat((np.cumsum(rows) - rows) * ROW - (off[i:j] - off[i]), size)
                payload[np.arange(len(shift)) + shift] = buf[off[i] : off[j]]
                media = encode(payload, rows.tolist(), size.tolist())
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(size), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_bytes long, media binary")


def thumbnails(media: list[bytes]) -> list[list[tuple[dict, np.ndarray]]]:
    """The parsed images and thumbnails that each media value holds, one after another."""
    data = b"".join(media)
    images, owner, at = [], [], 0
    for m, value in enumerate(media):
        end = at + len(value)
        while at < end:
            image = parse(data, at)
            images.append(image)
            owner.append(m)
            at = image["scan"]
            while True:  # to the end of the image
                at = data.find(b"\xff\xd9", at, end)
                if at < 0:
                    raise ValueError("JPEG without an end")
                at += 2
                break
        at = end
    out: list[list] = [[] for _ in media]
    for m, image, thumb in zip(owner, images, decode(data, images), strict=True):
        out[m].append((image, thumb))
    return out


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes themselves tell: read back, payload and thumbnail features of each row."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_images"]

    def run(batches):
        for batch in batches:
            values = batch.column(2)
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in values.to_pylist()])]) if len(values) else np.zeros(1, np.int64)
            for i, j in row_chunks(sizes, 3 << 20):
                part, rows = values.slice(i, j - i).to_pylist(), []
                for value, images in zip(part, thumbnails(part), strict=True):
                    payload = b"".join(t.tobytes() for _, t in images)
                    head = images[0][0]
                    rows.append((head["length"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(value), hashlib.sha256(value).hexdigest(), f"{head['width']}x{sum(x['height'] for x, _ in images)}:{thumbnail_hash(np.vstack([t for _, t in images]))}", len(images)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([batch.column(0).slice(i, j - i), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(released(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_images long")


def op1_media(spark, sf_dir):
    return features(stored(table(spark, sf_dir, "documents")))
