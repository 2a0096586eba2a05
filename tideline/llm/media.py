"""Operator 4: baseline JPEG media columns.

`encode` stores bytes losslessly as 8-bit luminance samples: each sample is an 8x8 block of one grey, so its quantised
DC coefficient is the sample and the DC-only thumbnail of the image is the payload. Samples are palette indices
of the bytes, with frequent bytes in the middle, as neighbours are coded by their difference. Rows of 192 blocks end
in restart markers and Huffman tables are made for each image. Payloads too high for one image become several in a row.

`decode` reads any baseline JPEG: it parses the markers, cuts the scan at restart markers and decodes the Huffman
codes of all pieces of a slice in lockstep with numpy. AC coefficients are skipped; DC coefficients of the first
component are dequantised into the thumbnail, whose size and difference hash make the feature.

Defined cases: a null text is empty, and its payload one row of spaces; equal texts give equal values; repeated rows stay; a null doc_id
is kept; an empty table gives no rows; other columns are not read; bytes that are no baseline JPEG raise ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table

ROW = 192
#: Bytes by rough frequency in European prose; bytes not named follow in their own order.
FREQUENT = b" etaoinsrhldcu\xc3m.f,pgwybvk\nETAOINSRHLDCUMFPGWYBVKxjqz0123456789-'\"():;!?XJQZ\xc2\xe2\x80\xa9\xa8\xa0\xb3\xb1\xbc\xa4\xb6\x9f"
_ORDER = np.array([*FREQUENT, *(b for b in range(256) if b not in FREQUENT)])
_SAMPLE = np.empty(256, np.uint8)
_SAMPLE[_ORDER] = [128 + k // 2 if k % 2 == 0 else 128 - (k + 1) // 2 for k in range(256)]
_BYTE_OF = np.empty(256, np.uint8)
_BYTE_OF[_SAMPLE] = np.arange(256)
_SIZE = np.array([int(abs(d)).bit_length() for d in range(-255, 256)])


def code_lengths(counts: np.ndarray) -> list[int]:
    """Huffman code lengths of symbols (0: not used); the code of ones alone stays free, as the format asks."""
    heap = [(int(n), i, [i]) for i, n in enumerate(counts) if n] + [(0, len(counts), [len(counts)])]
    heapq.heapify(heap)
    lengths = [0] * (len(counts) + 1)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            lengths[i] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    # the free code must be a longest one; it is, as its count is the least
    return lengths[:-1]


def _table(lengths: list[int]) -> tuple[bytes, list[int]]:
    """A DHT body (counts by length, symbols in order) and the canonical code of each symbol."""
    order = sorted((n, i) for i, n in enumerate(lengths) if n)
    codes, code, last = [0] * len(lengths), 0, 0
    for n, i in order:
        code <<= n - last
        codes[i], code, last = code, code + 1, n
    return bytes(sum(n == k for n, _ in order) for k in range(1, 17)) + bytes(i for _, i in order), codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int, dc: bytes) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0, 8]) + b"\1" * 63),
            _segment(0xC0, struct.pack(">BHHB", 8, 8 * height, 8 * width, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, b"\0" + dc),
            _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0"),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def _shapes(rows: int) -> list[tuple[int, int]]:
    """(width, rows of ROW samples) of the images that hold so many rows; sides stay below the format's 65,536 pixels."""
    out, wide = [], 42
    while rows > 8190:
        high = min(rows // wide, 8190)
        out.append((wide * ROW, high * wide))
        rows -= high * wide
    return out + [(ROW, rows)] * (rows > 0)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One media value for each payload, whose length must be a positive multiple of ROW."""
    samples = _SAMPLE[np.frombuffer(b"".join(payloads), np.uint8)].reshape(-1, ROW).astype(np.int16)
    diff = np.diff(samples, axis=1, prepend=np.int16(128))
    size = _SIZE[diff + 255]
    images = [(w, n, i) for i, p in enumerate(payloads) for w, n in _shapes(len(p) // ROW)]
    ends = np.cumsum([n for _, n, _ in images])
    image = np.repeat(np.arange(len(images)), [n for _, n, _ in images])
    counts = np.bincount((image[:, None] * 9 + size).ravel(), minlength=9 * len(images)).reshape(-1, 9)
    code, length, heads = np.zeros((len(images), 9), np.int64), np.zeros((len(images), 9), np.int64), []
    for k, (w, n, _) in enumerate(images):
        length[k] = lengths = code_lengths(counts[k])
        body, code[k] = _table(lengths)
        heads.append(_head(w, n * ROW // w, body))
    at = image[:, None]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    value = (code[at, size] << size | extra) << 1  # the block ends at once: one 0 bit
    bits = length[at, size] + size + 1
    upto = np.cumsum(bits, axis=1)
    n_bytes = (upto[:, -1] + 7) // 8
    first = np.concatenate([[0], np.cumsum(n_bytes)])
    place = first[:-1, None] * 8 + upto - bits
    word = value << (32 - (place & 7) - bits)
    byte = (place >> 3).ravel()
    total = np.zeros(first[-1] + 4)
    for k in range(4):
        total += np.bincount(byte + k, weights=((word >> (24 - 8 * k)) & 255).ravel(), minlength=len(total))
    raw = total[: first[-1]].astype(np.int64)
    raw[first[1:] - 1] |= (1 << (first[1:] * 8 - first[:-1] * 8 - upto[:, -1])) - 1
    # room for a 0 behind each 255 and for a marker behind each row but an image's last
    row = np.repeat(np.arange(len(n_bytes)), n_bytes)
    inner = np.ones(len(n_bytes), bool)
    inner[ends - 1] = False
    marks = np.concatenate([[0], np.cumsum(2 * inner)])
    full = raw == 255
    moved = np.arange(len(raw)) + np.cumsum(full) - full + marks[row]
    out = np.zeros(len(raw) + int(full.sum()) + marks[-1], np.uint8)
    out[moved] = raw
    behind = np.concatenate([moved[first[1:] - 1] + 1 + full[first[1:] - 1]])
    turn = np.arange(len(n_bytes)) - np.repeat(np.concatenate([[0], ends[:-1]]), [n for _, n, _ in images])
    out[behind[inner]] = 0xFF
    out[behind[inner] + 1] = 0xD0 + turn[inner] % 8
    stop = behind[ends - 1]
    scans, done, media = out.tobytes(), 0, [[] for _ in payloads]
    for (_, _, i), head, end in zip(images, heads, stop.tolist(), strict=True):
        media[i] += [head, scans[done:end], b"\xff\xd9"]
        done = end
    return [b"".join(m) for m in media]


class _Image:
    """What the markers of one baseline image say, and where its scan is."""

    def __init__(self, media: bytes, at: int):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant, self.codes, self.interval, self.parts, at = {}, {}, 0, None, at + 2
        while True:
            if at + 4 > len(media) or media[at] != 0xFF:
                raise ValueError("broken marker")
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.codes[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        if not self.parts or len(used) != len(self.parts):
            raise ValueError("no frame, or a scan of only some components")
        self.scan = at
        if len(self.parts) == 1:
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.h, self.v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        #: for each block of a unit: component, DC table, AC table
        self.blocks = [(i, used[p[0]] >> 4, used[p[0]] & 15) for i, p in enumerate(self.parts) for _ in range(p[1] * p[2])]

    def place(self) -> tuple[np.ndarray, int, int]:
        """Thumbnail place of each first-component block in scan order, with the thumbnail's width and height."""
        _, h, v, _ = self.parts[0]
        y, x, b, a = np.meshgrid(np.arange(self.down), np.arange(self.across), np.arange(v), np.arange(h), indexing="ij")
        wide = self.across * h
        return ((y * v + b) * wide + x * h + a).ravel(), wide, self.down * v


def _lookup(tables: list[tuple[bytes, bytes]], bits: int) -> np.ndarray:
    """For each table, code length << 8 | symbol by the next `bits` bits; 0 where there is no code."""
    out = np.zeros((len(tables), 1 << bits), np.int32)
    for row, (counts, symbols) in zip(out, tables, strict=True):
        at = k = 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                step = 1 << (bits - n)
                row[at : at + step] = n << 8 | symbols[k]
                at, k = at + step, k + 1
    return out.ravel()


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each media value its images as (width, height, DC-only luminance thumbnail)."""
    images, owner, raws = [], [], []
    for i, m in enumerate(media):
        at = 0
        while at < len(m):
            image = _Image(m, at)
            end = image.scan
            while True:  # the end of the scan: a marker that is no restart
                end = m.find(b"\xff", end)
                if end < 0 or end + 1 >= len(m):
                    raise ValueError("no end of image")
                if m[end + 1] == 0xD9:
                    break
                if m[end + 1] != 0 and not 0xD0 <= m[end + 1] <= 0xD7:
                    raise ValueError("more than one scan")
                end += 2
            images.append(image)
            owner.append(i)
            raws.append(m[image.scan : end])
            at = end + 2
    out: list[list] = [[] for _ in media]
    if not images:
        return out
    scan = np.frombuffer(b"".join(raws), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    after = np.concatenate([scan[1:], [0]])
    mark = (scan == 255) & (after >= 0xD0) & (after <= 0xD7)
    drop = mark.copy()
    drop[1:] |= mark[:-1] | (scan[:-1] == 255) & (scan[1:] == 0)
    plain = np.concatenate([scan[~drop], np.zeros(8, np.uint8)])
    kept = np.concatenate([[0], np.cumsum(~drop)])
    begin = np.sort(np.concatenate([starts[:-1], np.flatnonzero(mark) + 2]))
    image = np.searchsorted(starts, begin, "right") - 1
    wide = plain.astype(np.uint64)
    window = wide[:-7] << np.uint64(40) | wide[1:-6] << np.uint64(32) | wide[2:-5] << np.uint64(24) | wide[3:-4] << np.uint64(16) | wide[4:-3] << np.uint64(8) | wide[5:-2]
    # tables and block patterns of all images side by side
    bits = max(max((n for n, c in enumerate(t[0], 1) if c), default=1) for x in images for t in x.codes.values())
    tables, unit, unit_at = [], [], []
    for x in images:
        number = {k: len(tables) + j for j, k in enumerate(x.codes)}
        tables += x.codes.values()
        unit_at.append(len(unit))
        unit += [(c, number[d], number[16 + a]) for c, d, a in x.blocks]
    codes, unit, unit_at = _lookup(tables, bits), np.array(unit), np.array(unit_at)
    per_unit = np.array([len(x.blocks) for x in images])
    units = np.array([x.across * x.down for x in images])
    interval = np.array([x.interval or x.across * x.down for x in images])
    nth = np.arange(len(begin)) - np.searchsorted(begin, starts[:-1])[image]
    todo = np.clip(units[image] - nth * interval[image], 0, interval[image]) * per_unit[image]
    lead = np.array([x.parts[0][1] * x.parts[0][2] for x in images])
    base = np.concatenate([[0], np.cumsum(units * lead)])
    dcs = np.zeros(base[-1], np.int64)
    write = base[:-1][image] + nth * interval[image] * lead[image]
    bit, block, coef = kept[begin] * 8, np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    before = np.zeros((len(begin), 4), np.int64)
    active = np.flatnonzero(todo)
    limit = len(window) - 1
    while len(active):
        at, img, k = bit[active], image[active], coef[active]
        which = unit[unit_at[img] + block[active] % per_unit[img]]
        is_dc = k == 0
        if (at >> 3 > limit).any():
            raise ValueError("scan ends early")
        x = (window[at >> 3] << (at & 7).astype(np.uint64)) & np.uint64((1 << 48) - 1)
        code = codes[np.where(is_dc, which[:, 1], which[:, 2]) << bits | (x >> np.uint64(48 - bits)).astype(np.int64)]
        n, symbol = code >> 8, code & 255
        if not n.all():
            raise ValueError("no such code")
        size = np.where(is_dc, symbol, symbol & 15).astype(np.int64)
        extra = ((x >> (48 - n - size).astype(np.uint64)) & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        bit[active] = at + n + size
        d = np.flatnonzero(is_dc)
        if len(d):
            value = np.where(extra[d] < (1 << size[d]) >> 1, extra[d] - (1 << size[d]) + 1, extra[d])
            rows, part = active[d], which[d, 0]
            before[rows, part] += value
            first = part == 0
            dcs[write[rows[first]]] = before[rows[first], 0]
            write[rows[first]] += 1
        skip = np.where(is_dc, 1, np.where(size > 0, (symbol >> 4) + 1, np.where(symbol == 0xF0, 16, 64)))
        k = k + skip
        done = k >= 64
        coef[active] = np.where(done, 0, k)
        block[active] += done
        if done.any():
            active = active[block[active] < todo[active]]
    for i, x, a, b in zip(owner, images, base[:-1], base[1:], strict=True):
        place, w, h = x.place()
        thumb = np.empty(w * h, np.uint8)
        thumb[place] = np.clip(np.round(dcs[a:b] * x.quant[x.parts[0][3]] / 8) + 128, 0, 255)
        out[i].append((x.width, x.height, thumb.reshape(h, w)))
    return out


def difference_hash(thumb: np.ndarray) -> str:
    """64 bits: whether each of 8x9 cells is brighter than the one before it in its row."""
    h, w = thumb.shape
    rows, columns = np.linspace(0, h, 9).astype(int), np.linspace(0, w, 10).astype(int)
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = thumb.cumsum(0, dtype=np.float64).cumsum(1)
    top, bottom, left, right = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), columns[:-1], np.maximum(columns[1:], columns[:-1] + 1)
    bottom, right = np.minimum(bottom, h), np.minimum(right, w)
    top, left = np.minimum(top, bottom - 1), np.minimum(left, right - 1)
    mean = (total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]) / np.outer(bottom - top, right - left)
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def _encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            raw = [(t or "").encode() for t in part.column(1).to_pylist()]
            media = encode([r + b" " * ((-len(r)) % ROW or (not r) * ROW) for r in raw])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "media"):
            media, rows = part.column(2).to_pylist(), []
            for d, n, m, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), media, thumbnails(media), strict=True):
                payload = b"".join(_BYTE_OF[t].tobytes() for _, _, t in found)
                feature = ";".join(f"{w}x{h}:{difference_hash(t)}" for w, h, t in found)
                rows.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, found[0][0], found[0][1]))
            kinds = [{"long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")])


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a media column for each row of docs(doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored images of media(doc_id, n_bytes, media) hold, and their sizes and thumbnail hashes."""
    return media.mapInArrow(_features, FEATURES)


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored(encode_texts(table(spark, sf_dir, "documents")), "media"))
