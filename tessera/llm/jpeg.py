"""Baseline JPEG media columns: marker parsing, Huffman decoding and DC-only thumbnails.

`decode` reads baseline (SOF0) streams: DQT, DHT, DRI, COM, SOS with one interleaved scan.
The entropy-coded bits of all images of a batch that share their tables are decoded in
lock-step with numpy: every restart interval of every image is one lane, and a step decodes
one symbol in each lane from a 16-bit lookup table.  The DC terms alone give the luminance
thumbnail at an eighth of the size; dimensions and thumbnail hashes are the stored features.

`encode_payload` writes any bytes losslessly as a baseline grey JPEG.  The format's unit is
the quantised coefficient: a 64-byte group is one block, and byte b is a coefficient of
category 8 (-255..-128 for b < 128, 128..255 else), whose eight magnitude bits are b itself.
Each block is a restart interval, so that DC differences are DC values.  The payload's
length is in a comment segment, as the last row of blocks may be filled up.

Defined results: a null text is an empty one (64 zero bytes); equal texts give equal bytes,
hashes and features; a text of any length up to 4 GB is one image; a null doc_id stays null and
repeated rows are rows of their own; an empty table gives an empty result; a stream that is not
baseline JPEG, or claims more blocks than its scan can hold, raises ValueError when it is decoded
and has null features in `thumbnail_features`, which carries all other columns along.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Zigzag order of the standard: natural index of the k-th coefficient.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: The side of a JPEG is 16 bits; whole blocks up to this.
MOST_BLOCKS = 8191
CHUNK_BYTES = 4_000_000


# ---- writing -------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(width: int, height: int, payload: int) -> bytes:
    # category 8 after no zeros has the one-bit code 0; end of block has 10
    dc = bytes([0, 1] + [0] * 15) + bytes([8])
    ac = bytes([0x10, 1, 1] + [0] * 14) + bytes([0x08, 0x00])
    return (
        b"\xff\xd8"
        + _segment(0xFE, struct.pack(">Q", payload))
        + _segment(0xDB, bytes([0]) + bytes([1] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, dc)
        + _segment(0xC4, ac)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode_payload(data: bytes) -> bytes:
    """A baseline grey JPEG that holds `data` (a positive multiple of 64 bytes)."""
    if not data or len(data) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    n = len(data) // 64
    across = min(MOST_BLOCKS, max(int(np.ceil(np.sqrt(n))), -(-n // MOST_BLOCKS)))
    down = -(-n // across)
    if down > MOST_BLOCKS:
        raise ValueError("too long for one image")
    blocks = np.zeros((across * down, 64), np.uint8)
    blocks[:n] = np.frombuffer(data, np.uint8).reshape(n, 64)
    bits = np.zeros((len(blocks), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(len(blocks), 64, 8)
    coded = np.packbits(bits.reshape(len(blocks), 576), axis=1)
    lane = np.empty((len(blocks), 74), np.uint8)
    lane[:, :72], lane[:, 72], lane[:, 73] = coded, 0xFF, 0xD0 + np.arange(len(blocks)) % 8
    flat = lane.reshape(-1)
    stuff = np.nonzero(coded == 0xFF)
    at = stuff[0] * 74 + stuff[1] + 1
    body = np.insert(flat, at, 0) if len(at) else flat
    return _header(across * 8, down * 8, len(data)) + body[:-2].tobytes() + b"\xff\xd9"


# ---- reading -------------------------------------------------------------------------------


@dataclass
class Frame:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    parts: tuple = ()  # (id, horizontal, vertical, quantisation table, dc table, ac table)
    quant: dict[int, bytes] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    comment: bytes = b""
    scan: int = 0  # where the entropy-coded data begin

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return (-(-self.width // 8), -(-self.height // 8)) if len(self.parts) == 1 else (-(-self.width // (8 * h)), -(-self.height // (8 * v)))

    @property
    def layout(self) -> tuple:
        """Of each block of an MCU: component, DC table, AC table."""
        if len(self.parts) == 1:
            return ((0, self.huffman[self.parts[0][4]], self.huffman[self.parts[0][5] | 16]),)
        return tuple((c, self.huffman[p[4]], self.huffman[p[5] | 16]) for c, p in enumerate(self.parts) for _ in range(p[1] * p[2]))


def parse(data: bytes) -> Frame:
    """Markers up to the start of the scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    f, at = Frame(), 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xC0:
            depth, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
            f.parts = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0) for i in range(n))
            if depth != 8 or not f.width or not f.height:
                raise ValueError("not baseline with a known size")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                f.huffman[body[0]], body = body[1 : 17 + n], body[17 + n :]
        elif marker == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                f.quant[body[0] & 15], body = bytes(body[1 : 1 + size]), body[1 + size :]
        elif marker == 0xDD:
            f.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            f.comment = bytes(body)
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            if not f.parts or set(tables) != {p[0] for p in f.parts}:
                raise ValueError("one scan with all components is expected")
            f.parts = tuple((*p[:4], *tables[p[0]]) for p in f.parts)
            f.scan = at
            return f
        elif marker == 0xD9:
            raise ValueError("no scan")


def lookup(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: code length (0: none) and symbol of a DHT table."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 16
    for bits in range(1, 17):
        for _ in range(spec[bits - 1]):
            a, b = code << (16 - bits), (code + 1) << (16 - bits)
            length[a:b], symbol[a:b] = bits, spec[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def _lanes(data: bytes, f: Frame) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, and where its restart intervals begin in it."""
    raw = np.frombuffer(data, np.uint8)[f.scan :]
    ff = np.nonzero(raw[:-1] == 0xFF)[0]
    after = raw[ff + 1]
    ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    end = int(ends[0]) if len(ends) else len(raw)
    ff, after = ff[ff < end], after[ff < end]
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    starts = np.concatenate(([0], marks + 2))
    place = np.cumsum(keep) - keep
    return raw[:end][keep], np.where(starts < end, place[np.minimum(starts, end - 1)], keep.sum())


def decode_coefficients(images: list[bytes], frames: list[Frame]) -> list[np.ndarray]:
    """Per image: blocks in scan order x 64 quantised coefficients in zigzag order."""
    out: list[np.ndarray | None] = [None] * len(images)
    alike: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        alike.setdefault((f.layout, bool(f.restart)), []).append(i)
    for (layout, _), members in alike.items():
        streams, starts, quota, lanes_of, base = [], [], [], [], 0
        for i in members:
            f = frames[i]
            body, begin = _lanes(images[i], f)
            total = f.mcus[0] * f.mcus[1]
            per = f.restart or total
            n = -(-total // per)
            if len(begin) < n:
                raise ValueError("restart intervals are missing")
            if total * len(layout) > 4 * len(body):  # a block has two codes of a bit at least
                raise ValueError("more blocks than the scan can hold")
            starts.append(begin[:n] + base)
            quota.append(np.minimum(per, total - per * np.arange(n)))
            lanes_of.append(n)
            streams.append(body)
            base += len(body)
        found = _lockstep(np.concatenate([*streams, np.full(8, 255, np.uint8)]), np.concatenate(starts) * 8, np.concatenate(quota), layout)
        at = 0
        counts = np.concatenate(quota) * len(layout)
        ends = np.concatenate(([0], np.cumsum(counts)))
        for i, n in zip(members, lanes_of, strict=True):
            out[i] = found[ends[at] : ends[at + n]]
            at += n
    return out  # type: ignore[return-value]


def _lockstep(stream: np.ndarray, bit: np.ndarray, quota: np.ndarray, layout: tuple) -> np.ndarray:
    """Decode all lanes together; blocks of a lane are consecutive rows of the result."""
    tables = {spec: lookup(spec) for _, dc, ac in layout for spec in (dc, ac)}
    first = np.concatenate(([0], np.cumsum(quota * len(layout))[:-1]))
    out = np.zeros((int((quota * len(layout)).sum()), 64), np.int16)
    # 32 bits from every byte on: a code and its magnitude bits never need more than 7 + 16 + 11 = 34, so both are peeked apart
    wide = stream.astype(np.uint32)
    window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    last = len(window) - 1
    bit = bit.astype(np.int64).copy()
    predictor = np.zeros((len(bit), 1 + max(c for c, _, _ in layout)), np.int64)

    def peek(at: np.ndarray, n) -> np.ndarray:
        return (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - n)

    def magnitude(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        v = (peek(at, 16) >> (16 - size).astype(np.uint32)).astype(np.int64)
        return np.where(size == 0, 0, np.where(v < (1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v))

    for mcu in range(int(quota.max(initial=0))):
        lane = np.nonzero(quota > mcu)[0]
        for b, (component, dc, ac) in enumerate(layout):
            row = first[lane] + mcu * len(layout) + b
            at = bit[lane]
            length, symbol = (t[peek(at, 16)] for t in tables[dc])
            if not length.all():
                raise ValueError("bad Huffman code")
            at += length
            size = symbol.astype(np.int64)
            predictor[lane, component] += magnitude(at, size)
            out[row, 0] = predictor[lane, component]
            at += size
            k, live = np.ones(len(lane), np.int64), np.arange(len(lane))
            while len(live):
                pos = at[live]
                length, symbol = (t[peek(pos, 16)] for t in tables[ac])
                if not length.all():
                    raise ValueError("bad Huffman code")
                pos += length
                size, run = (symbol & 15).astype(np.int64), (symbol >> 4).astype(np.int64)
                place = k[live] + run
                coded = (size > 0) & (place < 64)
                value = magnitude(pos, size)
                out[row[live[coded]], place[coded]] = value[coded]
                at[live] = pos + size
                k[live] = np.where((size == 0) & (run < 15), 64, place + 1)
                live = live[k[live] < 64]
            bit[lane] = at
    return out


def thumbnail(coefficients: np.ndarray, f: Frame) -> np.ndarray:
    """DC-only luminance at an eighth of the size, as bytes."""
    across, down = f.mcus
    h, v = (1, 1) if len(f.parts) == 1 else f.parts[0][1:3]
    per = 1 if len(f.parts) == 1 else sum(p[1] * p[2] for p in f.parts)
    q = f.quant[f.parts[0][3]]
    q0 = q[0] if len(q) == 64 else int.from_bytes(q[:2], "big")
    dc = coefficients[:, 0].reshape(down, across, per)[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    grey = np.clip(np.rint(dc.astype(np.float64) * q0 / 8 + 128), 0, 255).astype(np.uint8)
    return grey[: -(-f.height // 8), : -(-f.width // 8)]


def thumbnail_hash(grey: np.ndarray) -> str:
    """Average hash: the 64 bits of an 8 x 8 area mean against their mean, as hex."""
    rows, cols = (np.arange(8) * n // 8 for n in grey.shape)

    def mean(a: np.ndarray, cuts: np.ndarray, axis: int) -> np.ndarray:
        ends = np.maximum(np.append(cuts[1:], a.shape[axis]), cuts + 1)
        total = np.concatenate([np.zeros_like(np.take(a, [0], axis)), np.cumsum(a, axis=axis)], axis=axis)
        size = (ends - cuts).reshape((-1, 1) if axis == 0 else (1, -1))
        return (np.take(total, ends, axis) - np.take(total, cuts, axis)) / size

    small = mean(mean(grey.astype(np.float64), rows, 0), cols, 1)
    return np.packbits(small.reshape(-1) > small.mean()).tobytes().hex()


def payload_of(coefficients: np.ndarray, f: Frame) -> bytes:
    """The bytes that encode_payload stored."""
    c = coefficients.reshape(-1)
    data = np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()
    return data[: struct.unpack(">Q", f.comment)[0]]


# ---- Spark ---------------------------------------------------------------------------------


def thumbnail_features(media: DataFrame, column: str = "media") -> DataFrame:
    """`media` (any columns, JPEG bytes in `column`) with width, height, thumb_sha256, thumb_hash; null where unreadable.

    A feature whose name the table has already gets underscores behind it, until the name is free.
    """
    taken = {c.lower() for c in media.columns}
    free = lambda name: free(f"{name}_") if name in taken else name

    @F.pandas_udf("width int, height int, thumb_sha256 string, thumb_hash string")
    def features(images: pd.Series) -> pd.DataFrame:
        rows = []
        for data in images:
            try:
                f = parse(bytes(data))
                grey = thumbnail(decode_coefficients([bytes(data)], [f])[0], f)
                rows.append((f.width, f.height, hashlib.sha256(grey.tobytes()).hexdigest(), thumbnail_hash(grey)))
            except (ValueError, TypeError, KeyError, IndexError, struct.error):
                rows.append((None, None, None, None))
        out = pd.DataFrame(rows, columns=["width", "height", "thumb_sha256", "thumb_hash"])
        return out.astype({"width": "Int32", "height": "Int32"})

    rows = media.select(F.struct("*").alias("row"), features(F.col(f"`{column}`")).alias("found"))
    return rows.select("row.*", *(F.col(f"found.{name}").alias(free(name)) for name in ("width", "height", "thumb_sha256", "thumb_hash")))


def store_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a JPEG of its UTF-8 bytes, filled up to a positive multiple of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                media = [encode_payload(t + bytes(-len(t) % 64 if t else 64)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Decode `media` (doc_id, n_bytes, media): digests of the payload read back and of the stored form, and features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(images: list[bytes]) -> list[tuple]:
        frames = [parse(x) for x in images]
        rows = []
        for x, f, c in zip(images, frames, decode_coefficients(images, frames), strict=True):
            payload, grey = payload_of(c, f), thumbnail(c, f)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(x), hashlib.sha256(x).hexdigest(), f"{f.width}x{f.height}:{thumbnail_hash(grey)}"))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images, rows, held = [], [], 0
            for x in b.column(2).to_pylist():  # lock-step over a few MB at a time
                images.append(x)
                held += len(x)
                if held >= CHUNK_BYTES:
                    rows += digest(images)
                    images, held = [], 0
            rows += digest(images)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store_payloads(table(spark, sf_dir, "documents")))
