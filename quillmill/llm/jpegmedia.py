"""Media columns: baseline JPEG images and DC-only luminance thumbnails.

``encode`` stores a payload without loss: each byte is one 8x8 block of equal samples, whose DC
coefficient, quantised by 8, is the byte less 128 and whose AC coefficients are all 0. An image is
192 blocks wide; payloads of more than 192 x 8191 bytes become several images, one after another.
``thumbnails`` reads any baseline JPEG (also several in a row, grey or in colour, with AC
coefficients and restart intervals): it parses the markers, decodes the Huffman-coded scans of
many restart intervals in step in numpy, and gives the luminance DC of each block as a sample,
without an inverse cosine transform. For images of ``encode`` those samples are the payload.

Cases: null text is empty text; an empty payload is padded to 192 bytes. Equal texts give equal
values. Whole texts of any length are stored. Progressive, 12-bit, lossless and cut-off files
raise ``ValueError``.
"""

import hashlib
import struct
import zlib
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fields

#: Blocks in a row, most rows of an image (65,535 / 8), blocks between restart markers.
WIDTH, MOST_ROWS, RESTART = 192, 8191, 192
#: Numbers of DC luminance codes of each length from 1 to 16, and their categories (ITU-T T.81, table K.3).
DC_LENGTHS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_VALUES = bytes(range(12))
#: One AC code, of one bit: end of block.
AC_LENGTHS, AC_VALUES = bytes([1] + [0] * 15), bytes([0])


def canonical(lengths: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """Codes as T.81 C.2 assigns them: value -> (code, length)."""
    code, k, out = 0, 0, {}
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[values[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block with each DC difference from -255 to 255 and no AC."""
    dc, (end, end_n) = canonical(DC_LENGTHS, DC_VALUES), canonical(AC_LENGTHS, AC_VALUES)[0]
    bits, sizes = np.zeros(511, dtype=np.int32), np.zeros(511, dtype=np.int32)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = dc[s]
        extra = d if d >= 0 else d + (1 << s) - 1
        bits[d + 255] = (((code << s) | extra) << end_n) | end
        sizes[d + 255] = n + s + end_n
    return bits, sizes


_BITS, _SIZES = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    quant = bytes([0]) + bytes([8] + [1] * 63)
    return (
        b"\xff\xd8"
        + _segment(0xDB, quant)
        + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, bytes([0x00]) + DC_LENGTHS + DC_VALUES)
        + _segment(0xC4, bytes([0x10]) + AC_LENGTHS + AC_VALUES)
        + _segment(0xDD, struct.pack(">H", RESTART))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode_many(payloads: list[np.ndarray]) -> list[bytes]:
    """One JPEG stream for each payload (bytes, a positive multiple of 192)."""
    parts = [(i, p[a : a + WIDTH * MOST_ROWS]) for i, p in enumerate(payloads) for a in range(0, len(p), WIDTH * MOST_ROWS)]
    samples = np.concatenate([p for _, p in parts]).astype(np.int16)
    first = np.arange(len(samples)) % RESTART == 0  # images are a multiple of RESTART blocks
    before = np.empty_like(samples)
    before[1:] = samples[:-1]
    before[first] = 128
    which = samples - before + 255
    bits, sizes = _BITS[which], _SIZES[which]
    # Each interval starts at a byte; what is left of its last byte is filled with ones.
    per = sizes.reshape(-1, RESTART).sum(axis=1, dtype=np.int64)
    bytes_of = (per + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(bytes_of)])
    ends = np.cumsum(sizes, dtype=np.int64)
    offset = ends - sizes - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), RESTART) + np.repeat(begin[:-1] * 8, RESTART)
    at = offset >> 3
    wide = bits << (24 - sizes - (offset & 7).astype(np.int32))  # codes have 17 bits at most: three bytes hold one that starts in the first
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at, wide = at[new], np.add.reduceat(wide, new)  # codes that start in one byte share no bit
    data = np.zeros(int(begin[-1]) + 3, dtype=np.uint8)
    for k in range(3):
        data[at + k] |= ((wide >> (16 - 8 * k)) & 255).astype(np.uint8)
    data = data[: begin[-1]]
    data[begin[1:] - 1] |= ((1 << (bytes_of * 8 - per)) - 1).astype(np.uint8)
    # A zero byte after each 0xFF, then a restart marker after each interval.
    full = data == 0xFF
    moved = np.concatenate([[0], np.cumsum(full)])
    stuffed = np.zeros(len(data) + moved[-1], dtype=np.uint8)
    stuffed[np.arange(len(data)) + moved[:-1]] = data
    edges = begin + moved[begin]
    out, k, raw = [b""] * len(payloads), 0, stuffed.tobytes()
    for i, p in parts:
        n = len(p) // RESTART
        scan = b"".join(raw[edges[k + j] : edges[k + j + 1]] + (bytes([0xFF, 0xD0 + j % 8]) if j < n - 1 else b"\xff\xd9") for j in range(n))
        out[i] += _head(len(p) // WIDTH) + scan
        k += n
    return out


class _Frame:
    """One image: what its markers say, and the byte ranges of its restart intervals."""

    def __init__(self):
        self.quant: dict[int, int] = {}
        self.tables: dict[int, tuple[bytes, bytes]] = {}
        self.components: list[tuple[int, int, int, int]] = []
        self.width = self.height = self.restart = 0
        self.order: list[tuple[int, bytes, bytes]] = []  # of the blocks of an MCU: component, DC table, AC table
        self.intervals: list[bytes] = []


def parse(stream: bytes) -> list[_Frame]:
    """The images of a stream of baseline JPEGs."""
    frames, at, frame = [], 0, None
    while at < len(stream):
        if stream[at] != 0xFF or at + 1 >= len(stream):
            raise ValueError(f"no marker at byte {at}")
        kind, at = stream[at + 1], at + 2
        if kind == 0xFF:
            at -= 1
            continue
        if kind == 0xD8:
            frame = _Frame()
            continue
        if kind == 0xD9 and frame is not None:
            frames.append(frame)
            frame = None
            continue
        if frame is None or at + 2 > len(stream):
            raise ValueError(f"unexpected marker {kind:02x}")
        size = struct.unpack_from(">H", stream, at)[0]
        body, at = stream[at + 2 : at + size], at + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                frame.quant[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                frame.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            frame.restart = struct.unpack(">H", body)[0]
        elif kind in (0xC0, 0xC1):
            bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only samples of 8 bits")
            frame.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("not a baseline image")
        elif kind == 0xDA:
            if not frame.components or body[0] != len(frame.components):
                raise ValueError("a scan must hold all components")
            for i in range(body[0]):
                _, h, v, _ = next(c for c in frame.components if c[0] == body[1 + 2 * i])
                tables = body[2 + 2 * i]
                frame.order += [(i, frame.tables[tables >> 4], frame.tables[16 + (tables & 15)])] * (h * v if body[0] > 1 else 1)
            start = begin = at
            while True:
                at = stream.find(b"\xff", at)
                if at < 0 or at + 1 >= len(stream):
                    raise ValueError("the scan has no end")
                mark = stream[at + 1]
                if 0xD0 <= mark <= 0xD7 or mark not in (0, 0xFF):
                    frame.intervals.append(stream[begin:at].replace(b"\xff\x00", b"\xff"))
                    if not 0xD0 <= mark <= 0xD7:
                        break
                    begin = at + 2
                at += 2 if mark != 0xFF else 1
            if start == at:
                raise ValueError("an empty scan")
    if frame is not None:
        raise ValueError("the image has no end")
    return frames


_LOOKUPS: dict[tuple[bytes, bytes], np.ndarray] = {}


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16 bits that may come next: 256 x code length + value."""
    if table not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        out = np.zeros(1 << 16, dtype=np.int32)
        for value, (code, n) in canonical(*table).items():
            out[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + value
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


def _dc_of(intervals: list[bytes], blocks: int, order, component: int) -> np.ndarray:
    """Quantised DC values of ``component``'s blocks in each interval. All intervals have ``blocks``
    blocks of it and share ``order``; they advance in step, a symbol at a time."""
    raw = b"".join(x + b"\xff" * 8 for x in intervals)
    window = np.ndarray(len(raw) - 7, dtype=">u8", buffer=raw, strides=(1,))  # 64 bits from each byte on
    sizes = np.fromiter(map(len, intervals), dtype=np.int64, count=len(intervals)) + 8
    p = (np.cumsum(sizes) - sizes) * 8
    end = p + (sizes - 8) * 8
    keep = [j for j, (c, _, _) in enumerate(order) if c == component]
    out = np.zeros((blocks, len(intervals)), dtype=np.int64)
    top = np.uint64(48)

    def symbol(lookup: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = lookup[w >> top]
        if not found.all():
            raise ValueError("a code that no table has")
        return found >> 8, found & 255

    place = 0
    for step in range(blocks * len(order) // len(keep)):
        c, dc, ac = order[step % len(order)]
        w = window[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        size, s = symbol(_lookup(dc), w)
        w <<= size.astype(np.uint64)
        if c == component:
            extra = ((w >> np.uint64(32)) >> (32 - s).astype(np.uint64)).astype(np.int64)
            out[place] = np.where(w >> np.uint64(63), extra, extra - (1 << s) + 1) * (s > 0)
            place += 1
        w <<= s.astype(np.uint64)
        p = p + size + s
        lookup, busy, k = _lookup(ac), None, 1
        while busy is None or len(busy):
            if busy is not None:
                q = p[busy]
                w = window[q >> 3].astype(np.uint64) << (q & 7).astype(np.uint64)
            size, rs = symbol(lookup, w)
            moved = size + (rs & 15)
            k = k + (rs >> 4) + 1
            more = (rs != 0) & (k < 64)
            if busy is None:
                p = p + moved
                busy = np.flatnonzero(more)
            else:
                p[busy] += moved
                busy = busy[more]
            k = k[more]
        if (p > end).any():
            raise ValueError("the scan is too short")
    return np.cumsum(out, axis=0).T


def thumbnails(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """Of each image of each stream: width, height, luminance thumbnail (one sample a block, 8 bits)."""
    frames = [(i, f) for i, s in enumerate(streams) for f in parse(s)]
    groups: dict[tuple, list[int]] = {}
    jobs = []
    for k, (_, f) in enumerate(frames):
        ch, cv = f.components[0][1:3]
        hs, vs = max(c[1] for c in f.components), max(c[2] for c in f.components)
        single = len(f.components) == 1
        wide, high = (1, 1) if single else (hs, vs)
        across, down = -(-f.width // (8 * wide)), -(-f.height // (8 * high))
        per = 1 if single else ch * cv
        mcus, step = across * down, f.restart or across * down
        if len(f.intervals) != -(-mcus // step):
            raise ValueError("restart intervals are missing")
        for r, data in enumerate(f.intervals):
            groups.setdefault((min(step, mcus - r * step) * per, *f.order), []).append(len(jobs))
            jobs.append((k, data))
    got: list = [None] * len(jobs)
    for (blocks, *order), members in groups.items():
        for i, values in zip(members, _dc_of([jobs[m][1] for m in members], blocks, order, order[0][0])):
            got[i] = values
    pieces: dict[int, list[np.ndarray]] = {}
    for (k, _), values in zip(jobs, got):
        pieces.setdefault(k, []).append(values)
    out: list[list] = [[] for _ in streams]
    for k, (i, f) in enumerate(frames):
        values = np.concatenate(pieces[k]) * f.quant[f.components[0][3]]
        samples = np.clip((values + 4) // 8 + 128, 0, 255).astype(np.uint8)
        single = len(f.components) == 1
        h, v = (1, 1) if single else f.components[0][1:3]
        hs, vs = (1, 1) if single else (max(c[1] for c in f.components), max(c[2] for c in f.components))
        across = -(-f.width // (8 * hs))
        image = samples.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
        used_w, used_h = -(-(-(-f.width * h // hs)) // 8), -(-(-(-f.height * v // vs)) // 8)
        out[i].append((f.width, f.height, image[:used_h, :used_w]))
    return out


@lru_cache(4096)
def cells(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First row of each of n equal parts (of one row at least), and how many rows it has."""
    first = np.arange(n) * size // n
    return first, np.maximum(1, np.append(first[1:], size) - first)


def thumbnail_hashes(image: np.ndarray) -> tuple[str, str]:
    """Average hash (8x8) and difference hash (8x9) of a thumbnail, as hexadecimal."""

    y, tall = cells(image.shape[0], 8)
    bands = np.add.reduceat(image, y, axis=0, dtype=np.int64)

    def reduced(columns: int) -> np.ndarray:
        x, wide = cells(image.shape[1], columns)
        return np.add.reduceat(bands, x, axis=1) / (tall[:, None] * wide)

    small, across = reduced(8), reduced(9)
    return (np.packbits(small > small.mean()).tobytes().hex(), np.packbits(across[:, 1:] > across[:, :-1]).tobytes().hex())


def padded(text: str | None) -> tuple[int, np.ndarray]:
    """Length of the text in UTF-8, and its bytes with spaces up to a positive multiple of 192."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), np.frombuffer(data + b" " * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data)), dtype=np.uint8)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, n_images long"


def media_digest(texts: list[str | None]) -> pd.DataFrame:
    """Store, read back and describe whole texts."""
    sizes, payloads = zip(*map(padded, texts))
    media = encode_many(list(payloads))
    rows = []
    for n, stream, images in zip(sizes, media, thumbnails(media)):
        back = b"".join(image.tobytes() for _, _, image in images)
        hashes = [thumbnail_hashes(image) for _, _, image in images]
        width, height = images[0][0], sum(x[1] for x in images)
        feature = f"{width}x{height};" + ";".join(f"a{a},d{d}" for a, d in hashes)
        rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, width, height, len(images)))
    return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in DIGEST.split(", ")])


@F.pandas_udf(T.BinaryType())
def to_media(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A function of a text column: the JPEG stream."""
    for texts in batches:
        texts = list(texts)
        yield pd.Series([m for a, b in chunks(texts) for m in encode_many([padded(t)[1] for t in texts[a:b]])], dtype=object)


@F.pandas_udf(T.BinaryType())
def from_media(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A function of a column of JPEG streams: the luminance samples of all images, or null for null."""
    for streams in batches:
        known = [s for s in streams if s is not None]
        samples = iter([b"".join(image.tobytes() for _, _, image in images) for images in thumbnails(known)])
        yield pd.Series([None if s is None else next(samples) for s in streams], dtype=object)


@F.pandas_udf(fields(DIGEST))
def media_columns(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A function of a text column: struct of sizes, hashes, dimensions and feature of its stored form."""
    for texts in batches:
        texts = list(texts)
        yield pd.concat([media_digest(texts[a:b]) for a, b in chunks(texts)], ignore_index=True) if texts else pd.DataFrame(columns=[f.split(" ")[0] for f in DIGEST.split(", ")])
