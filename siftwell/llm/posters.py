"""Baseline JPEG writing, and a poster of each page, as the given tables hold no images.

A page's poster shows its whole source: every byte of the HTML, in order, has a pixel, so the image grows with the page; one
of less than 72 x 64 pixels is enlarged to that, so that thumbnails have 9 x 8 pixels at least. Its size, its sampling
(grey, 4:4:4 or 4:2:0) and its restart interval follow from the page, so that the media operator meets all of them."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .media import ZIGZAG
from .spark_io import in_arrow, slices
from .textvec import ragged

#: Pixels that are encoded at once; the arrays of more outgrow the caches and are mapped anew each time.
PIXELS = 100_000
QUANT = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62]
    + [18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
)
_DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
_AC_COUNTS = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125])
_AC_FIRST = bytes.fromhex("0102030004110512213141061351610722711432819 1a1082342b1c11552d1f02433627282 090a".replace(" ", ""))
_AC_ALL = [0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
DC_TABLE = _DC_COUNTS + bytes(range(12))
AC_TABLE = _AC_COUNTS + _AC_FIRST + bytes(sorted({*_AC_ALL} - {*_AC_FIRST}))


@functools.cache
def codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, length, now, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            code[table[at]], length[table[at]] = now, n
            now, at = now + 1, at + 1
        now <<= 1
    return code, length


@functools.cache
def _dct(quant: bytes) -> np.ndarray:
    """A block's 64 pixels to its zigzag coefficients over their quantisers, as one matrix."""
    k = np.arange(8)
    m = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return np.ascontiguousarray((np.kron(m, m) / np.frombuffer(quant, np.int64)[:, None])[ZIGZAG].T)


@functools.cache
def _bits() -> np.ndarray:
    """How many bits a value's size takes."""
    return np.array([i.bit_length() for i in range(1 << 13)])


def _blocks(plane: np.ndarray, down: int, across: int) -> np.ndarray:
    """A plane's blocks, row by row, its edge repeated up to so many blocks."""
    h, w = plane.shape
    full = np.empty((down * 8, across * 8), np.int16)
    full[:h, :w] = plane
    full[:h, w:] = plane[:, -1:]
    full[h:] = full[h - 1]
    return (full - 128).reshape(down, 8, across, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)


def coefficients(plane: np.ndarray, down: int, across: int, quant: np.ndarray) -> np.ndarray:
    """Quantised zigzag coefficients of a plane's blocks."""
    return _transformed(_blocks(plane, down, across), quant)


def _transformed(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    return np.rint(blocks.reshape(-1, 64).astype(np.float64) @ _dct(quant.astype(np.int64).tobytes())).astype(np.int64)


def encode(planes: list[np.ndarray], width: int, height: int, halved: bool = False, interval: int = 0, quant: np.ndarray = QUANT) -> bytes:
    """A baseline JPEG of one or three planes; halved: the second and third have half the size (4:2:0)."""
    return encode_all([(planes, width, height, halved, interval)], quant)[0]


def encode_all(images: list[tuple[list[np.ndarray], int, int, bool, int]], quant: np.ndarray = QUANT) -> list[bytes]:
    """A baseline JPEG of each image, as encode() takes it; all blocks are worked on at once."""
    parts, lists, shapes, first_mcu = [], [], [], 0
    for image, (planes, width, height, halved, interval) in enumerate(images):
        s = 2 if halved else 1
        across, down = -(-width // (8 * s)), -(-height // (8 * s))
        for c, plane in enumerate(planes):
            k = s if c == 0 else 1
            lists.append(_blocks(plane, down * k, across * k))
            parts.append((len(lists[-1]), first_mcu, c, k, across, image))
        shapes.append((first_mcu, across * down, interval or across * down))
        first_mcu += across * down
    size, mcu0, c, k, across, image = (np.repeat(x, [p[0] for p in parts]) for x in np.array(parts, np.int64).T)
    begin = np.cumsum([0, *(p[0] for p in parts[:-1])])
    i = np.arange(len(size)) - np.repeat(begin, [p[0] for p in parts])
    mcu, j = np.divmod(i, k * k)
    at = (mcu // across * k + j // k) * across * k + mcu % across * k + j % k + np.repeat(begin, [p[0] for p in parts])
    order = np.lexsort((j, c, mcu0 + mcu))
    block, part, owner, mcu = _transformed(np.concatenate(lists), quant)[at[order]], c[order], image[order], mcu[order]
    mcus, interval = (np.array([x[n] for x in shapes], np.int64) for n in (1, 2))
    pieces = -(-mcus // interval)
    segment = (np.cumsum(pieces) - pieces)[owner] + mcu // interval[owner]
    diff = block[:, 0].copy()
    for n in range(3):
        i = np.flatnonzero(part == n)
        same = segment[i[1:]] == segment[i[:-1]]
        diff[i[1:]] -= np.where(same, block[i[:-1], 0], 0)

    def coded(symbol: np.ndarray, value: np.ndarray, size: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray]:
        code, length = codes(table)
        return code[symbol] << size | np.where(value < 0, value + (1 << size) - 1, value), length[symbol] + size

    bits_of = lambda x: _bits()[np.abs(x)]
    rows, k = np.nonzero(block[:, 1:])
    k += 1
    value = block[rows, k]
    before = np.where(np.append(True, rows[1:] != rows[:-1]), 0, np.append(0, k[:-1])) if len(rows) else k
    run = k - before - 1
    last = np.zeros(len(block), np.int64)
    last[rows] = k  # the rows' last one stays
    zrl, eob = np.repeat(np.arange(len(rows)), run >> 4), np.flatnonzero(last < 63)
    none = lambda x: np.zeros(len(x), np.int64)
    size, dc_size = bits_of(value), bits_of(diff)
    events = [
        (np.arange(len(block)) * 256, *coded(dc_size, diff, dc_size, DC_TABLE)),
        (rows[zrl] * 256 + k[zrl] * 2, *coded(none(zrl) + 0xF0, none(zrl), none(zrl), AC_TABLE)),
        (rows * 256 + k * 2 + 1, *coded((run & 15) << 4 | size, value, size, AC_TABLE)),
        (eob * 256 + 255, *coded(none(eob), none(eob), none(eob), AC_TABLE)),
    ]
    key, code, length = (np.concatenate(x) for x in zip(*events, strict=True))
    sort = np.argsort(key, kind="stable")
    key, code, length = key[sort], code[sort], length[sort]
    # a segment ends with ones up to a whole byte
    of = segment[key >> 8]
    full = np.bincount(of, length, int(segment[-1]) + 1).astype(np.int64)
    pad = -full % 8
    ends = np.cumsum(full + pad)
    where = np.append(np.cumsum(length) - length + (np.cumsum(pad) - pad)[of], ends - pad)
    code, length = np.append(code, (1 << pad) - 1), np.append(length, pad)
    # a code of 27 bits at most lies in two words of 32; no two share a bit, so sums of doubles are exact
    word, pair = where >> 5, code.astype(np.uint64) << (64 - (where & 31) - length).astype(np.uint64)
    words = np.bincount(word, (pair >> np.uint64(32)).astype(np.float64), (int(ends[-1]) >> 5) + 2)
    words += np.bincount(word + 1, (pair & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
    data, ends, at, out = words.astype(np.uint32).byteswap().tobytes(), [0, *(ends // 8).tolist()], 0, []
    for n, (planes, width, height, halved, interval) in zip(pieces.tolist(), images, strict=True):
        scan = [(b"" if not i else bytes([0xFF, 0xD0 + (i - 1) % 8])) + data[ends[at + i] : ends[at + i + 1]].replace(b"\xff", b"\xff\x00") for i in range(n)]
        at += n
        out.append(b"".join([_head(len(planes), width, height, halved, interval, quant), *scan, b"\xff\xd9"]))
    return out


def _head(n: int, width: int, height: int, halved: bool, interval: int, quant: np.ndarray) -> bytes:
    marker = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    s = 2 if halved else 1
    head = [b"\xff\xd8", marker(0xDB, b"\0" + quant[ZIGZAG].astype(np.uint8).tobytes())]
    head.append(marker(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, (s << 4 | s) if c == 0 else 0x11, 0]) for c in range(n))))
    head += [marker(0xC4, b"\0" + DC_TABLE), marker(0xC4, b"\x10" + AC_TABLE)]
    if interval:
        head.append(marker(0xDD, interval.to_bytes(2, "big")))
    head.append(marker(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\0\x3f\0"))
    return b"".join(head)


def _shrunk(data: np.ndarray, width: int, height: int) -> np.ndarray:
    """All bytes in order, spread or averaged over so many pixels."""
    n, pixels = len(data), width * height
    edge = np.arange(pixels) * n // pixels
    if n < pixels:
        return data[edge].reshape(height, width)
    total = np.add.reduceat(data.astype(np.int64), edge)
    return (total // np.diff(np.append(edge, n))).astype(np.uint8).reshape(height, width)


def _planes(html: str | None) -> tuple[list[np.ndarray], int, int, bool, int] | None:
    data = np.frombuffer((html or "").encode("utf-8", "replace"), np.uint8)
    n = len(data)
    if not n:
        return None
    width = max(72, math.isqrt(n * 4 // 3)) + n % 41
    height, mode = max(64, -(-n // width)), n % 3
    y = _shrunk(data, width, height)
    if mode == 0:
        return [y], width, height, False, 0
    halved = mode == 2
    w, h = (-(-width // 2), -(-height // 2)) if halved else (width, height)
    return [y, _shrunk(data[::2], w, h), _shrunk(data[1::2] if n > 1 else data, w, h)], width, height, halved, n % 7


def poster(html: str | None) -> bytes | None:
    """None for a null or empty page."""
    return all_posters([html])[0]


def all_posters(pages: list[str | None]) -> list[bytes | None]:
    drawn = [_planes(x) for x in pages]
    out: list[bytes | None] = [None] * len(pages)
    there = [i for i, x in enumerate(drawn) if x is not None]
    for a, b in slices([drawn[i][1] * drawn[i][2] for i in there], PIXELS):
        for i, data in zip(there[a:b], encode_all([drawn[i] for i in there[a:b]]), strict=True):
            out[i] = data
    return out


def posters(pages: DataFrame) -> DataFrame:
    """(page_id, media): every page with its poster."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(all_posters(batch.column(1).to_pylist()), pa.binary())], ["page_id", "media"])

        return step

    return in_arrow(pages.select("page_id", "html"), make, "page_id long, media binary")
