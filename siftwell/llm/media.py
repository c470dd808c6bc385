"""Operator 7: media columns of baseline JPEG images.

The markers are parsed one image at a time. The entropy-coded segments of many images, cut at restart markers, are decoded
in step, one lane a segment: a table look-up on the next 16 bits gives a code's length and value, and for AC coefficients,
of which only the lengths matter, all whole codes in these bits at once. A luminance block's DC coefficient is its mean, so
the DC values alone are the picture at an eighth of its size: the thumbnail. thumb_hash is its 64-bit difference hash.

Defined cases: null or empty media have status 'empty', other bytes without an SOI 'not_jpeg'; a progressive, lossless,
arithmetic or 12-bit image is 'unsupported' (with its dimensions); a broken header, table or code is 'corrupt'; a scan that
ends early, or is too short for the blocks that the header claims, is 'truncated'. No bytes raise, and memory follows the
bytes that are there, not what a header claims. Only 'ok' rows have a thumbnail. Images of any size are decoded whole;
repeated rows are decoded each; a null id stays null; other columns are ignored, whatever their names; an empty table gives
an empty result."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .spark_io import in_arrow

SCHEMA = "page_id long, status string, width int, height int, components int, thumb_width int, thumb_height int, thumbnail binary, thumb_hash string"
#: Bytes of images, and Huffman tables, that are decoded in step.
SLICE, TABLES = 4_000_000, 64
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28]
    + [35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)


class Broken(Exception):
    """The header can't be read; the argument is the status."""


@dataclass
class Scan:
    """Luminance as one scan gives it: the order of blocks in an MCU and where the luminance blocks go."""

    components: list[tuple[int, int, int]]  # (is luminance, DC table, AC table) of each block of an MCU
    mcus: int
    interval: int
    segments: list[bytes]
    block_at: np.ndarray  # place of each luminance block in the thumbnail in order of decoding, -1 outside
    tables: list[bytes] = field(default_factory=list)


@dataclass
class Header:
    width: int
    height: int
    components: int
    thumb: tuple[int, int]
    quant: int
    scan: Scan | None
    status: str = "ok"


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from a position on, unstuffed, and where they end."""
    out, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at == -1 or at + 1 >= len(data):
            out.append(data[begin:].replace(b"\xff\x00", b"\xff"))
            return out, len(data)
        kind = data[at + 1]
        if kind == 0:
            at += 2
        elif kind == 0xFF:
            at += 1
        elif 0xD0 <= kind <= 0xD7:
            out.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            at += 2
            begin = at
        else:
            out.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            return out, at


def _huffman(body: bytes) -> dict[int, bytes]:
    """The tables of a DHT segment; raises Broken where counts and values disagree or the codes don't fit their lengths."""
    out, i = {}, 0
    while i < len(body):
        counts = body[i + 1 : i + 17]
        size = sum(counts)
        table = body[i + 1 : i + 17 + size]
        if len(table) < 16 + size or size > 256 or body[i] & 0xEC or sum(n << (15 - k) for k, n in enumerate(counts)) > 1 << 16:
            raise Broken("corrupt")
        out[body[i]] = table
        i += 17 + size
    return out


def parse(data: bytes) -> Header:
    """Dimensions, and the scan that holds luminance; raises Broken."""
    if data[:2] != b"\xff\xd8":
        raise Broken("not_jpeg")
    at, quants, huff, interval = 2, {}, {}, 0
    frame: list[tuple[int, int, int, int]] = []
    width = height = 0
    head = None
    try:
        while at < len(data):
            if data[at] != 0xFF:
                raise Broken("corrupt")
            while data[at] == 0xFF:
                at += 1
            kind = data[at]
            at += 1
            if kind == 0xD9:
                break
            if kind == 1 or 0xD0 <= kind <= 0xD8:
                continue
            n = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + n]
            if n < 2 or len(body) < n - 2:
                raise Broken("truncated" if head else "corrupt")
            at += n
            if kind == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    first = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                    if wide > 1 or body[i] & 15 > 3 or not first or i + 1 + 64 * (1 + wide) > len(body):
                        raise Broken("corrupt")
                    quants[body[i] & 15] = first
                    i += 1 + 64 * (1 + wide)
            elif kind == 0xC4:
                huff |= _huffman(body)
            elif kind == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                if not width or not height or not frame or not all(1 <= f[1] <= 4 and 1 <= f[2] <= 4 for f in frame):
                    raise Broken("corrupt")
                if kind > 0xC1 or body[0] != 8:
                    return Header(width, height, len(frame), (0, 0), 0, None, "unsupported")
                if len(frame) > 4 or len({f[0] for f in frame}) < len(frame):
                    raise Broken("corrupt")
            elif kind == 0xDA:
                if not frame:
                    raise Broken("corrupt")
                scanned = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                if len(scanned) > 4 or len({c for c, _ in scanned}) < len(scanned):
                    raise Broken("corrupt")
                begin = at
                segments, at = _segments(data, at)
                if frame[0][0] not in [c for c, _ in scanned]:
                    continue
                by_id = {f[0]: f for f in frame}
                most_h, most_v = max(f[1] for f in frame), max(f[2] for f in frame)
                _, h, v, q = frame[0]
                tw, th = -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)
                tables, order = [], []

                def table(which: int, tables=tables) -> int:
                    if which not in huff:
                        raise Broken("corrupt")
                    tables.append(huff[which])
                    return len(tables) - 1

                for c, t in scanned:
                    dc, ac = table(t >> 4), table(16 | t & 15)
                    times = by_id[c][1] * by_id[c][2] if len(scanned) > 1 else 1
                    order += [(int(c == frame[0][0]), dc, ac)] * times
                across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
                mcus = across * down if len(scanned) > 1 else tw * th
                # a block takes two bits at least, so more blocks than that can't be there
                if mcus * len(order) * 2 > (at - begin) * 8 or -(-mcus // (interval or mcus)) > len(segments):
                    return Header(width, height, len(frame), (tw, th), quants[q], None, "truncated")
                if len(scanned) > 1:
                    y, x = np.divmod(np.arange(across * down * h * v), h * v)
                    row, col = y // across * v + x // h, y % across * h + x % h
                    place = np.where((row < th) & (col < tw), row * tw + col, -1)
                else:
                    place = np.arange(tw * th)
                head = Header(width, height, len(frame), (tw, th), quants[q], Scan(order, mcus, interval or mcus, segments, place, tables))
                break
    except (IndexError, KeyError, ValueError) as e:
        raise Broken("corrupt") from e
    if head is None:
        raise Broken("corrupt")
    return head


@functools.lru_cache(maxsize=2 * TABLES)
def lookup(table: bytes, dc: bool) -> np.ndarray:
    """By the next 16 bits, in one number. DC: bits of the code (5 bits, 0 where no code fits), size of the value.

    AC: for as many whole codes as the 16 bits hold, the bits with the values (5), the coefficients (7) and whether the block
    ends with them (1); then bits (5) and coefficients (7) of one code, 64 coefficients for the end of a block."""
    counts, values = np.frombuffer(table[:16], np.uint8), np.frombuffer(table[16:], np.uint8)
    bits, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for n in range(1, 17):
        for _ in range(int(counts[n - 1])):
            a, b = code << (16 - n), (code + 1) << (16 - n)
            if b > 1 << 16:
                break
            bits[a:b], symbol[a:b] = n, values[at]
            code += 1
            at += 1
        code <<= 1
    if dc:
        return (bits | symbol << 5).astype(np.int32)
    run, size = symbol >> 4, symbol & 15
    one = np.where(bits > 0, bits + size, 0)
    step = np.where(symbol == 0, 64, np.where(symbol == 0xF0, 16, run + 1))
    step[(size == 0) & (symbol != 0) & (symbol != 0xF0)] = 64  # not used by baseline: ends the block
    many, steps, over = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
    windows = np.arange(1 << 16)
    live = windows
    while len(live):
        rest = (windows[live] << many[live]) & 0xFFFF
        fits = (bits[rest] > 0) & (many[live] + one[rest] <= 16)
        live, rest = live[fits], rest[fits]
        many[live] += one[rest]
        end = step[rest] == 64
        steps[live] += np.where(end, 0, step[rest])
        over[live] = end
        live = live[~end]
    return (many | steps << 5 | over.astype(np.int64) << 12 | one << 13 | step << 18).astype(np.int32)


def decode(heads: list[Header]) -> tuple[list[np.ndarray], np.ndarray]:
    """DC values of the luminance blocks in place of each image, and its status (0 ok, 1 truncated, 2 corrupt)."""
    status = np.zeros(len(heads), np.int64)
    sizes = np.array([h.thumb[0] * h.thumb[1] for h in heads], np.int64)
    base = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()) + 1, np.int64)  # the last place takes blocks outside
    dcs: dict[bytes, int] = {}
    acs: dict[bytes, int] = {}
    image, begins, ends, units, chunks, orders, starts, lums = [], [], [], [], [], [], [], []
    at = 0
    places, place_at = [], 0
    for i, h in enumerate(heads):
        s = h.scan
        need = -(-s.mcus // s.interval)
        if len(s.segments) < need:
            status[i] = 1
        pattern = [(lum, dcs.setdefault(s.tables[d], len(dcs)), acs.setdefault(s.tables[a], len(acs)), j) for j, (lum, d, a) in enumerate(s.components)]
        # blocks of the same component share a prediction: the tables' index in the scan tells components apart
        which = [d // 2 for _, d, _ in s.components]
        lum_each = sum(lum for lum, _, _ in s.components)
        places.append(np.where(s.block_at < 0, len(out) - 1, s.block_at + base[i]))
        for k, data in enumerate(s.segments[:need]):
            image.append(i)
            begins.append(at * 8)
            ends.append((at + len(data)) * 8)
            chunks.append(data + b"\xff" * 8)
            at += len(data) + 8
            units.append(min(s.interval, s.mcus - k * s.interval) * len(pattern))
            orders.append(tuple((lum, d, a, w) for (lum, d, a, _), w in zip(pattern, which, strict=True)))
            starts.append(place_at + k * s.interval * lum_each)
            lums.append(lum_each)
        place_at += len(places[-1])
    if image:
        _lanes(np.array(image), np.array(begins), np.array(ends), np.array(units), b"".join(chunks), orders, np.array(starts), np.concatenate(places), [lookup(t, True) for t in dcs], [lookup(t, False) for t in acs], out, status)
    return [out[b : b + n] for b, n in zip(base, sizes, strict=True)], status


def _lanes(image, pos, end, units, data, orders, lum_at, places, dcs, acs, out, status) -> None:
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    window = np.zeros(len(raw), np.uint64)  # the eight bytes from each position on
    for k in range(8):
        window[: len(raw) - k] |= raw[k:] << np.uint64(56 - 8 * k)
    kinds = {o: i for i, o in enumerate(dict.fromkeys(orders))}
    kind = np.array([kinds[o] for o in orders])
    width = np.array([len(o) for o in kinds])[kind]
    table = np.zeros((len(kinds), max(map(len, kinds)), 4), np.int64)
    for o, i in kinds.items():
        table[i, : len(o)] = o
    dc, ac = np.concatenate(dcs), np.concatenate(acs)
    lane = np.arange(len(image))
    pred = np.zeros((len(image), 4), np.int64)
    unit, k = np.zeros(len(image), np.int64), np.zeros(len(image), np.int64)
    now = table[kind, 0]  # luminance, DC table, AC table, component of the block at hand
    pos, lum_at = pos.astype(np.int64).copy(), lum_at.astype(np.int64).copy()
    live = lane[units > 0]

    def fail(lanes: np.ndarray, at: np.ndarray) -> None:
        """No code fits: the data ended within it, or they are broken."""
        status[image[lanes]] = np.where(at + 16 > end[lanes], 1, 2)
        units[lanes] = 0

    while len(live):
        p = pos[live]
        w = window[p >> 3] << (p & 7).astype(np.uint64)
        code = (w >> np.uint64(48)).astype(np.int64)
        first = k[live] == 0
        at = live[first]
        if len(at):
            e = dc[now[at, 1] * 65536 + code[first]].astype(np.int64)
            n, size = e & 31, e >> 5
            bad = (n == 0) | (size > 15)
            size = np.where(bad, 0, size)
            value = np.where(size > 0, ((w[first] << n.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64), 0)
            value = np.where((size > 0) & (value < 1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value)
            pred[at, now[at, 3]] += value
            lum = at[now[at, 0] == 1]
            out[places[lum_at[lum]]] = pred[lum, now[lum, 3]]
            lum_at[lum] += 1
            pos[at] += n + size
            k[at] = 1
            fail(at[bad], p[first][bad])
        at = live[~first]
        if len(at):
            e = ac[now[at, 2] * 65536 + code[~first]]
            many, steps = e & 31, e >> 5 & 127
            use = (k[at] + steps <= 63) & (many > 0)
            n = np.where(use, many, e >> 13 & 31)
            k[at] += np.where(use, np.where(e >> 12 & 1, 64, steps), e >> 18)
            pos[at] += n
            fail(at[n == 0], p[~first][n == 0])
        done = live[k[live] >= 64]
        if len(done):
            k[done] = 0
            unit[done] += 1
            now[done] = table[kind[done], unit[done] % width[done]]
        late = live[pos[live] > end[live]]
        if len(late):
            status[image[late]] = np.maximum(status[image[late]], 1)
            units[late] = 0
        live = live[unit[live] < units[live]]


def grey(dc: np.ndarray, quant: int) -> np.ndarray:
    """Block means as bytes: DC is eight times the mean less 128."""
    return np.clip((dc * quant + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def difference_hash(thumbs: list[np.ndarray], shapes: list[tuple[int, int]]) -> list[str]:
    """64 bits: whether each of 8 x 8 sampled pixels is lighter than its right neighbour."""
    out = []
    for t, (w, h) in zip(thumbs, shapes, strict=True):
        x, y = (2 * np.arange(9) + 1) * w // 18, (2 * np.arange(8) + 1) * h // 16
        s = t.reshape(h, w)[y][:, x]
        out.append(np.packbits(s[:, :-1] > s[:, 1:]).tobytes().hex())
    return out


def features(images: list[bytes | None]) -> list[tuple]:
    """(status, width, height, components, thumb width, thumb height, thumbnail, hash) of each image."""
    out: list[tuple] = [("empty", *[None] * 7)] * len(images)
    rows: list[tuple[int, Header]] = []
    for i in sorted(range(len(images)), key=lambda i: len(images[i] or b"")):  # a slice takes as long as its longest lane, so images of like size share one
        if not images[i]:
            continue
        try:
            h = parse(images[i])
        except Broken as e:
            out[i] = (e.args[0], *[None] * 7)
            continue
        if h.scan is None:
            out[i] = (h.status, h.width, h.height, h.components, *[None] * 4)
        else:
            rows.append((i, h))
    at, total, tables = 0, 0, set()
    for k, (i, h) in enumerate(rows):
        more = tables | set(h.scan.tables)
        if k > at and (total + len(images[i]) > SLICE or len(more) > TABLES):
            _decoded(rows[at:k], out)
            at, total, more = k, 0, set(h.scan.tables)
        total, tables = total + len(images[i]), more
    _decoded(rows[at:], out)
    return out


def _decoded(rows: list[tuple[int, Header]], out: list[tuple]) -> None:
    heads = [h for _, h in rows]
    dcs, status = decode(heads)
    thumbs = [grey(d, h.quant) for d, h in zip(dcs, heads, strict=True)]
    hashes = difference_hash(thumbs, [h.thumb for h in heads])
    for (i, h), t, s, x in zip(rows, thumbs, status.tolist(), hashes, strict=True):
        good = s == 0
        out[i] = (("ok", "truncated", "corrupt")[s], h.width, h.height, h.components, h.thumb[0] if good else None, h.thumb[1] if good else None, t.tobytes() if good else None, x if good else None)


def media_features(df: DataFrame, media: str = "media", key: str = "page_id") -> DataFrame:
    """One row for each row: what is known of its image."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), *[pa.int32()] * 5, pa.binary(), pa.string()]

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            columns = zip(*features(batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types[1:], strict=True)]], names)

        return step

    return in_arrow(df.select(f"`{key}`", f"`{media}`"), make, SCHEMA)
