"""Vectorised text kernels: code points, pre-tokens and rolling hashes for whole batches at once."""

from __future__ import annotations

import functools

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
U = np.uint64


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point as the public byte-level BPE pattern sees it."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            a, b = ord(text[m.start()]), ord(text[m.end() - 1]) + 1
            if a < 0xD800 < b:
                table[a:0xD800] = table[0xE000:b] = kind
            else:
                table[a:b] = kind
    return table


@functools.lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x + U(0x9E3779B97F4A7C15)).astype(U, copy=False)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of code points: equal for equal strings, wherever they stand."""
    n = len(cp)
    power, inverse = _powers(max(10, int(n).bit_length()))
    prefix = np.zeros(n + 1, U)
    np.cumsum(mix(cp.astype(U)) * power[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U))


def pretokens(cp: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of concatenated texts.

    Same cuts as the public pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    gives text by text. firsts: where each non-empty text starts."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    after_blank = np.zeros(n, bool)  # the previous character is a plain blank of the same text
    after_blank[1:] = cp[:-1] == 32
    space = kind == SPACE
    start = first[:n] | (before != kind) & ~(after_blank & ~space)
    last_of_run = np.zeros(n, bool)
    last_of_run[:-1] = space[:-1] & ~space[1:]
    last_of_run &= ~first[1:]
    start |= last_of_run
    for i in np.flatnonzero((cp == 39) & start & (kind == OTHER)):
        tail = cp[i + 1 : i + 3]
        inside = 0 if first[i + 1] else 1 if i + 2 > n or first[min(i + 2, n)] else 2
        one = chr(tail[0]) if inside >= 1 else ""
        two = one + chr(tail[1]) if inside == 2 and len(tail) == 2 else ""
        long = 1 if one in ("s", "t", "m", "d") and one else 2 if two in ("re", "ve", "ll") else 0
        if long:
            start[i + 1 : i + 1 + long] = False
            if i + 1 + long < n:
                start[i + 1 + long] = True
    at = np.flatnonzero(start)
    return at, np.append(at[1:], n)


def words(cp: np.ndarray, firsts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of kept characters; no run crosses a text's start."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[firsts] = True
    on = np.zeros(n + 2, bool)
    on[1:-1] = keep
    start = on[1:-1] & (~on[:-2] | edge[:n])
    end = on[1:-1] & (~on[2:] | np.append(edge[1:n], True))
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated ranges [offset, offset + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(offsets - (ends - lengths), lengths) + np.arange(total)
