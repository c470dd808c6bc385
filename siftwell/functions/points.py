"""Texts as arrays of code points: words, their hashes and text-quality measures of many texts at once.

White space is Unicode white space and the separators 1C to 1F. Results don't depend on how the texts are sliced."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..cluster import release

SPACE, LETTER, NUMBER, LOWER, LATIN, VOWEL, HARD, STOP, END = (1 << i for i in range(9))
#: Rows whose texts are strings at once, and characters that are worked on at once.
ROWS, SLICE = 200, 200_000
U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def classes() -> np.ndarray:
    """Of each code point the classes it is in."""
    kinds = {"Z": SPACE, "L": LETTER, "N": NUMBER}
    names = map(unicodedata.category, map(chr, range(0x110000)))
    table = np.fromiter((kinds.get(c[0], 0) | (LOWER if c == "Ll" else 0) for c in names), np.uint16, 0x110000)
    for chars, kind in (("\t\n\v\f\r\x1c\x1d\x1e\x1f\x85", SPACE), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", LATIN), ("aeiouAEIOU", VOWEL), ("bcdfghjklmnpqrstvwxyz", HARD), (".!?", STOP), (".!?;:\"'", END)):
        table[[ord(c) for c in chars]] |= kind
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x + U(0x9E3779B97F4A7C15)).astype(U, copy=False)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, and where each begins and the last ends."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def runs(on: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of the marked characters; none crosses a text's start."""
    edge = np.zeros(len(on) + 1, bool)
    edge[at] = True
    mark = np.zeros(len(on) + 2, bool)
    mark[1:-1] = on
    starts = np.flatnonzero(mark[1:-1] & (~mark[:-2] | edge[:-1]))
    ends = np.flatnonzero(mark[1:-1] & (~mark[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def sums(flags: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(flags, dtype=np.int64))


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(1 << bits, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points: equal for equal strings, wherever they stand."""
    power, inverse = _powers(max(10, len(cp).bit_length()))
    prefix = np.zeros(len(cp) + 1, U)
    np.cumsum(mix(cp.astype(U)) * power[: len(cp)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U))


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct runs of n words, in order and end to end, and their number in each text."""
    cp, at = code_points([t.lower() for t in texts])
    starts, ends, row = runs(classes()[cp] & SPACE == 0, at)
    h = span_hashes(cp, starts, ends)
    gram = h
    for k in range(1, n):
        gram = mix(gram[:-1]) + h[k:]
    whole = row[n - 1 :] == row[: len(gram)]
    gram, row = gram[whole], row[: len(gram)][whole]
    gram = mix(gram).view(np.int64)
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1]))[: len(gram)]
    return gram[new], np.bincount(row[new], minlength=len(texts))


def entropies(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shannon entropy in bits of each text's characters."""
    held = np.flatnonzero(np.bincount(cp)) if len(cp) else np.zeros(0, np.int64)
    number = np.zeros(int(held[-1]) + 1 if len(held) else 1, np.int64)
    number[held] = np.arange(len(held))
    lengths, out = np.diff(at), np.zeros(len(at) - 1)
    most = max(1, (1 << 20) // max(1, len(held)))
    for a in range(0, len(lengths), most):  # so many rows that their counts take 8 MB
        b = min(a + most, len(lengths))
        pair = np.repeat(np.arange(b - a), lengths[a:b]) * len(held) + number[cp[at[a] : at[b]]]
        n = np.bincount(pair, minlength=1)
        some = np.flatnonzero(n)
        if len(pair):
            row = some // len(held)
            share = n[some] / lengths[a:b][row]
            out[a:b] = np.bincount(row, -share * np.log2(share), b - a)
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(b)), where=b > 0)


def measures(texts: list[str], stop_words: tuple[str, ...], good_lengths: tuple[int, int], vowelless: int) -> list[np.ndarray]:
    """(length without white space at the ends, begins with a small letter, lacks an end mark, gibberish, density) of each text.

    The last two are text.gibberish() and text.density() by the same steps."""
    m = len(texts)
    cp, at = code_points(texts)
    kind = classes()[cp]
    length = np.diff(at)
    of = lambda flags: (s := sums(flags))[at[1:]] - s[at[:-1]]
    solid = np.flatnonzero(kind & SPACE == 0)
    a, b = np.searchsorted(solid, at[:-1]), np.searchsorted(solid, at[1:])
    some = b > a
    first, last = solid[a[some]], solid[b[some] - 1]
    size, small, open_end = np.zeros(m, np.int64), np.zeros(m, bool), np.zeros(m, bool)
    size[some], small[some], open_end[some] = last - first + 1, kind[first] & LOWER > 0, kind[last] & END == 0
    special = _ratio(of(kind & (SPACE | LETTER | NUMBER) == 0), length)
    told = of(kind & (SPACE | STOP) == 0) > 0

    def latin(cp: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, row = runs((kind & (LETTER | NUMBER) > 0) | (cp == 95), at)
        letters = sums(kind & LATIN > 0)
        pure = letters[ends] - letters[starts] == ends - starts
        return starts[pure], ends[pure], row[pure]

    starts, ends, row = latin(cp, kind, at)
    vowels = sums(kind & VOWEL > 0)
    wide = ends - starts
    good = (wide >= good_lengths[0]) & (wide <= good_lengths[1]) & ((vowels[ends] > vowels[starts]) | (wide <= vowelless))
    good = _ratio(np.bincount(row, good, m), np.bincount(row, minlength=m))

    low, low_at = code_points([t.lower() for t in texts])
    low_kind = classes()[low]
    s, e, r = runs(low_kind & HARD > 0, low_at)
    hard = np.bincount(r, np.where(e - s >= 5, e - s, 0), m)
    cons = np.minimum(1.0, _ratio((length - (np.diff(low_at) - hard)) * 10, length))
    total = np.where(entropies(low, low_at) > 4.5, 0.2, 0.0) + np.where(special > 0.3, special / 0.5 * 0.3, 0.0) + np.where(good < 0.5, (1 - good) * 0.3, 0.0) + cons * 0.2
    gibberish = np.where(length < 10, 0.0, np.minimum(1.0, total))

    s, e, r = latin(low, low_kind, low_at)
    h = span_hashes(low, s, e)
    words, letters = np.bincount(r, minlength=m), np.bincount(r, e - s, m)
    order = np.lexsort((h, r))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (r[order][1:] != r[order][:-1]))[: len(h)]
    distinct = np.bincount(r[order][new], minlength=m)
    common = np.bincount(r, np.isin(h, _hashes(stop_words)), m)
    density = np.minimum(1.0, _ratio(distinct, words) / 0.5) * 0.3 + (1 - _ratio(common, words)) * 0.3 + np.minimum(1.0, _ratio(letters, words) / 6) * 0.2 + np.where(told, 0.2, 0.0)
    return [size, small, open_end, gibberish, np.where(words == 0, 0.0, density)]


@functools.cache
def _hashes(words: tuple[str, ...]) -> np.ndarray:
    cp, at = code_points(list(words))
    return span_hashes(cp, at[:-1], at[1:])


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many characters each, one row at least."""
    at = total = 0
    for i, n in enumerate(lengths):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def by_slices(make: Callable[[list[str]], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A column function of texts, null as empty, by Arrow batches that are read slice by slice; what it freed is given back.

    Called once a row: the optimiser takes it for nondeterministic, so it isn't repeated for a filter or a second use."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), ROWS):
                texts = [t or "" for t in batch.slice(at, ROWS).to_pylist()]
                out += [make(texts[a:b]) for a, b in slices([len(t) for t in texts], SLICE)]
            del batch
            yield pa.concat_arrays(out or [make([])])
            del out
            release()

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER).asNondeterministic()
