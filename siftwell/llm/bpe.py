"""Byte-pair merging for many words at once, and the shared pass that turns texts into token ids.

A vocabulary is a public rank file (base64 token and rank a line); its path is a parameter and it is only read."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np

from .spark_io import slices
from .textvec import code_points, mix, pretokens, ragged, span_hashes

NONE = np.int32(2**31 - 1)
#: Characters that are worked on at once, and words that a task remembers.
SLICE, MEMO, LANES = 600_000, 1_500_000, 30_000


class Vocabulary:
    """Token bytes by id and the pairs that merge, in an open-addressing table for vectorised look-ups."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for t, i in ranks.items():
            self.tokens[i] = t
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for t, i in ranks.items():
            for cut in range(1, len(t)):
                a = ranks.get(t[:cut])
                if a is not None and (b := ranks.get(t[cut:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        self.pairs = dict(zip(keys, values, strict=True))
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_value = np.full(1 << self.bits, NONE, np.int32)
        k, v = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(k)
        while len(k):
            free = self.slot_key[at] == -1
            self.slot_key[at[free]] = k[free]  # of several for one slot the last stays
            won = self.slot_key[at] == k
            self.slot_value[at[won]] = v[won]
            k, v, at = k[~won], v[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the two don't merge or one isn't there (< 0)."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        bad = (a < 0) | (b < 0)
        at = self._slot(key)
        out = np.full(len(key), NONE, np.int32)
        seen = self.slot_key[at]
        hit = (seen == key) & ~bad
        out[hit] = self.slot_value[at[hit]]
        todo = np.flatnonzero((seen != key) & (seen != -1) & ~bad)
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.slot_key[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.slot_value[at[todo[hit]]]
            todo = todo[(seen != key[todo]) & (seen != -1)]
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """One word by a heap, for words too long for the lanes: O(n log n)."""
        ids = [int(self.byte[b]) for b in word]
        n, alive = len(ids), [True] * len(ids)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = r, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r2 := self.pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r2, x, ids[x], ids[y]))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of ids of each; lowest rank first, leftmost on ties."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        order = np.argsort(lengths, kind="stable")
        short = order[(lengths[order] > 0) & (lengths[order] <= 48)]
        for i in order[lengths[order] > 48]:
            parts[i] = np.array(self.merge_long(words[i]), np.int32)
        for at in range(0, len(short), LANES):
            rows = short[at : at + LANES]
            long = lengths[rows]
            flat = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)
            ids = np.full((len(rows), int(long.max()) + 1), -1, np.int32)
            ids[np.arange(ids.shape[1]) < long[:, None]] = self.byte[flat]
            done, counts = self._lanes(ids, long)
            ends = np.cumsum(counts)
            for i, a, b in zip(rows, ends - counts, ends, strict=True):
                parts[i] = done[a:b]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts

    def _lanes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each step merges the best pair of every word that still has one."""
        rows, width = ids.shape
        out, count = ids.copy(), counts.copy()
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width - 1)
        live = np.arange(rows)
        while True:
            best = ranks.argmin(1)
            new = ranks[np.arange(len(live)), best]
            on = new != NONE
            if not on.all():
                out[live[~on]] = ids[~on]
                live, ids, ranks, best, new = live[on], ids[on], ranks[on], best[on], new[on]
            if not len(live):
                break
            lane = np.arange(len(live))
            tail = np.arange(width - 1) > best[:, None]
            ids[:, :-1][tail] = ids[:, 1:][tail]
            ids[:, -1] = -1
            ids[lane, best] = new
            ranks[:, :-1][tail[:, :-1]] = ranks[:, 1:][tail[:, :-1]]
            ranks[:, -1] = NONE
            ranks[lane, best] = self.rank(new, ids[lane, best + 1])
            back = np.flatnonzero(best > 0)
            ranks[back, best[back] - 1] = self.rank(ids[back, best[back] - 1], new[back])
            count[live] -= 1
        return out[np.arange(width) < count[:, None]], count


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces(text: str, most: int = SLICE) -> list[str]:
    """A very long text cut where a blank follows a non-blank, which is always the edge of a pre-token."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut != -1 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def tokenised(texts: list[str | None]) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts as (first row, end row, joined text, token starts, token ends, tokens of each row).

    A text longer than a slice comes in several items with the same row."""
    lengths = [len(t or "") for t in texts]
    for a, b in slices(lengths, SLICE):
        parts = pieces(texts[a] or "") if b == a + 1 else [None]
        for part in parts:
            joined = "".join([t or "" for t in texts[a:b]]) if part is None else part
            size = np.array(lengths[a:b] if part is None else [len(part)], np.int64)
            begins = np.cumsum(size) - size
            starts, ends = pretokens(code_points(joined), begins[size > 0])
            row = np.searchsorted(begins[size > 0], starts, "right")
            counts = np.zeros(b - a, np.int64)
            counts[size > 0] = np.bincount(row - 1, minlength=int((size > 0).sum())) if len(starts) else 0
            yield a, b, joined, starts, ends, counts


class Encoder:
    """Ids of pre-tokens, remembered by their 64-bit hashes; known(words) may resolve words before they are merged.

    known takes a list of bytes and returns (ids end to end, count of each, mask of the words it knew)."""

    def __init__(self, path: str, known=None):
        self.vocabulary, self.known = vocabulary(path), known
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.offset = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        if self.known is None:
            flat, counts = self.vocabulary.merge(words)
        else:
            flat, counts, had = self.known(words)
            rest = np.flatnonzero(~had)
            if len(rest):
                extra, n = self.vocabulary.merge([words[i] for i in rest])
                counts = counts.copy()
                base = np.cumsum(counts) - counts
                counts[rest] = n
                base[rest] = len(flat) + np.cumsum(n) - n
                flat = np.concatenate([flat, extra])[ragged(base, counts)]
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(self.pool) + len(flat), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        h = np.concatenate([self.hash, hashes])
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.offset = np.concatenate([self.offset, self.used + np.cumsum(counts) - counts])[order]
        self.count = np.concatenate([self.count, counts])[order]
        self.used += len(flat)

    def look_up(self, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset into the pool and number of ids of each pre-token."""
        if len(self.hash) > MEMO:
            self.forget()
        h, first, back = np.unique(span_hashes(code_points(text), starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, h)
        new = np.ones(len(h), bool)
        inside = at < len(self.hash)
        new[inside] = self.hash[at[inside]] != h[inside]
        if new.any():
            where = first[new]
            self.learn(h[new], [text[a:b].encode("utf-8", "replace") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            at = np.searchsorted(self.hash, h)
        return self.offset[at][back], self.count[at][back]

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids end to end, ids of each row); long texts come whole."""
        held: list[np.ndarray] = []
        items = tokenised(texts)
        now = next(items, None)
        while now is not None:
            a, b, text, starts, ends, counts = now
            offset, count = self.look_up(text, starts, ends)
            ids = self.pool[ragged(offset, count)]
            now = next(items, None)
            if now is not None and now[0] == a:
                held.append(ids)
                continue
            if held:
                ids = np.concatenate([*held, ids])
                held = []
                yield a, b, ids, np.array([len(ids)])
                continue
            per = np.zeros(b - a, np.int64)
            np.add.at(per, np.repeat(np.arange(b - a), counts), count)
            yield a, b, ids, per

    def encode(self, text: str) -> list[int]:
        return [int(x) for _, _, ids, _ in self.rows([text]) for x in ids]
