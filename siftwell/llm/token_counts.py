"""Operator 5: token counts by the whole-token shortcut.

Offline, every vocabulary string is proved or not: it must be valid UTF-8, be one pre-token, and merge to its own id.
A pre-token that is a proved string counts 1 by one look-up of its hash; only the others are merged.

Defined cases: null and empty texts count 0 tokens; repeated rows are counted each; a null doc_id stays null; other
columns are ignored, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .bpe import MEMO, tokenised, vocabulary
from .spark_io import in_arrow, vocabulary_file
from .textvec import code_points, pretokens, span_hashes

SCHEMA = "doc_id long, n_pretokens long, n_whole long, n_tokens long"


@functools.lru_cache(maxsize=2)
def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that are proved to encode alone as one token."""
    v = vocabulary(path)
    texts = []
    for t in v.tokens:
        try:
            texts.append(t.decode("utf-8"))
        except UnicodeDecodeError:
            texts.append("")
    joined = "".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(size) - size
    starts, _ = pretokens(code_points(joined), begins[size > 0])
    cuts = np.zeros(len(texts), np.int64)
    cuts[size > 0] = np.bincount(np.searchsorted(begins[size > 0], starts, "right") - 1, minlength=int((size > 0).sum()))
    maybe = np.flatnonzero(cuts == 1)
    flat, counts = v.merge([v.tokens[i] for i in maybe])
    own = flat[np.cumsum(counts) - counts] == maybe
    return [texts[i] for i in maybe[(counts == 1) & own]]


@functools.lru_cache(maxsize=2)
def whole_hashes(path: str) -> np.ndarray:
    strings = whole_tokens(path)
    ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
    starts = np.append(0, ends[:-1])
    return np.sort(span_hashes(code_points("".join(strings)), starts, ends))


def _member(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return at, (table[at] == h if len(table) else np.zeros(len(h), bool))


class Counter:
    def __init__(self, path: str):
        self.vocabulary, self.whole = vocabulary(path), whole_hashes(path)
        self.hash, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts(self, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each pre-token, and which took the shortcut."""
        h = span_hashes(code_points(text), starts, ends)
        _, whole = _member(self.whole, h)
        out = np.ones(len(h), np.int64)
        rest = np.flatnonzero(~whole)
        if len(rest):
            u, first, back = np.unique(h[rest], return_index=True, return_inverse=True)
            if len(self.hash) > MEMO:
                self.hash, self.count = self.hash[:0], self.count[:0]
            at, had = _member(self.hash, u)
            if not had.all():
                where = rest[first[~had]]
                _, n = self.vocabulary.merge([text[a:b].encode("utf-8", "replace") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
                both = np.concatenate([self.hash, u[~had]])
                order = np.argsort(both, kind="stable")
                self.hash, self.count = both[order], np.concatenate([self.count, n])[order]
                at, _ = _member(self.hash, u)
            out[rest] = self.count[at][back]
        return out, whole


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    file = vocabulary_file(docs.sparkSession, path)

    def make():
        counter = Counter(SparkFiles.get(file))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column(1).to_pylist()
            total = np.zeros((3, len(texts)), np.int64)
            for a, b, text, starts, ends, counts in tokenised(texts):
                if len(starts):
                    n, whole = counter.counts(text, starts, ends)
                    row = np.repeat(np.arange(a, b), counts)
                    for k, x in enumerate((None, whole, n)):
                        total[k] += np.bincount(row, x, len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, total)], ["doc_id", "n_pretokens", "n_whole", "n_tokens"])

        return step

    return in_arrow(docs.select("doc_id", "text"), make, SCHEMA)
