"""Operator 3: BPE encoding and decoding with a minimal acyclic transducer.

The frequent words of the whole corpus are compiled with their ids into an automaton that shares suffixes. Each arc carries
how many words come before it, so the sum along a word's path is its number, which leads to its ids. The automaton is one
file of flat arrays that workers map into memory; all words of a slice walk it in step. A word that it lacks is merged
exactly, so the lexicon's size changes the speed and never the ids.

Defined cases: null and empty texts give no ids and decode to ''; repeated rows are encoded each; a null doc_id stays null;
lone surrogates can't occur in Spark strings; other columns are ignored, whatever their names; empty tables give empty results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, tokenised, vocabulary
from .quality import bucket
from .spark_io import cut, in_arrow, in_rows, put_file, release, ship, vocabulary_file, vocabulary_path
from .textvec import code_points, ragged, span_hashes

#: Words in the lexicon, and distinct words that a counting task holds before it passes them on.
WORDS, HELD = 65_536, 400_000
SCHEMA = "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, by pre-token."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        hashes = np.zeros(0, np.uint64)
        names: list[np.ndarray] = []  # in the order of arrival; at[] leads from the sorted hashes to them
        at = np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            strings = np.concatenate(names) if names else np.zeros(0, object)
            return pa.RecordBatch.from_arrays([pa.array(strings[at].tolist(), pa.string()), pa.array(counts)], ["word", "n"])

        for batch in in_rows(batches):
            for _, _, text, starts, ends, _ in tokenised(batch.column(0).to_pylist()):
                if not len(starts):
                    continue
                h, first, n = np.unique(span_hashes(code_points(text), starts, ends), return_index=True, return_counts=True)
                where = np.searchsorted(hashes, h)
                where[where == len(hashes)] = 0
                had = hashes[where] == h if len(hashes) else np.zeros(len(h), bool)
                counts[where[had]] += n[had]
                new = first[~had]
                fresh = np.empty(len(new), object)
                fresh[:] = [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
                base = sum(map(len, names))
                names.append(fresh)
                both = np.concatenate([hashes, h[~had]])
                order = np.argsort(both, kind="stable")
                hashes, counts = both[order], np.concatenate([counts, n[~had]])[order]
                at = np.concatenate([at, base + np.arange(len(new))])[order]
                if len(hashes) > HELD:
                    yield flush()
                    counts, hashes, names, at = counts[:0], hashes[:0], [], at[:0]
        if len(hashes):
            yield flush()
        del counts, hashes, names, at
        release()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The automaton of distinct words as one flat file. Words are added in order and finished suffixes are shared at once."""
    order = sorted(range(len(words)), key=words.__getitem__)
    states: list[tuple] = []  # finished: (final, ((byte, state), ...))
    register: dict[tuple, int] = {}

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open nodes along the last word
    last = b""
    for i in order:
        w = words[i]
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        while len(path) - 1 > common:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        path.extend([False, []] for _ in w[common:])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], close(node)))
    root = close(path[0])
    total = np.zeros(len(states), np.int64)  # words from each state on; targets come before their sources
    arcs: list[tuple[int, int, int]] = []
    for s, (final, out) in enumerate(states):
        n = int(final)
        for byte, target in out:
            arcs.append((s * 256 + byte, target, n))
            n += int(total[target])
        total[s] = n
    key, target, skip = (np.array(x, np.int64) for x in (zip(*arcs, strict=True) if arcs else ((), (), ())))
    flat = np.array([x for i in order for x in ids[i]], np.int32)
    ends = np.cumsum([0, *(len(ids[i]) for i in order)])
    arrays = {"key": key, "target": target.astype(np.int32), "skip": skip.astype(np.int32), "final": np.array([s[0] for s in states], np.uint8), "ends": ends.astype(np.int64), "ids": flat}
    at, places = 0, {}
    for name, a in arrays.items():
        places[name] = (at, len(a), a.dtype.str)
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"root": root, "arrays": places}).encode()
    body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())
    return len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8) + body


class Lexicon:
    """A compiled file, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + n].tobytes())
        base = 8 + n + -n % 8
        for name, (at, size, kind) in head["arrays"].items():
            setattr(self, name, np.frombuffer(raw, kind, size, base + at) if size else np.zeros(0, kind))
        self.root = head["root"]

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that aren't in."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        found = np.full(len(words), -1, np.int64)
        if not len(self.key):
            return found
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        row = np.flatnonzero(size > 0)
        state, number = np.full(len(row), self.root, np.int64), np.zeros(len(row), np.int64)
        for depth in range(int(size.max(initial=0))):
            key = state * 256 + flat[begin[row] + depth]
            at = np.searchsorted(self.key, key)
            at[at == len(self.key)] = 0
            on = self.key[at] == key
            row, at = row[on], at[on]
            state, number = self.target[at].astype(np.int64), number[on] + self.skip[at]
            over = size[row] == depth + 1
            done = over & (self.final[state] == 1)
            found[row[done]] = number[done]
            row, state, number = row[~over], state[~over], number[~over]
            if not len(row):
                break
        return found

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number = self.find(words)
        had = number >= 0
        begin, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[had] = self.ends[number[had]]
        counts[had] = self.ends[number[had] + 1] - begin[had]
        return self.ids[ragged(begin, counts)], counts, had


class Decoder:
    def __init__(self, path: str):
        tokens = vocabulary(path).tokens
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.size) - self.size

    def raw(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids end to end, and how many each gives."""
        size = self.size[ids]
        return self.bytes[ragged(self.begin[ids], size)].tobytes(), size


def frequent(counts: DataFrame, words: int) -> DataFrame:
    """The words of the most common buckets of counts that hold no more than so many words; counts has been materialised.

    A top-k would send k rows of every task to the driver; the histogram of counts has a few hundred rows whatever the corpus."""
    hist = sorted(counts.groupBy(bucket(F.col("n")).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)
    total, least = 0, None
    for r in hist:
        total += r["k"]
        if total > words:
            break
        least = r["b"]
    return counts.filter(bucket(F.col("n")) >= least) if least is not None else counts.limit(0)


def build_lexicon(docs: DataFrame, path: str, words: int = WORDS) -> str:
    """Count all words, compile the most frequent ones, ship the file; returns its name. Which words are in never changes ids."""
    top = frequent(cut(word_counts(docs)), words).collect()
    strings = sorted(r["word"].encode("utf-8") for r in top)
    flat, counts = vocabulary(path).merge(strings)
    ends = np.cumsum(counts)
    data = compile_lexicon(strings, [flat[b - n : b].tolist() for n, b in zip(counts, ends, strict=True)])
    return put_file(docs.sparkSession, data, "lexicon")


def encode_documents(docs: DataFrame, path: str | None = None, words: int = WORDS) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip): the ids, and whether decoding them gave the text's bytes again."""
    name, file = build_lexicon(docs, path or vocabulary_path(), words), vocabulary_file(docs.sparkSession, path)

    def make():
        own = SparkFiles.get(file)
        encoder, decoder = Encoder(own, Lexicon(SparkFiles.get(name))), Decoder(own)

        def step(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for batch in in_rows([whole]):
                texts = batch.column(1).to_pylist()
                for a, b, ids, per in encoder.rows(texts):
                    data, size = decoder.raw(ids)
                    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(per))].tolist()
                    same = [data[x:y] == (t or "").encode() for x, y, t in zip(ends, ends[1:], texts[a:b], strict=False)]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(per, pa.int32()), lists, pa.array(same)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

        return step

    return in_arrow(docs.select("doc_id", "text"), make, SCHEMA)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); a null list gives null."""
    file = vocabulary_file(encoded.sparkSession, path)

    def make():
        decoder = Decoder(SparkFiles.get(file))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [None if x is None else decoder.raw(np.array(x, np.int64))[0].decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return in_arrow(encoded.select("doc_id", "token_ids"), make, "doc_id long, text string")
