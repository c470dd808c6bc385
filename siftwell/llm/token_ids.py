"""Operator 2: token ids as fixed-width bit-packed blocks.

Each id takes the fewest bits that hold the vocabulary. 64 ids fill a whole number of 64-bit words, so packing and
unpacking are shifts over numpy columns, and a block of ids starts on a byte: id i of a document is found from its
block's offset without reading the blocks before it.

Defined cases: a null or empty text packs to no block and an empty payload; repeated rows are packed each; a null doc_id
stays null; columns beyond doc_id and text are ignored, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .bpe import Encoder, vocabulary
from .spark_io import in_arrow, vocabulary_file

#: Ids in a block: a multiple of 64.
BLOCK = 1024
SCHEMA = "doc_id long, n_tokens int, bit_width int, block_offsets array<int>, packed binary"


def bit_width(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Little-endian bits, padded to whole bytes."""
    n = len(ids)
    full = np.zeros(-(-n // 64) * 64, np.uint64)
    full[:n] = ids
    full = full.reshape(-1, 64)
    out = np.zeros((len(full), width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, word] |= full[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= full[:, i] >> np.uint64(64 - shift)
    return out.tobytes()[: -(-n * width // 8)]


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    words = np.zeros(-(-n // 64) * width, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    words.view(np.uint8)[: len(raw)] = raw[: words.nbytes]
    words = words.reshape(-1, width)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = x & mask
    return out.reshape(-1)[:n].astype(np.int32)


def read_range(packed: bytes, block_offsets: list[int], width: int, n_tokens: int, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of one document; only the blocks that hold them are unpacked."""
    start, stop = max(0, start), min(stop, n_tokens)
    if start >= stop:
        return np.zeros(0, np.int32)
    a, b = start // BLOCK, (stop - 1) // BLOCK
    end = block_offsets[b + 1] if b + 1 < len(block_offsets) else len(packed)
    ids = unpack(packed[block_offsets[a] : end], width, min(n_tokens, (b + 1) * BLOCK) - a * BLOCK)
    return ids[start - a * BLOCK : stop - a * BLOCK]


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    file = vocabulary_file(docs.sparkSession, path)

    def make():
        own = SparkFiles.get(file)
        encoder = Encoder(own)
        width = bit_width(vocabulary(own).size)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a, b, ids, per in encoder.rows(batch.column(1).to_pylist()):
                # all documents of the slice are packed at once, each from a fresh group of 64
                groups = -(-per // 64)
                room = np.zeros(int(groups.sum()) * 64, np.int32)
                start = (np.cumsum(groups) - groups) * 64
                room[np.repeat(start - (np.cumsum(per) - per), per) + np.arange(len(ids))] = ids
                data = pack(room, width)
                packed = [data[s * width // 8 : s * width // 8 + -(-n * width // 8)] for s, n in zip(start.tolist(), per.tolist(), strict=True)]
                offsets = [list(range(0, len(p), BLOCK * width // 8)) for p in packed]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(per, pa.int32()), pa.array([width] * (b - a), pa.int32()), pa.array(offsets, pa.list_(pa.int32())), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "bit_width", "block_offsets", "packed"])

        return step

    return in_arrow(docs.select("doc_id", "text"), make, SCHEMA)


def unpack_documents(packed: DataFrame) -> DataFrame:
    """The inverse: (doc_id, token_ids)."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n, width, data = (batch.column(i).to_pylist() for i in (1, 2, 3))
            ids = [unpack(d, w, k) for d, w, k in zip(data, width, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

        return step

    return in_arrow(packed.select("doc_id", "n_tokens", "bit_width", "packed"), make, "doc_id long, token_ids array<int>")
