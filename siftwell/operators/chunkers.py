"""Splitters: fixed width, sentences, paragraphs, and the recursive one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import release, ship
from ..functions.text import stripped

#: Rows whose texts are held as strings at once.
ROWS = 200
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of (chunk_index, chunk): windows of size characters, each starting size - overlap after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda at, i: F.struct(i.alias("chunk_index"), F.substring(text, at + 1, F.lit(size)).alias("chunk")))


def split_by_size(df: DataFrame, size: int = 500, overlap: int = 0, text: str = "text") -> DataFrame:
    """The rows' other columns with chunk_index and chunk; blank windows are dropped, null texts give none."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.inline(windows(F.col(text), size, overlap))).filter(F.col("chunk").rlike("(?U)\\S"))


def _packed(pieces: Column, fits, joint: str, gap: int) -> Column:
    """Greedy packing: a piece joins the open chunk while fits(its length, count, piece), else opens the next."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("length"), F.lit(0).alias("count"))

    def step(s: Column, p: Column) -> Column:
        joins = fits(s["length"], s["count"], p)
        return F.struct(
            F.when(joins | (s["count"] == 0), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"),
            F.when(s["count"] == 0, p).when(joins, F.concat(s["open"], F.lit(joint), p)).otherwise(p).alias("open"),
            (F.when(joins, s["length"]).otherwise(0) + F.length(p) + gap).alias("length"),
            (F.when(joins, s["count"]).otherwise(0) + 1).alias("count"),
        )

    return F.aggregate(pieces, start, step, lambda s: F.when(s["count"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "(?U)(?<=[.!?])\\s+"), stripped), lambda s: s != "")


def sentence_chunks(df: DataFrame, size: int = 500, min_sentences: int = 1, text: str = "text") -> DataFrame:
    """Whole sentences, packed up to size with at least min_sentences each."""
    rest = [c for c in df.columns if c != text]
    packed = _packed(sentences(F.col(text)), lambda length, count, p: (length + F.length(p) <= size) | (count < min_sentences), " ", 1)
    return df.select(*rest, F.posexplode(packed).alias("chunk_index", "chunk"))


def paragraph_chunks(df: DataFrame, size: int = 1000, text: str = "text") -> DataFrame:
    """Paragraphs, packed while their lengths (separators not counted, within a chunk they are) stay within size."""
    rest = [c for c in df.columns if c != text]
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        joins = F.length(s["open"]) + F.length(p) <= size
        return F.struct(
            F.when(joins | ~s["open"].rlike("(?U)\\S"), s["done"]).otherwise(F.concat(s["done"], F.array(stripped(s["open"])))).alias("done"),
            F.when(joins & (s["open"] != ""), F.concat(s["open"], F.lit("\n\n"), p)).otherwise(p).alias("open"),
        )

    packed = F.aggregate(F.split(F.col(text), "\n\n"), start, step, lambda s: F.when(s["open"].rlike("(?U)\\S"), F.concat(s["done"], F.array(stripped(s["open"])))).otherwise(s["done"]))
    return df.select(*rest, F.posexplode(packed).alias("chunk_index", "chunk"))


def recursive_pieces(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator, merge neighbours up to size, split what is still too long at the next one."""
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size - overlap) if text[i : i + size].strip()]
    mark, finer = separators[0], separators[1:]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for piece in text.split(mark) if mark else text:
        extra = len(piece) + (len(mark) if length else 0)
        if length + extra <= size:
            # an empty open chunk is replaced, not extended
            held, length = ([*held, piece], length + extra) if length else ([piece], len(piece))
            continue
        if length:
            out.append(mark.join(held))
        if len(piece) <= size:
            held, length = [piece], len(piece)
        else:
            out += recursive_pieces(piece, size, overlap, finer)
            held, length = [], 0
    if length:
        out.append(mark.join(held))
    return out


def recursive_chunks(df: DataFrame, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, chunk) by Arrow batches; sequential within a text. 0 stands for the default size or overlap."""
    size, overlap = size or 500, overlap or 50
    if "" not in separators and overlap >= size:  # with single characters at the end, windows are never cut
        raise ValueError("overlap must be less than size")
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):  # Python strings of a whole batch would take many times its memory
                rows = batch.slice(first, ROWS)
                ids, at, parts = [], [], []
                for i, t in enumerate(rows.column(1).to_pylist()):
                    for k, p in enumerate(recursive_pieces(t or "", size, overlap, separators)):
                        if p.strip():
                            ids.append(i)
                            at.append(k)
                            parts.append(p.strip())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(ids, pa.int64())), pa.array(at, pa.int32()), pa.array(parts, pa.string())], [key, "chunk_index", "chunk"])
            batch = rows = None
            release()

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, chunk_index int, chunk string")


def chunker(strategy: str):
    found = {"recursive": recursive_chunks, "sentence": sentence_chunks, "size": split_by_size, "paragraph": paragraph_chunks}
    if strategy not in found:
        raise ValueError(f"unknown strategy {strategy!r}; there are {sorted(found)}")
    return found[strategy]
