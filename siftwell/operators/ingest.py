"""Texts to a store: extraction check, chunks, batch validation, and the accepted chunks into the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from . import chunk_score as C
from . import duplicates as D
from .chunkers import recursive_chunks
from .store import Store


def text_chunks(docs: DataFrame, split: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, text, source, metadata) of documents (doc_id, text, source); ids sort as documents and their chunks do.

    split turns (doc_id, text) into (doc_id, chunk_index, chunk); without one it is the recursive splitter."""
    parts = (split or recursive_chunks)(docs.select("doc_id", "text"))
    of = docs.select("doc_id", "source").distinct()
    name = F.concat_ws("-", F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lpad(F.col("chunk_index").cast("string"), 10, "0"))
    return parts.join(of, "doc_id").select(name.alias("id"), F.col("chunk").alias("text"), "source", F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("chunk_index"), F.col("chunk_index").cast("string")).alias("metadata"))


def validated_batch(chunks: DataFrame, similarity: float = 0.9) -> DataFrame:
    """The chunks as one batch, each checked against the earlier ones too."""
    known = D.penalties(D.near(D.item_sets(chunks, D.shingles(F.col("text"))), similarity)).withColumnRenamed("duplicate", "_dup")
    return C.validate(chunks.join(known, "id", "left"), duplicate=F.col("_dup")).drop("_dup")


def ingest_chunks(chunks: DataFrame, store: Store, validate: bool = True) -> DataFrame:
    """Loads the chunks that pass and returns one row: created, loaded, rejected, avg_score (null unless they are validated)."""
    checked = cut(validated_batch(chunks) if validate else chunks.withColumns({"score": F.lit(None).cast("double"), "passed": F.lit(True)}))
    if not checked.filter("passed").isEmpty():
        store.add(checked.filter("passed").select("id", "text", "source", "metadata", F.col("score").alias("quality_score")))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return checked.agg(F.count(F.lit(1)).alias("created"), n(F.col("passed")).alias("loaded"), n(~F.col("passed")).alias("rejected"), F.avg("score").alias("avg_score"))


def ingest_texts(docs: DataFrame, store: Store, split: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ingest_chunks of documents (doc_id, text, source), with documents and bad_extraction, which are counted but not left out."""
    raw = C.extraction(docs.select("doc_id", "text")).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum((~F.col("acceptable")).cast("long")), F.lit(0)).alias("bad_extraction"))
    return raw.crossJoin(ingest_chunks(text_chunks(docs, split), store))
