"""What the operators share on the Spark side: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut, release, share, shared_folder, ship

__all__ = ["cut", "release", "share", "shared_folder", "ship"]

#: Rows up to which a decision table is broadcast; a larger one is joined with a salted shuffle.
BROADCAST_ROWS = 100_000
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put_file(spark: SparkSession, data: bytes, stem: str) -> str:
    """Write bytes to the shared folder and hand them to every executor; returns the name for SparkFiles."""
    name = f"{stem}-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(share(spark, data, name))
    return name


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a single unsplit file over all cores; an input that already has a partition a core is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 4) else df


def join_small(big: DataFrame, small: DataFrame, keys: list[str], salt: list[str], rows: int | None = None) -> DataFrame:
    """Inner equi-join with a decision table: broadcast behind a count of its rows, else a shuffle salted against hot keys.

    small must have been materialised, as it is counted."""
    n = small.count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the salt is a function of the row, so that a task that runs again deals its rows alike
    return big.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def wrapped(df: DataFrame, **derived) -> DataFrame:
    """The rows as one column _row beside derived columns, which so can't clash with the rows' own names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(k) for k, c in derived.items()])


def unwrapped(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def in_rows(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, as Python strings of a whole batch take many times the memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with one state a task: make() returns what turns a batch into batches."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        del step
        release()

    return df.mapInArrow(run, schema)


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


def vocabulary_path() -> str:
    return os.environ.get("SIFTWELL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def vocabulary_file(spark: SparkSession, path: str | None = None) -> str:
    """Hand a vocabulary file to every executor, once a session; returns its name for SparkFiles."""
    path, sc = path or vocabulary_path(), spark.sparkContext
    known = sc.__dict__.setdefault("_siftwell_vocabularies", {})
    if path not in known:
        with open(path, "rb") as f:
            known[path] = put_file(spark, f.read(), "vocabulary")
    return known[path]
