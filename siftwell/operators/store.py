"""A chunk store on Parquet: add, upsert, delete, update, scan, search, statistics, and the shapes that sinks want."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of the same key; the anti join is on keys alone."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return old.join(ids.select(key), key, "left_anti")


def search_metadata(df: DataFrame, wanted: dict[str, str], limit: int = 100, key: str = "id") -> DataFrame:
    for k, v in wanted.items():
        df = df.filter(F.col("metadata")[k] == v)
    return df.orderBy(key).limit(limit)


def stats(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"), F.max(F.size(embedding)).cast("int").alias("dimension"))


def without_source(old: DataFrame, source: str) -> DataFrame:
    """A null source is no named one, so its rows stay."""
    return old.filter(~F.coalesce(F.col("source") == source, F.lit(False)))


_SCALAR = "^(?:true|false|null|-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^\\[{].*)?$"


def narrowed(df: DataFrame, sink: str) -> DataFrame:
    """Metadata and text as a kind of sink keeps them.

    scalar keeps all metadata, values that are lists or objects (JSON text) as the strings they are; short keeps scalars alone and
    cuts texts to 1000 characters, which is what such a sink stores; bare drops metadata."""
    if sink == "short":
        short = df.withColumn("text", F.substring("text", 1, 1000))
        return short.withColumn("metadata", F.map_filter("metadata", lambda k, v: v.isNotNull() & v.rlike("(?s)" + _SCALAR))) if "metadata" in df.columns else short
    if sink == "scalar":
        return df.withColumn("metadata", F.map_filter("metadata", lambda k, v: v.isNotNull()))
    if sink == "bare":
        return df.drop("metadata")
    raise ValueError(f"unknown sink {sink!r}")


def placeholder_embedding(text: Column) -> Column:
    """48 numbers in 0..1: the bytes of the text's SHA-384."""
    digest = F.sha2(text.cast("binary"), 384)
    return F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


def documents_shape(df: DataFrame) -> DataFrame:
    """(page_content, metadata) with source and quality score among the metadata."""
    extra = F.map_filter(F.create_map(F.lit("source"), F.col("source"), F.lit("quality_score"), F.col("quality_score").cast("string")), lambda k, v: v.isNotNull())
    keep = F.map_filter(F.col("metadata"), lambda k, v: ~k.isin("source", "quality_score"))
    return df.select("id", F.col("text").alias("page_content"), F.map_concat(keep, extra).alias("metadata"))


def from_documents(df: DataFrame) -> DataFrame:
    """Chunks of (page_content, metadata): the source moves out of the metadata."""
    return df.select("id", F.col("page_content").alias("text"), F.coalesce(F.col("metadata")["source"], F.lit("")).alias("source"), F.map_filter("metadata", lambda k, v: k != "source").alias("metadata"))


def nodes_shape(df: DataFrame) -> DataFrame:
    """(node_id, text, metadata) with source and quality score among the metadata."""
    return documents_shape(df).select(F.col("id").alias("node_id"), F.col("page_content").alias("text"), "metadata")


def from_nodes(df: DataFrame) -> DataFrame:
    """Chunks of (node_id, text, metadata): the source, else the file path, moves out of the metadata."""
    m = F.col("metadata")
    # a file path is the source only where there is none, but leaves the metadata in either case
    return df.select(F.col("node_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(m["source"], m["file_path"], F.lit("")).alias("source"), F.map_filter(m, lambda k, v: ~k.isin("source", "file_path")).alias("metadata"))


def spans_shape(df: DataFrame) -> DataFrame:
    """(text, metadata, quality_score), as splitters that work on spans take chunks back."""
    return df.select("text", "metadata", "quality_score")


def from_spans(df: DataFrame, source: str = "") -> DataFrame:
    """Chunks of (text, start_index, end_index, token_count), of which the last three may be missing and go to the metadata."""
    there = [c for c in ("start_index", "end_index", "token_count") if c in df.columns]
    meta = F.map_filter(F.create_map(*[x for c in there for x in (F.lit(c), F.col(c).cast("string"))]).cast("map<string,string>"), lambda k, v: v.isNotNull())
    rest = [c for c in df.columns if c not in {"text", *there}]
    return df.select(*rest, F.coalesce("text", F.lit("")).alias("text"), F.lit(source).alias("source"), meta.alias("metadata"))


class Store:
    """A folder of numbered versions; a write makes the next one and moves the pointer last, so a lost job leaves the old version."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        ship(spark)

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> str | None:
        fs, path = self._fs("CURRENT")
        return self.spark.read.text(path.toString()).first()[0] if fs.exists(path) else None

    def get_all(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/{v}")

    def _write(self, df: DataFrame) -> None:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}")
        fs, path = self._fs("CURRENT")
        out = fs.create(path, True)
        out.write(bytearray(name.encode()))
        out.close()

    def add(self, chunks: DataFrame) -> None:
        old = self.get_all()
        self._write(chunks if old is None else upserted(old, chunks, self.key))

    def delete(self, ids: DataFrame) -> int:
        """Rows that were there and are gone."""
        old = self.get_all()
        if old is None:
            return 0
        before = old.count()
        self._write(without(old, ids, self.key))
        return before - self.get_all().count()

    def update(self, chunks: DataFrame) -> None:
        """Rows whose keys are there are replaced, others are added."""
        self.add(chunks)

    def delete_source(self, source: str) -> None:
        old = self.get_all()
        if old is not None:
            self._write(without_source(old, source))

    def search(self, wanted: dict[str, str], limit: int = 100) -> DataFrame | None:
        old = self.get_all()
        return None if old is None else search_metadata(old, wanted, limit, self.key)

    def stats(self) -> DataFrame | None:
        old = self.get_all()
        return None if old is None else stats(old) if "embedding" in old.columns else old.agg(F.count(F.lit(1)).alias("count"), F.lit(None).cast("int").alias("dimension"))

    def clear(self) -> None:
        fs, path = self._fs("CURRENT")
        fs.delete(path, False)
