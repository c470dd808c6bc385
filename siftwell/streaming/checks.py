"""The chunk checks on streams: stateless ones as they are, repeated ids dropped within a watermark, counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from ..operators.chunk_score import validate


def read_chunks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    ship(spark)
    return spark.readStream.schema(schema).json(folder)


def validated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first chunk of each id that arrives within the watermark, scored; needs id and created_at."""
    return validate(stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"]))


def window_counts(checked: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Chunks and passed ones by window of created_at."""
    return checked.groupBy(F.window("created_at", width)).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("passed").cast("long")).alias("passed"))
