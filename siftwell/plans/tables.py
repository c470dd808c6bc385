"""The given tables, and rounding for comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a single small file is dealt over the cores, as its texts are long."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < min(cores, 4) else df


def six(c: Column) -> Column:
    return F.round(c.cast("double"), 6)
