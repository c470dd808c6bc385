"""Connected parts of a graph by alternating large-star and small-star steps, with lineage cut at each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its neighbours (the larger ones, or the smaller ones and itself) to the least of its neighbourhood.

    The least is an aggregate that tasks prepare, joined back: a node that very many are linked to is in no task whole."""
    if large:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen = both.join(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "a")
    if large:
        out = seen.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, part) for each node of the edges (a, b); part is the least node that it is connected to."""
    now = cut(edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = state(now)
    while True:
        now = cut(_star(_star(now, True), False))
        got = state(now)
        if got == seen:
            break
        seen = got
    return now.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("part")).distinct()
