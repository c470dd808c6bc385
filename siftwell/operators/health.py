"""Staleness, coverage, drift and the health roll-up of a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE_KEYS = ("crawled_at", "published", "date", "last_modified", "updated_at", "created_at")


def metadata_date(metadata: Column) -> Column:
    """The first of the metadata's dates that can be read."""
    return F.coalesce(*[F.regexp_replace(metadata[k], "Z$", "+00:00").try_cast("timestamp") for k in DATE_KEYS])


def staleness(df: DataFrame, as_of: Column, days: Column | int = 90, created: str | None = "created_at") -> DataFrame:
    """The rows with content_date, known (a date in the metadata) and stale (older than the window at as_of)."""
    own = metadata_date(F.col("metadata"))
    found = df.withColumns({"known": own.isNotNull(), "content_date": F.coalesce(own, F.col(created)) if created else own})
    window = F.make_dt_interval(days if isinstance(days, Column) else F.lit(days))
    return found.withColumn("stale", F.coalesce(as_of - F.col("content_date") > window, F.lit(False)))


def staleness_report(judged: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    old = F.col("known") & F.col("stale")
    return judged.agg(
        F.count(F.lit(1)).alias("total"), n(old).alias("stale"), n(F.col("known") & ~F.col("stale")).alias("fresh"), n(~F.col("known")).alias("unknown"),
        F.count_distinct(F.when(old, F.col("source"))).alias("stale_sources"), F.min(F.when(F.col("known"), F.col("content_date"))).alias("oldest"), F.coalesce(F.avg(old.cast("double")), F.lit(0.0)).alias("staleness_ratio"),
    )


def stale_sources(judged: DataFrame) -> DataFrame:
    return judged.filter("known and stale").select("source").distinct()


def coverage(df: DataFrame, topics: list[str], text: str = "text") -> DataFrame:
    """(topic, covered): whether any text holds the topic; one pass with one flag a topic, whatever the table's size."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    flags = df.agg(*[F.coalesce(F.bool_or(F.contains(low, F.lit(t.lower()))), F.lit(False)).alias(f"t{i}") for i, t in enumerate(topics)])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"t{i}").alias("covered")) for i, t in enumerate(topics)])).alias("t")).select("t.topic", "t.covered")


def drift(scored: DataFrame, baseline: float) -> DataFrame:
    now = F.avg("score")
    return scored.agg(now.alias("current"), F.lit(baseline).alias("baseline"), (now - baseline).alias("change"), (F.try_divide(now - baseline, F.lit(baseline)) * 100).alias("change_pct"), (now >= baseline).alias("improved"))


def recommendations(staleness_ratio: Column, duplicate_groups: Column, missing_topics: Column, avg_quality: Column) -> Column:
    """Codes of what to do, in order."""
    each = [(staleness_ratio > 0.3, "RECRAWL_STALE"), (duplicate_groups > 0, "REMOVE_DUPLICATES"), (missing_topics > 0, "ADD_MISSING_TOPICS"), (avg_quality < 0.6, "REVIEW_QUALITY")]
    return F.filter(F.array(*[F.when(c, F.lit(k)) for c, k in each]), lambda x: x.isNotNull())


def roll_up(stale: DataFrame, quality: DataFrame, copies: DataFrame, covered: DataFrame | None = None, golden: DataFrame | None = None) -> DataFrame:
    """One row: staleness_ratio, avg_quality (0 where nothing is scored), duplicate_groups, missing_topics, golden_pass_rate (null without tests), recommendations.

    stale, quality (avg_quality), copies (duplicate_groups) and golden (pass_rate) have one row each, covered one a topic."""
    none = stale.limit(1).select(F.array().cast("array<string>").alias("missing_topics"))
    missing = none if covered is None else covered.agg(F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("topic")))).alias("missing_topics"))
    tested = stale.limit(1).select(F.lit(None).cast("double").alias("golden_pass_rate")) if golden is None else golden.select(F.col("pass_rate").alias("golden_pass_rate"))
    one = stale.select("staleness_ratio").crossJoin(quality.select(F.coalesce("avg_quality", F.lit(0.0)).alias("avg_quality"))).crossJoin(copies.select("duplicate_groups")).crossJoin(missing).crossJoin(tested)
    return one.withColumn("recommendations", recommendations(F.col("staleness_ratio"), F.col("duplicate_groups"), F.size("missing_topics"), F.col("avg_quality")))
