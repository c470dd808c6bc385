"""Operator 1: mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id. A source's share of a budget is met by keeping its documents below a hash
threshold, so smaller budgets are nested in larger ones and nothing is sorted. Thresholds come from histograms: tokens by
source and the hash's first 12 bits over all documents, then by the next 24 and the last 24 bits over the documents of the
boundary buckets alone.

Budgets: total_fraction of all tokens, split by weight over the sources there are; a source that has less gives all it has,
and what it leaves is dealt to the others by their weights, so a budget is met wherever there are the tokens for it. Without
weights of its own a source weighs the square root of its tokens: large sources stay larger, but less so.
level is the smallest nested budget (1 the smallest) that holds the document.

Defined cases: a null source counts as the source ''; a null doc_id is hashed as ''; a null or empty text has 0 tokens;
rows that share a doc_id share a hash, so they stay or go together; other columns stay as they are, whatever their names;
an empty table stays empty."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spark_io import cut, join_small, unwrapped, wrapped

#: Production parameters: relative weights by source, the weight of any other (None: the root of its tokens), the part of all tokens that the largest mix has, and the nested budgets.
WEIGHTS, DEFAULT_WEIGHT, TOTAL_FRACTION, LEVELS = {}, None, 0.9, (0.25, 0.5, 1.0)
#: Bits of the hash and of the two steps; weights are whole numbers of so small a part, so that sums don't depend on their order.
HASH_BITS, FIRST, NEXT, UNIT = 60, 12, 24, 1024


def token_count(text: Column) -> Column:
    """Tokens as runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _weight(source: Column, avail: Column, weights: dict[str, float], default: float | None) -> Column:
    other = F.sqrt(avail.cast("double")) if default is None else F.lit(float(default))
    each = reduce(lambda rest, kv: F.when(source == kv[0], F.lit(float(kv[1]))).otherwise(rest), weights.items(), other)
    return F.greatest(F.floor(each * UNIT).cast("long"), F.lit(1))


def budgets(sources: DataFrame, total_fraction: float, levels: tuple[float, ...]) -> DataFrame:
    """(m_source, m_level, m_left, m_avail, m_target): each source's budget and, by weight alone, its part of the mix.

    sources: (m_source, m_avail, m_weight), materialised. A source is filled whose tokens by weight are at most what is left by
    weight for the others; filling it raises that, so it is found by a few sums over the sources."""
    total, weight = sources.agg(F.sum("m_avail"), F.sum("m_weight")).first()
    if not total:
        return sources.select("m_source", F.explode(F.array(*[F.lit(i + 1) for i in range(len(levels))])).alias("m_level"), "m_avail", F.col("m_avail").alias("m_left"), F.lit(0.0).alias("m_target"))
    wanted = [math.floor(float(total) * total_fraction * x) for x in levels]
    ratio = F.col("m_avail").cast("double") / F.col("m_weight")
    full = [(0, 0)] * len(levels)
    share = lambda i: (wanted[i] - full[i][0]) / (weight - full[i][1]) if weight > full[i][1] else math.inf
    while True:
        sums = sources.agg(*[F.coalesce(F.sum(F.when(ratio <= share(i), F.col(c))), F.lit(0)) for i in range(len(levels)) for c in ("m_avail", "m_weight")]).first()
        now = [(sums[2 * i], sums[2 * i + 1]) for i in range(len(levels))]
        if now == full:
            break
        full = now
    each = [F.struct(F.lit(i + 1).alias("i"), F.when(ratio <= share(i), F.col("m_avail")).otherwise(F.floor(F.lit(float(wanted[i] - full[i][0])) * F.col("m_weight") / F.lit(float(max(1, weight - full[i][1])))).cast("long")).alias("left")) for i in range(len(levels))]
    return sources.withColumn("m_b", F.explode(F.array(*each))).select("m_source", F.col("m_b.i").alias("m_level"), F.col("m_b.left").alias("m_left"), "m_avail", (F.col("m_weight") / F.lit(float(weight))).alias("m_target"))


def source_totals(first: DataFrame, weights: dict[str, float] | None, default_weight: float | None) -> DataFrame:
    weights = WEIGHTS if weights is None else weights
    return cut(first.groupBy("m_source").agg(F.sum("m_sum").alias("m_avail")).withColumn("m_weight", _weight(F.col("m_source"), F.col("m_avail"), weights, default_weight)))


def thresholds(narrow: DataFrame, weights=None, default_weight=DEFAULT_WEIGHT, total_fraction=TOTAL_FRACTION, levels=LEVELS) -> DataFrame:
    """(m_source, m_level, m_limit): documents of the source with a hash below the limit are in the level.

    narrow: (m_source, m_tokens, m_hash), materialised."""
    shift = HASH_BITS - FIRST
    first = cut(narrow.groupBy("m_source", F.shiftright("m_hash", shift).alias("m_bucket")).agg(F.sum("m_tokens").alias("m_sum")))
    dealt = cut(budgets(source_totals(first, weights, default_weight), total_fraction, levels).drop("m_target"))
    w = Window.partitionBy("m_source", "m_level").orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def boundary(hist: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
        """The first bucket that goes beyond what is left, and what is left before it."""
        cum = hist.join(open_, keys).withColumn("m_cum", F.sum("m_sum").over(w))
        return cum.filter("m_cum > m_left").groupBy("m_source", "m_level").agg(F.min_by(F.struct("m_bucket", (F.col("m_left") - F.col("m_cum") + F.col("m_sum")).alias("m_left")), "m_bucket").alias("m_b")).select("m_source", "m_level", "m_b.m_bucket", "m_b.m_left")

    whole = dealt.filter("m_avail <= m_left").select("m_source", "m_level", F.lit(1 << HASH_BITS).cast("long").alias("m_limit"))
    edge = cut(boundary(first, dealt.filter("m_avail > m_left").drop("m_avail"), ["m_source"]))
    done = FIRST
    while done < HASH_BITS:
        done += NEXT
        # several levels may share a boundary bucket, so its documents are read once for each
        inside = join_small(narrow.withColumn("m_prefix", F.shiftright("m_hash", HASH_BITS - done + NEXT)), edge.withColumnRenamed("m_bucket", "m_prefix"), ["m_source", "m_prefix"], ["m_hash"])
        hist = inside.groupBy("m_source", "m_level", "m_left", F.shiftright("m_hash", HASH_BITS - done).alias("m_bucket")).agg(F.sum("m_tokens").alias("m_sum"))
        edge = cut(boundary(hist.drop("m_left"), edge.drop("m_bucket"), ["m_source", "m_level"]))
    return cut(edge.select("m_source", "m_level", F.col("m_bucket").alias("m_limit")).unionByName(whole))


def mixed(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows (with m_source and m_hash) that are in the largest mix, with m_in, the smallest level that holds each."""
    by_source = cut(limits.groupBy("m_source").agg(F.collect_list(F.struct("m_level", "m_limit")).alias("m_limits")))
    fits = F.array_min(F.transform(F.filter("m_limits", lambda x: F.col("m_hash") < x["m_limit"]), lambda x: x["m_level"]))
    return join_small(rows, by_source, ["m_source"], ["m_hash"]).withColumn("m_in", fits).filter("m_in is not null").drop("m_limits")


def narrow_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("m_source"), token_count(F.col("text")).alias("m_tokens"), id_hash(F.col("doc_id")).alias("m_hash"))


def mix_report(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, source, tokens, level) of every document in the largest mix."""
    narrow = cut(narrow_rows(docs))
    kept = mixed(narrow, thresholds(narrow, **parameters))
    return kept.select("doc_id", F.col("m_source").alias("source"), F.col("m_tokens").alias("tokens"), F.col("m_in").alias("level"))


def mix_shares(docs: DataFrame, weights=None, default_weight=DEFAULT_WEIGHT, total_fraction=TOTAL_FRACTION, levels=LEVELS) -> DataFrame:
    """(source, available, target, budget, tokens, share): of the largest mix, each source's part by weight and what it has in fact."""
    narrow = cut(narrow_rows(docs))
    sources = source_totals(narrow.groupBy("m_source").agg(F.sum("m_tokens").alias("m_sum")), weights, default_weight)
    dealt = budgets(sources, total_fraction, levels).filter(F.col("m_level") == len(levels))
    kept = mixed(narrow, thresholds(narrow, weights, default_weight, total_fraction, levels)).groupBy("m_source").agg(F.sum("m_tokens").alias("m_kept"))
    both = dealt.join(kept, "m_source", "left").withColumn("m_kept", F.coalesce("m_kept", F.lit(0)))
    return both.crossJoin(F.broadcast(both.agg(F.sum("m_kept").alias("m_all")))).select(F.col("m_source").alias("source"), F.col("m_avail").alias("available"), F.col("m_target").alias("target"), F.col("m_left").alias("budget"), F.col("m_kept").alias("tokens"), F.try_divide(F.col("m_kept").cast("double"), F.col("m_all").cast("double")).alias("share"))


def mix_filter(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the largest mix, with their own columns; their texts are read once to count and once to copy."""
    limits = thresholds(cut(narrow_rows(docs)), **parameters)
    return unwrapped(mixed(wrapped(docs, m_source=F.coalesce("source", F.lit("")), m_hash=id_hash(F.col("doc_id"))), limits))


def oracle(docs: str = "documents") -> str:
    """The same rows by running sums over sorted ratios and sorted hashes."""
    other = "sqrt(CAST(avail AS DOUBLE))" if DEFAULT_WEIGHT is None else f"CAST({DEFAULT_WEIGHT} AS DOUBLE)"
    each = "CASE source " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in WEIGHTS.items()) + f" ELSE {other} END" if WEIGHTS else other
    tiers = ", ".join(f"({i + 1}, CAST({x} AS DOUBLE))" for i, x in enumerate(LEVELS))
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS tokens,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM {docs}),
s AS (SELECT source, avail, greatest(CAST(floor({each} * {UNIT}) AS BIGINT), 1) AS weight FROM (SELECT source, CAST(sum(tokens) AS BIGINT) AS avail FROM d GROUP BY source)),
l AS (SELECT *, CAST(avail AS DOUBLE) / weight AS ratio, CAST(floor(CAST((SELECT sum(avail) FROM s) AS DOUBLE) * CAST({TOTAL_FRACTION} AS DOUBLE) * x) AS BIGINT) AS wanted FROM s, (VALUES {tiers}) t(level, x)),
r AS (SELECT *, sum(weight) OVER (PARTITION BY level) AS weights, coalesce(sum(avail) OVER w, 0) AS before_avail, coalesce(sum(weight) OVER w, 0) AS before_weight FROM l
  WINDOW w AS (PARTITION BY level ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
f AS (SELECT *, ratio <= CAST(wanted - before_avail AS DOUBLE) / CAST(weights - before_weight AS DOUBLE) AS filled FROM r),
g AS (SELECT *, wanted - coalesce(sum(avail) FILTER (filled) OVER (PARTITION BY level), 0) AS rest, weights - coalesce(sum(weight) FILTER (filled) OVER (PARTITION BY level), 0) AS rest_weight FROM f),
b AS (SELECT source, level, CASE WHEN filled THEN avail ELSE CAST(floor(CAST(rest AS DOUBLE) * weight / CAST(greatest(1, rest_weight) AS DOUBLE)) AS BIGINT) END AS budget FROM g),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS run FROM d)
SELECT doc_id, c.source, tokens, min(level) AS level FROM c JOIN b ON b.source = c.source AND run <= budget GROUP BY ALL"""
