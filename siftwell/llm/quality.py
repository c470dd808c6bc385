"""Operator 9: quality rules with adaptive thresholds from mergeable quantile sketches.

Each metric is a whole number, so its sketch can be a log-linear histogram: exact below 64, above that 32 buckets an octave
(within 3.2 % of the value). Histograms of the same metric merge by adding counts: one per language and source where these
have MIN_GROUP documents, else the merged one of the language, else that of all documents. Bounds are the quartiles widened
by WIDTH times their distance, at least MARGIN of the metric; a document outside any bound is rejected.

Metrics: symbols, capitals per 1000 characters (100 characters are added below the line, so that short texts are judged
mildly), distinct words per 1000 words (20 distinct words are added to both), characters per 100 words (20 words of 6
characters are added).

Defined cases: a null or empty text is rejected; a null language or source counts as ''; ties in a sketch share a bucket;
repeated rows are judged alike and all count; other columns stay as they are, whatever their names; an empty table stays empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spark_io import cut, join_small, unwrapped, wrapped

#: Metric: (least distance of the quartiles that counts, whether low values are rejected, whether high ones are).
METRICS = {"symbols": (8, False, True), "capitals": (8, False, True), "distinct": (60, True, False), "word_size": (40, True, True)}
MIN_GROUP, WIDTH = 200, 4
_WORD = "[^ \\t\\n\\r\\f]+"
_PREFIX = "q_"


def metrics(text: Column) -> dict[str, Column]:
    n = F.length(text)
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    k = F.size(words)
    per = lambda a, b: F.floor(a / b).cast("long")
    return {
        "symbols": per(F.length(F.regexp_replace(text, "[\\p{L}\\p{N} \\t\\n\\r\\f]+", "")) * 1000, n + 100),
        "capitals": per(F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")) * 1000, n + 100),
        "distinct": per((F.size(F.array_distinct(words)) + 20) * 1000, k + 20),
        "word_size": per((n + 120) * 100, k + 20),
    }


def bucket(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (shift * 32 + F.floor(v / F.pow(F.lit(2.0), shift))).cast("long")


def bucket_value(b: Column) -> Column:
    """The least value of a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0))
    return ((b - shift * 32) * F.pow(F.lit(2.0), shift)).cast("long")


def measured() -> dict[str, Column]:
    """Language, source, whether the text is empty, and the metrics, under q_ names."""
    found = {_PREFIX + k: c for k, c in metrics(F.col("text")).items()}
    return {"q_lang": F.coalesce("lang", F.lit("")), "q_source": F.coalesce("source", F.lit("")), "q_empty": F.coalesce(F.length("text"), F.lit(0)) == 0} | found


def bounds(narrow: DataFrame, min_group: int = MIN_GROUP, width: int = WIDTH) -> DataFrame:
    """(q_lang, q_source, q_bounds): lowest and highest value allowed of each metric, null for no bound."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), bucket(F.col(_PREFIX + m)).alias("b")) for m in METRICS]))
    sketch = cut(narrow.filter("not q_empty").select("q_lang", "q_source", pairs.alias("p")).groupBy("q_lang", "q_source", F.col("p.m").alias("m"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n")))
    scopes = []
    for rank, keys in enumerate((["q_lang", "q_source"], ["q_lang"], [])):
        merged = sketch.groupBy(*keys, "m", "b").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "m")
        cum = merged.withColumns({"c": F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "t": F.sum("n").over(w)})
        at = lambda q: bucket_value(F.min(F.when(F.col("c") * 4 >= F.col("t") * q, F.col("b"))))
        scopes.append((rank, keys, cum.groupBy(*keys, "m").agg(F.max("t").alias("t"), at(1).alias("q1"), at(3).alias("q3"))))
    groups = sketch.select("q_lang", "q_source", "m").distinct()
    rows = [groups.join(s, [*keys, "m"]).withColumn("r", F.lit(rank)) for rank, keys, s in scopes]
    best = reduce(DataFrame.unionByName, [r.select("q_lang", "q_source", "m", "t", "q1", "q3", "r") for r in rows]).filter((F.col("t") >= min_group) | (F.col("r") == len(scopes) - 1))
    chosen = best.groupBy("q_lang", "q_source", "m").agg(F.min_by(F.struct("q1", "q3"), "r").alias("q"))
    least = reduce(lambda rest, kv: F.when(F.col("m") == kv[0], F.lit(kv[1][0])).otherwise(rest), METRICS.items(), F.lit(0))
    reach = width * F.greatest(F.col("q.q3") - F.col("q.q1"), least)
    low = F.col("m").isin([k for k, v in METRICS.items() if v[1]])
    high = F.col("m").isin([k for k, v in METRICS.items() if v[2]])
    ends = F.struct(F.when(low, F.col("q.q1") - reach).cast("long").alias("lo"), F.when(high, F.col("q.q3") + reach).cast("long").alias("hi"))
    return cut(chosen.groupBy("q_lang", "q_source").agg(F.map_from_entries(F.collect_list(F.struct("m", ends.alias("e")))).alias("q_bounds")))


def kept(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The measured rows inside all bounds of their language and source."""
    inside = [~F.col("q_empty")]
    for m in METRICS:
        e, v = F.col("q_bounds")[m], F.col(_PREFIX + m)
        inside.append(F.coalesce(v >= e["lo"], F.lit(True)) & F.coalesce(v <= e["hi"], F.lit(True)))
    return join_small(rows.filter(~F.col("q_empty")), limits, ["q_lang", "q_source"], [_PREFIX + m for m in METRICS]).filter(reduce(Column.__and__, inside))


def quality_report(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, lang, source, symbols, capitals, distinct_words, word_size) of the documents that pass; texts are read once."""
    narrow = cut(docs.select("doc_id", *[c.alias(k) for k, c in measured().items()]))
    good = kept(narrow, bounds(narrow, **parameters))
    return good.select("doc_id", F.col("q_lang").alias("lang"), F.col("q_source").alias("source"), F.col("q_symbols").alias("symbols"), F.col("q_capitals").alias("capitals"), F.col("q_distinct").alias("distinct_words"), F.col("q_word_size").alias("word_size"))


def quality_filter(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that pass, with their own columns."""
    limits = bounds(cut(docs.select(*[c.alias(k) for k, c in measured().items()])), **parameters)
    return unwrapped(kept(wrapped(docs, **measured()), limits))


def oracle(docs: str = "documents") -> str:
    """The kept rows with their metrics."""
    rx = "'[^ \\t\\n\\r\\f]+'"
    met = f"""SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  length(regexp_replace(text, '[\\p{{L}}\\p{{N}} \\t\\n\\r\\f]+', '', 'g')) * 1000 // (length(text) + 100) AS symbols,
  length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) * 1000 // (length(text) + 100) AS capitals,
  (len(list_distinct(regexp_extract_all(text, {rx}))) + 20) * 1000 // (len(regexp_extract_all(text, {rx})) + 20) AS distinct_words,
  (length(text) + 120) * 100 // (len(regexp_extract_all(text, {rx})) + 20) AS word_size FROM {docs} WHERE length(text) > 0"""
    names = {"symbols": "symbols", "capitals": "capitals", "distinct": "distinct_words", "word_size": "word_size"}
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS m, {c} AS v FROM d" for m, c in names.items())

    def scope(rank: int, keys: str) -> str:
        part = f"{keys}, " if keys else ""
        return f"SELECT {rank} AS r, {'lang' if rank < 2 else 'NULL'} AS l, {'source' if rank < 1 else 'NULL'} AS s, m, max(t) AS t, min(b) FILTER (c * 4 >= t) AS b1, min(b) FILTER (c * 4 >= t * 3) AS b3 FROM (SELECT *, sum(n) OVER (PARTITION BY {part}m ORDER BY b) AS c, sum(n) OVER (PARTITION BY {part}m) AS t FROM (SELECT {part}m, b, count(*) AS n FROM x GROUP BY {part}m, b)) GROUP BY {part}m"

    value = lambda b: f"({b} - greatest({b} // 32 - 1, 0) * 32) * (1::BIGINT << greatest({b} // 32 - 1, 0))"
    least = " ".join(f"WHEN '{m}' THEN {v[0]}" for m, v in METRICS.items())
    tests = []
    for m, v in METRICS.items():
        if v[1]:
            tests.append(f"{names[m]} >= (SELECT q1 - reach FROM g WHERE g.lang = d.lang AND g.source = d.source AND m = '{m}')")
        if v[2]:
            tests.append(f"{names[m]} <= (SELECT q3 + reach FROM g WHERE g.lang = d.lang AND g.source = d.source AND m = '{m}')")
    return f"""WITH d AS ({met}), y AS ({long}),
x AS (SELECT *, greatest(length(bin(v)) - 6, 0) * 32 + (v >> greatest(length(bin(v)) - 6, 0)) AS b FROM y),
z AS ({scope(0, 'lang, source')} UNION ALL {scope(1, 'lang')} UNION ALL {scope(2, '')}),
p AS (SELECT k.lang, k.source, z.m, arg_min(b1, r) AS b1, arg_min(b3, r) AS b3 FROM (SELECT DISTINCT lang, source FROM d) k JOIN z ON (r = 0 AND l = lang AND s = source) OR (r = 1 AND l = lang) OR r = 2 WHERE t >= {MIN_GROUP} OR r = 2 GROUP BY ALL),
q AS (SELECT lang, source, m, {value('b1')} AS q1, {value('b3')} AS q3 FROM p),
g AS (SELECT *, {WIDTH} * greatest(q3 - q1, CASE m {least} END) AS reach FROM q)
SELECT doc_id, lang, source, symbols, capitals, distinct_words, word_size FROM d WHERE {' AND '.join(tests)}"""
