"""Operator 8: URL filters by a path-template tree.

Each URL is cut into host and path segments (query and fragment go). Per host the segments form a tree:

1. Variable segments become wildcards: a segment that holds a digit is '*' ('*.ext' with an extension), and where a node
   has more than FAN_OUT other children, all of these become '*'.
2. Similar branches merge: templates of a host that differ in one named segment alone, the last named one, form a family.
   A member whose share of good labels differs from the family's by at most MERGE_Z standard errors, or that has no label,
   joins the family's branch '{}'; the others stay alone. The decision on a member needs only its own and the family's
   counts, so it doesn't depend on any order.
3. A template's purity is (good + ALPHA * prior) / (labelled + ALPHA), the prior being the share of good labels over all
   pages; below MIN_PURITY its pages are rejected.

A page is good if its label has quality 1 and isn't toxic; labels belong to pages of the same number. Paths of any depth are
used whole; levels at which no host has more than FAN_OUT names can't widen and cost nothing.

Defined cases: a null or empty URL and one without a scheme have the host '' and the template ''; several labels of one page
count as good if all are; a null page_id has no label and its row is kept; repeated rows count each; no label at all gives
every template the prior 1; other columns are ignored, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import BROADCAST_ROWS, cut, join_small

#: Production parameters.
FAN_OUT, MERGE_Z, ALPHA, MIN_PURITY = 20, 1.0, 4.0, 0.4
_EXT = "^.*[0-9].*(\\.[A-Za-z]{1,5})$"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def segments_of(url: Column) -> Column:
    """Path segments with the variable ones by their look as wildcards."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    each = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(each, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, _EXT, 1))).otherwise(s))


def page_labels(labels: DataFrame) -> DataFrame:
    """(l_id, l_good): one row a page."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.min(good.cast("int")).alias("l_good"))


def fan_out(counts: DataFrame, limit: int) -> DataFrame:
    """Replace the named children of nodes that have more than so many, level by level; counts: (u_host, u_segs, ...)."""
    keys = [c for c in counts.columns if c not in ("u_host", "u_segs")]
    # only where a host has so many names at a level, whatever their parents, can a node have them
    level = counts.select("u_host", F.posexplode("u_segs").alias("u_at", "u_name")).filter(~F.col("u_name").startswith("*")).distinct().groupBy("u_host", "u_at").agg(F.count(F.lit(1)).alias("u_n"))
    for d in sorted(r[0] for r in level.filter(F.col("u_n") > limit).select("u_at").distinct().collect()):
        here = F.get("u_segs", F.lit(d))
        parent = F.slice("u_segs", 1, d)
        named = here.isNotNull() & ~here.startswith("*")
        nodes = counts.filter(named).select("u_host", parent.alias("u_parent"), here.alias("u_child")).distinct()
        wide = cut(nodes.groupBy("u_host", "u_parent").agg(F.count(F.lit(1)).alias("u_n")).filter(F.col("u_n") > limit).select("u_host", "u_parent", F.lit(True).alias("u_wide")))
        if wide.isEmpty():
            continue
        side = F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide
        changed = F.transform("u_segs", lambda s, i: F.when((i == d) & F.col("u_wide") & ~s.startswith("*"), F.lit("*")).otherwise(s))
        counts = cut(counts.withColumn("u_parent", parent).join(side, ["u_host", "u_parent"], "left").withColumn("u_segs", F.when(F.col("u_wide"), changed).otherwise(F.col("u_segs"))).select("u_host", "u_segs", *keys))
    return counts


def family_of(segs: Column) -> Column:
    """The template with its last named segment as '{}'; null without one."""
    last = F.array_max(F.transform(segs, lambda s, i: F.when(~s.startswith("*"), i)))
    return F.when(last.isNotNull(), F.transform(segs, lambda s, i: F.when(i == last, F.lit("{}")).otherwise(s)))


def templates(pages: DataFrame, labels: DataFrame, fan: int = FAN_OUT, z: float = MERGE_Z, alpha: float = ALPHA, purity: float = MIN_PURITY) -> tuple[DataFrame, DataFrame]:
    """(rows, decisions): rows (page_id, url, u_host, u_raw); decisions (u_host, u_raw, template, pages, labelled, good, purity, keep)."""
    found = pages.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("u_host"), F.coalesce(segments_of(F.col("url")), F.array().cast("array<string>")).alias("u_raw"))
    rows = cut(found)
    known = rows.join(page_labels(labels), rows["page_id"] == F.col("l_id"), "left")
    counts = cut(known.groupBy("u_host", "u_raw").agg(F.count(F.lit(1)).alias("n"), F.count("l_good").alias("k"), F.coalesce(F.sum("l_good"), F.lit(0)).alias("g")))
    total = counts.agg(F.sum("g"), F.sum("k")).first()
    prior = total[0] / total[1] if total[1] else 1.0
    tree = fan_out(counts.withColumn("u_segs", F.col("u_raw")), fan)
    node = cut(tree.groupBy("u_host", "u_segs").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("g").alias("g")).withColumn("family", family_of(F.col("u_segs"))))
    families = node.filter("family is not null").groupBy("u_host", "family").agg(F.sum("k").alias("fk"), F.sum("g").alias("fg"), F.count(F.lit(1)).alias("members"))
    share = F.try_divide("fg", "fk")
    apart = F.pow(F.try_divide("g", "k") - share, F.lit(2)) * F.col("k") > z * z * share * (1 - share)
    joins = F.col("family").isNotNull() & (F.col("members") > 1) & ((F.col("k") == 0) | ~apart)
    merged = cut(node.join(families, ["u_host", "family"], "left").withColumn("u_final", F.when(joins, F.col("family")).otherwise(F.col("u_segs"))))
    # a branch kept apart may be named as a family is: the two are told apart by the flag
    text = F.concat(F.lit("/"), F.concat_ws("/", "u_final"))
    merged = merged.select("u_host", "u_segs", F.when(F.col("u_host") == "", F.lit("")).otherwise(text).alias("template"), "n", "k", "g")
    sums = merged.groupBy("u_host", "template").agg(F.sum("n").alias("pages"), F.sum("k").alias("labelled"), F.sum("g").alias("good"))
    smooth = F.round((F.col("good") + alpha * prior) / (F.col("labelled") + alpha), 9)
    judged = sums.withColumn("purity", smooth).withColumn("keep", F.col("purity") >= purity)
    decisions = cut(tree.select("u_host", "u_segs", "u_raw").join(merged.select("u_host", "u_segs", "template"), ["u_host", "u_segs"]).join(judged, ["u_host", "template"]).select("u_host", "u_raw", "template", "pages", "labelled", "good", "purity", "keep"))
    return rows, decisions


def url_report(pages: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """(page_id, host, template, pages, labelled, good, purity, keep) of every page."""
    rows, decisions = templates(pages, labels, **parameters)
    return join_small(rows, decisions, ["u_host", "u_raw"], ["page_id", "url"]).select("page_id", F.col("u_host").alias("host"), "template", "pages", "labelled", "good", "purity", "keep")


def url_filter(pages: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The pages of templates that are pure enough: their page_id and url."""
    rows, decisions = templates(pages, labels, **parameters)
    return join_small(rows, decisions.filter("keep"), ["u_host", "u_raw"], ["page_id", "url"]).select("page_id", "url")


def oracle() -> str:
    """The same report in DuckDB."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    raw = f"""SELECT page_id, coalesce(lower(regexp_extract(url, '{scheme}(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
  coalesce(list_transform(list_filter(string_split(regexp_extract(url, '{scheme}[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' || regexp_extract(s, '{_EXT.replace(chr(92) * 2, chr(92))}', 1) ELSE s END), []) AS segs FROM pages"""
    last = "(SELECT * FROM walk WHERE d = (SELECT deep FROM m))"
    c = "CASE WHEN len(segs) > d AND NOT starts_with(segs[d + 1], '*') THEN segs[d + 1] END"
    named = "list_max(list_transform(range(1, len(segs) + 1), lambda i: CASE WHEN NOT starts_with(segs[i], '*') THEN i END))"
    return f"""WITH RECURSIVE r AS ({raw}),
lab AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
m AS (SELECT max(len(segs)) AS deep FROM r),
walk AS (SELECT 0 AS d, page_id, host, segs, good FROM r LEFT JOIN lab ON page_id = doc_id
UNION ALL SELECT d + 1, page_id, host, CASE WHEN wide > {FAN_OUT} AND c IS NOT NULL THEN segs[:d] || ['*'] || segs[d + 2:] ELSE segs END, good FROM (SELECT *, {c} AS c, count(DISTINCT {c}) OVER (PARTITION BY host, segs[:d]) AS wide FROM walk) WHERE d < (SELECT deep FROM m)),
node AS (SELECT host, segs, count(*) AS n, count(good) AS k, coalesce(sum(good), 0) AS g, {named} AS nm FROM {last} GROUP BY host, segs),
fam AS (SELECT *, CASE WHEN nm IS NOT NULL THEN segs[:nm - 1] || ['{{}}'] || segs[nm + 1:] END AS family FROM node),
agg AS (SELECT *, sum(k) OVER (PARTITION BY host, family) AS fk, sum(g) OVER (PARTITION BY host, family) AS fg, count(*) OVER (PARTITION BY host, family) AS members FROM fam),
fin AS (SELECT *, CASE WHEN host = '' THEN '' ELSE '/' || array_to_string(CASE WHEN family IS NOT NULL AND members > 1 AND (k = 0 OR NOT pow(g / k - fg / fk, 2) * k > {MERGE_Z * MERGE_Z} * (fg / fk) * (1 - fg / fk)) THEN family ELSE segs END, '/') END AS template FROM agg),
pr AS (SELECT coalesce(sum(good) / count(good), 1.0) AS prior FROM {last}),
t AS (SELECT host, template, sum(n)::BIGINT AS pages, sum(k)::BIGINT AS labelled, sum(g)::BIGINT AS good FROM fin GROUP BY ALL),
j AS (SELECT *, round((good + {ALPHA} * (SELECT prior FROM pr)) / (labelled + {ALPHA}), 9) AS purity FROM t)
SELECT page_id, l.host, j.template, pages, labelled, j.good, purity, purity >= {MIN_PURITY} AS keep
FROM {last} l JOIN fin ON fin.host = l.host AND fin.segs = l.segs JOIN j ON j.host = l.host AND j.template = fin.template"""
