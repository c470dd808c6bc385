"""Queries of the text-quality layer over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk_score as C
from ..operators import chunkers as S
from ..operators import duplicates as D
from . import signals_sql as Q
from .tables import six, table

SIG = f"WITH sig AS ({Q.signals()})"
NEAR = 0.9


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _column(name: str, f, sql: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _docs(spark, sf).select("doc_id", six(f(F.col("text"))).alias(name))

    return query, f"{SIG} SELECT doc_id, CAST(round({sql}, 6) AS DOUBLE) AS {name} FROM sig"


def t16_chunk_score(spark: SparkSession, sf: str) -> DataFrame:
    v = C.validate(C.chunks(_docs(spark, sf)))
    return v.select(F.col("id").alias("doc_id"), *[six(F.col(c)).alias(c) for c in ("extraction", "coherence", "density", "duplicate", "score")], "passed", C.codes().alias("codes"))


def t14_required_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which every third has no language and every fifth a title: which keys are missing, and whether that is an issue."""
    meta = F.map_filter(F.create_map(F.lit("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.lit("title"), F.when(F.col("doc_id") % 5 == 0, F.lit("t"))), lambda k, v: v.isNotNull() | (k == "title"))
    v = C.validate(_docs(spark, sf).select(F.col("doc_id").alias("id"), "text", "source", meta.alias("metadata")), required=("lang", "title"))
    return v.select(F.col("id").alias("doc_id"), F.exists("issues", lambda x: x["code"] == "MISSING_METADATA").alias("missing"), F.array_join(C.missing_keys(F.col("metadata"), ("lang", "title")), ",").alias("keys"))


def t22_extraction_score(spark: SparkSession, sf: str) -> DataFrame:
    e = C.extraction(_docs(spark, sf))
    return e.select("doc_id", six(F.col("boilerplate")).alias("boilerplate"), six(F.col("extraction_score")).alias("extraction_score"), "acceptable", C.codes().alias("codes"))


def t23_page_score(spark: SparkSession, sf: str) -> DataFrame:
    p = C.page_score(table(spark, sf, "pages").select("page_id", F.col("html").alias("text")))
    return p.select("page_id", six(F.col("overall")).alias("overall"), "passed")


def t24_paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.paragraph_chunks(_docs(spark, sf).select("doc_id", "text"), 1000)


def c1_recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.recursive_chunks(_docs(spark, sf))


def c2_size_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_by_size(_docs(spark, sf).select("doc_id", "text"), 500, 50)


def c3_sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.sentence_chunks(_docs(spark, sf).select("doc_id", "text"), 500)


def t20_language(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.language(F.col("text")).alias("language"))


def _near(spark: SparkSession, sf: str, items, t: float) -> DataFrame:
    return D.near(D.item_sets(_docs(spark, sf), items(F.col("text")), "doc_id"), t)


def _linked(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "class_id", "copies", "links", six(F.col("best")).alias("best"))


def d1_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _linked(_near(spark, sf, D.shingles, 0.92))


def d2_word_set_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _linked(_near(spark, sf, D.words, 0.92))


def near(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, D.shingles, NEAR)


def validated(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    """All documents as one batch, each checked against the earlier ones too."""
    known = D.penalties(near(spark, sf) if found is None else found).withColumnRenamed("duplicate", "dup")
    return C.validate(C.measured(C.chunks(_docs(spark, sf))).join(known, "id", "left"), duplicate=F.col("dup")).drop("dup")


def d3_scored_with_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    v = validated(spark, sf)
    return v.select(F.col("id").alias("doc_id"), six(F.col("duplicate")).alias("duplicate"), six(F.col("score")).alias("score"), "passed", C.codes().alias("codes"))


def d4_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return D.groups(near(spark, sf))


def a05_duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    return D.group_report(_docs(spark, sf), near(spark, sf))


def a01_batch_report(spark: SparkSession, sf: str) -> DataFrame:
    r = C.report(validated(spark, sf))
    return r.withColumn("avg_score", six(F.col("avg_score")))


def a02_issue_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return C.issue_histogram(validated(spark, sf))


def p01_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return validated(spark, sf).filter("passed").select(F.col("id").alias("doc_id"), "source")


def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    v = validated(spark, sf).select(F.col("id").alias("doc_id"), "passed")
    return v.join(table(spark, sf, "labels"), "doc_id").groupBy("quality", "passed").agg(F.count(F.lit(1)).alias("n"))


_WORDS = "SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\s\\x{85}\\p{Z}\\x{1c}-\\x{1f}\\v]+'), lambda x: x <> '') AS w FROM documents"


def _sets(items: str) -> str:
    """Distinct words, or runs of three of them."""
    if items == "w":
        return f"SELECT doc_id, list_distinct(w) AS s FROM ({_WORDS})"
    run = "x || ' ' || lead(x, 1) OVER t || ' ' || lead(x, 2) OVER t"
    return f"SELECT doc_id, list(DISTINCT g) AS s FROM (SELECT doc_id, {run} AS g FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM ({_WORDS})) WINDOW t AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL GROUP BY doc_id"


def _pairs_sql(items: str, t: float) -> str:
    return f"""sets AS (SELECT * FROM ({_sets(items)}) WHERE len(s) > 0), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a, b, k / (na + nb - k) AS similarity FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb FROM one x JOIN one y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) WHERE k / (na + nb - k) >= {t} - 1e-9)"""


_GRAMS = "runs"
_SHINGLES = _pairs_sql(_GRAMS, NEAR)
#: With batch(), the scores of documents each of which is checked against the earlier ones.
BATCH = f"{SIG}, {_SHINGLES}, pen AS (SELECT b, 1 - max(similarity) AS p FROM pairs GROUP BY b), batch AS ({Q.chunk_scores(dup='coalesce(p, 1.0)', join='LEFT JOIN pen ON b = doc_id')})"


def _linked_sql(items: str, t: float) -> str:
    return f"""WITH sets AS (SELECT doc_id, list_sort(s) AS s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class_id, count(*) OVER (PARTITION BY list_sort(s)) - 1 AS copies FROM ({_sets(items)}) WHERE len(s) > 0),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets WHERE doc_id = class_id),
pairs AS (SELECT a, b, k / (na + nb - k) AS similarity FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb FROM one x JOIN one y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) WHERE k / (na + nb - k) >= {t} - 1e-9),
l AS (SELECT a, count(*) AS links, max(similarity) AS top FROM pairs GROUP BY a)
SELECT doc_id, class_id, copies, coalesce(links, 0) AS links, round(CASE WHEN copies > 0 THEN 1.0 ELSE top END, 6)::DOUBLE AS best FROM sets LEFT JOIN l ON a = class_id WHERE copies > 0 OR links > 0"""


_SCORED = f"{SIG} SELECT doc_id, round(extraction, 6) AS extraction, round(CAST(coherence AS DOUBLE), 6) AS coherence, round(density, 6) AS density, round(CAST(duplicate AS DOUBLE), 6) AS duplicate, round(score, 6) AS score, passed, codes FROM ({Q.chunk_scores()})"
_FOLD = "list_reduce(list_concat([{start}], list_transform({pieces}, lambda p: {{'done': []::VARCHAR[], 'open': p, 'length': 0, 'count': 0}})), lambda s, q: {step})"

QUERIES, ORACLE_SQL = {}, {}
for _name, _f, _sql in (
    ("t01_entropy", lambda c: T.entropy(c), "ent"),
    ("t02_special_ratio", lambda c: T.special_ratio(c), "special"),
    ("t03_word_ratio", lambda c: T.word_ratio(c), "good"),
    ("t04_consonant_runs", lambda c: T.consonant_runs(c), "cons"),
    ("t05_gibberish", lambda c: T.gibberish(c), "gib"),
    ("t06_ocr_confidence", lambda c: T.ocr_confidence(c), "ocr"),
    ("t07_density", lambda c: T.density(c), "den"),
    ("t09_sentence_count", lambda c: T.sentence_count(c), "CAST(sentences AS DOUBLE)"),
    ("t10_coherence", lambda c: T.coherence(c), "coh"),
    ("t18_corrupt_ratio", lambda c: T.corrupt_ratio(c), "bad"),
    ("t21_boilerplate", lambda c: T.boilerplate_ratio(c), "boiler"),
):
    QUERIES[_name], ORACLE_SQL[_name] = _column(_name.split("_", 1)[1], _f, _sql)
ORACLE_SQL["t08_low_density"] = f"{SIG} SELECT doc_id FROM sig WHERE den < 0.3"
QUERIES["t08_low_density"] = lambda spark, sf: _docs(spark, sf).filter(T.density(F.col("text")) < C.MIN_DENSITY).select("doc_id")
QUERIES |= {f.__name__: f for f in (t16_chunk_score, t14_required_metadata, t20_language, t22_extraction_score, t23_page_score, t24_paragraph_chunks, c1_recursive_chunks, c2_size_chunks, c3_sentence_chunks, d1_near_duplicates, d2_word_set_duplicates, d3_scored_with_duplicates, d4_duplicate_groups, a05_duplicate_report, a01_batch_report, a02_issue_histogram, p01_accepted, label_agreement)}
ORACLE_SQL |= {
    "t16_chunk_score": _SCORED,
    "t14_required_metadata": "SELECT doc_id, doc_id % 3 = 0 OR lang IS NULL OR doc_id % 5 <> 0 AS missing, concat_ws(',', CASE WHEN doc_id % 3 = 0 OR lang IS NULL THEN 'lang' END, CASE WHEN doc_id % 5 <> 0 THEN 'title' END) AS keys FROM documents",
    "t20_language": Q.language_vote(),
    "t22_extraction_score": f"{SIG} SELECT doc_id, round(boilerplate, 6) AS boilerplate, round(extraction_score, 6) AS extraction_score, acceptable, codes FROM ({Q.extraction_scores()})",
    "t23_page_score": f"WITH sig AS ({Q.signals('pages', 'html', 'page_id')}) SELECT page_id, round(0.4 * extraction_score + 0.3 * CASE WHEN length(s) < 50 THEN 0.3 ELSE 1 END + 0.3 * (1 - short_lines), 6) AS overall, acceptable AND length(s) >= 50 AS passed FROM ({Q.extraction_scores()})",
    "c2_size_chunks": "SELECT doc_id, CAST(i AS INT) AS chunk_index, substr(text, CAST(i * 450 + 1 AS BIGINT), 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 1, 0)) // 450 + 1)) AS i FROM documents) WHERE regexp_matches(substr(text, CAST(i * 450 + 1 AS BIGINT), 500), '\\S')",
    "d1_near_duplicates": _linked_sql(_GRAMS, 0.92),
    "d2_word_set_duplicates": _linked_sql("w", 0.92),
    "d3_scored_with_duplicates": f"{BATCH} SELECT doc_id, round(duplicate, 6) AS duplicate, round(score, 6) AS score, passed, codes FROM batch",
    "d4_duplicate_groups": f"WITH {_SHINGLES} SELECT b AS id, min(a) AS representative FROM pairs GROUP BY b",
    "a05_duplicate_report": f"WITH {_SHINGLES}, g AS (SELECT b AS id, min(a) AS r FROM pairs GROUP BY b) SELECT (SELECT count(*) FROM documents) AS checked, (SELECT count(DISTINCT r) FROM g) AS duplicate_groups, (SELECT count(*) FROM (SELECT id FROM g UNION SELECT r FROM g)) AS duplicate_chunks",
    "a01_batch_report": f"{BATCH} SELECT count(*) AS total, sum(passed::BIGINT)::BIGINT AS passed, sum((NOT passed)::BIGINT)::BIGINT AS failed, sum((warned AND passed)::BIGINT)::BIGINT AS warnings, round(avg(score), 6) AS avg_score FROM batch",
    "a02_issue_histogram": f"{BATCH} SELECT code, count(*) AS n FROM (SELECT unnest(string_split(codes, ',')) AS code FROM batch WHERE codes <> '') GROUP BY code",
    "p01_accepted": f"{BATCH} SELECT doc_id, source FROM batch JOIN documents USING (doc_id) WHERE passed",
    "label_agreement": f"{BATCH} SELECT quality, passed, count(*) AS n FROM batch JOIN labels USING (doc_id) GROUP BY ALL",
}
# greedy packing as a recursive walk over numbered pieces
_WALK = """WITH RECURSIVE p AS ({pieces}), r AS (SELECT doc_id, 1::BIGINT AS i, 0::BIGINT AS c, {first} AS room FROM p WHERE i = 1
UNION ALL SELECT p.doc_id, p.i, CASE WHEN {joins} THEN r.c ELSE r.c + 1 END, CASE WHEN {joins} THEN r.room + {more} ELSE {first_p} END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
SELECT r.doc_id, CAST(dense_rank() OVER (PARTITION BY r.doc_id ORDER BY c) - 1 AS INT) AS chunk_index, chunk FROM (SELECT r.doc_id, c, {glue} AS chunk FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY r.doc_id, c) r WHERE chunk <> ''"""
_SENTENCES = f"SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i FROM (SELECT doc_id, {Q.STRIP('s')} AS s, j FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS j FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\\s\\x{{85}}\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents))) WHERE s <> ''"
ORACLE_SQL["c3_sentence_chunks"] = _WALK.format(pieces=_SENTENCES, first="length(s) + 1", joins="r.room + length(p.s) <= 500", more="length(p.s) + 1", first_p="length(p.s) + 1", glue="string_agg(s, ' ' ORDER BY p.i)")
_PARAGRAPHS = "SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS x FROM documents)"
ORACLE_SQL["t24_paragraph_chunks"] = _WALK.format(pieces=_PARAGRAPHS, first="length(s)", joins="r.room + length(p.s) <= 1000", more="length(p.s) + CASE WHEN r.room > 0 THEN 2 ELSE 0 END", first_p="length(p.s)", glue=Q.STRIP("string_agg(s, chr(10) || chr(10) ORDER BY p.i)"))
