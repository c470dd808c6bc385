"""Queries of rules, registry, relevance, retrieval, health, store and sources."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import cut, shared_folder
from ..operators import chunk_score as C
from ..operators import chunkers as S2
from ..operators import config as G
from ..operators import duplicates as D
from ..operators import export as E
from ..operators import health as H
from ..operators import ingest as N
from ..operators import registry as R
from ..operators import relevance as V
from ..operators import rules as L
from ..operators import store as K
from ..sources import readers as S
from . import quality_queries as B
from . import signals_sql
from .tables import six, table

RULES = [
    L.Rule("has_number", pattern="[0-9]", field="required", severity="warning"),
    L.Rule("mentions_the", pattern="(^|[^a-z])the([^a-z]|$)", field="required", severity="error"),
    L.Rule("number_range", kind="numerical", low=10, high=1000, severity="warning"),
    L.Rule("chars_range", kind="numerical", low=100, high=20000, field="n_chars", severity="error"),
    L.Rule("has_title", kind="required", field="title", severity="info"),
    L.Rule("inert", pattern="the"),
]
FACTS = [L.Fact("the", 20.0, 5.0), L.Fact("total", 7.0)]
PATTERNS = [R.Pattern("*.example.org", "org", 1, 30), R.Pattern("www.*", "web", 2, 60), R.Pattern("https?://m\\.", "mobile", 4, 10, regex=True), R.Pattern("blog.*.example.net", "blog", 5, 7)]
BLOCKED = ["*adult*", "spam.*"]
TOPICS = ["the and", "of", "der", "nicht in the index", "que la"]
INTENT = V.Intent("demo", "Answers about invented prose.", ["readers"], ["What is it?"], TOPICS, ["password", "trash"], "Utopia", ["Erewhon"])
AS_OF = "2024-02-15 00:00:00"


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(table(spark, sf, "documents"))


def p06_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = L.apply_rules(_meta(spark, sf), RULES)
    return d.select(F.col("id").alias("doc_id"), F.array_join(F.transform("violations", lambda x: x["code"]), ",").alias("codes"), "rules_passed", six(F.col("rules_score")).alias("rules_score"))


def p07_facts(spark: SparkSession, sf: str) -> DataFrame:
    d = L.check_facts(table(spark, sf, "conversations").filter("role = 'assistant'"), FACTS)
    return d.select("conv_id", "turn", F.col("facts_checked").cast("long").alias("facts_checked"), F.array_join("mismatches", ",").alias("mismatches"))


def r01_authority(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", R.domain(u).alias("domain"), R.authority(u, PATTERNS).alias("tier"), R.freshness_days(u, PATTERNS).alias("days"), R.source_name(u, PATTERNS).alias("name"), R.allowed(u, BLOCKED).alias("allowed"), R.trusted(u, PATTERNS, BLOCKED).alias("trusted"))


def t25_page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted pages with the authority of their source."""
    p = C.page_score(table(spark, sf, "pages").select("page_id", "url", F.col("html").alias("text")))
    return p.filter("overall >= 0.6").select("page_id", R.authority(F.col("url"), PATTERNS).alias("authority_tier"), R.source_name(F.col("url"), PATTERNS).alias("source_name"))


def p09_irrelevant(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(V.irrelevant(F.col("text"), INTENT.irrelevant)).select("doc_id")


def p10_topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(V.matched_topics(F.col("text"), TOPICS), "|").alias("topics"))


def p07_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Assistants' turns against facts, then against all rules without metadata."""
    d = G.RuleSet(RULES, {f.key: f for f in FACTS}).responses(table(spark, sf, "conversations").filter("role = 'assistant'"))
    return d.select("conv_id", "turn", "response_passed", F.array_join(F.transform("violations", lambda x: x["code"]), ",").alias("codes"))


def p08_rules_from_yaml(spark: SparkSession, sf: str) -> DataFrame:
    """The rules by way of their YAML text and back."""
    d = G.RuleSet.from_dict(yaml_round(G.RuleSet(RULES, {f.key: f for f in FACTS}).to_dict())).chunks(_meta(spark, sf))
    return d.select(F.col("id").alias("doc_id"), F.array_join(F.transform("violations", lambda x: x["code"]), ",").alias("codes"), "rules_passed", six(F.col("rules_score")).alias("rules_score"))


def yaml_round(data: dict) -> dict:
    """Through YAML and back; where no YAML library is there, through JSON, which YAML includes."""
    try:
        import yaml
    except ImportError:
        return json.loads(json.dumps(data))
    return yaml.safe_load(G.write_yaml(data))


def r05_registry_from_yaml(spark: SparkSession, sf: str) -> DataFrame:
    """The registry by way of its YAML text and back, with a source and a blocked domain added by hand."""
    r = G.Registry.from_dict(yaml_round(G.Registry(PATTERNS[:-1], BLOCKED[:-1]).to_dict()))
    r.add_source(PATTERNS[-1].pattern, PATTERNS[-1].name, PATTERNS[-1].tier, PATTERNS[-1].days)
    r.block_domain(BLOCKED[-1])
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", R.domain(u).alias("domain"), r.authority(u).alias("tier"), r.freshness_days(u).alias("days"), r.source_name(u).alias("name"), r.allowed(u).alias("allowed"), r.trusted(u).alias("trusted"))


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, with the vector of the same number where there is one, judged against vector 0."""
    e = table(spark, sf, "embeddings")
    intent = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("intent")))  # one row
    rows = table(spark, sf, "documents").select("doc_id", "text").join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").crossJoin(intent)
    return V.decide(rows, INTENT, F.col("intent"))


def p11_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("doc_id", six(F.col("relevance")).alias("relevance"), "decision")


def p12_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted chunks with what was found among their metadata."""
    d = V.enriched(_decided(spark, sf).withColumn("metadata", F.create_map(F.lit("kept"), F.lit("yes"))), INTENT)
    return d.select("doc_id", *[F.col("metadata")[k].alias(k) for k in ("kept", "intent", "matched_topics")], six(F.col("metadata")["relevance_score"]).alias("relevance_score"))


def p14_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Documents embedded by a model of three numbers, loaded once a task and called with batches."""

    def load():
        return lambda texts: [[len(t), t.count("e"), t.count(" ")] for t in texts]

    d = V.embedded(table(spark, sf, "documents").select("doc_id", "text"), load)
    return d.select("doc_id", *[F.col("embedding")[i].alias(f"x{i}") for i in range(3)])


def a09_relevance_report(spark: SparkSession, sf: str) -> DataFrame:
    r = V.relevance_report(_decided(spark, sf))
    return r.select("total", "accepted", "reviewed", "rejected", "unscored", *[six(F.col(c)).alias(c) for c in ("avg_relevance", "acceptance_rate", "rejection_rate")])


def p15_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the next one."""
    e = table(spark, sf, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("q")), "vec_id").select("vec_id", six(V.cosine(F.col("embedding"), F.col("q"))).alias("similarity"))


def _top(spark: SparkSession, sf: str, k: int = 10, where=None) -> DataFrame:
    """Every row whose id is divisible by 20 asks all rows."""
    e = table(spark, sf, "embeddings")
    return V.top_k(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), k, where=where)


def k02_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select("query_id", "vec_id", "rank")


def k02_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, 5, F.col("label") == 3).select("query_id", "vec_id", "rank")


def _golden(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each asking vector wants those of its own label, but for itself."""
    e = table(spark, sf, "embeddings")
    found = _top(spark, sf).join(e.select("vec_id", F.concat(F.lit("s"), "label").alias("source")), "vec_id").filter("vec_id != query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", place), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.array(F.concat(F.lit("s"), "label")).alias("expected"))


def a10_golden(spark: SparkSession, sf: str) -> DataFrame:
    r = V.golden_eval(*_golden(spark, sf))
    return r.select("questions", *[six(F.col(c)).alias(c) for c in r.columns[1:]])


def k11_junit(spark: SparkSession, sf: str) -> DataFrame:
    """Questions as test cases: passed if one of the first three found is wanted."""
    found, golden = _golden(spark, sf)
    hit = golden.join(found.filter("rank <= 3"), "query_id", "left").groupBy("query_id").agg(F.coalesce(F.bool_or(F.array_contains("expected", F.col("source"))), F.lit(False)).alias("passed"))
    return E.junit_cases(hit.withColumn("reason", F.lit("no <expected> source")))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as chunks: a third has a date in its metadata."""
    e = table(spark, sf, "events")
    meta = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("published"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).otherwise(F.create_map(F.lit("published"), F.lit("unknown")))
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), meta.alias("metadata"), F.col("ts").alias("created_at"), "value")


def _stale(spark: SparkSession, sf: str) -> DataFrame:
    return H.staleness(_events(spark, sf), F.lit(AS_OF).cast("timestamp"), 30)


def p16_stale(spark: SparkSession, sf: str) -> DataFrame:
    return _stale(spark, sf).select("id", "known", "stale")


def a03_staleness_report(spark: SparkSession, sf: str) -> DataFrame:
    r = H.staleness_report(_stale(spark, sf))
    return r.withColumns({"oldest": F.date_format("oldest", "yyyy-MM-dd HH:mm:ss"), "staleness_ratio": six(F.col("staleness_ratio"))})


def a04_stale_sources(spark: SparkSession, sf: str) -> DataFrame:
    return H.stale_sources(_stale(spark, sf))


def a06_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return H.coverage(table(spark, sf, "documents"), TOPICS)


def a07_drift(spark: SparkSession, sf: str) -> DataFrame:
    r = H.drift(B.validated(spark, sf), 0.8)
    return r.select("baseline", "improved", *[six(F.col(c)).alias(c) for c in ("current", "change", "change_pct")])


def a08_health(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = cut(B.near(spark, sf))
    quality = C.report(B.validated(spark, sf, found)).select(F.col("avg_score").alias("avg_quality"))
    r = H.roll_up(H.staleness_report(_stale(spark, sf)), quality, D.group_report(docs, found), H.coverage(docs, TOPICS), V.golden_eval(*_golden(spark, sf)))
    return r.select(six(F.col("staleness_ratio")).alias("staleness_ratio"), six(F.col("avg_quality")).alias("avg_quality"), "duplicate_groups", F.array_join("missing_topics", "|").alias("missing_topics"), six(F.col("golden_pass_rate")).alias("golden_pass_rate"), F.array_join("recommendations", ",").alias("recommendations"))


def a11_intent_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Quality gate, then relevance: counts of each step."""
    good = B.validated(spark, sf).select(F.col("id").alias("doc_id"), "passed")
    d = good.join(_decided(spark, sf).select("doc_id", "decision"), "doc_id", "left")
    on = lambda c: F.count(F.when(c, 1))
    each = [on(F.col("passed") & (F.col("decision") == k)).alias(name) for k, name in (("accept", "accepted"), ("review", "reviewed"), ("reject", "rejected"), ("unscored", "unscored"))]
    return d.agg(F.count(F.lit(1)).alias("total"), on(F.col("passed")).alias("quality_passed"), *each)


def a12_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's texts into a new store in chunks of 300 characters: what was created, loaded and rejected, and what the store holds."""
    store = K.Store(spark, f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    docs = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("source"))
    r = cut(N.ingest_texts(docs, store, lambda d: S2.split_by_size(d, 300)))
    held = store.get_all()
    return r.select("documents", "bad_extraction", "created", "loaded", "rejected", six(F.col("avg_score")).alias("avg_score")).crossJoin(held.agg(F.count(F.lit(1)).alias("stored")) if held is not None else spark.range(1).select(F.lit(0).cast("long").alias("stored")))


def k01_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.col("c_acctbal").alias("quality_score"))
    new = c.filter("id % 7 = 0").withColumn("text", F.concat("text", F.lit(" (new)")))
    return K.upserted(c.filter("id % 14 != 0"), new)


def _customers(spark: SparkSession, sf: str) -> tuple[K.Store, DataFrame]:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("source"))
    return K.Store(spark, f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"), c


def k04_get_all(spark: SparkSession, sf: str) -> DataFrame:
    """What two additions to a store leave there."""
    store, c = _customers(spark, sf)
    store.add(c.filter("id % 3 != 0"))
    store.add(c.filter("id % 2 = 0").withColumn("text", F.lower("text")))
    return store.get_all()


def k06_update(spark: SparkSession, sf: str) -> DataFrame:
    store, c = _customers(spark, sf)
    store.add(c)
    store.update(c.filter("id % 10 = 0").withColumn("text", F.lit("new")))
    return store.get_all()


def k12_delete_source(spark: SparkSession, sf: str) -> DataFrame:
    store, c = _customers(spark, sf)
    store.add(c)
    store.delete_source("BUILDING")
    return store.get_all()


def s07_database_to_store(spark: SparkSession, sf: str) -> DataFrame:
    """Database rows as chunks of ten characters, loaded to a store."""
    store, _ = _customers(spark, sf)
    rows = S.rows_to_chunks(table(spark, sf, "part"), "p_name", ["p_partkey"], 10)
    store.add(rows.select(F.concat_ws("-", F.col("metadata")["p_partkey"], F.coalesce(F.col("metadata")["chunk_index"], F.lit("0"))).alias("id"), "text", "source", "metadata", "quality_score"))
    return store.get_all().select("id", "text", "source", "quality_score")


def s01_chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks written to JSON lines and read again from there."""
    path = f"{shared_folder(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    _meta(spark, sf).select(F.col("id").cast("string").alias("id"), "text", "source", "metadata").write.json(path)
    return S.load_chunks(spark, path, "jsonl").select("id", "text", "source", F.col("metadata")["lang"].alias("lang"))


def s14_paging(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as addresses, their lines as pages: read until one fails (returned) or is short (quantity)."""
    pages = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return S.pages_read(pages, "l_orderkey", "l_linenumber", F.col("l_returnflag") != "R", F.col("l_quantity"), 10, 5).select("l_orderkey", "l_linenumber")


def s20_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nodes and back; every second has its source as a file path."""
    n = K.nodes_shape(_meta(spark, sf).withColumn("quality_score", F.lit(0.5)))
    path = F.col("node_id") % 2 == 0
    moved = n.withColumn("metadata", F.when(path, F.map_concat(F.map_filter("metadata", lambda k, v: k != "source"), F.create_map(F.lit("file_path"), F.col("metadata")["source"]))).otherwise(F.col("metadata")))
    return K.from_nodes(moved).select("id", "text", "source", F.col("metadata")["lang"].alias("lang"), F.size("metadata").alias("n"))


def s20_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of the documents' texts as spans with their places."""
    w = S2.split_by_size(table(spark, sf, "documents").select("doc_id", "text"), 400)
    spans = w.select("doc_id", F.col("chunk").alias("text"), (F.col("chunk_index") * 400).alias("start_index"), (F.col("chunk_index") * 400 + F.length("chunk")).alias("end_index"))
    c = K.from_spans(spans, "documents")
    return c.select("doc_id", "text", "source", *[F.col("metadata")[k].cast("int").alias(k) for k in ("start_index", "end_index")])


def k03_delete(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return K.without(c, c.filter("o_orderstatus = 'F'"))


def k05_stats(spark: SparkSession, sf: str) -> DataFrame:
    return K.stats(table(spark, sf, "embeddings"))


def k07_search(spark: SparkSession, sf: str) -> DataFrame:
    return K.search_metadata(_meta(spark, sf), {"lang": "de"}).select("id", "source")


def k08_narrowed(spark: SparkSession, sf: str) -> DataFrame:
    return K.narrowed(_meta(spark, sf), "short").select("id", "text")


def k09_placeholder_embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = K.placeholder_embedding(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.size(e).cast("long").alias("n"), six(F.aggregate(e, F.lit(0.0), lambda a, b: a + b)).alias("total"))


def k10_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = K.documents_shape(_meta(spark, sf).withColumn("quality_score", F.lit(0.5)))
    back = K.from_documents(d)
    return back.select("id", "text", "source", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["quality_score"].alias("quality_score"))


def k11_export(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.to_json(F.struct("doc_id", "quality", "toxic")).alias("json"))


def k12_categories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source", "lang").distinct()


def k12_pseudo_score(spark: SparkSession, sf: str) -> DataFrame:
    return k02_top_k(spark, sf).select("query_id", "vec_id", six(F.greatest(F.lit(0.0), 1 - (F.col("rank") - 1) * 0.1)).alias("pseudo"))


def s01_chunk_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    j = _meta(spark, sf).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "text", "source", "metadata")).alias("j"))
    return j.select(F.from_json("j", S.CHUNK).alias("c")).select("c.id", "c.text", "c.source", F.col("c.metadata")["lang"].alias("lang"))


def s02_sql(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("siftwell_orders")
    return S.run_sql(spark, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM siftwell_orders WHERE o_totalprice > :least GROUP BY o_orderstatus", {"least": 1000})


def s04_guard(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    verbs = ["SELECT", "select a.", "INSERT INTO", "WITH x AS (SELECT", "delete from", "SELECT 'drop' FROM", "SELECT updated FROM", "EXEC"]
    sql = F.concat(F.element_at(F.array(*map(F.lit, verbs)), (n % len(verbs) + 1).cast("int")), F.lit(" "), F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", S.writes(sql).alias("writes"), S.read_only(sql).alias("read_only"))


def s06_rows_to_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = S.rows_to_chunks(table(spark, sf, "documents"), "text", ["doc_id", "lang"], 500)
    return c.select(F.col("metadata")["doc_id"].cast("long").alias("doc_id"), F.col("metadata")["chunk_index"].cast("int").alias("chunk_index"), "text")


def s09_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return S.pages_text(table(spark, sf, "pages"))


def s10_sitemap(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' URLs by way of sitemaps of a thousand ids each, so that their size doesn't follow the table's; every entry is read, however often an id repeats."""
    esc = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<url><loc>"), esc, F.lit("</loc><lastmod>2024-01-05</lastmod><priority>0.5</priority></url>"))
    maps = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 1000).alias("g")).agg(F.array_join(F.collect_list(entry), "").alias("u")).select(F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), "u", F.lit("</urlset>")).alias("xml"))
    return S.read_sitemaps(maps, max_urls=None).select("loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"), "priority")


def s11_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's items by way of one RSS feed, as chunks."""
    esc = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>t"), F.col("item_id"), F.lit("</title><link>http://f/"), F.col("item_id"), F.lit("</link><pubDate>Fri, 05 Jan 2024 10:00:00 +0000</pubDate><description>"), esc, F.lit("</description></item>"))
    feed = table(spark, sf, "benchmark").groupBy(F.floor(F.col("item_id") / 50).alias("g")).agg(F.array_join(F.collect_list(item), "").alias("u")).select(F.concat(F.lit("<rss><channel>"), "u", F.lit("</channel></rss>")).alias("xml"))
    c = S.feed_chunks(S.read_feeds(feed))
    return c.select("source", F.col("metadata")["title"].alias("title"), F.col("metadata")["published"].alias("published"), F.length("text").alias("n"))


def s15_responses(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    body = F.when(F.col("event_id") % 5 == 0, F.lit("{}")).when(F.col("event_id") % 7 == 0, F.lit('{"error": 1}')).otherwise(F.col("props"))
    score, code = S.response_score(status, body)
    return table(spark, sf, "events").select("event_id", score.alias("score"), code.alias("code"))


def s17_pdf_pages(spark: SparkSession, sf: str) -> DataFrame:
    scanned = F.length("text") < 50
    return table(spark, sf, "documents").select("doc_id", six(C.pdf_page_score(F.col("text"), scanned)).alias("score"))


def s19_pdf_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as files, their documents as pages."""
    p = C.pdf_issues(table(spark, sf, "documents"), "source", F.col("text"), F.length("text") < 50)
    return p.select("source", "scanned_pages", "low_pages", six(F.col("avg_score")).alias("avg_score"), C.codes().alias("codes"))


def s18_table_score(spark: SparkSession, sf: str) -> DataFrame:
    row = F.array("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.lit("x")), F.col("n_regionkey").cast("string"))
    t = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(row).alias("cells"))
    return t.select("n_regionkey", six(S.table_score(F.col("cells"))).alias("score"))


def s21_first_urls(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("link"), "page_id")
    return S.keep_first(u, "link", "page_id")


def s22_fenced_json(spark: SparkSession, sf: str) -> DataFrame:
    """Events' properties as a model's fenced answers, every fifth broken."""
    answer = F.when(F.col("event_id") % 5 == 0, F.lit("Sorry, no JSON {")).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    found = S.json_or_error(answer)
    return table(spark, sf, "events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"), F.get_json_object(found, "$.error").alias("error"))


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "prtaks" and k[1:3].isdigit()}

_DOM = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_FIRST = f"CASE WHEN regexp_full_match({_DOM}, '.*\\.example\\.org') THEN {{0}} WHEN regexp_full_match({_DOM}, 'www\\..*') THEN {{1}} WHEN regexp_matches(url, '^https?://m\\.') THEN {{2}} WHEN regexp_full_match({_DOM}, 'blog\\..*\\.example\\.net') THEN {{3}} ELSE {{4}} END"
_OK = f"(NOT contains({_DOM}, 'adult') AND NOT starts_with({_DOM}, 'spam.'))"
_NUM = "TRY_CAST(replace(replace(nullif(regexp_extract(text, '\\$?[0-9,]+(?:\\.[0-9]+)?'), ''), '$', ''), ',', '') AS DOUBLE)"
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_DEC = f"""dec AS (SELECT d.doc_id, d.text, CASE WHEN contains(lower(d.text), 'password') OR contains(lower(d.text), 'trash') THEN 0 ELSE ({_COS} + 1) / 2 END AS relevance FROM documents d LEFT JOIN embeddings e ON vec_id = doc_id, (SELECT * FROM embeddings WHERE vec_id = 0) q),
deci AS (SELECT *, CASE WHEN relevance IS NULL THEN 'unscored' WHEN relevance >= 0.6 THEN 'accept' WHEN relevance >= 0.4 THEN 'review' ELSE 'reject' END AS decision FROM dec)"""


def _topics(joint: str) -> str:
    each = ", ".join("CASE WHEN " + " AND ".join(f"contains(lower(text), '{w}')" for w in t.split()) + f" THEN '{t}' END" for t in TOPICS)
    return f"coalesce(array_to_string(list_filter([{each}], lambda x: x IS NOT NULL)[:5], '{joint}'), '')"


_RANK = f"row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 12) DESC, e.vec_id)"
_TOPK = f"topk AS (SELECT q.vec_id AS query_id, e.vec_id, {_RANK} AS rank, e.label, q.label AS want FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10)"
_GOLD = "f AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, label = want AS hit, label FROM topk WHERE vec_id <> query_id)"
_STALE = f"st AS (SELECT event_id AS id, event_type AS source, event_id % 3 = 0 AS known, ts, TIMESTAMP '{AS_OF}' - ts > INTERVAL 30 DAY AS stale FROM events)"


def _oracles(sig: str, scores: str, extraction: str, pages_sig: str) -> dict[str, str]:
    special = "length(regexp_replace(text, '[\\p{L}\\p{N}\\s]+', '', 'g')) / length(text)"
    pdf = f"((CASE WHEN length(text) < 50 THEN 0.3 ELSE 1 END) * (CASE WHEN length(trim(text)) < 50 THEN 0.5 ELSE 1 END) * (CASE WHEN {special} > 0.3 THEN 1 - {special} ELSE 1 END))"
    fact = lambda k: f"coalesce(nullif(regexp_extract(text, '(?i){k}\\s*[:=]\\s*\\$?([0-9,]+(?:\\.[0-9]+)?)', 1), ''), nullif(regexp_extract(text, '(?i){k}\\s+(?:is|costs?|=)\\s+\\$?([0-9,]+(?:\\.[0-9]+)?)', 1), ''))"
    value = lambda k: f"TRY_CAST(replace({fact(k)}, ',', '') AS DOUBLE)"
    verbs = "['SELECT', 'select a.', 'INSERT INTO', 'WITH x AS (SELECT', 'delete from', 'SELECT ''drop'' FROM', 'SELECT updated FROM', 'EXEC']"
    word = "'\\b(ALTER|CREATE|DELETE|DROP|EXEC|EXECUTE|GRANT|INSERT|REVOKE|TRUNCATE|UPDATE)\\b'"
    p06 = f"""SELECT doc_id, coalesce(array_to_string([CASE WHEN a THEN 'RULE_HAS_NUMBER' END, CASE WHEN b THEN 'RULE_MENTIONS_THE' END, CASE WHEN c THEN 'RULE_NUMBER_RANGE' END, CASE WHEN e THEN 'RULE_CHARS_RANGE' END, 'RULE_HAS_TITLE'], ','), '') AS codes,
  NOT (b OR e) AS rules_passed, round(greatest(0, 1 - 0.1 * (a::INT + b::INT + c::INT + e::INT + 1)), 6)::DOUBLE AS rules_score
FROM (SELECT doc_id, NOT regexp_matches(text, '[0-9]') AS a, NOT regexp_matches(text, '(?i)(^|[^a-z])the([^a-z]|$)') AS b, coalesce({_NUM} < 10 OR {_NUM} > 1000, false) AS c, n_chars < 100 OR n_chars > 20000 AS e FROM documents)"""
    r01 = f"SELECT page_id, {_DOM} AS domain, {_FIRST.format(1, 2, 4, 5, 3)} AS tier, {_FIRST.format(30, 60, 10, 7, 90)} AS days, {_FIRST.format(*(chr(39) + x + chr(39) for x in ('org', 'web', 'mobile', 'blog', '')))} AS name, {_OK} AS allowed, {_OK} AND {_FIRST.format('true', 'true', 'true', 'true', 'false')} AS trusted FROM pages"
    return {
        "p06_rules": p06,
        "p07_facts": f"""SELECT conv_id, turn, CAST(({fact('the')} IS NOT NULL) AS BIGINT) + CAST(({fact('total')} IS NOT NULL) AS BIGINT) AS facts_checked,
  coalesce(array_to_string([CASE WHEN {fact('the')} IS NOT NULL AND coalesce(abs({value('the')} - 20) > 5, true) THEN 'the' END, CASE WHEN {fact('total')} IS NOT NULL AND coalesce(abs({value('total')} - 7) > 0, true) THEN 'total' END], ','), '') AS mismatches FROM conversations WHERE role = 'assistant'""",
        "r01_authority": r01,
        "t25_page_chunks": f"WITH sig AS ({pages_sig}), x AS (SELECT page_id, 0.4 * extraction_score + 0.3 * CASE WHEN length(s) < 50 THEN 0.3 ELSE 1 END + 0.3 * (1 - short_lines) AS overall FROM ({extraction})) SELECT page_id, {_FIRST.format(1, 2, 4, 5, 3)} AS authority_tier, {_FIRST.format(*(chr(39) + x + chr(39) for x in ('org', 'web', 'mobile', 'blog', '')))} AS source_name FROM x JOIN pages USING (page_id) WHERE overall >= 0.6",
        "p09_irrelevant": "SELECT doc_id FROM documents WHERE contains(lower(text), 'password') OR contains(lower(text), 'trash')",
        "p10_topics": f"SELECT doc_id, {_topics('|')} AS topics FROM documents",
        "p11_relevance": f"WITH {_DEC} SELECT doc_id, round(relevance, 6) AS relevance, decision FROM deci",
        "p12_enriched": f"WITH {_DEC} SELECT doc_id, 'yes' AS kept, 'demo' AS intent, {_topics(',')} AS matched_topics, round(relevance, 6) AS relevance_score FROM deci WHERE decision = 'accept'",
        "a09_relevance_report": f"WITH {_DEC} SELECT count(*) AS total, count(*) FILTER (decision = 'accept') AS accepted, count(*) FILTER (decision = 'review') AS reviewed, count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision = 'unscored') AS unscored, round(avg(relevance), 6) AS avg_relevance, round(avg((decision = 'accept')::INT), 6) AS acceptance_rate, round(avg((decision = 'reject')::INT), 6) AS rejection_rate FROM deci",
        "p15_cosine": f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e JOIN embeddings q ON q.vec_id = e.vec_id + 1",
        "k02_filtered": f"SELECT q.vec_id AS query_id, e.vec_id, CAST({_RANK} AS INT) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.label = 3 QUALIFY rank <= 5",
        "k11_junit": f"""WITH {_TOPK}, {_GOLD}, h AS (SELECT query_id, coalesce(bool_or(hit) FILTER (rank <= 3), false) AS ok FROM f GROUP BY query_id)
SELECT query_id, '  <testcase name="' || query_id || '" classname="golden"' || CASE WHEN ok THEN '/>' ELSE '>' || chr(10) || '    <failure message="no &lt;expected&gt; source"/>' || chr(10) || '  </testcase>' END AS xml FROM h""",
        "p14_embedded": "SELECT doc_id, length(text)::DOUBLE AS x0, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS x1, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS x2 FROM documents",
        "k04_get_all": "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS text, c_mktsegment AS source FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
        "k06_update": "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS text, c_mktsegment AS source FROM customer",
        "k12_delete_source": "SELECT c_custkey AS id, c_name AS text, c_mktsegment AS source FROM customer WHERE c_mktsegment <> 'BUILDING'",
        "s07_database_to_store": "SELECT p_partkey || '-' || i AS id, substr(p_name, CAST(i * 10 + 1 AS BIGINT), 10) AS text, 'database' AS source, 1.0::DOUBLE AS quality_score FROM (SELECT *, unnest(range(0, (length(p_name) - 1) // 10 + 1)) AS i FROM part) WHERE regexp_matches(substr(p_name, CAST(i * 10 + 1 AS BIGINT), 10), '\\S')",
        "s01_chunk_files": "SELECT CAST(doc_id AS VARCHAR) AS id, text, source, lang FROM documents",
        "s14_paging": "SELECT l_orderkey, l_linenumber FROM (SELECT *, min(l_linenumber) FILTER (l_linenumber <= 5 AND (l_returnflag = 'R' OR l_quantity < 10)) OVER (PARTITION BY l_orderkey) AS stop FROM lineitem) WHERE l_linenumber <= 5 AND l_linenumber <= coalesce(stop, 5)",
        "s20_nodes": "SELECT doc_id AS id, text, source, lang, 3 AS n FROM documents",
        "s20_spans": "SELECT doc_id, substr(text, CAST(i * 400 + 1 AS BIGINT), 400) AS text, 'documents' AS source, CAST(i * 400 AS INT) AS start_index, CAST(least(i * 400 + 400, length(text)) AS INT) AS end_index FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 1, 0)) // 400 + 1)) AS i FROM documents) WHERE regexp_matches(substr(text, CAST(i * 400 + 1 AS BIGINT), 400), '\\S')",
        "k02_top_k": f"WITH {_TOPK} SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM topk",
        "k12_pseudo_score": f"WITH {_TOPK} SELECT query_id, vec_id, round(greatest(0, 1 - 0.1 * (rank - 1)), 6)::DOUBLE AS pseudo FROM topk",
        "a10_golden": f"""WITH {_TOPK}, {_GOLD},
per AS (SELECT query_id, min(rank) FILTER (hit) AS first, {', '.join(f'count(DISTINCT CASE WHEN hit AND rank <= {k} THEN label END) / greatest(count(*) FILTER (rank <= {k}), 1) AS p{k}' for k in (1, 3, 5, 10))} FROM f GROUP BY query_id)
SELECT count(*) AS questions, round(avg((first IS NOT NULL)::INT), 6) AS pass_rate, round(avg(coalesce(1.0 / first, 0)), 6)::DOUBLE AS mrr, {', '.join(f'round(avg(p{k}), 6) AS precision_at_{k}' for k in (1, 3, 5, 10))} FROM per""",
        "p16_stale": f"WITH {_STALE} SELECT id, known, stale FROM st",
        "a03_staleness_report": f"WITH {_STALE} SELECT count(*) AS total, count(*) FILTER (known AND stale) AS stale, count(*) FILTER (known AND NOT stale) AS fresh, count(*) FILTER (NOT known) AS unknown, count(DISTINCT source) FILTER (known AND stale) AS stale_sources, strftime(min(ts) FILTER (known), '%Y-%m-%d %H:%M:%S') AS oldest, round(avg((known AND stale)::INT), 6) AS staleness_ratio FROM st",
        "a04_stale_sources": f"WITH {_STALE} SELECT DISTINCT source FROM st WHERE known AND stale",
        "a06_coverage": " UNION ALL ".join(f"SELECT '{t}' AS topic, bool_or(contains(lower(text), '{t}')) AS covered FROM documents" for t in TOPICS),
        "a07_drift": f"{B.BATCH} SELECT 0.8::DOUBLE AS baseline, avg(score) >= 0.8 AS improved, round(avg(score), 6) AS current, round(avg(score) - 0.8, 6) AS change, round((avg(score) - 0.8) / 0.8 * 100, 6) AS change_pct FROM batch",
        "a08_health": f"""{B.BATCH}, {_STALE}, c AS ({' UNION ALL '.join(f"SELECT '{t}' AS topic, bool_or(contains(lower(text), '{t}')) AS covered FROM documents" for t in TOPICS)}), {_TOPK}, {_GOLD},
x AS (SELECT (SELECT avg((known AND stale)::INT) FROM st) AS r, (SELECT avg(score) FROM batch) AS q, (SELECT count(*) FROM c WHERE NOT covered) AS m, (SELECT count(DISTINCT r) FROM (SELECT min(a) AS r FROM pairs GROUP BY b)) AS d,
  (SELECT coalesce(string_agg(topic, '|' ORDER BY topic), '') FROM c WHERE NOT covered) AS names, (SELECT avg(ok::INT) FROM (SELECT bool_or(hit) AS ok FROM f GROUP BY query_id)) AS g)
SELECT round(r, 6) AS staleness_ratio, round(q, 6) AS avg_quality, d AS duplicate_groups, names AS missing_topics, round(g, 6) AS golden_pass_rate, coalesce(array_to_string(list_filter([CASE WHEN r > 0.3 THEN 'RECRAWL_STALE' END, CASE WHEN d > 0 THEN 'REMOVE_DUPLICATES' END, CASE WHEN m > 0 THEN 'ADD_MISSING_TOPICS' END, CASE WHEN q < 0.6 THEN 'REVIEW_QUALITY' END], lambda v: v IS NOT NULL), ','), '') AS recommendations FROM x""",
        "a11_intent_pipeline": f"{B.BATCH}, {_DEC} SELECT count(*) AS total, count(*) FILTER (passed) AS quality_passed, {', '.join(f"count(*) FILTER (passed AND decision = '{k}') AS {n}" for k, n in (('accept', 'accepted'), ('review', 'reviewed'), ('reject', 'rejected'), ('unscored', 'unscored')))} FROM batch LEFT JOIN deci USING (doc_id)",
        "a12_ingest": f"""WITH documents AS (SELECT item_id * 100000 + i AS doc_id, substr(text, CAST(i * 300 + 1 AS BIGINT), 300) AS text FROM (SELECT *, unnest(range(0, (greatest(length(text) - 1, 0)) // 300 + 1)) AS i FROM benchmark) WHERE regexp_matches(substr(text, CAST(i * 300 + 1 AS BIGINT), 300), '\\S')),
raw AS (SELECT count(*) AS documents, count(*) FILTER (NOT acceptable) AS bad_extraction FROM (WITH sig AS ({signals_sql.signals('benchmark', 'text', 'item_id')}) {signals_sql.extraction_scores()})),
{B.BATCH[5:]} SELECT any_value(documents) AS documents, any_value(bad_extraction) AS bad_extraction, count(*) AS created, count(*) FILTER (passed) AS loaded, count(*) FILTER (NOT passed) AS rejected, round(avg(score), 6) AS avg_score, count(*) FILTER (passed) AS stored FROM batch, raw""",
        "p08_rules_from_yaml": p06,
        "r05_registry_from_yaml": r01,
        "p07_responses": f"""SELECT conv_id, turn, NOT (bad OR b OR e) AS response_passed, array_to_string(list_filter([CASE WHEN a THEN 'RULE_HAS_NUMBER' END, CASE WHEN b THEN 'RULE_MENTIONS_THE' END, CASE WHEN c THEN 'RULE_NUMBER_RANGE' END, CASE WHEN e THEN 'RULE_CHARS_RANGE' END, 'RULE_HAS_TITLE'], lambda v: v IS NOT NULL), ',') AS codes
FROM (SELECT conv_id, turn, NOT regexp_matches(text, '[0-9]') AS a, NOT regexp_matches(text, '(?i)(^|[^a-z])the([^a-z]|$)') AS b, coalesce({_NUM} < 10 OR {_NUM} > 1000, false) AS c, coalesce({_NUM} < 100 OR {_NUM} > 20000, false) AS e,
  {fact('the')} IS NOT NULL AND coalesce(abs({value('the')} - 20) > 5, true) OR {fact('total')} IS NOT NULL AND coalesce(abs({value('total')} - 7) > 0, true) AS bad FROM conversations WHERE role = 'assistant')""",
        "k01_upsert": "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_name || ' (new)' ELSE c_name END AS text, c_acctbal AS quality_score FROM customer",
        "k03_delete": "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
        "k05_stats": "SELECT count(*) AS count, max(len(embedding))::INT AS dimension FROM embeddings",
        "k07_search": "SELECT doc_id AS id, source FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 100",
        "k08_narrowed": "SELECT doc_id AS id, substr(text, 1, 1000) AS text FROM documents",
        "k10_documents": "SELECT doc_id AS id, text, source, lang, '0.5' AS quality_score FROM documents",
        "k11_export": """SELECT '{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}' AS json FROM labels""",
        "k12_categories": "SELECT DISTINCT source, lang FROM documents",
        "s01_chunk_round_trip": "SELECT CAST(doc_id AS VARCHAR) AS id, text, source, lang FROM documents",
        "s02_sql": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus",
        "s04_guard": f"SELECT n_nationkey, regexp_matches(upper(q), {word}) AS writes, starts_with(upper(q), 'SELECT') AND NOT regexp_matches(upper(q), {word}) AS read_only FROM (SELECT n_nationkey, {verbs}[n_nationkey % 8 + 1] || ' ' || n_name AS q FROM nation)",
        "s06_rows_to_chunks": "SELECT doc_id, CASE WHEN length(text) > 500 THEN CAST(i AS INT) END AS chunk_index, substr(text, CAST(i * 500 + 1 AS BIGINT), 500) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 500 + 1)) AS i FROM documents WHERE regexp_matches(text, '\\S'))",
        "s10_sitemap": "SELECT url AS loc, '2024-01-05' AS lastmod, 0.5::DOUBLE AS priority FROM pages",
        "s11_feed": "SELECT 'http://f/' || item_id AS source, 't' || item_id AS title, '2024-01-05T10:00:00' AS published, CAST(length(trim(text)) AS INT) AS n FROM benchmark",
        "s15_responses": "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 WHEN event_id % 5 = 0 THEN 0.5 WHEN event_id % 7 = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS score, CASE WHEN event_type = 'error' THEN 'HTTP_ERROR' WHEN event_id % 5 = 0 THEN 'EMPTY_RESPONSE' WHEN event_id % 7 = 0 THEN 'API_ERROR' END AS code FROM events",
        "s17_pdf_pages": f"SELECT doc_id, round({pdf}, 6)::DOUBLE AS score FROM documents",
        "s19_pdf_issues": f"SELECT source, scanned_pages, low_pages, avg_score, array_to_string(list_filter([CASE WHEN scanned_pages > 0 THEN 'SCANNED_PAGES' END, CASE WHEN low_pages > 0 THEN 'LOW_QUALITY_PAGES' END, CASE WHEN n < 50 THEN 'INSUFFICIENT_CONTENT' END], lambda v: v IS NOT NULL), ',') AS codes FROM (SELECT source, count(*) FILTER (length(text) < 50) AS scanned_pages, count(*) FILTER ({pdf} < 0.5) AS low_pages, sum(length(text)) AS n, round(avg({pdf}), 6) AS avg_score FROM documents GROUP BY source)",
        "s18_table_score": "SELECT n_regionkey, round(1 - count(*) FILTER (n_nationkey % 2 = 0) / (3 * count(*)), 6) AS score FROM nation GROUP BY n_regionkey",
        "s21_first_urls": "SELECT regexp_replace(url, '[?#].*$', '') AS link, min(page_id) AS page_id FROM pages GROUP BY 1",
        "s22_fenced_json": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 5 = 0 THEN 'invalid JSON' END AS error FROM events",
    }
