from __future__ import annotations

import json
import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell import cli, cluster
from siftwell.functions import text as T
from siftwell.operators import chunk_score as C
from siftwell.operators import chunkers as S
from siftwell.operators import config as G2
from siftwell.operators import duplicates as D
from siftwell.operators import export as E
from siftwell.operators import health as H
from siftwell.operators import ingest as I
from siftwell.operators import registry as R
from siftwell.operators import relevance as V
from siftwell.operators import rules as L
from siftwell.operators import store as K
from siftwell.plans import knowledge_queries as Q
from siftwell.plans import quality_queries as B
from siftwell.sources import readers as G

CHUNK = "id long, text string, source string, metadata map<string,string>"


def chunk(spark, *texts, meta=None):
    return spark.createDataFrame([(i, t, "s", meta or {}) for i, t in enumerate(texts)], CHUNK)


def codes(spark, *texts):
    return [r.c.split(",") if r.c else [] for r in C.validate(chunk(spark, *texts)).orderBy("id").select(C.codes().alias("c")).collect()]


def test_chunk_codes(spark):
    found = codes(spark, "", "   ", None, "Too short", "x" * 20_000 + ".")
    assert all("EMPTY_CONTENT" in f for f in found[:3])
    assert "CONTENT_TOO_SHORT" in found[3] and "CONTENT_TOO_LONG" in found[4]


def test_scalars(spark):
    rows = spark.createDataFrame([(0, "the " * 7), (1, "aAb b"), (2, ""), (3, "short"), (4, "It works. Well")], "id long, text string")
    c = F.col("text")
    got = {r.id: r for r in rows.select("id", T.density(c).alias("d"), T.entropy(c).alias("e"), T.gibberish(c).alias("g"), T.sentence_count(c).alias("s"), T.coherence(c).alias("k")).collect()}
    assert got[0].d == pytest.approx(0.3857, abs=1e-4)
    n = Counter("aab b")
    assert got[1].e == pytest.approx(-sum(v / 5 * math.log2(v / 5) for v in n.values()))
    assert got[2].d == got[2].e == got[2].k == 0 and got[3].g == 0
    assert got[4].s == 2 and got[4].k == pytest.approx(0.9 * 0.85 * 0.7)


def test_report_of_nothing(spark):
    assert C.report(C.validate(chunk(spark, "x").limit(0))).first().asDict() == {"total": 0, "passed": 0, "failed": 0, "warnings": 0, "avg_score": 0.0}


def test_recursive_pieces():
    text = "One two three. Four five.\n\nSix " + "y" * 40 + " seven"
    for size in (5, 10, 25, 100):
        parts = S.recursive_pieces(text, size)
        assert all(len(p) <= size for p in parts)
        assert "".join("".join(parts).split()).replace(".", "") == "".join(text.split()).replace(".", "")
    assert S.recursive_pieces("", 5) == [] and S.recursive_pieces("abc", 5) == ["abc"]


def test_chunkers(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, None), (3, " ")], "doc_id long, text string")
    got = [(r.doc_id, r.chunk_index, r.chunk) for r in S.split_by_size(df, 4, 1).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (1, 3, "j")]
    s = spark.createDataFrame([(1, "Aa. Bb! Cc? Dd")], "doc_id long, text string")
    assert [r.chunk for r in S.sentence_chunks(s, 8).orderBy("chunk_index").collect()] == ["Aa. Bb!", "Cc? Dd"]
    p = spark.createDataFrame([(1, "aaa\n\nbbb\n\ncccccc")], "doc_id long, text string")
    assert [r.chunk for r in S.paragraph_chunks(p, 8).orderBy("chunk_index").collect()] == ["aaa\n\nbbb", "cccccc"]
    assert [r.chunk for r in S.recursive_chunks(df, 4).orderBy("chunk_index").collect()] == ["abcd", "efgh", "ij"]
    with pytest.raises(ValueError):
        S.windows(F.col("text"), 5, 5)
    with pytest.raises(ValueError):
        S.chunker("none")


def test_near_pairs_brute(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "a b c d e f g x", "q r s", "q r s", "", None, "p q", "a b c d e f g h i"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in enumerate(texts) if (w := (t or "").split())}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and len(x & y) / len(x | y) >= 0.6}
    found = {r.id: r for r in D.near(D.item_sets(df, D.shingles(F.col("text"))), 0.6).collect()}
    assert set(found) == {i for p in want for i in p}
    for i, r in found.items():
        mine = {(b if a == i else a): j for (a, b), j in want.items() if i in (a, b)}
        before = {k: j for k, j in mine.items() if k < i}
        assert r.links == len({frozenset(sets[k]) for k, j in mine.items() if j < 1}) and r.copies == sum(j == 1 for j in mine.values())
        assert r.class_id == min([i, *(k for k, j in mine.items() if j == 1)]) and r.best == pytest.approx(max(mine.values()))
        assert r.representative == min(before, default=None) and r.duplicate == (pytest.approx(1 - max(before.values())) if before else None)


def test_duplicate_index(spark, tmp_path):
    index = D.Index(K.Store(spark, f"file://{tmp_path}/index"), 0.6)
    one = spark.createDataFrame([(1, "a b c d e f"), (2, "q r s t u")], "id long, text string")
    assert index.find(one).count() == 0
    index.add(one)
    new = spark.createDataFrame([(3, "a b c d e f g"), (4, "x y z"), (2, "q r s t u")], "id long, text string")
    assert [(r.id, r.representative) for r in index.find(new).collect()] == [(3, 1)]
    index.clear()
    assert index.find(new).count() == 0


def test_rules_and_facts(spark):
    def run(rule, text, meta=None):
        return L.apply_rules(chunk(spark, text, meta=meta), [rule]).first()

    assert [v.code for v in run(L.Rule("phone", pattern="[0-9]{3}", field="required", severity="error"), "none").violations] == ["RULE_PHONE"]
    assert not run(L.Rule("phone", pattern="[0-9]{3}", field="required", severity="error"), "none").rules_passed
    assert run(L.Rule("pii", pattern="x"), "x").violations == [] and run(L.Rule("pii", pattern="x", forbid=True), "x").violations
    assert run(L.Rule("price", kind="numerical", low=100), "Price is $50").violations
    assert run(L.Rule("q", kind="numerical", high=100, field="quantity"), "7", {"quantity": "150"}).violations
    assert not run(L.Rule("q", kind="numerical", high=100, field="quantity"), "7", {"quantity": "many"}).violations
    two = L.apply_rules(chunk(spark, "t"), [L.Rule("a", kind="required", field="a"), L.Rule("b", kind="required", field="b")]).first()
    assert two.rules_score == pytest.approx(0.8)
    f = L.check_facts(chunk(spark, "fee is 20", "fee: 103", "no"), [L.Fact("fee", 15.0), L.Fact("fee", 100.0, 5.0)]).orderBy("id").collect()
    assert [r.mismatches for r in f] == [["fee"], [], []] and [r.facts_checked for r in f] == [1, 1, 0]
    assert L.Rule.of({"name": "n", "type": "numeric", "condition": {"min": 1}}).low == 1


def test_registry(spark):
    u = spark.createDataFrame([("https://x.gov.zw/a",), ("https://gov.zw.fake.com/",), ("https://example.com/",), ("https://a.example.com",), ("example.com",), (None,)], "url string")
    pats = [R.Pattern("*.gov.zw", "gov", 1, 10), R.Pattern("*.example.com", "ex", 2)]
    assert [r[0] for r in u.select(R.authority(F.col("url"), pats)).collect()] == [1, 3, 3, 2, 3, 3]
    assert [r[0] for r in u.limit(2).select(R.trusted(F.col("url"), pats, ["*.gov.zw"])).collect()] == [False, False]
    with pytest.raises(ValueError):
        R.Pattern("x", tier=6)


def test_relevance_and_golden(spark):
    i = V.Intent("i", topics=["red fox", "cow"], irrelevant=["spam"])
    df = spark.createDataFrame([(1, "the red fox", [0.6, 0.8]), (2, "spam", [1.0, 0.0]), (3, "x", [-0.5, math.sqrt(0.75)]), (4, "y", [0.0, 0.0])], "id long, text string, embedding array<double>")
    got = {r.id: r for r in V.decide(df, i, F.array(F.lit(1.0), F.lit(0.0))).collect()}
    assert got[1].relevance == pytest.approx(0.8) and got[1].decision == "accept" and got[1].topics == ["red fox"]
    assert got[2].relevance == 0 and got[3].decision == "reject" and got[4].relevance == 0.5
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3)], "query_id long, source string, rank int")
    g = spark.createDataFrame([(1, ["b"])], "query_id long, expected array<string>")
    e = V.golden_eval(r, g).first()
    assert e.mrr == 0.5 and e.precision_at_3 == pytest.approx(1 / 3) and e.pass_rate == 1
    assert V.golden_eval(r.limit(0), spark.createDataFrame([(1, [])], "query_id long, expected array<string>")).first().pass_rate == 1
    assert "Relevant topics: red fox, cow" in i.text()


def test_staleness(spark):
    df = spark.createDataFrame([({"crawled_at": "bad", "date": "2024-01-01T00:00:00Z"}, "a"), ({}, "b")], "metadata map<string,string>, source string").withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))
    r = H.staleness(df, F.lit("2024-06-01").cast("timestamp")).orderBy("source").collect()
    assert [x.known for x in r] == [True, False] and all(x.stale for x in r)
    rep = H.staleness_report(H.staleness(df, F.lit("2024-06-01").cast("timestamp"))).first()
    assert (rep.stale, rep.unknown, rep.staleness_ratio) == (1, 1, 0.5)


def test_store(spark, tmp_path):
    s = K.Store(spark, f"file://{tmp_path}/s")
    assert s.get_all() is None
    s.add(chunk(spark, "a", "b"))
    s.add(chunk(spark, "A"))
    assert sorted(r.text for r in s.get_all().collect()) == ["A", "b"]
    assert s.delete(spark.createDataFrame([(1,), (9,)], "id long")) == 1
    assert [r.text for r in s.get_all().collect()] == ["A"]
    import hashlib

    e = chunk(spark, "hello").select(K.placeholder_embedding(F.col("text"))).first()[0]
    assert e == pytest.approx([b / 255 for b in hashlib.sha384(b"hello").digest()])


def test_sources(spark):
    assert G.html_text("<title>T</title><nav>x</nav><p>a <b>b</b></p><script>1</script>") == ("T", "T\na\nb")
    assert G.html_text(None) == ("", "") and G.html_text("plain") == ("", "plain")
    assert G.sitemap_urls("<urlset><url><loc>u</loc><priority>x</priority></url></urlset>")[0][:2] == ("url", "u") and G.sitemap_urls("<") == []
    item = G.feed_items("<rss><channel><item><title>t</title><link>l</link><description>d</description><pubDate>Fri, 05 Jan 2024 10:00:00 +0000</pubDate><category>c</category></item></channel></rss>")[0]
    assert item[0] == "t" and item[3].year == 2024 and item[5] == ["c"]
    q = spark.createDataFrame([("SELECT 1",), ("select 'drop'",), ("WITH x AS (SELECT 1) SELECT 1",), ("SELECT dropped",)], "q string")
    assert [tuple(r) for r in q.select(G.writes(F.col("q")), G.read_only(F.col("q"))).collect()] == [(False, True), (True, False), (False, False), (False, True)]
    with pytest.raises(ValueError):
        G.run_sql(spark, "DROP TABLE x")


def test_sitemaps_hold_every_page(spark, tmp_path):
    n = 170_000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/?a=1&b="), "id").alias("url"))
    pages.unionByName(spark.range(11_000).select(F.lit(7).cast("long").alias("page_id"), F.concat(F.lit("http://r/<"), "id").alias("url"))).write.parquet(f"{tmp_path}/pages.parquet")
    r = Q.s10_sitemap(spark, str(tmp_path)).agg(F.count_distinct("loc").alias("n"), F.max("loc").alias("last")).first()
    assert r.n == n + 11_000 and r.last == "http://r/<9999"


def test_batches_check_duplicates(spark, tmp_path):
    text = "The committee met on Monday and agreed to publish the yearly report of the northern river survey."
    docs = [(1, text), (2, text), (3, "A quite different sentence tells of bread, butter, salt and how long a kitchen fire burns.")]
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x", "2024-02-14 00:00:00", 1.0)], "event_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sf = str(tmp_path)
    lone = C.report(C.validate(C.chunks(spark.read.parquet(f"{sf}/documents.parquet")))).first()
    assert {r.code: r.n for r in B.a02_issue_histogram(spark, sf).collect()}["NEAR_DUPLICATE"] == 1
    batch, health, drift = B.a01_batch_report(spark, sf).first(), Q.a08_health(spark, sf).first(), Q.a07_drift(spark, sf).first()
    assert batch.total == 3 and batch.warnings == lone.warnings + 1
    for score in (batch.avg_score, health.avg_quality, drift.current):
        assert score == pytest.approx(lone.avg_score - 0.25 / 3, abs=2e-6)
    assert "REMOVE_DUPLICATES" in health.recommendations.split(",")


def test_stripped_takes_linear_time(spark):
    df = spark.createDataFrame([("a" + " " * 400_000 + "b",), (" \n x \u00a0",), ("   ",)], "t string")
    began = time.time()
    assert [len(r[0]) for r in df.select(T.stripped(F.col("t"))).collect()] == [400_002, 1, 0]
    assert time.time() - began < 10


def test_validate_extracts_words_twice(spark):
    plan = C.validate(chunk(spark, "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2


def test_config(tmp_path):
    rules = G2.RuleSet.from_dict({"rules": [{"name": "a", "pattern": "x", "field": "required"}, {"type": "numeric", "condition": {"min": 1, "max": 2}, "enabled": False}], "known_facts": [{"key": "k", "value": 1}, {"key": "k", "value": 2, "tolerance": 3}]})
    assert [r.name for r in rules.rules] == ["a", "unnamed"] and rules.rules[1].high == 2 and not rules.rules[1].enabled and rules.facts["k"].value == 2
    (tmp_path / "r.yaml").write_text(rules.to_yaml())
    again = G2.RuleSet.from_yaml(tmp_path / "r.yaml")
    assert again.rules == rules.rules and again.facts == rules.facts
    reg = G2.Registry.from_dict({"sources": [{"domain": "*.gov.zw", "authority": 1}, {"pattern": "m\\.", "is_regex": True}], "blocked": ["spam.*"]})
    reg.add_source("x.org")
    reg.block_domain("spam.*")
    (tmp_path / "s.yaml").write_text(reg.to_yaml())
    assert G2.Registry.from_yaml(tmp_path / "s.yaml") == reg and len(reg.blocked) == 1 and reg.sources[2].name == "x.org"
    i = G2.intent_from_dict({"system": {"name": "n", "relevant_topics": ["t"], "geographic_focus": "Here", "quality_requirements": {"min_relevance_score": 0.7}}})
    assert (i.name, i.place, i.accept, i.review) == ("n", "Here", 0.7, 0.4) and G2.intent_from_dict(G2.intent_to_dict(i)) == i
    with pytest.raises(FileNotFoundError):
        G2.Registry.from_yaml(tmp_path / "none.yaml")
    (tmp_path / "b.yaml").write_text("a: [")
    with pytest.raises(ValueError):
        G2.RuleSet.from_yaml(tmp_path / "b.yaml")


def test_ingest_and_cli(spark, tmp_path):
    good = "The committee met on Monday and agreed to publish the yearly report of the northern river survey."
    docs = spark.createDataFrame([(1, good + " " + good.replace("river", "lake"), "a"), (2, "", "b"), (3, None, "b"), (4, good, "c")], "doc_id long, text string, source string")
    store = K.Store(spark, f"file://{tmp_path}/store")
    r = I.ingest_texts(docs, store).first()
    assert (r.documents, r.bad_extraction, r.created, r.loaded, r.rejected) == (4, 2, 2, 2, 0) and store.get_all().count() == 2
    assert I.ingest_texts(docs.limit(0), store).first().created == 0 and store.get_all().count() == 2
    assert I.ingest_chunks(chunk(spark, "x"), K.Store(spark, f"file://{tmp_path}/raw"), validate=False).first().loaded == 1
    h = cli.health(spark, f"file://{tmp_path}/store", "2024-01-01 00:00:00", ["river", "ocean"]).first()
    assert h.missing_topics == ["ocean"] and h.duplicate_groups == 0 and h.golden_pass_rate is None and h.recommendations == ["ADD_MISSING_TOPICS"]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "text": good, "source": "s", "metadata": {"a": "b"}}, {"id": "2", "text": ""}]))
    v = cli.validate(spark, f"file://{tmp_path}/c.json", output=f"file://{tmp_path}/out").first()
    assert (v.total, v.passed, v.failed) == (2, 1, 1) and spark.read.json(f"file://{tmp_path}/out").count() == 2
    assert cli.validate(spark, f"file://{tmp_path}/c.json", threshold=0.99).first().passed == 0


def test_adapters_and_reading(spark, tmp_path):
    n = spark.createDataFrame([("i", "t", {"file_path": "p", "k": "v"}), ("j", None, {"source": "s", "file_path": "p"})], "node_id string, text string, metadata map<string,string>")
    assert [tuple(r) for r in K.from_nodes(n).orderBy("id").collect()] == [("i", "t", "p", {"k": "v"}), ("j", "", "s", {})]
    s = spark.createDataFrame([("t", 0, None)], "text string, start_index int, token_count int")
    assert tuple(K.from_spans(s, "x").first()) == ("t", "x", {"start_index": "0"})
    assert G.jdbc_url("postgresql://u:p%40@h:5/d") == ("jdbc:postgresql://h:5/d", {"user": "u", "password": "p@"}) and G.jdbc_url("sqlite:///a.db")[0] == "jdbc:sqlite:a.db" and G.jdbc_url("jdbc:x") == ("jdbc:x", {})
    p = spark.createDataFrame([("u", 1, 10, True), ("u", 2, 3, True), ("u", 3, 10, True), ("v", 1, None, True), ("w", 1, 10, True), ("w", 2, 10, False), ("w", 3, 10, True)], "url string, page int, n int, ok boolean")
    assert sorted((r.url, r.page) for r in G.pages_read(p, "url", "page", F.col("ok"), F.col("n"), 10).collect()) == [("u", 1), ("u", 2), ("v", 1), ("w", 1), ("w", 2)]
    a = spark.createDataFrame([('```json\n{"k": 1}\n```',), ("no",), (None,)], "t string")
    got = [r[0] for r in a.select(G.json_or_error(F.col("t"))).collect()]
    assert json.loads(got[0]) == {"k": 1} and json.loads(got[1])["raw"] == "no" and "error" in json.loads(got[2])
    E.write_junit(spark.createDataFrame([(1, True, None), (2, False, "a < b")], "query_id int, passed boolean, reason string"), f"file://{tmp_path}/j")
    import xml.etree.ElementTree as ET

    root = ET.fromstring("\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/j").collect()).encode())
    assert root.get("failures") == "1" and [c.get("name") for c in root] == ["1", "2"] and root[1][0].get("message") == "a < b"
    atom = G.feed_items("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>t</title><link href='l'/><summary>s</summary><updated>2024-01-05T10:00:00Z</updated><category term='c'/></entry></feed>")[0]
    assert atom[:3] == ("t", "l", "s") and atom[3].day == 5 and atom[5] == ["c"]
    assert G.html_text("<p>a</p><nav>menu<p>b</p>") == ("", "a")


def test_embedding_hook(spark):
    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(70)], "id long, text string")
    got = {r.id: r.embedding for r in V.embedded(df, lambda: lambda texts: [[len(t), len(texts)] for t in texts], batch=8).collect()}
    assert all(v[0] == i and v[1] <= 8 for i, v in got.items()) and len(got) == 70


def test_top_k_brute(spark):
    import numpy as np

    rng = np.random.RandomState(0)
    m = rng.randint(-2, 3, (60, 5)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<double>")
    q = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    norm = np.linalg.norm(m, axis=1)
    cos = np.round(np.divide(m @ m.T, np.outer(norm, norm), out=np.zeros((60, 60)), where=np.outer(norm, norm) > 0), 12)
    want = {i: [j for _, j in sorted((-cos[i, j], j) for j in range(60))][:7] for i in (0, 20, 40)}
    got = {}
    for r in V.top_k(df, q, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want and V.top_k(df.limit(0), q, 3).count() == 0


def test_shared_folder_is_asked_for_on_clusters(spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "yarn", "getConf": staticmethod(lambda: {})})

    with pytest.raises(ValueError):
        cluster.shared_folder(Session)
