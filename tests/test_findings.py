from __future__ import annotations

import math
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import chunkers as S
from siftwell.operators import duplicates as D
from siftwell.operators import relevance as V
from siftwell.plans import catalogue
from siftwell.sources import readers as G

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def same_as_sql(spark, tmp_path, name, **tables):
    """The query over these tables gives the rows of its SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    plain = lambda v: ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)], DOCS)


SPACES = " \t\n\v\f\r\x1c\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"


@pytest.mark.parametrize("name", ["s17_pdf_pages", "s19_pdf_issues"])
def test_pdf_scores_of_odd_pages(spark, tmp_path, name):
    """empty and null pages, and each kind of white space, at the ends and within."""
    texts = ["", None, " ", "x" * 49 + "\n", "x" * 49 + " \n", "ab" * 30, "?!" * 40, "a%" * 40 + "é" * 20]
    texts += [f for c in SPACES for f in (c * 60, "x" * 49 + c, c + "x" * 49 + c * 2 + "\n", ("y" * 3 + c * 2) * 20)]
    same_as_sql(spark, tmp_path, name, documents=documents(spark, texts))
    same_as_sql(spark, tmp_path, name, documents=documents(spark, [t for t in texts if t != ""]))


def shuffled(spark, run):
    """Rows that went through shuffles while it ran."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_common_words_make_no_candidates(spark):
    """F3, F14 to F16: texts of the same common words, none near another, aren't paired; neither are many near copies of one text."""
    rng = random.Random(5)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(60)], 40)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert shuffled(spark, lambda: D.near(D.item_sets(df, D.words(F.col("text"))), 0.92).collect()) < 20_000
    base = [f"b{i}" for i in range(200)]
    copies = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(copies)), "id long, text string")
    got = []
    assert shuffled(spark, lambda: got.extend(D.near(D.item_sets(df, D.words(F.col("text"))), 0.92).collect())) < 20_000
    assert len(got) == 120 and all(r.links == 119 and r.best == pytest.approx(198 / 202) for r in got)


@pytest.mark.parametrize("t", [0.6, 0.8, 0.92])
def test_near_sets_by_brute_force(spark, monkeypatch, t):
    """Sets of 1 to 300 words around a few centres, compared in one block and in many."""
    rng = random.Random(int(100 * t))
    centres = [[f"c{j}w{i}" for i in range(n)] for j, n in enumerate((1, 2, 5, 11, 12, 13, 24, 40, 90, 300))]
    texts = []
    for c in centres:
        for _ in range(14):
            off = rng.randint(0, max(1, int(len(c) * (1 - t) * 1.5)))
            texts.append(" ".join([*rng.sample(c, max(1, len(c) - off)), *[f"n{rng.randint(0, 9999)}" for _ in range(rng.randint(0, off))]]))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [frozenset(x.split()) for x in texts]
    least = {}
    for i, s in enumerate(sets):
        least.setdefault(s, i)
    want = {}
    for i, s in enumerate(sets):
        others = {o: len(s & o) / len(s | o) for o in least if o != s and len(s & o) / len(s | o) >= t - 1e-9}
        if others or sets.count(s) > 1:
            want[i] = (least[s], sets.count(s) - 1, len(others))
    for block in (D.BLOCK, 3):
        monkeypatch.setattr(D, "BLOCK", block)
        got = {r.id: (r.class_id, r.copies, r.links) for r in D.near(D.item_sets(df, D.words(F.col("text"))), t).collect()}
        assert got == want


@pytest.mark.parametrize("name", ["p01_accepted", "a02_issue_histogram", "label_agreement", "a07_drift", "a11_intent_pipeline"])
def test_texts_are_measured_once(spark, tmp_path, name):
    """F4 to F10, F12: filters and sums over validated rows don't measure the texts again, nor move them."""
    documents(spark, ["The first text of all.", "Another one."]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython|MapInArrow|BatchEvalPython", plan)) == 1 and "regexp_extract_all" not in plan


class Grabbed:
    """Stands for a table: gives what a function would run on its batches."""

    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run

    def withColumn(self, name, run):
        return run


class Udf:
    def __init__(self, run):
        self.run = run

    def asNondeterministic(self):
        return self

    def __call__(self, column):
        return self.run


@pytest.mark.parametrize("what", ["F13 c1_recursive_chunks", "F17 s09_html_text", "F18 t16_chunk_score", "F19 p14_embedded"])
def test_python_memory_does_not_follow_the_batch(spark, monkeypatch, what):
    monkeypatch.setattr(F, "arrow_udf", lambda run, *kinds: Udf(run))
    table = Grabbed(spark)
    name, run = what.split()[1], None
    if name == "c1_recursive_chunks":
        run = S.recursive_chunks(table)
    elif name == "s09_html_text":
        run = G.pages_text(table)
    elif name == "t16_chunk_score":
        run = T.measures(F.col("text"))
    else:
        run = V.embedded(table, lambda: lambda texts: [[len(t)] * 8 for t in texts])

    def peak(rows):
        texts = pa.array([f"<p>{i}</p> Some words. " * 90 for i in range(rows)])
        ids = pa.array(range(rows), pa.int64())
        batch = {"c1_recursive_chunks": [ids, texts], "s09_html_text": [ids, texts, texts]}.get(name)
        given = [pa.RecordBatch.from_arrays(batch, [str(i) for i in range(len(batch))]) if batch else texts]
        tracemalloc.start()
        for _ in run(iter(given)):
            pass
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    peak(10)
    assert peak(8000) < 2 * peak(400)


def test_top_k_in_many_blocks(spark, monkeypatch):
    """blocks hold so many vectors at most, and the k best of all blocks are those of brute force, ties and null vectors included."""
    rng = np.random.RandomState(1)
    m = rng.randint(-2, 3, (300, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "vec_id long, embedding array<double>")
    q = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert max(len(r.ids) // 8 for r in V._packed(df, "vec_id", "embedding", 16).collect()) == 16
    norm = np.linalg.norm(m, axis=1)
    cos = np.round(np.divide(m @ m.T, np.outer(norm, norm), out=np.zeros((300, 300)), where=np.outer(norm, norm) > 0), 12)
    want = {i: [j for _, j in sorted((-cos[i, j], j) for j in range(300))][:7] for i in range(0, 300, 20)}
    for vectors, queries, tile in ((16, 4, 3), (5, 100, 256), (300, 1, 1)):
        for k, v in (("VECTORS", vectors), ("QUERIES", queries), ("TILE", tile)):
            monkeypatch.setattr(V, k, v)
        got = {}
        for r in V.top_k(df, q, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want
