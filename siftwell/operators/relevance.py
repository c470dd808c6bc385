"""Relevance to a stated intent, and retrieval by vectors with its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.window import Window

from ..cluster import cut, release, ship

ACCEPT, REVIEW = 0.6, 0.4


@dataclass(frozen=True)
class Intent:
    name: str
    description: str = ""
    users: list[str] = field(default_factory=list)
    questions: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    irrelevant: list[str] = field(default_factory=list)
    place: str = ""
    places: list[str] = field(default_factory=list)
    accept: float = ACCEPT
    review: float = REVIEW

    def text(self) -> str:
        """What is embedded for the intent."""
        also = f" (also: {', '.join(self.places)})" if self.places else ""
        parts = [
            f"System purpose: {self.description.strip()}" if self.description else "",
            f"Target users: {', '.join(self.users)}" if self.users else "",
            "Questions this system should answer:" + "".join(f"\n- {q}" for q in self.questions) if self.questions else "",
            f"Relevant topics: {', '.join(self.topics)}" if self.topics else "",
            f"Geographic focus: {self.place}{also}" if self.place else "",
        ]
        return "\n\n".join(p for p in parts if p)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null vectors give null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(F.try_divide(dot(a, b), norms))


def matched_topics(text: Column, topics: list[str]) -> Column:
    """Up to five topics all of whose words the text holds, in the intent's order."""
    low = F.lower(text)
    each = []
    for t in topics:
        hit = F.lit(True)
        for w in t.lower().split():
            hit = hit & F.contains(low, F.lit(w))
        each.append(F.when(hit, F.lit(t)))
    return F.slice(F.filter(F.array(*each).cast("array<string>"), lambda x: x.isNotNull()), 1, 5)


def irrelevant(text: Column, topics: list[str]) -> Column:
    hit = F.lit(False)
    for t in topics:
        hit = hit | F.contains(F.lower(text), F.lit(t.lower()))
    return hit


def decide(df: DataFrame, intent: Intent, vector: Column, text: str = "text", embedding: str = "embedding") -> DataFrame:
    """The rows with relevance (cosine moved to 0..1, 0 for an irrelevant topic), decision and topics.

    An irrelevant text is rejected with or without a vector; any other without one has no relevance and is 'unscored'."""
    score = F.when(irrelevant(F.col(text), intent.irrelevant), 0.0).otherwise((cosine(F.col(embedding), vector) + 1) / 2)
    d = df.withColumn("relevance", score)
    return d.withColumns({"decision": F.when(F.col("relevance").isNull(), "unscored").when(F.col("relevance") >= intent.accept, "accept").when(F.col("relevance") >= intent.review, "review").otherwise("reject"), "topics": matched_topics(F.col(text), intent.topics)})


def enriched(decided: DataFrame, intent: Intent, metadata: str = "metadata") -> DataFrame:
    """The accepted rows, their metadata with relevance_score, matched_topics and intent, which replace keys of these names."""
    new = F.create_map(F.lit("relevance_score"), F.col("relevance").cast("string"), F.lit("matched_topics"), F.array_join("topics", ","), F.lit("intent"), F.lit(intent.name))
    old = F.map_filter(F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("relevance_score", "matched_topics", "intent"))
    return decided.filter("decision = 'accept'").withColumn(metadata, F.map_concat(old, new))


def relevance_report(decided: DataFrame) -> DataFrame:
    n = lambda k: F.coalesce(F.sum((F.col("decision") == k).cast("long")), F.lit(0)).alias(f"{k}ed")
    rate = lambda k: F.coalesce(F.avg((F.col("decision") == k).cast("double")), F.lit(0.0)).alias(f"{k}ance_rate" if k == "accept" else f"{k}ion_rate")
    return decided.agg(F.count(F.lit(1)).alias("total"), n("accept"), n("review"), n("reject"), F.count(F.when(F.col("decision") == "unscored", 1)).alias("unscored"), F.coalesce(F.avg("relevance"), F.lit(0.0)).alias("avg_relevance"), rate("accept"), rate("reject"))


#: Vectors and queries in a block, and queries whose scores are held at once.
VECTORS, QUERIES, TILE = 8192, 4096, 256


def _packed(df: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """(ids, dim, vectors): at most so many vectors, with norm 1 or 0, as one row; null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if len(part.column(1).value_lengths().unique()) > 1:
                    raise ValueError("vectors of different lengths")
                m = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                norm = np.sqrt((m * m).sum(1, keepdims=True))
                m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()]), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()])], ["ids", "dim", "vectors"])
            del batch
        release()

    return df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(run, "ids binary, dim int, vectors binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k most similar vectors of each query that meet the condition, ties by key.

    Exact: blocks of vectors meet blocks of queries (query_id, query), a product each, of which goes on what may be among a
    query's k best by what its task has seen; the ranking merges these. Scores are compared to twelve digits, so that the
    order of sums doesn't matter."""
    ship(vectors.sparkSession)
    all_ = _packed(vectors if where is None else vectors.filter(where), key, "embedding", VECTORS).repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism, "ids")
    asked = cut(_packed(queries, "query_id", "query", QUERIES))
    pairs = all_.crossJoin(asked.toDF("q_ids", "q_dim", "q_vectors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, np.ndarray] = {}  # of each block of queries, a bound below the k-th best score
        for batch in batches:
            for i in range(batch.num_rows):
                ids, dim, data, q_ids, q_dim, q_data = (c[i] for c in batch.columns)
                v, q = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, n.as_py()) for x, n in ((data, dim), (q_data, q_dim)))
                names, asks = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(q_ids.as_buffer(), np.int64)
                bound = least.setdefault(asks.tobytes(), np.full(len(q), -np.inf))
                for at in range(0, len(q), TILE):
                    score = q[at : at + TILE] @ v.T
                    low = bound[at : at + TILE]
                    if len(names) > k and (np.isinf(low).any() or (score >= low[:, None]).sum() > 4 * k * len(low)):
                        np.maximum(low, np.partition(score, len(names) - k, axis=1)[:, len(names) - k] - 2e-12, out=low)  # so that rounding loses nothing
                    row, column = np.nonzero(score >= low[:, None])
                    found = np.round(score[row, column], 12)
                    del score
                    order = np.lexsort((names[column], -found, row))
                    row, column, found = row[order], column[order], found[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) < k
                    yield pa.RecordBatch.from_arrays([pa.array(asks[at + row[best]]), pa.array(names[column[best]]), pa.array(found[best])], ["query_id", key, "score"])
            del batch
        release()

    scored = pairs.mapInArrow(run, f"query_id long, `{key}` long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def embedded(df: DataFrame, load: Callable[[], Callable[[list[str]], Any]], text: str = "text", into: str = "embedding", batch: int = 32) -> DataFrame:
    """The rows with the vectors that a model gives: load() is called once a task, its result with so many texts at a time.

    A null text is an empty one. The model is the caller's: none is part of this library."""
    ship(df.sparkSession)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for part in parts:
            out = [pa.array([], pa.list_(pa.float64()))]
            for at in range(0, len(part), batch):  # Python strings and numbers of a whole part would take many times its memory
                texts = ["" if t is None else t for t in part.slice(at, batch).to_pylist()]
                out.append(pa.array([list(map(float, v)) for v in model(texts)], pa.list_(pa.float64())))
            del part
            yield pa.concat_arrays(out)
            del out
        release()

    return df.withColumn(into, F.arrow_udf(run, "array<double>", ArrowUDFType.SCALAR_ITER)(F.col(text)))


def golden_eval(retrieved: DataFrame, golden: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: pass rate, mean reciprocal rank, precision at each k.

    retrieved (query_id, source, rank), golden (query_id, expected): a question passes if any expected source is there or none is expected."""
    hit = F.array_contains("expected", F.col("source"))
    per = golden.join(retrieved, "query_id", "left").groupBy("query_id", "expected").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        *[F.coalesce(F.try_divide(F.count_distinct(F.when(hit & (F.col("rank") <= k), F.col("source"))).cast("double"), F.count(F.when(F.col("rank") <= k, 1))), F.lit(0.0)).alias(f"p{k}") for k in ks],
    )
    good = F.col("first").isNotNull() | (F.size("expected") == 0)
    return per.agg(F.count(F.lit(1)).alias("questions"), F.avg(good.cast("double")).alias("pass_rate"), F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"), *[F.avg(f"p{k}").alias(f"precision_at_{k}") for k in ks])
