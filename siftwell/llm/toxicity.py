"""Operator 4: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; texts of the corpus itself, whatever their labels, are the unlabelled set. No
negative label is read. Linear classifiers in numpy minimise the class-prior-corrected risk
    pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)),
and when the second part falls below zero, the step goes up that part alone. The prior pi is a parameter; where it is None it
is estimated: by a first classifier, the least over all thresholds of the share of unlabelled texts above it to that of
positives, as above a high one there are hardly any others. The mean of the classifiers, each trained from another start,
decides; the threshold is where the corrected zero-one risk is least, found for each language with OWN_THRESHOLD positives in
the sample (its prior is pi times its share of the positives over its share of the unlabelled) and for all others together.

The features are a text's distinct words (letters, lower case), their stems of 4 to 8 letters, and whether at least 2, 3 or 4
of the distinct words have a stem, by 64-bit hash: those that more positives have than chance allows. Training reads at most
MAX_POSITIVE confirmed texts and MAX_UNLABELLED of the corpus, chosen by the hash of their ids; scoring reads every text
whole.

Defined cases: null and empty texts have no words and are not toxic; a null language counts as ''; without any positive
example nothing is toxic; a doc_id with several labels is positive if one of them is; labels without a text are left out;
repeated rows are scored each; a null doc_id is scored too; other columns are ignored, whatever their names; an empty table
gives an empty result."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import cut, in_arrow, ship, slices
from .textvec import LETTER, classes, code_points, mix, span_hashes, words

#: The bounds of the training sample, the share of toxic texts (None: estimated), and the other production parameters.
MAX_POSITIVE, MAX_UNLABELLED, PRIOR = 4000, 12_000, None
STEMS, LEVELS, LEAST_SHARE, LEAST_Z, CLASSIFIERS, STEPS, RATE, DECAY = (4, 5, 6, 7, 8), 4, 0.02, 5.0, 3, 1500, 0.05, 1e-5
OWN_THRESHOLD = 10
#: For the estimate of the prior: what the first classifier takes it for, and the least share of positives above a threshold.
FIRST_PRIOR, LEAST_CAUGHT = 0.2, 0.5
SCHEMA = "doc_id long, score double, toxic boolean"
SLICE = 600_000


def word_sets(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, rows in order, hashes) of each slice's distinct words, stems and levels of stems."""
    low = [(t or "").lower() for t in texts]
    lengths = list(map(len, low))
    for a, b in slices(lengths, SLICE):
        size = np.array(lengths[a:b], np.int64)
        full = np.flatnonzero(size > 0)
        begins = (np.cumsum(size) - size)[full]
        cp = code_points("".join(low[a:b]))
        starts, ends = words(cp, begins, classes()[cp] == LETTER)
        row = full[np.searchsorted(begins, starts, "right") - 1] if len(starts) else starts
        h = span_hashes(cp, starts, ends)
        order = np.lexsort((h, row))
        order = order[np.append(True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1]))] if len(order) else order
        starts, ends, row, h = starts[order], ends[order], row[order], h[order]
        # stems: the first letters of longer words, hashed apart from whole words of that spelling
        longer = [np.flatnonzero(ends - starts > k) for k in STEMS]
        at = np.concatenate(longer)
        stem = mix(span_hashes(cp, starts[at], np.concatenate([starts[i] + k for i, k in zip(longer, STEMS, strict=True)])))
        order = np.lexsort((stem, row[at]))
        stem, of = stem[order], row[at][order]
        first = np.flatnonzero(np.append(True, (stem[1:] != stem[:-1]) | (of[1:] != of[:-1]))) if len(stem) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(stem)))
        stem, of = stem[first], of[first]
        every = [h, stem, *(mix(stem[times >= k] + np.uint64(k)) for k in range(2, LEVELS + 1))]
        where = [row, of, *(of[times >= k] for k in range(2, LEVELS + 1))]
        order = np.argsort(np.concatenate(where), kind="stable")
        yield a, b, np.concatenate(where)[order], np.concatenate(every)[order]


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # mean of the classifiers
    bias: float
    threshold: float
    own: dict[str, float] = field(default_factory=dict)  # thresholds by language

    def toxic(self, scores: np.ndarray, langs: list[str | None]) -> np.ndarray:
        return scores > np.array([self.own.get(x or "", self.threshold) for x in langs], np.float64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for a, b, row, h in word_sets(texts):
            if not len(h) or not len(self.features):
                continue
            at = np.searchsorted(self.features, h)
            at[at == len(self.features)] = 0
            hit = self.features[at] == h
            out[a:b] += np.bincount(row[hit], self.weights[at[hit]], b - a)
        return out


def choose_features(held: list[np.ndarray], positive: np.ndarray, candidates: int) -> np.ndarray:
    """Places among the candidates that mark positives; held: the candidates that each text has."""
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    flat = np.concatenate(held) if held else np.zeros(0, np.int64)
    p, u = (np.bincount(flat[positive[row] == on], minlength=candidates) for on in (True, False))
    n, m = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    rate = (p + u + 1) / (n + m + 1)
    z = (p / n - u / m) / np.sqrt(rate * (1 - rate) * (1 / n + 1 / m) + 1e-12)
    return np.flatnonzero((z >= LEAST_Z) & (p >= least_positives(n)))


def least_positives(n: int) -> int:
    """In how many of n positives a feature must be."""
    return max(2, int(np.ceil(LEAST_SHARE * n)))


def _matrix(held: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    x = np.zeros((len(held), len(features)), np.float32)
    for i, s in enumerate(held):
        x[i, np.isin(features, s, assume_unique=True)] = 1
    return x


def risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """pi * R+(positives), and R-(unlabelled) - pi * R-(positives) before it is held at zero; w: a column a classifier, the bias last."""
    zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
    # a positive costs log(1 + exp(-z)), a negative log(1 + exp(z))
    return prior * np.logaddexp(0, -zp).mean(0), np.logaddexp(0, zu).mean(0) - prior * np.logaddexp(0, zp).mean(0)


def gradient(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk; where its second part is below zero, the way up that part alone."""
    zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
    sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    negative = np.logaddexp(0, zu).mean(0) - prior * np.logaddexp(0, zp).mean(0)
    times = lambda x, y: np.vstack([x.T @ y.astype(x.dtype), y.sum(0)]) / len(x)
    up = -prior * times(xp, 1 - sp)
    down = times(xu, su) - prior * times(xp, sp)
    return np.where(negative >= 0, up + down, -down)


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, seeds: int = CLASSIFIERS, steps: int = STEPS) -> np.ndarray:
    """Weights, a column a start, that minimise the non-negative risk with the logistic loss, by Adam over all rows."""
    w = np.stack([np.append(np.random.RandomState(s).normal(0, 0.01, xp.shape[1]), -1.0) for s in range(seeds)], 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = gradient(w, xp, xu, prior)
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def estimated_prior(xp: np.ndarray, xu: np.ndarray) -> float:
    """The share of positives among the unlabelled: trained on the even rows of both, read off the odd ones.

    Above a threshold that LEAST_CAUGHT of the positives pass, the unlabelled texts that pass too are positives and few others;
    the share of the former bounds theirs."""
    w = fit_nnpu(xp[::2], xu[::2], FIRST_PRIOR, 1, STEPS // 5)[:, 0]
    sp, su = np.sort(xp[1::2] @ w[:-1]), np.sort(xu[1::2] @ w[:-1])
    if not len(sp) or not len(su):
        return FIRST_PRIOR
    at = np.unique(np.concatenate([sp, su])) - 1e-9
    caught, flagged = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    good = caught >= LEAST_CAUGHT
    return float(np.clip((flagged[good] / caught[good]).min(), 1e-3, 0.9)) if good.any() else FIRST_PRIOR


def best_threshold(sp: np.ndarray, su: np.ndarray, prior: float) -> float:
    """Where pi * P(missed) + max(0, P(flagged) - pi * P(caught)) is least: the middle of the widest such gap."""
    edges = np.unique(np.concatenate([sp, su]))
    if not len(edges):
        return np.inf
    middle = (edges[1:] + edges[:-1]) / 2 if len(edges) > 1 else edges
    caught = 1 - np.searchsorted(np.sort(sp), middle) / max(1, len(sp))
    flagged = 1 - np.searchsorted(np.sort(su), middle) / max(1, len(su))
    risk = prior * (1 - caught) + np.maximum(0, flagged - prior * caught)
    good = np.flatnonzero(risk <= risk.min() + 1e-9)
    gap = np.diff(edges)[good] if len(edges) > 1 else np.zeros(1)
    return float(middle[good[int(np.argmax(gap))]])


def train(candidates: np.ndarray, held: list[np.ndarray], positive: np.ndarray, prior: float | None, langs: list[str] | None = None) -> Model:
    """candidates: sorted hashes; held: places of those that each sampled text has; positive: the confirmed ones, all others are the unlabelled set."""
    if not positive.any() or positive.all():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, np.inf)
    features = choose_features(held, positive, len(candidates))
    x = _matrix(held, features)
    prior = estimated_prior(x[positive], x[~positive]) if prior is None else prior
    mean = fit_nnpu(x[positive], x[~positive], prior).mean(1)
    w, bias = mean[:-1], float(mean[-1])
    s = x @ w + bias
    own, tongue = {}, np.array(langs if langs is not None else [""] * len(held))
    for lang in np.unique(tongue):
        p, u = positive & (tongue == lang), ~positive & (tongue == lang)
        if p.sum() >= OWN_THRESHOLD and u.any():
            here = prior * p.sum() / positive.sum() * (~positive).sum() / u.sum()
            own[str(lang)] = best_threshold(s[p], s[u], min(1.0, here))
    return Model(candidates[features], w, bias, best_threshold(s[positive], s[~positive], prior), own)


def candidate_hashes(texts: DataFrame) -> np.ndarray:
    """Sorted hashes that enough positives have; texts (is_p, lang, text). Counted in the tasks, so the driver gets the common ones alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, h in word_sets(batch.column(0).to_pylist()):
                hashes, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["h", "n"])

    good = texts.filter("is_p")
    least = least_positives(good.count())
    got = good.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h").toArrow()
    return np.sort(np.array(got["h"].to_pylist(), np.int64).view(np.uint64))


def _chosen(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most so many of the ids (l_id, distinct), by their hash: first those below a bound that about 1.2 times as many are under, then the least of these.

    So no task sends more than its part of the sample."""
    h = F.pmod(F.xxhash64("l_id", F.lit(seed)), F.lit(1 << 40))
    bound = min(1 << 40, int((1.2 * most + 200) / max(1, ids.count()) * (1 << 40)))
    return ids.filter(h < bound).orderBy(h, "l_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = PRIOR) -> Model:
    ship(docs.sparkSession)
    toxic = cut(labels.filter("doc_id is not null and toxic = 1").select(F.col("doc_id").alias("l_id")).distinct())
    every = docs.filter("doc_id is not null").select(F.col("doc_id").alias("l_id"))
    # both are bounded by the parameters, so they are broadcast; a text may serve in both sets, as a positive of the corpus
    chosen = _chosen(toxic, max_positive, 11).withColumn("is_p", F.lit(True)).unionByName(_chosen(every, max_unlabelled, 5).distinct().withColumn("is_p", F.lit(False)))
    texts = cut(docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("is_p", F.coalesce("lang", F.lit("")).alias("lang"), "text").distinct())
    known = candidate_hashes(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, h in word_sets(batch.column(2).to_pylist()):
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                row, at = row[hit], at[hit].astype(np.int32)
                sets = [np.sort(at[x:y]).tobytes() for x, y in zip(np.searchsorted(row, range(b - a)), np.searchsorted(row, range(b - a), "right"), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sets, pa.binary())], ["is_p", "lang", "held"])

    got = texts.mapInArrow(run, "is_p boolean, lang string, held binary").toArrow()
    rows = sorted(zip(*(got[c].to_pylist() for c in ("is_p", "lang", "held")), strict=True))
    return train(known, [np.frombuffer(r[2], np.int32) for r in rows], np.array([r[0] for r in rows], bool), prior, [r[1] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic) of every document."""
    blob = pickle.dumps(model)

    def make():
        m = pickle.loads(blob)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            s = m.scores(batch.column(1).to_pylist())
            toxic = m.toxic(s, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s), pa.array(toxic)], ["doc_id", "score", "toxic"])

        return step

    return in_arrow(docs.select("doc_id", "text", "lang"), make, SCHEMA)


def find_toxic(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The documents judged toxic, with their scores."""
    return score(docs, fit(docs, labels, **bounds)).filter("toxic")
