"""Operators 1, 8, 9 and 10 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from siftwell.llm import mixing, near_copies, quality, url_filter
from siftwell.llm.graph import components


def mixed_brute(rows, weights, default, fraction, levels):
    tokens = lambda t: len(re.findall(r"[^ \t\n\r\f]+", t or ""))
    h = lambda i: int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)
    by = defaultdict(list)
    for i, t, s in rows:
        by[s or ""].append((h(i), i, tokens(t)))
    have = {s: sum(x[2] for x in v) for s, v in by.items()}
    total, w = sum(have.values()), {s: max(1, int(weights.get(s, have[s] ** 0.5 if default is None else default) * 1024)) for s in by}

    def budget(wanted):
        """Deal what is left by weight; who has less gives all; until none does."""
        left, full = set(by), {}
        while True:
            rest = wanted - sum(full.values())
            less = {s for s in left if have[s] / w[s] <= rest / sum(w[x] for x in left)}
            if not less:
                return full | {s: int(rest * w[s] / sum(w[x] for x in left)) for s in left}
            full |= {s: have[s] for s in less}
            left -= less
            if not left:
                return full

    budgets = [budget(int(total * fraction * f)) for f in levels]
    out = []
    for s, v in by.items():
        for x, i, n in v:
            run = sum(m for y, _, m in v if y <= x)
            fits = [k + 1 for k, f in enumerate(levels) if run <= budgets[k][s]]
            if fits:
                out.append((i, s, n, fits[0]))
    return sorted(out, key=str)


def test_mixing(docs, odd):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 50), "en", rng.choice(["src0", "a", "b", None])) for i in range(400)]
    few = [(1000 + i, "w " * 5, "en", "few") for i in range(9)]
    for args in (({"src0": 3.0}, 1.0, 0.6, (0.1, 0.5, 1.0)), ({}, None, 0.9, (0.5, 1.0))):
        names = dict(zip(("weights", "default_weight", "total_fraction", "levels"), args, strict=True))
        got = mixing.mix_report(docs(rows + few), **names)
        assert sorted(map(tuple, got.collect()), key=str) == mixed_brute([(i, t, s) for i, t, _, s in rows + few], *args)
        shares = mixing.mix_shares(docs(rows + few), **names).collect()
        # the budget is met but for the last document of each source
        every = sum(r.available for r in shares)
        assert args[2] * every - 50 * len(shares) <= sum(r.tokens for r in shares) <= args[2] * every and sum(r.target for r in shares) == pytest.approx(1)
        assert all(r.tokens == r.available for r in shares if r.source == "few")
    kept = mixing.mix_filter(odd, total_fraction=1e9)
    assert kept.count() == odd.count() and kept.columns == odd.columns
    assert mixing.mix_filter(odd.limit(0)).count() == mixing.mix_report(odd.limit(0)).count() == 0


def test_quality(docs, odd):
    rng = random.Random(2)
    clean = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "today", "with", "friends"]) + str() for _ in range(rng.randint(5, 60))) + ".", "en", "a") for i in range(300)]
    junk = [(1000, "#$% ^&* " * 40, "en", "a"), (1001, "AAAA BBBB " * 40, "en", "a"), (1002, "", "en", "a"), (1003, "x" * 5000, "en", "a")]
    kept = {r.doc_id for r in quality.quality_report(docs(clean + junk)).collect()}
    assert kept == set(range(300))
    f = quality.quality_filter(docs(clean + junk))
    assert {r.doc_id for r in f.collect()} == kept and "m_hash" in f.columns
    assert {r.doc_id for r in quality.quality_filter(odd).collect()} <= {1, 4, 5, 6, 7, None}
    assert quality.quality_filter(odd.limit(0)).count() == 0


def test_sketch_bucket(spark):
    from pyspark.sql import functions as F

    v = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).withColumn("v", quality.bucket_value(F.col("b"))).collect()
    assert all(r.v <= r.id <= r.v * 33 / 32 + 1e-9 for r in v) and all(r.v == r.id for r in v if r.id < 64)
    assert [r.b for r in v] == sorted(r.b for r in v)


def grams(t, n=3):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def groups_brute(rows, t=0.5):
    """(doc_id, class_id, links, copies, best) by comparing every two texts."""
    texts = sorted({(i, x) for i, x in rows if i is not None and grams(x)})
    near = {(a, b): j for a, (_, x) in enumerate(texts) for b, (_, y) in enumerate(texts) if a != b and (j := len(grams(x) & grams(y)) / len(grams(x) | grams(y))) >= t - 1e-9}
    group = [*range(len(texts))]
    for _ in texts:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    out = []
    for a, (i, _) in enumerate(texts):
        mine = {b: j for (x, b), j in near.items() if x == a}
        if mine:
            others = {frozenset(grams(texts[b][1])) for b, j in mine.items() if j < 1}
            out.append((i, texts[group[a]][0], len(others), sum(j == 1 for j in mine.values()), round(max(mine.values()), 9)))
    return sorted(out)


def report(df):
    return sorted((r.doc_id, r.class_id, r.links, r.copies, round(r.best, 9)) for r in df.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w) + (" " + passage if rng.random() < 0.3 else "")))
    return rows


SIZES = [{}, {"BLOCK": 3, "PIECE": 100, "HELD_GRAMS": 300}]


@pytest.mark.parametrize("sizes", SIZES)
def test_jaccard_join(docs, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(near_copies, k, v)
    rows = [*corpus(160, len(sizes)), (500, "a b"), (501, "A  B"), (502, ""), (503, None), (None, "a b"), (500, "a b"), (0, "other text of the same id")]
    assert report(near_copies.jaccard_join(docs(rows))) == groups_brute(rows)


def test_jaccard_chain(docs, monkeypatch):
    """One connected part far beyond a block: each text shares half with the next one, the ends share nothing."""
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    monkeypatch.setattr(near_copies, "PIECE", 40)
    rows = [(i, " ".join(f"w{k}" for k in range(5 * i, 5 * i + 22))) for i in range(90)] + [(1000 + i, "boiler plate text " * 3 + f"own{i} word{i}") for i in range(60)]
    got = report(near_copies.jaccard_join(docs(rows)))
    assert got == groups_brute(rows) and {c for i, c, *_ in got if i < 1000} == {0}


def test_links_connect_possible_partners_only(spark, monkeypatch):
    """The links connect just what the pairs of classes do that may be partners by a gram of both; texts that share a late gram stay apart."""
    monkeypatch.setattr(near_copies, "HELD_GRAMS", 200)
    rng = random.Random(5)
    rows = []
    for node in range(150):
        held = sorted(rng.sample(range(90), rng.randint(2, 24)))
        size = len(held) + rng.randint(0, len(held) // 2)
        rows.append((node, size, len(held), len(held) - -(-size // 2) + 1, np.array(held, np.int64).tobytes()))
    group = [*range(len(rows))]
    for a, sa, ha, _, x in rows:
        for b, sb, hb, _, y in rows[:a]:
            x_, y_ = np.frombuffer(x, np.int64).tolist(), np.frombuffer(y, np.int64).tolist()
            if any(3 * min(ha - x_.index(g), hb - y_.index(g)) >= sa + sb for g in {*x_} & {*y_}) and group[a] != group[b]:
                group = [min(group[a], group[b]) if k in (group[a], group[b]) else k for k in group]
    links = near_copies._prefix_links(spark.createDataFrame(rows, "node long, size int, held int, prefix int, grams binary").repartition(3), 0.5)
    part = {r.node: r.part for r in components(links).collect()}
    assert 1 < len({*group}) < len(rows) and [part.get(k, k) for k in range(len(rows))] == group


@pytest.mark.parametrize("few", [1, 3, 100])
def test_counts(monkeypatch, few):
    monkeypatch.setattr(near_copies, "FEW", few)
    rng = random.Random(few)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40)))) for _ in range(20)]
    want = np.array([[len({*a} & {*b}) for b in sets] for a in sets])
    got = near_copies.counts(sets)
    assert (got == want)[~np.eye(20, dtype=bool)].all() and (near_copies.counts(sets, 7) == want[:7, 7:]).all()


def test_jaccard_tiles(docs, monkeypatch):
    """A dense group over many tiles and blocks, whose links are summed at either end."""
    for k, v in {"BLOCK": 12, "TILE": 4, "SENT": 500}.items():
        monkeypatch.setattr(near_copies, k, v)
    rng = random.Random(8)
    rows = []
    for i in range(60):
        w = [f"w{k}" for k in range(40)]
        for _ in range(rng.choice([0, 1, 3, 6])):
            w[rng.randrange(40)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    assert report(near_copies.jaccard_join(docs(rows))) == groups_brute(rows)


def test_jaccard_repeats(docs, spark):
    """A table that holds each row twice gives the rows of the table itself."""
    rows = corpus(80, 4)
    assert report(near_copies.jaccard_join(docs(rows + rows))) == groups_brute(rows)
    twice = docs(rows).unionByName(docs(rows))
    assert report(near_copies.jaccard_join(twice)) == groups_brute(rows)


def test_jaccard_bytes(docs):
    """A document takes about as many bytes in many fragments as in few."""
    rng = random.Random(3)
    texts = docs([(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(9999)) for _ in range(300))) for i in range(200)])
    size = []
    for fragments in (16, 1024):
        s = near_copies.segments(texts, fragments, 3).toPandas()
        size.append(sum(len(x) for c in ("steps", "gram", "uids", "sizes") for x in s[c] if x is not None) / 200)
    assert size[1] < 1.05 * size[0] and size[1] < 7.2 * 300


def test_near_filter(docs, odd):
    rows = [*corpus(120, 9), (500, "a b"), (501, "A  B"), (502, ""), (503, None), (None, "a b"), (None, "a b"), (500, "a b")]
    left = near_copies.near_filter(docs(rows)).collect()
    ids = sorted((r.doc_id for r in left if r.doc_id is not None))
    of = {i: c for i, c, *_ in groups_brute(rows)}
    assert ids == sorted(i for i in {r[0] for r in rows if r[0] is not None} if of.get(i, i) == i) and sum(r.doc_id is None for r in left) == 2
    assert near_copies.near_filter(odd.limit(0)).count() == near_copies.jaccard_join(odd.limit(0)).count() == 0
    assert near_copies.near_filter(odd).columns == odd.columns


def test_steps():
    rows, begins = np.array([0, 0, 3, 700, 5, 5, 260]), np.array([0, 4])
    out, at = near_copies.stepped(rows, begins)
    assert near_copies.unstepped(out[: at[1]]).tolist() == [0, 0, 3, 700] and near_copies.unstepped(out[at[1] :]).tolist() == [5, 5, 260]


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r.node: r.part for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 103: 100}


PAGES = "page_id long, url string, html string, u_host string, n long"


def test_urls(spark):
    good = [(i, f"https://a.example/en/{i}", "", "x", 1) for i in range(20)] + [(100 + i, f"https://a.example/fr/{i}?q=1", "", "x", 1) for i in range(20)]
    bad = [(200 + i, f"http://b.example/ads/{i}.html#t", "", "x", 1) for i in range(20)]
    wide = [(300 + i, f"http://c.example/tag/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", "", "x", 1) for i in range(40)]
    odd = [(400, None, "", "x", 1), (401, "", "", "x", 1), (402, "no scheme", "", "x", 1), (None, "https://a.example/en/5", "", "x", 1), (1, "https://a.example/en/1", "", "x", 1), (403, "http://d.example/" + "/".join("xyz" * 2000), "", "x", 1)]
    deep = [(500 + i, f"http://e.example/a/b/c/d/e/f/g/h/{'abcdefghij'[i % 10]}{'klm'[i // 10]}/end", "", "x", 1) for i in range(30)]
    pages = spark.createDataFrame(good + bad + wide + odd + deep, PAGES)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 140)] + [(200 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (1, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    r = url_filter.url_report(pages, labels).collect()
    assert len(r) == pages.count()
    by = {x.page_id: x for x in r if x.page_id is not None}
    assert by[0].template == by[100].template == "/{}/*" and by[0].keep and by[0].pages == 42
    assert by[200].template == "/ads/*.html" and not by[200].keep and by[200].labelled == 20
    assert by[300].template == "/tag/*" and by[300].pages == 40
    assert (by[400].host, by[400].template) == (by[402].host, by[402].template) == ("", "")
    assert by[403].template == "/" + "/".join("xyz" * 2000) and by[500].template == "/a/b/c/d/e/f/g/h/*/end" and by[500].pages == 30
    assert {x.page_id for x in url_filter.url_filter(pages, labels).collect()} == {x.page_id for x in r if x.keep}
    none = url_filter.url_report(pages, labels.limit(0)).collect()
    assert all(x.purity == 1 and x.keep for x in none) and url_filter.url_report(pages.limit(0), labels).count() == 0
