"""Operators 4, 6 and 7 against brute force and held-out rows, and the pipeline."""

from __future__ import annotations

import base64
import itertools
import math
import random
import re
import shutil
import time
import tracemalloc
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import media, posters, secrets, toxicity


def brute_cost(value):
    """Least cost over all cuts, by trying them all."""
    per, best = math.log10(secrets.alphabet(value)), math.inf
    known = {}
    for a, b, _, c in secrets.spans(value):
        known[a, b] = min(c, known.get((a, b), math.inf))
    # a maximal repeat or walk may be used whole only, any stretch may be brute force
    for n in range(len(value)):
        for cuts in itertools.combinations(range(1, len(value)), n):
            e = [0, *cuts, len(value)]
            cost = sum(min(known.get((a, b), math.inf), (b - a) * per) for a, b in zip(e, e[1:], strict=False)) + n * secrets.LINK
            best = min(best, cost)
    return best


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text("abcqwe123P@", min_size=1, max_size=10), st.sampled_from(["password1", "20240115ab", "aaaaaaa", "qwertyui", "dragon99", "abcabcab", "P@ssw0rd"])))
def test_guess_cost(value):
    cost, cut = secrets.guess_cost(value)
    assert cost == pytest.approx(brute_cost(value))
    assert "".join(x.split(":", 1)[1] for x in cut) == value


def test_secrets(docs, odd):
    key = "tok3n" + "fJ9x2Lq8Zr4Wb7Tn"
    rows = [(1, f'api_key = "{key}" and password: password123'), (2, "no secret here"), (3, None), (4, ""), (None, f"token={key}"), (5, f"secret: {key}\nsecret: {key}"), (6, "x " * 100_000 + f"auth_token = {key}")]
    got = secrets.scan(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.keyword, r.is_secret) for r in got) == [(0, "token", True), (1, "api_key", True), (1, "password", False), (5, "secret", True), (5, "secret", True), (6, "auth_token", True)]
    text = {r.doc_id: r.text for r in secrets.redact(docs(rows)).collect()}
    assert text[1] == 'api_key = "<SECRET>" and password: password123' and text[2] == "no secret here"
    assert text[3] is None and text[4] == "" and text[5].count("<SECRET>") == 2 and key not in text[6]
    assert secrets.redact(odd).count() == odd.count() and secrets.redact(odd).columns == odd.columns
    assert secrets.scan(odd.limit(0)).count() == secrets.redact(odd.limit(0)).count() == 0
    assert all(r.n_chars == len(r.text) for r in secrets.redact(docs(rows)).collect() if r.text is not None)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('"accessToken": "04dbK9fQ2vLx81P"', "04dbK9fQ2vLx81P"),
        ('clientSecret = "Zk9fQ2vLx81Pqq"', "Zk9fQ2vLx81Pqq"),
        ("userPassword = 'Zk9fQ2vLx81Pqq'", "Zk9fQ2vLx81Pqq"),
        ("dbPassword=Zk9fQ2vLx81Pqq", "Zk9fQ2vLx81Pqq"),
        ("AWSSecretKey=Zk9fQ2vLx81Pqq", "Zk9fQ2vLx81Pqq"),
        ('password = "it\'s-Zk9fQ2vLx81P"', "it's-Zk9fQ2vLx81P"),
        ('password = "a\\"b-Zk9fQ2vLx81P"', 'a\\"b-Zk9fQ2vLx81P'),
        *[(f"password: Zk9f{c}Q2vLx81Pqq, next", f"Zk9f{c}Q2vLx81Pqq") for c in ";,)<>'\""],
        ("(token=Zk9fQ2vLx81Pqq).", "Zk9fQ2vLx81Pqq"),
        ("Authorization: Bearer Zk9fQ2vLx81Pqq.Rt5x", "Zk9fQ2vLx81Pqq.Rt5x"),
        ('"Authorization": "Basic Zk9fQ2vLx81Pqq=="', "Zk9fQ2vLx81Pqq=="),
        ('curl -H "Authorization: Bearer Zk9fQ2vLx81Pqq"', "Zk9fQ2vLx81Pqq"),
        ("sent with Bearer Zk9fQ2vLx81PqqRt5x", "Zk9fQ2vLx81PqqRt5x"),
    ],
)
def test_secret_contexts(text, value):
    assert [f[3] for f in secrets.findings(text)] == [value]
    assert secrets.redacted(text) == text.replace(value, secrets.MARK)
    assert secrets.redacted(secrets.redacted(text)) == secrets.redacted(text)


def test_secret_lists():
    found = secrets.findings("password=abcd1234,apiToken=Zk9fQ2vLx81Pqq;pwd:Rt5xQ2vLx81Pqq")
    assert [f[2:4] for f in found] == [("password", "abcd1234"), ("apitoken", "Zk9fQ2vLx81Pqq"), ("pwd", "Rt5xQ2vLx81Pqq")]
    for plain in ("monkey: bananas and more", "basic principles of bearer bonds", "the token of a <placeholder>", "password: <your-password>"):
        assert secrets.redacted(plain) == plain


@pytest.mark.parametrize("text", ["a_" * 500_000 + " token", "a_" * 500_000 + "token", "token" * 200_000, "token " + " " * 1_000_000, "," * 500_000 + "token=" + ",a_" * 300_000, 'token="' + "x" * 1_000_000, "basic " * 200_000, "xToken=" * 150_000, "token=abcd," * 100_000, "token='" * 150_000, "token=<" * 150_000])
def test_secrets_take_linear_time(text):
    began = time.process_time()
    secrets.findings(text)
    assert time.process_time() - began < 20


def test_secrets_prefilter_is_wider():
    """Whatever the context pattern finds, the filter in front lets through."""
    key = "fJ9x2Lq8Zr4Wb7Tn"
    for name in ("to\u212aen", "pa\u017f\u017fword", "TOKEN", "Api-Key", "passPhrase", "myPwd", "PROXY-Authorization", "credentials", "secretkey"):
        text = f"{name} = {key}"
        assert not secrets.findings(text) or re.search(secrets.NEAR, text, re.ASCII)
        assert bool(secrets.findings(text)) == name.isascii()


def test_secret_words_are_ranked():
    known = secrets.dictionary(secrets.vocabulary_path())
    assert len(known) > 15_000 and secrets.guess_cost("correcthorsebatterystaple")[0] < secrets.guess_cost("corhectrorsetabberyptasle")[0]
    assert secrets.guess_cost("thinkingaboutwaterfalls")[0] < 16 < secrets.guess_cost("fJ9x2Lq8Zr4Wb7Tn")[0]


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_toxicity(spark, docs, odd):
    rng = random.Random(4)
    bad = ["vilefoo", "nastybar", "grossbaz", "meanqux"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        rows.append((i, words_of(rng, 40) + (" " + " ".join(rng.sample(bad, 3)) if toxic else "")))
        if i < 400:
            labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (9999, 1, 1), (0, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id for r in toxicity.find_toxic(docs(rows), lab).collect()}
    held = {i for i in range(400, 600) if i % 5 == 0}
    assert len(found & held) >= 0.9 * len(held) and not {i for i in found if i % 5}
    model = toxicity.fit(docs(rows), lab)
    assert toxicity.score(odd, model).count() == odd.count()
    assert not any(r.toxic for r in toxicity.score(odd, model).collect())
    assert toxicity.find_toxic(docs(rows), lab.limit(0)).count() == 0 and toxicity.find_toxic(odd.limit(0), lab).count() == 0


def pu_rows(seed, n=200, share=0.1):
    rng = np.random.RandomState(seed)
    draw = lambda n, p: (rng.rand(n, 4) < p).astype(np.float32)
    toxic, plain = [0.9, 0.5, 0.1, 0.1], [0.05, 0.5, 0.1, 0.1]
    return draw(50, toxic), np.vstack([draw(int(n * share), toxic), draw(n - int(n * share), plain)])


def plain_risk(w, xp, xu, prior):
    """The two parts of the risk, a row at a time."""
    z = lambda x: sum(a * b for a, b in zip(x, w[:-1], strict=True)) + w[-1]
    mean = lambda rows, sign: sum(math.log1p(math.exp(sign * z(r))) for r in rows) / len(rows)
    return prior * mean(xp, -1), mean(xu, 1) - prior * mean(xp, 1)


def test_risk_and_gradient():
    xp, xu = (x.astype(np.float64) for x in pu_rows(0))
    signs = set()
    for seed, prior in ((1, 0.1), (2, 0.3), (3, 0.9), (4, 0.99)):
        w = np.vstack([np.random.RandomState(seed).normal(0, 2, (4, 1)), [[-3.0]]])
        first, second = plain_risk(w[:, 0], xp, xu, prior)
        got = toxicity.risk(w, xp, xu, prior)
        assert (got[0][0], got[1][0]) == pytest.approx((first, second))
        signs.add(second >= 0)
        g = toxicity.gradient(w, xp, xu, prior)[:, 0]
        for k in range(5):
            step = np.zeros(5)
            step[k] = 1e-5
            a, b = plain_risk(w[:, 0] + step, xp, xu, prior), plain_risk(w[:, 0] - step, xp, xu, prior)
            want = (sum(a) - sum(b)) / 2e-5 if second >= 0 else -(a[1] - b[1]) / 2e-5
            assert g[k] == pytest.approx(want, abs=1e-4)
    assert signs == {True, False}


def test_risk_is_non_negative_corrected():
    xp, xu = pu_rows(0)
    w = toxicity.fit_nnpu(xp, xu, 0.1, 2)
    assert (w[0] > 1).all() and (w[0] > 3 * abs(w[1])).all()


def test_prior_is_estimated():
    for share in (0.05, 0.2, 0.5):
        rng = np.random.RandomState(int(share * 100))
        draw = lambda n, p: (rng.rand(n, 6) < p).astype(np.float32)
        toxic, plain = [0.7, 0.7, 0.7, 0.2, 0.2, 0.2], [0.01, 0.01, 0.01, 0.2, 0.2, 0.2]
        xp, xu = draw(600, toxic), np.vstack([draw(int(3000 * share), toxic), draw(3000 - int(3000 * share), plain)])
        xu = xu[rng.permutation(len(xu))]
        assert toxicity.estimated_prior(xp, xu) == pytest.approx(share, rel=0.35)


def scalar_decode(data):
    """A plain decoder, one bit at a time: luminance DC values in MCU order."""
    h = media.parse(data)
    s = h.scan
    tables = []
    for t in s.tables:
        code, at, d = 0, 16, {}
        for n in range(1, 17):
            for _ in range(t[n - 1]):
                d[n, code] = t[at]
                code, at = code + 1, at + 1
            code <<= 1
        tables.append(d)
    out, left = [], s.mcus
    for seg in s.segments:
        bits = "".join(f"{b:08b}" for b in seg)
        p, pred = 0, {}

        def symbol(d):
            nonlocal p
            for n in range(1, 17):
                if (n, int(bits[p : p + n], 2)) in d:
                    p += n
                    return d[n, int(bits[p - n : p], 2)]
            raise AssertionError

        def value(n):
            nonlocal p
            v = int(bits[p : p + n] or "0", 2)
            p += n
            return v if not n or v >= 1 << (n - 1) else v - (1 << n) + 1

        for _ in range(min(s.interval, left)):
            for lum, dc, ac in s.components:
                pred[dc] = pred.get(dc, 0) + value(symbol(tables[dc]))
                if lum:
                    out.append(pred[dc])
                k = 1
                while k < 64:
                    x = symbol(tables[ac])
                    if x == 0:
                        break
                    k += (x >> 4) + 1
                    value(x & 15)
        left -= s.interval
    thumb = np.zeros(h.thumb[0] * h.thumb[1], np.int64)
    for v, at in zip(out, s.block_at, strict=True):
        if at >= 0:
            thumb[at] = v
    return thumb


@pytest.mark.parametrize(("halved", "interval", "n"), [(False, 0, 1), (False, 3, 1), (False, 2, 3), (True, 0, 3), (True, 4, 3)])
def test_jpeg(halved, interval, n):
    rng = np.random.RandomState(interval + n)
    for w, h in ((8, 8), (50, 33), (17, 70)):
        s = 2 if halved else 1
        planes = [rng.randint(0, 256, (h, w)).astype(np.uint8)] + [rng.randint(0, 256, (-(-h // s), -(-w // s))).astype(np.uint8)] * (n - 1)
        data = posters.encode(planes, w, h, halved, interval)
        head = media.parse(data)
        (dc,), status = media.decode([head])
        assert status[0] == 0 and dc.tolist() == scalar_decode(data).tolist()
        want = posters.coefficients(planes[0], head.thumb[1], head.thumb[0], posters.QUANT)[:, 0]
        assert dc.tolist() == want.tolist()
        assert media.features([data])[0][1:6] == (w, h, n, -(-w // 8), -(-h // 8))


def test_media_cases(spark):
    good = posters.poster("<html>" + "hello " * 500)
    dc_marker = good.index(b"\xff\xc0")
    progressive = good[:dc_marker] + b"\xff\xc2" + good[dc_marker + 2 :]
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, progressive), (6, good[:-40]), (7, b"\xff\xd8\xff\xdb\x00"), (None, good), (8, good[:dc_marker] + b"\xff\xd9")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, "x") for i, b in rows], "page_id long, media binary, status string")
    got = media.media_features(df).collect()
    status = {r.page_id: r.status for r in got}
    assert status == {1: "ok", 2: "empty", 3: "empty", 4: "not_jpeg", 5: "unsupported", 6: "truncated", 7: "corrupt", 8: "corrupt", None: "ok"} and len(got) == len(rows)
    assert all((r.thumbnail is not None) == (r.status == "ok") for r in got)
    assert media.media_features(df.limit(0)).count() == 0
    big = posters.encode([np.tile(np.arange(256, dtype=np.uint8), (1200, 8))], 2048, 1200)
    assert media.features([big])[0][0] == "ok"
    p = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "yy")], "page_id long, html string")
    assert sorted(r.status for r in media.media_features(posters.posters(p)).collect()) == ["empty", "empty", "ok", "ok"]


@pytest.fixture
def tables(spark, docs, odd, tmp_path):
    rng = random.Random(8)
    rows = [(i, words_of(rng, 60) + (" password = fJ9x2Lq8Zr4Wb7TnQ" if i % 10 == 0 else ""), "en", f"src{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "src0") for i in range(20)] + [(300, "$#@ " * 200, "en", "src0")]
    docs(rows).unionByName(odd).write.parquet(f"{tmp_path}/t/documents.parquet")
    yield f"{tmp_path}/t"
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_pipeline(spark, tables):
    import corpus_pipeline as p

    assert 4 <= len(p.STAGES) <= 5
    docs, columns, seen = spark.read.parquet(f"{tables}/documents.parquet"), None, []
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns, name
        path = f"{tables}/{uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
    assert seen[0] > seen[1] == seen[2] > seen[3]
    assert docs.filter("text like '%fJ9x2Lq8Zr4Wb7TnQ%'").count() == 0
    out = p.run(spark, tables).collect()
    assert len(out) == seen[3] and all(r.round_trip for r in out)
    assert not {r.doc_id for r in out} & {*range(200, 220), 300}


def test_posters_take_little_memory():
    """Bits are written by words, in slices that stay small: a page of noise takes no more than that, and gives the same bytes alone as among others."""
    rng = random.Random(11)
    pages = ["".join(chr(rng.randrange(32, 127)) for _ in range(n)) for n in (5, 9_000, 40_001, 90_002, 90_003, 90_004)]
    alone = [posters.poster(x) for x in pages]
    tracemalloc.start()
    together = posters.all_posters(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert together == alone and peak < 40e6


def test_posters_grow():
    rng = random.Random(7)
    pages = ["<p>" + words_of(rng, n) for n in (1, 30, 300, 3000, 15_000)] + ["<p>" + words_of(rng, 300) for _ in range(40)]
    got = media.features([posters.poster(p) for p in pages])
    assert {r[0] for r in got} == {"ok"} and all(r[1] * r[2] >= len(p) for p, r in zip(pages, got, strict=True))
    assert all(r[4] >= 9 and r[5] >= 8 for r in got)
    assert len({r[7] for r in got}) == len(pages)


POSTER = posters.poster("<html>" + "hello world " * 60)
#: A one-pixel image of a public encoder, colour, 4:2:0 without optimised tables.
PIXEL = base64.b64decode(
    "/9j/4AAQSkZJRgABAQEAYABgAAD/2wBDAAIBAQIBAQICAgICAgICAwUDAwMDAwYEBAMFBwYHBwcGBwcICQsJCAgKCAcHCg0KCgsMDAwMBwkODw0MDgsMDAz/2wBDAQICAgMDAwYDAwYMCAcIDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAwMDAz/"
    "wAARCAABAAEDASIAAhEBAxEB/8QAHwAAAQUBAQEBAQEAAAAAAAAAAAECAwQFBgcICQoL/8QAtRAAAgEDAwIEAwUFBAQAAAF9AQIDAAQRBRIhMUEGE1FhByJxFDKBkaEII0KxwRVS0fAkM2JyggkKFhcYGRolJicoKSo0NTY3ODk6Q0RFRkdISUpTVFVWV1hZWmNkZWZnaGlqc3R1dnd4"
    "eXqDhIWGh4iJipKTlJWWl5iZmqKjpKWmp6ipqrKztLW2t7i5usLDxMXGx8jJytLT1NXW19jZ2uHi4+Tl5ufo6erx8vP09fb3+Pn6/8QAHwEAAwEBAQEBAQEBAQAAAAAAAAECAwQFBgcICQoL/8QAtREAAgECBAQDBAcFBAQAAQJ3AAECAxEEBSExBhJBUQdhcRMiMoEIFEKRobHBCSMz"
    "UvAVYnLRChYkNOEl8RcYGRomJygpKjU2Nzg5OkNERUZHSElKU1RVVldYWVpjZGVmZ2hpanN0dXZ3eHl6goOEhYaHiImKkpOUlZaXmJmaoqOkpaanqKmqsrO0tba3uLm6wsPExcbHyMnK0tPU1dbX2Nna4uPk5ebn6Onq8vP09fb3+Pn6/9oADAMBAAIRAxEAPwD9/KKKKAP/2Q=="
)


def java_jpeg(spark, width, height, colour, seed):
    """An image written by the JVM's own encoder, and its own reading of it as grey means."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 1 if colour else 10)
    rng = random.Random(seed)
    for y in range(height):
        for x in range(width):
            v = (x * 3 + y * 2 + rng.randrange(20)) % 256
            image.setRGB(x, y, v << 16 | (v + 40 * colour) % 256 << 8 | v)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    if not colour:
        return data, np.array([[back.getRaster().getSample(x, y, 0) for x in range(width)] for y in range(height)])
    rgb = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(width)] for y in range(height)])
    return data, 0.299 * (rgb >> 16) + 0.587 * (rgb >> 8 & 255) + 0.114 * (rgb & 255)


def test_foreign_jpegs(spark):
    assert media.features([PIXEL])[0][:6] == ("ok", 1, 1, 3, 1, 1)
    for width, height, colour in ((16, 16, True), (40, 24, True), (33, 17, False)):
        data, grey = java_jpeg(spark, width, height, colour, width)
        r = media.features([data])[0]
        assert r[:6] == ("ok", width, height, 3 if colour else 1, -(-width // 8), -(-height // 8))
        thumb = np.frombuffer(r[6], np.uint8).reshape(r[5], r[4]).astype(float)
        for y in range(height // 8):
            for x in range(width // 8):
                assert abs(thumb[y, x] - grey[8 * y : 8 * y + 8, 8 * x : 8 * x + 8].mean()) < 6


@settings(max_examples=400, deadline=None)
@given(st.sampled_from([POSTER, PIXEL, posters.poster("x" * 301), posters.poster("y" * 302)]), st.lists(st.tuples(st.floats(0, 1, exclude_max=True), st.integers(0, 255)), max_size=4), st.floats(0, 1), st.booleans())
def test_no_bytes_raise(data, changes, keep, cut):
    raw = bytearray(data)
    for where, value in changes:
        raw[int(where * len(raw))] = value
    if cut:
        raw = raw[: int(keep * len(raw))]
    (r,) = media.features([bytes(raw)])
    assert r[0] in ("ok", "truncated", "corrupt", "unsupported", "not_jpeg", "empty") and (r[6] is not None) == (r[0] == "ok")


def test_many_broken_images():
    """Each header byte with each of several values, in one call, so that none harms another."""
    end = PIXEL.index(b"\xff\xda") + 14
    raw = [PIXEL[:i] + bytes([v]) + PIXEL[i + 1 :] for i in range(end) for v in (0, 1, 2, 5, 16, 0x7F, 0xC0, 0xFF)]
    got = media.features([*raw, PIXEL])
    assert got[-1][0] == "ok" and {"corrupt", "ok", "truncated", "unsupported"} <= {r[0] for r in got}


def test_lying_header():
    at = POSTER.index(b"\xff\xc0")
    lie = POSTER[: at + 5] + b"\xff\xff\xff\xff" + POSTER[at + 9 :]
    tracemalloc.start()
    (r,) = media.features([lie])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert r[:3] == ("truncated", 65535, 65535) and peak < 8_000_000
