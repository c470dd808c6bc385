"""Operator 6: secret scans by a password guess-cost dynamic programme.

A value in a credential context (token = "...", password: ...) is cut into spans: dictionary words, dates, repeats, keyboard
walks and brute force. Each span costs the log10 of the guesses for it, and each span after the first adds LINK. The least
total over all cuts is the value's cost; from SECRET on it is a secret, below that a placeholder or a weak word. A word costs
the log10 of its rank: common passwords first, then the whole words of a public vocabulary file, whose ids ascend as its words
get rarer.

A keyword with its sign is looked for first; then its name is followed back and its value read on, so a text takes time in
proportion to its length.

Defined cases: null and empty texts have no findings and stay as they are; values of less than LEAST characters are no
findings, longer ones of any length are scored whole; every finding of a text counts, in order, repeats too; letters of
keywords are ASCII; a null doc_id stays null; other columns stay as they are, whatever their names; an empty table gives an
empty result."""

from __future__ import annotations

import base64
import functools
import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import in_arrow, ship, vocabulary_file, vocabulary_path, wrapped

SECRET, LINK, LEAST = 10.0, math.log10(2), 4
MARK = "<SECRET>"
_KEYS = "passwords?|passwd|pwd|passphrase|secrets?|tokens?|api[_-]?keys?|access[_-]?keys?|secret[_-]?keys?|private[_-]?keys?|auth|(?:proxy-)?authorization|credentials?|bearer"
#: A keyword with its sign, or an authorization scheme alone before what looks like a credential.
HEAD = rf"(?a:(?i:(?P<key>{_KEYS})(?P<is>[\"']?[ \t]*(?::=|=>|=|:)[ \t]*)|(?P<scheme>bearer|basic)[ \t]++(?=[a-z+/._~=-]*+[0-9])(?P<credential>[a-z0-9+/._~=-]{{16,}}+)))"
#: A quoted value ends at its own quote and may hold escapes; a bare one ends at white space or at the next name in a list, its last punctuation is no part of it.
_SCHEME = r"(?:(?a:(?i:bearer|basic))[ \t]++(?=[^\s\"']{8}))?+"
QUOTED = rf"(?P<quote>[\"']){_SCHEME}(?P<quoted>(?:\\[^\r\n]|(?!(?P=quote))[^\\\r\n]){{4,}}+)(?P=quote)"
BARE = rf"{_SCHEME}(?![\"']|<[^<>\s]*+>)(?=\S)"
_LAST = ".,;:!?)]}>\"'`"
#: What a text must hold for HEAD to match; cheap enough to run over everything.
NEAR = r"(?i)(?:passw|passphrase|pwd|secret|token|key|auth|credential|bearer|basic[ \t])"
SCHEMA = "doc_id long, position int, keyword string, value string, guesses_log10 double, segments array<string>, is_secret boolean"
#: Common passwords, which come before the vocabulary's words.
WORDS = (
    "password 123456 123456789 12345678 qwerty abc123 admin letmein welcome monkey dragon master login hello test guest root user "
    "secret token key changeme example sample default public private access auth demo temp none null true false your my the and "
    "for with from that this have not are was you all one new time love god sex money football baseball sunshine princess "
    "shadow michael jordan superman batman trustno1 iloveyou starwars computer internet server data base home work office "
    "summer winter spring autumn monday friday january april june july august march company system service client value "
    "string text name here insert replace pass word code open close start stop red blue green black white dog cat horse "
    "battery staple correct apple orange banana king queen star moon sun fire water earth wind tree house car book"
).split()
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_DIGIT = re.compile("[0-3]")
_LEET = str.maketrans("430157@$!", "aeoistasi")


@functools.lru_cache(maxsize=4)
def dictionary(path: str) -> ahocorasick.Automaton:
    """Finds words of three letters and more as (length, rank); ranks begin at 2."""
    ranks = {w: i + 2 for i, w in reversed([*enumerate(WORDS)])}
    with open(path, "rb") as f:
        lines = sorted((int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in f if x.strip()))
    for _, token in lines:
        if re.fullmatch(rb" [A-Za-z]{3,}", token):
            ranks.setdefault(token[1:].decode().lower(), len(ranks) + 2)
    out = ahocorasick.Automaton()
    for w, rank in ranks.items():
        out.add_word(w, (len(w), rank))
    out.make_automaton()
    return out


@functools.cache
def _steps() -> frozenset[str]:
    """Neighbouring keys or letters, both ways."""
    return frozenset(p for r in _ROWS for a, b in zip(r, r[1:], strict=False) for p in (a + b, b + a))


def alphabet(value: str) -> int:
    """How many characters a brute-force guesser must try for each of this value's."""
    if re.fullmatch(r"[0-9]+", value):
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 16
    return max(2, 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value)) + 32 * bool(re.search("[^A-Za-z0-9]", value)))


def spans(value: str, path: str | None = None) -> Iterator[tuple[int, int, str, float]]:
    """All spans that aren't brute force, as (start, end, kind, cost)."""
    # characters whose lower case is longer stay as they are, so that places agree
    low = value.lower() if len(value.lower()) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    known = dictionary(path or vocabulary_path())
    plain = low.translate(_LEET)
    for text, leet in ((low, 0.0), (plain, LINK))[: 1 + (plain != low)]:
        for last, (size, rank) in known.iter(text):
            at, end = last + 1 - size, last + 1
            if not leet or low[at:end] != plain[at:end]:
                yield at, end, "word", math.log10(rank) + (0.0 if value[at:end].islower() or value[at:end].isdigit() else LINK) + leet
    for m in _DIGIT.finditer(value):
        i = m.start()
        for size in (4, 8, 10):
            if _DATE.fullmatch(value, i, i + size) and i + size <= len(value):
                yield i, i + size, "date", math.log10(119 if size == 4 else 365 * 119 * (2 if size == 8 else 8))
    yield from _runs(value, low)


def _runs(value: str, low: str) -> Iterator[tuple[int, int, str, float]]:
    """Maximal repeats of a unit of 1 to 4 characters, and maximal keyboard or alphabet walks of 3 and more."""
    n, base, steps = len(value), math.log10(alphabet(value)), _steps()
    for unit in (1, 2, 3, 4):
        at = 0
        while at + unit < n:
            end = at + unit
            while end < n and value[end] == value[end - unit]:
                end += 1
            times = (end - at) // unit
            if times >= (3 if unit == 1 else 2):
                yield at, at + times * unit, "repeat", unit * base + math.log10(times)
            at = max(at + 1, end - unit + 1)
    at = 0
    while at < n - 1:
        end = at + 1
        while end < n and low[end - 1 : end + 1] in steps:
            end += 1
        if end - at >= 3:
            yield at, end, "walk", math.log10(2 * sum(map(len, _ROWS)) * (end - at))
        at = max(at + 1, end - 1)


def guess_cost(value: str, path: str | None = None) -> tuple[float, list[str]]:
    """Least cost over all cuts, and the spans of a cut that has it as 'kind:text'."""
    n, per = len(value), math.log10(alphabet(value))
    if not n:
        return 0.0, []
    into: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
    for a, b, kind, cost in spans(value, path):
        into[b].append((a, kind, cost))
    # closed[i]: best cut of value[:i]; brute[i]: best one whose last span is brute force, which one more character extends
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    brute, brute_from = math.inf, 0
    for i in range(1, n + 1):
        fresh = best[i - 1][0] + (LINK if i > 1 else 0.0) + per
        if fresh < brute + per:
            brute, brute_from = fresh, i - 1
        else:
            brute += per
        now = (brute, brute_from, "brute")
        for a, kind, cost in into[i]:
            total = best[a][0] + (LINK if a else 0.0) + cost
            if total < now[0]:
                now = (total, a, kind)
        best.append(now)
    out, i = [], n
    while i:
        _, a, kind = best[i]
        out.append(f"{kind}:{value[a:i]}")
        i = a
    return best[n][0], out[::-1]


@functools.cache
def _patterns() -> tuple[re.Pattern, ...]:
    return tuple(map(re.compile, (HEAD, QUOTED, BARE, r"\s|\Z")))


@functools.lru_cache(maxsize=20_000)
def judged(value: str, path: str | None = None) -> tuple[float, tuple[str, ...]]:
    cost, cut = guess_cost(value, path)
    return round(cost, 9), tuple(cut)


_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def _name_start(text: str, at: int) -> int:
    """Where the name begins whose last word begins here, -1 if this is inside a word: access_token, dbPassword, AWSSecretKey."""
    if at and text[at - 1] in _NAME:
        before, first, next_ = text[at - 1], text[at], text[at + 1]
        if not (first.isupper() and (not before.isupper() or next_.islower())):
            return -1
    while at and (text[at - 1] in _NAME or text[at - 1] in "_-" and at > 1 and text[at - 2] in _NAME):
        at -= 1
    return at


def findings(text: str | None, path: str | None = None) -> list[tuple[int, int, str, str, float, tuple[str, ...]]]:
    """(start, end, keyword, value, cost, spans) of each credential-context value."""
    text, out, end, blank = text or "", [], 0, 0
    head, quoted_, bare, space = _patterns()
    heads = [(start, m) for m in head.finditer(text) if (start := _name_start(text, m.start())) >= 0]
    for k, (start, m) in enumerate(heads):
        if start < end:
            continue
        quoted = None
        if m["scheme"]:
            if start < m.start():
                continue
            a, b = m.span("credential")
        elif quoted := quoted_.match(text, m.end()):
            a, b = quoted.span("quoted")
        elif v := bare.match(text, m.end()):
            a = v.end()
            if blank <= a:  # where this run of other characters ends is looked for once, however many names it holds
                blank = space.search(text, a).start()
            b, then = blank, k + 1
            while then < len(heads) and heads[then][0] < b:
                mark = heads[then][0] - 1 - (text[heads[then][0] - 1] in "\"'")
                if mark > a and text[mark] in ",;":
                    b = mark
                then += 1
        else:
            continue
        value = text[a:b] if quoted else text[a:b].rstrip(_LAST)
        if len(value) >= LEAST:
            end = a + len(value)
            out.append((a, end, text[start : m.end("key")].lower() if m["key"] else m["scheme"].lower(), value, *judged(value, path)))
    return out


def redacted(text: str | None, path: str | None = None) -> str | None:
    at, parts = 0, []
    for a, b, _, _, cost, _ in findings(text, path):
        if cost >= SECRET:
            parts += [text[at:a], MARK]
            at = b
    return "".join([*parts, text[at:]]) if parts else text


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each credential-context value of each text, position in characters."""
    name = vocabulary_file(docs.sparkSession, path)

    def make():
        words = SparkFiles.get(name)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = [(i, p, k, v, c, list(s), c >= SECRET) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p, _, k, v, c, s in findings(t, words)]
            if rows:
                columns = [*zip(*rows, strict=True)]
                types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "position", "keyword", "value", "guesses_log10", "segments", "is_secret"])

        return step

    return in_arrow(docs.select("doc_id", "text").filter(F.col("text").rlike(NEAR)), make, SCHEMA)


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with each secret masked and n_chars, where there is one, following the text; nothing is dropped.

    Python sees only the texts that may hold a credential context; of the others it gets nulls."""
    ship(docs.sparkSession)
    name = vocabulary_file(docs.sparkSession, path)
    mask = F.pandas_udf(lambda texts: texts.map(lambda t: redacted(t, SparkFiles.get(name))), "string")
    masked = wrapped(docs, s_text=mask(F.when(F.col("text").rlike(NEAR), F.col("text"))))
    own = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    own["text"] = F.coalesce("s_text", own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("s_text").isNull(), own["n_chars"]).otherwise(F.length("s_text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*[c.alias(k) for k, c in own.items()])
