"""Scalar text-quality functions as Spark columns; all but entropy() and measures() stay in the JVM.

Words are runs of letters, digits and underscores that are a-z alone in lower case, so that no engine's notion of a word
boundary matters. White space is Unicode white space. A null text gives null."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import points

STOP_WORDS = (
    "a all also an and are as at be been both but by can could did do does each every few for from had has have he here how "
    "i in is it its just may might more most must need no nor not now of on only or other own same shall she should so some "
    "such than that the there these they this those to too very was we were what when where which who why will with would "
    "you"
).split()
VOWELLESS, GOOD_LENGTHS = 3, (2, 20)
#: A run of word characters that are all a-z or A-Z.
_LATIN = "(?<![\\p{L}\\p{N}_])[A-Za-z]++(?![\\p{L}\\p{N}_])"


def stripped(text: Column) -> Column:
    """Without white space at both ends; a run within is passed once."""
    return F.regexp_replace(text, "(?U)^\\s++|(?<!\\s)\\s++$", "")


def blank(text: Column) -> Column:
    return ~text.rlike("(?U)\\S")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _entropies(texts: pd.Series) -> pd.Series:
    """Of many texts at once: characters are counted by one sort of (row, character) pairs a slice."""
    low = [(t or "").lower() for t in texts]
    out, at = np.zeros(len(low)), 0
    while at < len(low):
        end, size = at + 1, len(low[at])
        while end < len(low) and size + len(low[end]) <= 600_000:
            size += len(low[end])
            end += 1
        lengths = np.array([len(t) for t in low[at:end]], np.int64)
        points = np.frombuffer("".join(low[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair, n = np.unique(np.repeat(np.arange(end - at), lengths) << 21 | points, return_counts=True)
        share = n / lengths[pair >> 21]
        out[at:end] = np.bincount(pair >> 21, -share * np.log2(share), end - at)
        at = end
    return pd.Series(out)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the lower-case characters; 0 for a null text.

    By Arrow batches: in the JVM it would take a row or a pass over the text for each character."""
    return F.pandas_udf(_entropies, "double")(text)


def special_ratio(text: Column) -> Column:
    return ratio(F.length(F.regexp_replace(text, "(?U)[\\p{L}\\p{N}\\s]+", "")), F.length(text))


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_LATIN), F.lit(0))


def word_ratio(text: Column, words: Column | None = None) -> Column:
    """Share of words of a usual length that hold a vowel (short ones needn't). words: latin_words(text), where they are known."""
    good = lambda w: F.length(w).between(*GOOD_LENGTHS) & (w.rlike("[aeiouAEIOU]") | (F.length(w) <= VOWELLESS))
    words = latin_words(text) if words is None else words
    return ratio(F.size(F.filter(words, good)), F.size(words))


def consonant_runs(text: Column) -> Column:
    held = F.length(text) - F.length(F.regexp_replace(F.lower(text), "[bcdfghjklmnpqrstvwxyz]{5,}", ""))
    return F.least(F.lit(1.0), ratio(held * 10, F.length(text)))


def gibberish(text: Column, special: Column | None = None, good: Column | None = None) -> Column:
    """Confidence in 0..1 that the text is gibberish; texts under 10 characters never are. special, good: the ratios, where they are known."""
    special = special_ratio(text) if special is None else special
    good = word_ratio(text) if good is None else good
    total = (
        F.when(entropy(text) > 4.5, 0.2).otherwise(0.0)
        + F.when(special > 0.3, special / 0.5 * 0.3).otherwise(0.0)
        + F.when(good < 0.5, (1 - good) * 0.3).otherwise(0.0)
        + consonant_runs(text) * 0.2
    )
    return F.when(F.length(text) < 10, 0.0).otherwise(F.least(F.lit(1.0), total))


def _measures(texts: list[str]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(points.measures(texts, tuple(STOP_WORDS), GOOD_LENGTHS, VOWELLESS), (pa.int32(), pa.bool_(), pa.bool_(), pa.float64(), pa.float64()), strict=True)], ["len", "low", "open", "gib", "den"])


def measures(text: Column) -> Column:
    """Of a text in one pass: len (without white space at the ends), low (begins with a small letter), open (lacks an end mark), gib (gibberish()), den (density())."""
    return points.by_slices(_measures, "struct<len:int,low:boolean,open:boolean,gib:double,den:double>")(text)


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[.!?]+"), lambda s: s.rlike("(?U)\\S")))


def ocr_confidence(text: Column) -> Column:
    pieces = F.split(text, "[.!?]+")
    proper = F.size(F.filter(F.transform(pieces, stripped), lambda s: s.rlike("^\\p{Lu}")))
    value = (1 - special_ratio(text) * 0.5) * (0.5 + ratio(proper, F.size(pieces)) * 0.5) * (0.5 + word_ratio(text) * 0.5)
    return F.when(text == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def density(text: Column, words: Column | None = None) -> Column:
    """words: latin_words(lower(text)), where they are known."""
    words = latin_words(F.lower(text)) if words is None else words
    n = F.size(words)
    letters = F.length(F.array_join(words, ""))
    score = (
        F.least(F.lit(1.0), ratio(F.size(F.array_distinct(words)), n) / 0.5) * 0.3
        + (1 - ratio(F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))), n)) * 0.3
        + F.least(F.lit(1.0), ratio(letters, n) / 6) * 0.2
        + F.when(sentence_count(text) > 0, 0.2).otherwise(0.0)
    )
    return F.when(n == 0, 0.0).otherwise(score)


def coherence(text: Column) -> Column:
    s = stripped(text)
    first = F.lower(F.regexp_extract(s, "(?U)^\\S+", 0))
    score = (
        F.when(s.rlike("^[\\p{Lu}\\p{N}]"), 1.0).otherwise(0.85)
        * F.when(s.rlike("[.!?;:\"']$"), 1.0).otherwise(0.9)
        * F.when(F.exists(F.split(s, "[.!?]+"), lambda p: F.length(stripped(p)) > 10), 1.0).otherwise(0.7)
        * F.when(first.isin("it", "this", "that"), 0.85).otherwise(1.0)
    )
    return F.when(blank(text), 0.0).otherwise(score)


def corrupt_ratio(text: Column) -> Column:
    return ratio(F.length(F.regexp_replace(text, "[^\\x{FFFD}\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}]+", "")), F.length(text))


BOILERPLATE = ("all rights reserved", "cookie", "copyright", "follow us", "newsletter", "privacy policy", "share this", "subscribe", "terms of service")


def boilerplate_ratio(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.lower(stripped(x)))
    phrases = "|".join(BOILERPLATE)
    return ratio(F.size(F.filter(lines, lambda x: (F.length(x) < 20) | x.rlike(phrases))), F.size(lines))


def short_line_ratio(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), stripped)
    return ratio(F.size(F.filter(lines, lambda x: F.length(x) < 20)), F.size(lines))


#: A few of each language's commonest words, for a vote.
COMMON = {"en": "the of and to in is that was for it", "de": "der die und das ist nicht ein zu den mit", "fr": "le la les et des est une dans que pour", "es": "el los las y en una que por con para"}


def language(text: Column) -> Column:
    """The language whose common words are most of the text's (ties: first by code); null under 50 characters or without any."""
    words = F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+"), F.lit(0))
    held = lambda k: F.size(F.filter(words, lambda w: w.isin(COMMON[k].split())))
    votes = F.array(*[F.struct((-held(k)).alias("n"), F.lit(k).alias("lang")) for k in sorted(COMMON)])
    best = F.array_min(votes)
    return F.when((F.length(text) >= 50) & (best["n"] < 0), best["lang"])
