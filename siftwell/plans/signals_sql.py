"""DuckDB fragments that state the text functions a second time, for the comparisons."""

from __future__ import annotations

# stated apart from the functions', so that a wrong one shows
STOP_WORDS = (
    "you would why with will who which where when what were we was very too to those this they these there the that than such so some "
    "should she shall same own other or only on of now not nor no need must most more might may just its it is in i how here he have has had "
    "from for few every each does do did could can by but both been be at as are and an also all a"
).split()
BOILERPLATE = ["copyright", "all rights reserved", "terms of service", "privacy policy", "cookie", "subscribe", "newsletter", "follow us", "share this"]
COMMON = {"de": "mit den zu ein nicht ist das und die der", "en": "it for was that is in to and of the", "es": "que para con por una en y las los el", "fr": "pour que dans une est des et les la le"}

STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\x{{85}}\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\v]+|[\\s\\x{{85}}\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\v]+$', '', 'g')"
RUNS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+')"
LATIN = "list_filter(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]+'))"
SPECIAL = "(length(regexp_replace({0}, '[\\p{{L}}\\p{{N}}\\s\\x{{85}}\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\v]+', '', 'g')) / greatest(length({0}), 1))"
CONSONANTS = "least(1.0, 10 * (length({0}) - length(regexp_replace(lower({0}), '[bcdfghjklmnpqrstvwxyz]{{5,}}', '', 'g'))) / greatest(length({0}), 1))"


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def signals(table: str = "documents", text: str = "text", keys: str = "doc_id") -> str:
    """(keys, s, ent, special, good, cons, gib, den, sentences, coh, ocr, bad, boiler, short_lines, runs)"""
    t = text
    good = f"list_filter({LATIN.format(t)}, lambda w: length(w) BETWEEN 2 AND 20 AND (regexp_matches(w, '[aeiouAEIOU]') OR length(w) <= 3))"
    lines = f"list_transform(string_split({t}, chr(10)), lambda x: {STRIP('x')})"
    return f"""SELECT *, CASE WHEN length(t) < 10 THEN 0 ELSE least(1.0, CASE WHEN ent > 4.5 THEN 0.2 ELSE 0 END + CASE WHEN special > 0.3 THEN 0.3 * special / 0.5 ELSE 0 END
    + CASE WHEN good < 0.5 THEN 0.3 * (1 - good) ELSE 0 END + 0.2 * cons) END AS gib,
  CASE WHEN len(lw) = 0 THEN 0 ELSE least(1.0, len(list_distinct(lw)) / len(lw) / 0.5) * 0.3 + (1 - len(list_filter(lw, lambda w: list_contains({_sql_list(STOP_WORDS)}, w))) / len(lw)) * 0.3
    + least(1.0, list_sum(list_transform(lw, lambda w: length(w))) / len(lw) / 6) * 0.2 + CASE WHEN sentences > 0 THEN 0.2 ELSE 0 END END AS den,
  CASE WHEN s = '' THEN 0 ELSE (CASE WHEN regexp_matches(s, '^[\\p{{Lu}}\\p{{N}}]') THEN 1 ELSE 0.85 END) * (CASE WHEN right(s, 1) IN ('.', '!', '?', ';', ':', '"', '''') THEN 1 ELSE 0.9 END)
    * (CASE WHEN len(list_filter(pieces, lambda p: length({STRIP('p')}) > 10)) > 0 THEN 1 ELSE 0.7 END) * (CASE WHEN lower(regexp_extract(s, '^[^\\s\\p{{Z}}]+')) IN ('it', 'this', 'that') THEN 0.85 ELSE 1 END) END AS coh,
  CASE WHEN t = '' THEN 0 ELSE greatest(0, least(1, (1 - 0.5 * special) * (0.5 + 0.5 * len(list_filter(pieces, lambda p: regexp_matches({STRIP('p')}, '^\\p{{Lu}}'))) / len(pieces)) * (0.5 + 0.5 * good))) END AS ocr
FROM (SELECT {keys}, {t} AS t, {STRIP(t)} AS s, coalesce(list_aggregate(string_split(lower({t}), ''), 'entropy'), 0) AS ent, {SPECIAL.format(t)} AS special,
  coalesce(len({good}) / nullif(len({LATIN.format(t)}), 0), 0) AS good, {CONSONANTS.format(t)} AS cons, {LATIN.format(f'lower({t})')} AS lw,
  string_split_regex({t}, '[.!?]+') AS pieces, len(list_filter(string_split_regex({t}, '[.!?]+'), lambda p: {STRIP('p')} <> '')) AS sentences,
  length(regexp_replace({t}, '[^\\x{{FFFD}}\\x{{0}}-\\x{{8}}\\x{{B}}\\x{{C}}\\x{{E}}-\\x{{1F}}]+', '', 'g')) / greatest(length({t}), 1) AS bad,
  len(list_filter({lines}, lambda x: length(x) < 20 OR regexp_matches(lower(x), '{'|'.join(BOILERPLATE)}'))) / len({lines}) AS boiler,
  len(list_filter({lines}, lambda x: length(x) < 20)) / len({lines}) AS short_lines,
  len(regexp_extract_all(lower({t}), '[bcdfghjklmnpqrstvwxyz]{{5,}}')) AS runs FROM {table})"""


def chunk_scores(extra: str = "", dup: str = "1.0", join: str = "") -> str:
    """(doc_id, extraction, coherence, density, duplicate, score, passed, codes) over a table sig, see signals()."""
    low = "regexp_matches(s, '^\\p{Ll}')"
    end = "(s <> '' AND right(s, 1) NOT IN ('.', '!', '?', ';', ':', '\"', ''''))"
    codes = [
        ("s = ''", "EMPTY_CONTENT"), ("s <> '' AND length(s) < 50", "CONTENT_TOO_SHORT"), ("length(s) > 10000", "CONTENT_TOO_LONG"), ("gib >= 0.5", "GIBBERISH_DETECTED"),
        ("s <> '' AND den < 0.3", "LOW_DENSITY"), ("dup < 1", "NEAR_DUPLICATE"), (low, "BAD_START_BOUNDARY"), (end, "BAD_END_BOUNDARY"),
    ]
    listed = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in codes)
    return f"""SELECT *, (extraction + coherence + density + duplicate) * 0.25 AS score, (extraction + coherence + density + duplicate) * 0.25 >= 0.6 AND NOT (s = '' OR gib > 0.8) AS passed,
  s = '' OR (length(s) < 50 OR length(s) > 10000 OR gib >= 0.5 AND gib <= 0.8 OR den < 0.3 OR dup < 1) AS warned
FROM (SELECT *, (CASE WHEN s = '' THEN 0 WHEN length(s) < 50 THEN 0.7 ELSE 1 END) * (CASE WHEN gib >= 0.5 THEN 1 - gib ELSE 1 END) AS extraction,
  (CASE WHEN {low} THEN 0.9 ELSE 1 END) * (CASE WHEN {end} THEN 0.9 ELSE 1 END) AS coherence, den AS density, dup AS duplicate, coalesce(array_to_string([{listed}], ','), '') AS codes
FROM (SELECT *, {dup} AS dup FROM sig {join}))"""


def extraction_scores() -> str:
    """(doc_id, ocr_c, boilerplate, extraction_score, acceptable, codes) over a table sig."""
    errors, warnings = "(CAST(s = '' AS INT) + CAST(bad > 0.2 AS INT))", "(CAST(s <> '' AND length(s) < 50 AS INT) + CAST(bad > 0.05 AND bad <= 0.2 AS INT) + CAST(special > 0.3 AS INT) + CAST(runs > length(t) / 100 AS INT) + CAST(boiler > 0.5 AND t <> '' AS INT))"
    listed = [("s = ''", "EMPTY_CONTENT"), ("s <> '' AND length(s) < 50", "CONTENT_TOO_SHORT"), ("bad > 0.05", "ENCODING_CORRUPTION"), ("special > 0.3", "HIGH_SPECIAL_CHAR_RATIO"), ("runs > length(t) / 100", "POSSIBLE_GIBBERISH"), ("boiler > 0.5 AND t <> ''", "HIGH_BOILERPLATE")]
    codes = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in listed)
    return f"""SELECT *, CASE WHEN t = '' THEN 0 ELSE boiler END AS boilerplate, {errors} = 0 AS acceptable, coalesce(array_to_string([{codes}], ','), '') AS codes,
  greatest(0, least(1, pow(0.3, {errors}) * pow(0.8, {warnings}) * (CASE WHEN special > 0.3 THEN 0.5 + 0.5 * greatest(0, 1 - 2 * special) ELSE 1 END) * (1 - 0.5 * CASE WHEN t = '' THEN 0 ELSE boiler END))) AS extraction_score FROM sig"""


def language_vote() -> str:
    n = lambda k: f"len(list_filter(w, lambda x: list_contains({_sql_list(COMMON[k].split())}, x)))"
    ks = sorted(COMMON)
    best = f"greatest({', '.join(n(k) for k in ks)})"
    return f"SELECT doc_id, CASE WHEN length(text) >= 50 AND {best} > 0 THEN CASE {' '.join(f'WHEN {n(k)} = {best} THEN {chr(39)}{k}{chr(39)}' for k in ks)} END END AS language FROM (SELECT *, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents)"
