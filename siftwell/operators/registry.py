"""Source authority: the first pattern of an ordered list that a URL matches decides."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TIER, DEFAULT_DAYS = 3, 90


@dataclass(frozen=True)
class Pattern:
    pattern: str
    name: str = ""
    tier: int = DEFAULT_TIER
    days: int = DEFAULT_DAYS
    regex: bool = False

    def __post_init__(self):
        if not 1 <= self.tier <= 5:
            raise ValueError("tier must be 1 to 5")


def glob(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "[" and (end := pattern.find("]", i + 1 if pattern[i : i + 1] in ("!", "]") else i)) > 0:
            inside = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]"
            i = end + 1
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.sub(r"([^A-Za-z0-9_])", r"\\\1", c)
    return f"^{out}$"


def domain(url: Column) -> Column:
    """The part between // and the path in lower case, with its port; '' without a scheme."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def matches(url: Column, p: Pattern) -> Column:
    return url.rlike(f"^(?:{p.pattern})") if p.regex else domain(url).rlike(glob(p.pattern.lower()))


def first_match(url: Column, patterns: list[Pattern], value, default) -> Column:
    return F.coalesce(reduce(lambda rest, p: F.when(matches(url, p), F.lit(value(p))).otherwise(rest), reversed(patterns), F.lit(default)), F.lit(default))


def authority(url: Column, patterns: list[Pattern]) -> Column:
    return first_match(url, patterns, lambda p: p.tier, DEFAULT_TIER)


def freshness_days(url: Column, patterns: list[Pattern]) -> Column:
    return first_match(url, patterns, lambda p: p.days, DEFAULT_DAYS)


def source_name(url: Column, patterns: list[Pattern]) -> Column:
    return first_match(url, patterns, lambda p: p.name, "")


def allowed(url: Column, blocked: list[str]) -> Column:
    return reduce(lambda ok, b: ok & ~domain(url).rlike(glob(b.lower())), blocked, F.lit(True))


def trusted(url: Column, patterns: list[Pattern], blocked: list[str]) -> Column:
    return allowed(url, blocked) & reduce(lambda hit, p: hit | matches(url, p), patterns, F.lit(False))
