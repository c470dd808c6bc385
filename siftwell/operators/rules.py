"""Declarative domain rules and known facts, compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = "\\$?[0-9,]+(?:\\.[0-9]+)?"


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str = "regex"  # regex, numerical or required
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    field: str | None = None
    severity: str = "warning"
    message: str = ""
    enabled: bool = True
    forbid: bool = False  # an option: a found pattern is a violation

    @staticmethod
    def of(d: dict) -> Rule:
        limits = d.get("condition") if isinstance(d.get("condition"), dict) else {}
        return Rule(d["name"], {"numeric": "numerical", "required_field": "required"}.get(d.get("type", "regex"), d.get("type", "regex")), d.get("pattern") or (d.get("condition") if isinstance(d.get("condition"), str) else None), limits.get("min"), limits.get("max"), d.get("field"), d.get("severity", "warning"), d.get("message", ""), d.get("enabled", True), d.get("forbid", False))

    @property
    def code(self) -> str:
        return f"RULE_{self.name.upper()}"

    def value(self, text: Column, metadata: Column) -> Column:
        first = F.regexp_replace(F.regexp_extract(text, _NUMBER, 0), "[$,]", "").try_cast("double")
        return first if not self.field else F.when(F.map_contains_key(metadata, F.lit(self.field)), metadata[self.field].try_cast("double")).otherwise(first)

    def broken(self, text: Column, metadata: Column) -> Column:
        """Whether the rule is violated; unknown kinds never are."""
        if not self.enabled:
            return F.lit(False)
        if self.kind == "regex" and self.pattern and (self.field == "required" or self.forbid):
            hit = text.rlike(f"(?i){self.pattern}")
            return hit if self.forbid else ~hit
        if self.kind == "numerical":
            v, never = self.value(text, metadata), F.lit(False)
            under = v < self.low if self.low is not None else never
            return F.coalesce(under, never) | F.coalesce(v > self.high if self.high is not None else never, never)
        if self.kind == "required" and self.field:
            return ~F.map_contains_key(metadata, F.lit(self.field))
        return F.lit(False)


@dataclass(frozen=True)
class Fact:
    key: str
    value: float | str
    tolerance: float = 0.0


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with violations (code, severity), rules_passed and rules_score; a null text is an empty one."""
    text, metadata = F.coalesce("text", F.lit("")), F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    each = [F.when(r.broken(text, metadata), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules]
    found = F.filter(F.array(*each), lambda x: x.isNotNull()) if rules else F.array().cast("array<struct<code:string,severity:string>>")
    return df.withColumn("violations", found).withColumns({"rules_passed": ~F.exists("violations", lambda x: x["severity"] == "error"), "rules_score": F.greatest(F.lit(0.0), 1 - F.size("violations") * 0.1)})


def extracted(text: Column, key: str) -> Column:
    """The number that follows a key (a regex) as 'key: 5', 'key = 5', 'key is 5' or 'key costs 5'; null without one."""
    number = "\\$?([0-9,]+(?:\\.[0-9]+)?)"
    a, b = (F.regexp_extract(text, f"(?i){key}{x}{number}", 1) for x in ("\\s*[:=]\\s*", "\\s+(?:is|costs?|=)\\s+"))
    return F.regexp_replace(F.when(a != "", a).when(b != "", b), ",", "")


def check_facts(df: DataFrame, facts: list[Fact], text: str = "text") -> DataFrame:
    """The rows with facts_checked and mismatches (keys); of facts with one key the last counts."""
    told = {f.key: f for f in facts}
    values = {k: extracted(F.coalesce(text, F.lit("")), k) for k in told}

    def differs(f: Fact, v: Column) -> Column:
        number = v.try_cast("double")
        if isinstance(f.value, int | float):
            return F.when(number.isNull(), F.lit(True)).otherwise(F.abs(number - float(f.value)) > f.tolerance)
        return F.lower(v) != f.value.lower()

    checked = F.size(F.filter(F.array(*values.values()), lambda x: x.isNotNull()))
    wrong = F.filter(F.array(*[F.when(v.isNotNull() & differs(told[k], v), F.lit(k)) for k, v in values.items()]), lambda x: x.isNotNull())
    return df.withColumns({"facts_checked": checked, "mismatches": wrong}) if told else df.withColumns({"facts_checked": F.lit(0), "mismatches": F.array().cast("array<string>")})
