"""Rules, facts, source registry and intent from dictionaries and YAML, and back. YAML needs a YAML library on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame

from . import registry as R
from .relevance import Intent
from .rules import Fact, Rule, apply_rules, check_facts


def read_yaml(path: str | Path) -> dict[str, Any]:
    """A missing file raises FileNotFoundError, broken YAML ValueError; an empty file is an empty dictionary."""
    import yaml

    try:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"{path} isn't YAML: {e}") from e


def write_yaml(data: dict[str, Any]) -> str:
    import yaml

    return yaml.safe_dump(data, sort_keys=False, allow_unicode=True)


@dataclass
class RuleSet:
    """Rules in order and facts by key; of facts with one key the last counts."""

    rules: list[Rule] = field(default_factory=list)
    facts: dict[str, Fact] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> RuleSet:
        out = cls([Rule.of({"name": "unnamed"} | d) for d in data.get("rules") or []])
        for d in data.get("known_facts") or []:
            out.add_fact(Fact(d.get("key", ""), d.get("value"), d.get("tolerance") or 0.0))
        return out

    @classmethod
    def from_yaml(cls, path: str | Path) -> RuleSet:
        return cls.from_dict(read_yaml(path))

    def add_rule(self, rule: Rule) -> None:
        self.rules.append(rule)

    def add_fact(self, fact: Fact) -> None:
        self.facts[fact.key] = fact

    def to_dict(self) -> dict[str, Any]:
        def one(r: Rule) -> dict[str, Any]:
            limits = {k: v for k, v in (("min", r.low), ("max", r.high)) if v is not None}
            return {"name": r.name, "type": r.kind, "severity": r.severity, "message": r.message, "pattern": r.pattern, "condition": limits or None, "field": r.field, "enabled": r.enabled, "forbid": r.forbid}

        return {"rules": [one(r) for r in self.rules], "known_facts": [{"key": f.key, "value": f.value, "tolerance": f.tolerance} for f in self.facts.values()]}

    def to_yaml(self) -> str:
        return write_yaml(self.to_dict())

    def chunks(self, df: DataFrame) -> DataFrame:
        return apply_rules(df, self.rules)

    def responses(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Facts first, then all rules as on a chunk without metadata; needs no metadata column and leaves none."""
        from pyspark.sql import functions as F

        judged = apply_rules(check_facts(df, [*self.facts.values()], text).withColumn("metadata", F.create_map().cast("map<string,string>")), self.rules).drop("metadata")
        return judged.withColumn("response_passed", (F.size("mismatches") == 0) & F.col("rules_passed"))


@dataclass
class Registry:
    """Source patterns in order, the first match deciding, and blocked domains."""

    sources: list[R.Pattern] = field(default_factory=list)
    blocked: list[str] = field(default_factory=list)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Registry:
        out = cls(blocked=list(data.get("blocked") or []))
        for d in data.get("sources") or []:
            name = d.get("domain", d.get("pattern", ""))
            out.sources.append(R.Pattern(name, d.get("name", name), d.get("authority", R.DEFAULT_TIER), d.get("freshness_days", R.DEFAULT_DAYS), d.get("is_regex", False)))
        return out

    @classmethod
    def from_yaml(cls, path: str | Path) -> Registry:
        return cls.from_dict(read_yaml(path))

    def to_dict(self) -> dict[str, Any]:
        return {"sources": [{"domain": p.pattern, "name": p.name, "authority": p.tier, "freshness_days": p.days, "is_regex": p.regex} for p in self.sources], "blocked": self.blocked}

    def to_yaml(self) -> str:
        return write_yaml(self.to_dict())

    def add_source(self, domain: str, name: str | None = None, authority: int = R.DEFAULT_TIER, freshness_days: int = R.DEFAULT_DAYS) -> None:
        self.sources.append(R.Pattern(domain, name or domain, authority, freshness_days))

    def block_domain(self, domain: str) -> None:
        if domain not in self.blocked:
            self.blocked.append(domain)

    def authority(self, url: Column) -> Column:
        return R.authority(url, self.sources)

    def freshness_days(self, url: Column) -> Column:
        return R.freshness_days(url, self.sources)

    def source_name(self, url: Column) -> Column:
        return R.source_name(url, self.sources)

    def allowed(self, url: Column) -> Column:
        return R.allowed(url, self.blocked)

    def trusted(self, url: Column) -> Column:
        return R.trusted(url, self.sources, self.blocked)


def intent_from_dict(data: dict[str, Any]) -> Intent:
    """The settings may stand under a key 'system'; a place may be a string or primary and secondary ones."""
    data = data.get("system", data)
    place, wanted = data.get("geographic_focus") or {}, data.get("quality_requirements") or {}
    first, others = (place, []) if isinstance(place, str) else (place.get("primary") or "", place.get("secondary") or [])
    lists = [list(data.get(k) or []) for k in ("target_users", "core_questions", "relevant_topics", "irrelevant_topics")]
    return Intent(data.get("name", "Unnamed System"), data.get("description", ""), *lists, first, list(others), wanted.get("min_relevance_score", 0.6), wanted.get("review_threshold", 0.4))


def intent_to_dict(i: Intent) -> dict[str, Any]:
    return {
        "system": {
            "name": i.name, "description": i.description, "target_users": i.users, "core_questions": i.questions, "relevant_topics": i.topics, "irrelevant_topics": i.irrelevant,
            "geographic_focus": {"primary": i.place, "secondary": i.places}, "quality_requirements": {"min_relevance_score": i.accept, "review_threshold": i.review},
        }
    }
