"""Ordered rule tables as array literals, and the lookups that selection and classification share.

A rule list comes from configuration and is folded into the plan once, so a rule check is part of a
scan and never a join: a short list in its generated code, a long one by an automaton (``automaton``). Order matters: the first rule that fits wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automaton


def keywords(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def hits(text: Column, words: Sequence[str]) -> Column:
    """All words contained in ``text`` (lower case), in rule order."""
    if len(words) > automaton.FROM:
        words = list(words)
        return automaton.found(text, words, lambda places: [words[k] for k in places], "array<string>", [])
    return F.filter(keywords(words), lambda k: F.contains(text, F.lower(k)))


def first_hit(text: Column, words: Sequence[str]) -> Column:
    """The first word contained in ``text``; null if there is none."""
    return F.get(hits(text, words), F.lit(0))


def any_hit(text: Column, words: Sequence[str]) -> Column:
    if len(words) > automaton.FROM:
        return automaton.found(text, words, bool, "boolean")
    return F.exists(keywords(words), lambda k: F.contains(text, F.lower(k)))


def first_mapped(text: Column, mapping: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """The target of the first mapping whose key is contained in ``text``, else ``default``."""
    out = F.lit(None).cast("string") if default is None else default
    if len(mapping) > automaton.FROM:
        targets = [target for _, target in mapping]
        return F.coalesce(automaton.found(text, [key for key, _ in mapping], lambda places: targets[places[0]] if places else None, "string"), out)
    for key, target in reversed(mapping):
        out = F.when(F.contains(text, F.lit(key.lower())), F.lit(target)).otherwise(out)
    return out


@dataclass(frozen=True)
class SelectionRules:
    """Which events are accepted. Empty lists switch their check off."""

    include_types: Sequence[str] = ()
    exclude_types: Sequence[str] = ()
    positive: Sequence[str] = ()
    negative: Sequence[str] = ()
    exclude_locations: Sequence[str] = ()
    local_keywords: Sequence[str] = ()
    category_mapping: Sequence[tuple[str, str]] = ()
    default_category: str = "communaute"
    required: Sequence[str] = ("name", "date")
    min_days_ahead: int = 0
    max_days_ahead: int = 90
    exclude_past: bool = True


def selection_rules(rows: DataFrame, **limits: object) -> SelectionRules:
    """Rules from a configuration table (rule_set, ord, key, target), which is small by its nature."""
    found = sorted(rows.collect(), key=lambda r: r["ord"])
    pick = lambda name: tuple(r["key"] for r in found if r["rule_set"] == name)
    mapping = tuple((r["key"], r["target"]) for r in found if r["rule_set"] == "category_mapping")
    return SelectionRules(
        include_types=pick("include_type"), exclude_types=pick("exclude_type"), positive=pick("positive"), negative=pick("negative"),
        exclude_locations=pick("exclude_location"), local_keywords=pick("local_keyword"), category_mapping=mapping, **limits,
    )


@dataclass(frozen=True)
class ClassifierRules:
    """source: ordered (key, category); venue: ordered (key, category or None); words: category -> keywords."""

    source: Sequence[tuple[str, str]] = ()
    venue: Sequence[tuple[str, str | None]] = ()
    words: dict[str, Sequence[str]] = field(default_factory=dict)
    categories: Sequence[str] = ("danse", "musique", "theatre", "art", "communaute")
    default: str = "communaute"

    def extended(self, source: Sequence[tuple[str, str]] = (), venue: Sequence[tuple[str, str | None]] = (), words: dict[str, Sequence[str]] | None = None) -> ClassifierRules:
        """New rules with entries added or replaced; these ones stay as they are."""
        merged = {k: (*self.words.get(k, ()), *(words or {}).get(k, ())) for k in [*self.words, *(k for k in words or {} if k not in self.words)]}
        return ClassifierRules(tuple((dict(self.source) | dict(source)).items()), tuple((dict(self.venue) | dict(venue)).items()), merged, self.categories, self.default)
