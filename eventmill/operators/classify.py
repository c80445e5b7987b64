"""Keyword classification of events with confidence and alternatives, as column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from . import rules as R

NAME_WEIGHT, TEXT_WEIGHT, VENUE_WEIGHT = 2.0, 1.0, 3.0
SOURCE_CONFIDENCE, DEFAULT_CONFIDENCE, MOST = 0.95, 0.3, 0.95
HIGH_SCORE, BOOST = 5.0, 0.1
CONFIDENT, UNCERTAIN = 0.7, 0.5


def _venue(location: Column, rules: R.ClassifierRules) -> tuple[Column, Column]:
    """The first venue key contained, and its category; a venue of many uses ends the search without one."""
    key = category = F.lit(None).cast("string")
    for k, c in reversed(rules.venue):
        hit = F.contains(location, F.lit(k))
        key, category = F.when(hit, F.lit(k)).otherwise(key), F.when(hit, F.lit(c).cast("string")).otherwise(category)
    return key, category


def classify_events(events: DataFrame, rules: R.ClassifierRules) -> DataFrame:
    """Adds category, confidence, reason, alternatives (the next three scores above 0, ``name:score``), is_confident and is_uncertain.

    ``events`` has name, description, location and source_category. A source category decides at
    once; else the venue counts 3, a keyword in the name 2, one only in the description 1. Equal
    scores keep the order of the categories.
    """
    even = lambda c: F.lower(clean_text(F.col(c)))
    named = events.withColumns({f"__{c}": even(c) for c in ("name", "description", "location", "source_category")})
    source = F.when(F.col("__source_category") != "", R.first_mapped(F.col("__source_category"), rules.source))
    hall, place = _venue(F.col("__location"), rules)

    def score(category: str) -> Column:
        words = R.keywords(rules.words.get(category, ()))
        in_name = F.size(F.filter(words, lambda k: F.contains(F.col("__name"), F.lower(k))))
        in_text = F.size(F.filter(words, lambda k: F.contains(F.col("__description"), F.lower(k)) & ~F.contains(F.col("__name"), F.lower(k))))
        at = F.when(F.col("__place") == category, VENUE_WEIGHT).otherwise(0.0)
        return at + NAME_WEIGHT * in_name + TEXT_WEIGHT * in_text

    scored = named.withColumns({"__source": source, "__place": place, "__hall": F.when(place.isNotNull(), hall)})
    scored = scored.withColumns({f"__s{i}": score(c) for i, c in enumerate(rules.categories)})
    rows = [F.struct((-F.col(f"__s{i}")).alias("minus"), F.lit(i).alias("ord"), F.lit(c).alias("category")) for i, c in enumerate(rules.categories)]
    total = reduce(lambda a, b: a + b, (F.col(f"__s{i}") for i in range(len(rules.categories))))
    ranked = scored.withColumns({"__ranked": F.array_sort(F.array(*rows)), "__total": total})
    best = -F.col("__ranked")[0]["minus"]
    sure = best / F.col("__total")
    confidence = F.least(F.when(best >= HIGH_SCORE, sure + BOOST).otherwise(sure), F.lit(MOST))
    none = F.col("__total") == 0
    others = F.transform(F.filter(F.slice("__ranked", 2, 3), lambda r: r["minus"] < 0), lambda r: F.concat(r["category"], F.lit(":"), (-r["minus"]).cast("int").cast("string")))
    decided = F.col("__source").isNotNull()
    chosen = F.col("__ranked")[0]["category"]
    words = (best - F.when(F.col("__hall").isNotNull(), VENUE_WEIGHT).otherwise(0.0)).cast("int")
    signals = F.array_compact(F.array(F.concat(F.lit("venue '"), "__hall", F.lit("'")), F.when(words > 0, F.concat(words.cast("string"), F.lit(" keyword(s)")))))
    matched = F.concat(F.lit("Matched "), F.array_join(signals, ", "), F.lit(" for '"), chosen, F.lit("'"))
    mapped = F.concat(F.lit("Source category mapped: '"), F.coalesce("source_category", F.lit("")), F.lit("' → "), "__source")
    added = ("category", "confidence", "reason", "alternatives", "is_confident", "is_uncertain")
    out = ranked.withColumns(
        {
            "category": F.when(decided, F.col("__source")).when(none, F.lit(rules.default)).otherwise(F.col("__ranked")[0]["category"]),
            "confidence": F.round(F.when(decided, SOURCE_CONFIDENCE).when(none, DEFAULT_CONFIDENCE).otherwise(confidence), 6),
            "reason": F.when(decided, mapped).when(none, "No category keywords matched, using default").otherwise(matched),
            "alternatives": F.when(decided | none, F.lit("")).otherwise(F.array_join(others, ",")),
        }
    )
    out = out.withColumns({"is_confident": F.col("confidence") >= CONFIDENT, "is_uncertain": F.col("confidence") < UNCERTAIN})
    return out.select(*[c for c in events.columns if c not in added], *added)
