"""Selection of events: ordered checks, of which the first that fails gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def event_text() -> Column:
    """Name, location, description and category in one lower-case text."""
    return F.lower(F.concat_ws(" ", *map(_text, ("name", "location", "description", "category"))))


def missing_fields(rules: R.SelectionRules) -> Column:
    tests = {"name": _text("name") == "", "date": F.col("start_ts").isNull(), "location": _text("location") == ""}
    return F.array_compact(F.array(*(F.when(tests[f], f) for f in ("name", "date", "location") if f in rules.required)))


def excluded_location(rules: R.SelectionRules) -> Column:
    """The first excluded place named, unless the event's own location is a local one (either contains the other)."""
    even = lambda c: F.translate(F.lower(c), "-_", "  ")
    place = even(_text("location"))
    local = (_text("location") != "") & F.exists(R.keywords(rules.local_keywords), lambda k: F.contains(place, even(k)) | F.contains(even(k), place))
    return F.when(~local, R.first_hit(event_text(), rules.exclude_locations))


def date_fault(rules: R.SelectionRules, as_of: Column) -> Column:
    """past_date, min_days or max_days; bounds are whole days from the day of ``as_of`` on the wall clock."""
    today = F.date_trunc("day", as_of).cast("timestamp_ntz")
    days = lambda n: today + F.make_dt_interval(F.lit(n))
    start = F.col("start_ts")
    past = F.when(start < today, "past_date") if rules.exclude_past else F.lit(None).cast("string")
    return F.coalesce(past, F.when(start < days(rules.min_days_ahead), "min_days").when(start > days(rules.max_days_ahead), "max_days"))


def included_type(rules: R.SelectionRules) -> Column:
    return R.any_hit(event_text(), rules.include_types) if rules.include_types else F.lit(True)


def select_events(events: DataFrame, rules: R.SelectionRules, as_of: Column) -> DataFrame:
    """Adds accepted, criterion and detail (the first failing rule, its keyword; or the positive words).

    ``events`` has name, location, description, category and start_ts; a row without a date skips
    the date check unless a date is required.
    """
    negative, kind, place, date = R.first_hit(event_text(), rules.negative), R.first_hit(event_text(), rules.exclude_types), excluded_location(rules), date_fault(rules, as_of)
    fault = lambda criterion, detail: F.struct(criterion.alias("criterion"), detail.alias("detail"))
    failed = (
        F.when(F.size(missing_fields(rules)) > 0, fault(F.lit("required_fields"), F.array_join(missing_fields(rules), ", ")))
        .when(negative.isNotNull(), fault(F.lit("negative_keyword"), negative))
        .when(kind.isNotNull(), fault(F.lit("excluded_type"), kind))
        .when(place.isNotNull(), fault(F.lit("excluded_location"), place))
        .when(date.isNotNull(), fault(date, F.lit("")))
        .when(~included_type(rules), fault(F.lit("no_included_type"), F.lit("")))
    )
    positive = F.array_join(R.hits(event_text(), rules.positive), ", ")
    judged = events.withColumn("__failed", failed)
    fine = F.when(positive != "", "positive_keywords").otherwise("all_criteria")
    return judged.withColumns(
        {"accepted": F.col("__failed").isNull(), "criterion": F.coalesce("__failed.criterion", fine), "detail": F.coalesce("__failed.detail", positive)}
    ).drop("__failed")


def map_category(raw: Column, rules: R.SelectionRules) -> Column:
    default = F.lit(rules.default_category)
    return F.when(F.coalesce(raw, F.lit("")) == "", default).otherwise(R.first_mapped(F.lower(raw), rules.category_mapping, default))


def map_category_schema_type(kind: Column, url: Column, by_type: list[tuple[str, str]], by_path: list[tuple[str, str]], configured: list[tuple[str, str]], default: str) -> Column:
    """Configured names exactly, else the schema type, else the first part of the URL's path, else the default."""
    exact = lambda c, pairs: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in pairs], F.lit(None).cast("string"))
    first = F.regexp_extract(url, r"^[^/]*//[^/?#]*/([^/?#]+)", 1)
    return F.coalesce(exact(kind, configured), exact(kind, by_type), exact(first, by_path), exact(first, configured), F.lit(default))


def map_category_ids(ids: Column, known: list[tuple[int, str]]) -> Column:
    """The category of the first id that is known."""
    table = F.create_map(*[x for k, v in known for x in (F.lit(k), F.lit(v))])
    return F.get(F.filter(F.transform(ids, lambda i: F.try_element_at(table, i)), lambda c: c.isNotNull()), F.lit(0))


def map_category_tags(tags: Column, configured: list[tuple[str, str]], groups: list[tuple[str, list[str]]]) -> Column:
    """The first tag with a configured category, else the first tag that holds a word of an ordered group."""

    def one(tag: Column) -> Column:
        low = F.lower(tag)
        exact = F.coalesce(*[F.when(low == k.lower(), F.lit(v)) for k, v in configured], F.lit(None).cast("string"))
        return F.coalesce(exact, *[F.when(R.any_hit(low, words), F.lit(name)) for name, words in groups])

    return F.get(F.filter(F.transform(tags, one), lambda c: c.isNotNull()), F.lit(0))


def category_from_text(text: Column, ordered: list[tuple[str, str]], default: str) -> Column:
    """The category of the first word found, letter case counting."""
    out = F.lit(default)
    for word, category in reversed(ordered):
        out = F.when(F.contains(text, F.lit(word)), F.lit(category)).otherwise(out)
    return out


def category_ignoring_default(candidates: Column, rules: R.SelectionRules, default: str) -> Column:
    """The first candidate's category that isn't the general default."""
    mapped = F.transform(candidates, lambda c: map_category(c, rules))
    return F.coalesce(F.get(F.filter(mapped, lambda c: c != rules.default_category), F.lit(0)), F.lit(default))


def is_in_area_url(url: Column, city: Column, cities: list[str]) -> Column:
    """The second path part is a listed city, or the city's text names one, or the URL has fewer than three parts."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[^/]*//[^/?#]*/?([^?#]*)", 1), "/"), lambda p: p != "")
    return (F.size(parts) < 3) | F.coalesce(F.get(parts, F.lit(1)).isin(*cities), F.lit(False)) | R.any_hit(F.lower(F.coalesce(city, F.lit(""))), cities)


def is_in_area_text(text: Column, url: Column, city: Column, cities: list[str], venues: list[str]) -> Column:
    """A listed city, or a venue keyword in the text, or in the URL without its hyphens and spaces."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.translate(F.lower(F.coalesce(url, F.lit(""))), "- ", "")
    return F.lower(F.coalesce(city, F.lit(""))).isin(*cities) | R.any_hit(low, venues) | F.exists(R.keywords(venues), lambda k: F.contains(bare, F.translate(F.lower(k), "- ", ""))) | R.any_hit(low, cities[:1])


def extract_city(text: Column, cities: list[str]) -> Column:
    """The first listed city in the text, capitalised."""
    return F.initcap(R.first_hit(F.lower(text), cities))


def without_markers(df: DataFrame, col: str, markers: list[str], any_case: bool = True) -> DataFrame:
    """Rows whose text holds none of the markers: sold out, cancelled, book notices, challenge pages."""
    text = F.coalesce(F.col(col), F.lit(""))
    text = F.lower(text) if any_case else text
    return df.where(~F.exists(R.keywords(markers), lambda k: F.contains(text, F.lower(k) if any_case else k)))


def drop_external_venues(df: DataFrame, col: str, outside: list[str], own: list[str]) -> DataFrame:
    """Rows at an outside place, unless one of our own venues is named with it."""
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    return df.where(~R.any_hit(low, outside) | R.any_hit(low, own))


def future_only(events: DataFrame, as_of: Column, strictly: bool = False) -> DataFrame:
    start = F.col("start_ts")
    return events.where(start > as_of if strictly else start >= as_of)


def roll_ongoing_to_today(events: DataFrame, as_of: Column, hour: int = 10) -> DataFrame:
    """What has begun and not ended is set to today; what has ended goes."""
    today = F.date_trunc("day", as_of).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))
    begun = F.col("start_ts") < as_of
    return events.where(~begun | (F.col("end_ts") > as_of)).withColumn("start_ts", F.when(begun, today).otherwise(F.col("start_ts")))
