"""Calendar views: multi-day events, weeks, days, taxonomies, pages, search and related events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T


def number_multi_day(events: DataFrame, dates: DataFrame) -> DataFrame:
    """One event for each listed day, at the base event's time: day_of, group id and source id say which.

    ``dates`` has event_id, ord (place in the list) and day. The group is named by the first listed day.
    """
    group = Window.partitionBy("event_id")
    listed = dates.withColumns({"nth": F.row_number().over(group.orderBy("day", "ord")), "of": F.count("*").over(group), "listed": F.first("day").over(group.orderBy("ord"))})
    rows = events.drop("day_of", "event_group_id").join(listed, "event_id")
    time = F.hour("start_ts") * 60 + F.minute("start_ts")
    return rows.withColumns(
        {
            "event_group_id": F.concat(T.slugify(F.col("name")), F.lit("-"), F.date_format("listed", "yyyyMM")),
            "day_of": F.format_string("Jour %d sur %d", "nth", "of"),
            "source_id": F.concat("source_id", F.lit(":day"), F.col("nth").cast("string")),
            "start_ts": F.date_trunc("day", F.col("day")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), time),
        }
    ).drop("ord", "day", "nth", "of", "listed")


def multi_day_groups(events: DataFrame) -> DataFrame:
    """(event_group_id, n, first_day, last_day) of the groups there are."""
    day = F.date_format("start_ts", "yyyy-MM-dd")
    return events.where("event_group_id is not null").groupBy("event_group_id").agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def active_events(events: DataFrame) -> DataFrame:
    return events.where("coalesce(expired, false) = false and coalesce(draft, false) = false")


def hide_after_expiry(events: DataFrame, as_of: Column) -> DataFrame:
    return events.where(~F.coalesce("draft", F.lit(False)) & (D.expiry_ts(F.col("start_ts")) > as_of))


def week_view(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(day, label, n) of today and the days after it, empty days too."""
    today = F.to_date(as_of)
    week = events.sparkSession.range(1).select(F.explode(F.sequence(today, F.date_add(today, days - 1))).alias("day"), today.alias("today"))
    counts = events.where(F.to_date("start_ts").between(today, F.date_add(today, days - 1))).groupBy(F.to_date("start_ts").alias("day")).agg(F.count("*").alias("n"))
    out = week.join(counts, "day", "left")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), D.day_label(F.col("day"), F.col("today")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def day_view(events: DataFrame, day: Column) -> DataFrame:
    """The events of one day by start time; events without a time come first."""
    at = F.coalesce(D.start_time(F.col("start_ts")), F.lit("00:00"))
    return events.where(F.to_date("start_ts") == day).withColumn("at", at).orderBy("at", "event_id")


def events_per_day(events: DataFrame) -> DataFrame:
    """(day, n, label) with the label in words for none, one and several."""
    counts = events.groupBy(F.date_format("start_ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    label = F.when(F.col("n") == 0, "Aucun événement").when(F.col("n") == 1, "1 événement").otherwise(F.concat(F.col("n").cast("string"), F.lit(" événements")))
    return counts.withColumn("label", label)


def events_grouped_by_year(events: DataFrame) -> DataFrame:
    return events.groupBy(F.year("start_ts").alias("year")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def taxonomy_term_counts(items: DataFrame, taxonomies: dict[str, str]) -> DataFrame:
    """(taxonomy, term, n) over array columns: one pass, all taxonomies together."""

    def named(taxonomy: str, column: str) -> Column:
        terms = F.array_distinct(F.coalesce(column, F.array().cast("array<string>")))
        return F.transform(terms, lambda t: F.struct(F.lit(taxonomy).alias("taxonomy"), t.alias("term")))

    pairs = [named(k, c) for k, c in taxonomies.items()]
    return items.select(F.explode(F.concat(*pairs)).alias("x")).groupBy("x.taxonomy", "x.term").agg(F.count("*").alias("n"))


def paginate(df: DataFrame, key: str, order: list[str], size: int = 30) -> DataFrame:
    """``df`` with ``page``, numbered within each ``key``.

    A listing has a key (a term, a year, a source), so that no window spans the table.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("page", F.ceil(F.row_number().over(w) / size).cast("int"))


def cap_per_key(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key; the plan keeps that many per key before its shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def search_events(events: DataFrame, query: str, as_of: Column, days: int = 7) -> DataFrame:
    """Active events of the coming days with the query in name, description or location, accents and case aside."""
    text = T.normalize_venue_text(F.concat_ws(" ", F.col("name"), F.col("description"), F.col("location")))
    inside = F.to_date("start_ts").between(F.to_date(as_of), F.date_add(F.to_date(as_of), days - 1))
    return active_events(events).where(inside & F.contains(text, T.normalize_venue_text(F.lit(query))))


def related_events(items: DataFrame, asked: DataFrame, weights: dict[str, float], k: int = 5) -> DataFrame:
    """(id, other, score, nth): for each asked item the ``k`` items that share the most weighted terms.

    ``items`` and ``asked`` have id and an array column for each taxonomy. Items with equal terms
    score alike, so items are grouped by their terms first: pairs are formed between asked items and
    term sets, and the best sets are then unfolded, k items of a set at most.
    """
    arrays = {t: F.array_sort(F.array_distinct(F.coalesce(t, F.array().cast("array<string>")))) for t in weights}
    terms = lambda df: df.select("id", *(a.alias(t) for t, a in arrays.items()))

    def weighted(taxonomy: str, weight: float) -> Column:
        return F.transform(taxonomy, lambda x: F.struct(F.lit(taxonomy).alias("taxonomy"), x.alias("term"), F.lit(float(weight)).alias("weight")))

    flat = F.concat(*(weighted(t, w) for t, w in weights.items()))
    keyed = terms(items).withColumn("set", F.xxhash64(*weights))
    sets = keyed.groupBy("set", *weights).agg(F.min("id").alias("any"))
    a = terms(asked).select("id", F.explode(flat).alias("x")).select("id", "x.*")
    b = sets.select("set", F.explode(flat).alias("x")).select("set", "x.taxonomy", "x.term")
    scored = a.join(b, ["taxonomy", "term"]).groupBy("id", "set").agg(F.sum("weight").alias("score"))
    # k + 1 sets hold k items beside the asked one, whatever the sets' sizes
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "set")))
    edge = best.withColumn("floor", F.min(F.when(F.col("place") <= k + 1, F.col("score"))).over(Window.partitionBy("id"))).where("score >= floor")
    few = keyed.select("set", F.col("id").alias("other")).withColumn("m", F.row_number().over(Window.partitionBy("set").orderBy("other"))).where(F.col("m") <= k + 1)
    pairs = edge.join(few, "set").where("id <> other")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return pairs.select("id", "other", "score", nth.alias("nth")).where(F.col("nth") <= k)
