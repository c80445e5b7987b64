"""Duplicates of published events across sources: three matchers, their combination, and the merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..sources.snapshots import SnapshotTable

# confidences of the matchers, and what follows from them
URL, SIMILAR, MODERATE, NAME = 0.95, 0.85, 0.6, 0.75
DUPLICATE, MERGE, NEAR = 0.7, 0.8, 0.5

_NEW = ("source_id", "name", "event_url", "start_ts", "location")


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def anti_join_source_id(new: DataFrame, published: DataFrame) -> DataFrame:
    """New events whose source id isn't published yet."""
    return new.join(published.select("source_id").where("source_id is not null").distinct(), "source_id", "left_anti")


def url_entries(published: DataFrame) -> DataFrame:
    """(url, path): the URL in normal form."""
    return published.select(U.normalize_url("event_url").alias("url"), "path").where("url <> ''")


def _slot(events: DataFrame, own: str) -> DataFrame:
    place, norm = (T.normalize_name(c).alias(k) for c, k in (("location", "place"), ("name", "norm")))
    return events.select(own, _day(F.col("start_ts")).alias("day"), F.date_format("start_ts", "HH:mm").alias("time"), place, norm).where("place <> ''")


def slot_entries(published: DataFrame) -> DataFrame:
    """(day, time, place, norm, path): norm is the name in normal form."""
    return _slot(published, "path")


def _named(events: DataFrame, own: str) -> DataFrame:
    return events.select(own, T.normalize_name("name").alias("key"), _day(F.col("start_ts")).alias("day")).where("key <> ''")


def name_entries(published: DataFrame) -> DataFrame:
    """(key, day, path): key is the name in normal form."""
    return _named(published, "path")


def match_urls(new: DataFrame, entries: DataFrame) -> DataFrame:
    """Matches of ``new`` with ``url_entries``; the last path of a URL stands for it."""
    last = entries.groupBy("url").agg(F.max("path").alias("path"))
    asked = new.select("source_id", U.normalize_url("event_url").alias("url")).where("url <> ''")
    return asked.join(last, "url").select("source_id", "path", F.lit(URL).alias("confidence"), F.lit("url").alias("reason"))


def match_slots(new: DataFrame, entries: DataFrame) -> DataFrame:
    """Matches of ``new`` with ``slot_entries``: the best name of the slot, the least path among equals.

    Each pair of different names that meet is rated once, whatever the slots and events that bear
    them; pairs whose letters alone keep them from being alike aren't rated. One row of each name
    of a slot meets.
    """
    slot = ["day", "time", "place"]
    a = _slot(new, "source_id").withColumnRenamed("norm", "new_name")
    b = entries.groupBy(*slot, F.col("norm").alias("old_name")).agg(F.min("path").alias("path"))
    pairs = a.select(*slot, "new_name").distinct().join(b, slot)
    # what is rated asks for the count, or the optimizer would rate the pairs before they are grouped
    texts, once = pairs.groupBy("new_name", "old_name").agg(F.count("*").alias("n")), F.col("n") > 0
    alike = F.coalesce(T.most_similarity(T.letter_counts(F.col("new_name")), T.letter_counts(F.col("old_name"))) > NEAR, F.lit(False))
    ratio = T.normalized_similarity(F.col("new_name"), F.col("old_name"))
    rated = texts.where(F.when(once, alike)).select("new_name", "old_name", F.when(once, ratio).alias("ratio")).where(F.col("ratio") > NEAR)
    rated = rated.select("new_name", "old_name", F.when(F.col("ratio") > 0.7, SIMILAR).otherwise(MODERATE).alias("confidence"))
    best = pairs.join(rated, ["new_name", "old_name"]).groupBy(*slot, "new_name").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "path")).alias("x"))
    return a.join(best, [*slot, "new_name"]).select("source_id", "x.path", (-F.col("x.minus")).alias("confidence"), F.lit("date_time_location").alias("reason"))


def match_names(new: DataFrame, entries: DataFrame) -> DataFrame:
    """Matches of ``new`` with ``name_entries``: all paths of a name and day."""
    return _named(new, "source_id").join(entries, ["key", "day"]).select("source_id", "path", F.lit(NAME).alias("confidence"), F.lit("name_date").alias("reason"))


def match_first_names(new: DataFrame, entries: DataFrame) -> DataFrame:
    """The same, of a name and day only the least path, which is the one that counts among matches of one kind."""
    return match_names(new, entries.groupBy("key", "day").agg(F.min("path").alias("path")))


def match_by_url(new: DataFrame, published: DataFrame) -> DataFrame:
    """(source_id, path, confidence, reason): the same URL in normal form; the last path of a URL stands for it."""
    return match_urls(new, url_entries(published))


def match_by_date_time_location(new: DataFrame, published: DataFrame) -> DataFrame:
    """The same day, time and place, and a name that is similar or at least moderately so: the best one, of the least path."""
    return match_slots(new, slot_entries(published))


def match_by_name_date(new: DataFrame, published: DataFrame) -> DataFrame:
    """The same normalised name on the same day: every pair of events."""
    return match_names(new, name_entries(published))


def combine_matches(new: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each new event: the best match (the least path among equals), and what follows from it."""
    # a name match counts only where nothing better than the merge threshold was found
    best = matches.groupBy("source_id").agg(
        F.max("confidence").alias("confidence"), F.min_by("path", F.struct(-F.col("confidence"), "path")).alias("path"), F.array_sort(F.collect_set("reason")).alias("reasons")
    )
    out = new.select("source_id").join(best, "source_id", "left")
    c = F.coalesce("confidence", F.lit(0.0))
    reasons = F.filter(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: (r != "name_date") | (c < MERGE))
    flags = (c >= DUPLICATE).alias("is_duplicate"), (c >= MERGE).alias("should_merge"), ((c >= NEAR) & (c < DUPLICATE)).alias("is_near")
    return out.select("source_id", F.when(c >= MODERATE, F.col("path")).alias("path"), c.alias("confidence"), F.array_join(reasons, ",").alias("reasons"), *flags)


def detect_duplicates(new: DataFrame, published: DataFrame) -> DataFrame:
    matches = match_by_url(new, published).unionByName(match_by_date_time_location(new, published)).unionByName(match_first_names(new, name_entries(published)))
    return combine_matches(new, matches)


def duplicate_index_stats(published: DataFrame) -> DataFrame:
    key = F.concat_ws("|", _day(F.col("start_ts")), F.date_format("start_ts", "HH:mm"), T.normalize_name(F.coalesce("location", F.lit(""))))
    return published.agg(F.count_distinct(F.nullif(U.normalize_url("event_url"), F.lit(""))).alias("total_urls"), F.count_distinct(key).alias("total_date_locations"), F.count_distinct(F.nullif(T.normalize_name("name"), F.lit(""))).alias("total_names"))


def merge_steps(published: DataFrame, found: DataFrame) -> DataFrame:
    """(path, ord, source_id, changed): whether each row of ``found``, merged in its order, changes its file.

    It does if it brings the first description or image, or a URL or source id that the file and the
    rows before it don't have. Columns as for ``merge_duplicates``.
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    none = F.array().cast("array<string>")
    file = published.select(
        "path", text("description").isNotNull().alias("has_text"), text("image").isNotNull().alias("has_image"),
        F.array_append(F.coalesce("alternate_sources", none), F.coalesce("event_url", F.lit(""))).alias("urls"),
        F.array_append(F.coalesce("source_ids", none), F.coalesce("source_id", F.lit(""))).alias("ids"),
    )
    # the row of the least ord that brings a value is the one that adds it
    adds = [F.struct(F.lit(kind).alias("kind"), (F.lit("") if kind in ("description", "image") else text(kind)).alias("value"), text(kind).isNotNull().alias("there")) for kind in ("description", "image", "event_url", "source_id")]
    brought = found.select("path", "ord", F.explode(F.array(*adds)).alias("x")).select("path", "ord", "x.*").where("there and value is not null")
    first = brought.groupBy("path", "kind", "value").agg(F.min("ord").alias("ord")).join(file, "path")
    fresh = F.when(F.col("kind") == "description", ~F.col("has_text")).when(F.col("kind") == "image", ~F.col("has_image"))
    fresh = fresh.when(F.col("kind") == "event_url", ~F.array_contains("urls", F.col("value"))).otherwise(~F.array_contains("ids", F.col("value")))
    changing = first.where(fresh).select("path", "ord").distinct().withColumn("changed", F.lit(True))
    rows = found.select("path", "ord", "source_id").join(changing, ["path", "ord"], "left")
    return rows.withColumn("changed", F.coalesce("changed", F.lit(False)))


def merge_duplicates(published: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """``published`` with what its duplicates add: empty text and image filled, other URLs and source ids noted.

    ``found`` has path, ord, description, image, event_url and source_id of the new rows; rows of one
    path are folded in their order, the first filled value wins. last_crawled changes with the row only.
    """
    filled = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ord")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("ord", c)))), lambda x: x[c])
    adds = found.groupBy("path").agg(filled("description").alias("d"), filled("image").alias("i"), ordered("event_url").alias("urls"), ordered("source_id").alias("ids"))
    none = F.array().cast("array<string>")
    both = published.join(adds, "path", "left")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    urls = F.array_union(F.coalesce("alternate_sources", none), F.array_except(F.coalesce("urls", none), F.array(F.coalesce("event_url", F.lit("")))))
    old_ids = F.array_union(F.coalesce("source_ids", none), F.array_compact(F.array(text("source_id"))))
    ids = F.when(F.size(F.array_except(F.coalesce("ids", none), old_ids)) > 0, F.array_union(old_ids, F.col("ids"))).otherwise(F.coalesce("source_ids", none))
    new = {"description": F.coalesce(text("description"), F.col("d"), F.col("description")), "image": F.coalesce(text("image"), F.col("i"), F.col("image")), "alternate_sources": urls, "source_ids": ids}
    changed = F.array_compact(
        F.array(
            F.when(text("description").isNull() & F.col("d").isNotNull(), "description"),
            F.when(text("image").isNull() & F.col("i").isNotNull(), "image"),
            F.when(F.size(urls) > F.size(F.coalesce("alternate_sources", none)), "alternate_sources"),
            F.when(F.size(ids) > F.size(F.coalesce("source_ids", none)), "source_ids"),
        )
    )
    out = both.withColumns({f"__{k}": v for k, v in new.items()} | {"changes": changed})
    out = out.withColumns({k: F.col(f"__{k}") for k in new} | {"last_crawled": F.when(F.size("changes") > 0, as_of).otherwise(F.col("last_crawled"))})
    return out.drop("d", "i", "urls", "ids", *(f"__{k}" for k in new))


def merge_into(table: SnapshotTable, found: DataFrame, as_of: Column) -> int:
    """``merge_duplicates`` written back: only buckets with a path of ``found`` are read and written anew. Returns the version."""
    return table.rewrite(found.select("path"), lambda rows: merge_duplicates(rows, found, as_of).drop("changes"))
