"""Publishing: front matter, page text, what happens to each new event, feeds and the sitemap."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U


def event_title(name: Column, day_of: Column) -> Column:
    return F.concat_ws(" - ", name, F.nullif(day_of, F.lit("")))


def event_file_path(start: Column, slug: Column) -> Column:
    return F.concat(F.date_format(start, "yyyy/MM/dd/"), slug, F.lit(".fr.md"))


def to_event(parsed: DataFrame) -> DataFrame:
    """Events of parsed records (name, url, date, time, location): 20:00 without a time, midnight with a bad one."""
    minutes = F.when(F.coalesce("time", F.lit("")) == "", F.lit(D.DEFAULT_HOUR * 60)).otherwise(F.coalesce(D.parse_french_time(F.col("time")), F.lit(0)))
    day = F.date_trunc("day", F.col("date")).cast("timestamp_ntz")
    return parsed.withColumn("start_ts", day + F.make_dt_interval(F.lit(0), F.lit(0), minutes))


def validate_event(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejects carry the missing fields of name, event_url and start_ts as ``reason``."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    reason = F.array_join(F.array_compact(F.array(*(F.when(empty(c), c) for c in ("name", "event_url", "start_ts")))), ",")
    judged = events.withColumn("reason", reason)
    return judged.where("reason = ''").drop("reason"), judged.where("reason <> ''")


def _front_matter(as_of: Column) -> Column:
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fields = {
        "title": T.clean_text(event_title(F.col("name"), F.col("day_of"))), "slug": T.slugify(F.col("name")), "date": iso(F.col("start_ts")), "draft": F.coalesce("draft", F.lit(False)),
        "expiryDate": iso(D.expiry_ts(F.col("start_ts"))), "name": F.col("name"), "eventURL": F.col("event_url"), "startTime": D.start_time(F.col("start_ts")),
        "description": some("description"), "image": some("image"), "eventGroupId": some("event_group_id"), "dayOf": some("day_of"), "sourceId": some("source_id"),
        "dates": F.array(D.french_date_term(F.col("start_ts"))), "lastCrawled": iso(as_of), "expired": F.lit(False),
    }
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def to_front_matter(events: DataFrame, as_of: Column) -> DataFrame:
    """(event_id, front_matter): ordered fields as JSON; optional ones only where they are filled."""
    return events.select("event_id", _front_matter(as_of).alias("front_matter"))


# text that YAML writes as it is, unless it is one of the words: no sign that means anything, no space but single ones
_PLAIN = re.compile(r"[A-Za-z/](?:[A-Za-z0-9_/.\-]|:(?=[A-Za-z0-9/])|(?<! )#| (?=[A-Za-z0-9_/]))*")
_WORDS = frozenset("y n yes no on off true false null".split())
# text that YAML quotes because it looks like a time, and that needs no escapes
_TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}|[0-9]{2}:[0-5][0-9]")

_EARLY = re.compile(r"0[0-9]:[0-5][0-9]")  # one that doesn't look so


def is_plain(text: str) -> bool:
    """Whether YAML surely takes a text for itself."""
    return _PLAIN.fullmatch(text) is not None and text.lower() not in _WORDS


def front_matter_yaml(fields: dict[str, object], dumper: type) -> str:
    """``yaml.dump`` of the fields in block style; plain values, which most are, without the dumper."""
    import yaml

    out = []
    for key, value in fields.items():
        if value is True or value is False:
            out.append(f"{key}: {'true' if value else 'false'}\n")
        elif isinstance(value, str) and len(key) + len(value) < 70 and (is_plain(value) or _EARLY.fullmatch(value)):
            out.append(f"{key}: {value}\n")
        elif isinstance(value, str) and _TIME.fullmatch(value) and value[0] in "12":
            out.append(f"{key}: '{value}'\n")
        elif isinstance(value, list) and value and all(isinstance(v, str) and len(v) < 70 and is_plain(v) for v in value):
            out.append(f"{key}:\n" + "".join(f"- {v}\n" for v in value))
        else:
            out.append(yaml.dump({key: value}, Dumper=dumper, allow_unicode=True, sort_keys=False))
    return "".join(out)


def render_event_markdown(events: DataFrame, as_of: Column) -> DataFrame:
    """(event_id, path, page): YAML front matter and body; rendered in Arrow batches."""

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
        for frame in batches:
            head = [front_matter_yaml(json.loads(x), dumper) for x in frame["front_matter"]]
            yield pd.DataFrame({"event_id": frame["event_id"], "path": frame["path"], "page": [f"---\n{h}---\n{b}" for h, b in zip(head, frame["body"])]})

    path = event_file_path(F.col("start_ts"), T.slugify(F.col("name")))
    rows = events.select("event_id", _front_matter(as_of).alias("front_matter"), path.alias("path"), F.coalesce("description", F.lit("")).alias("body"))
    return rows.mapInPandas(render, "event_id long, path string, page string")


def _decisions(duplicates: DataFrame) -> DataFrame:
    """One row for each source id of ``detect_duplicates``, the one to merge before one that is only a duplicate."""
    given = duplicates.columns
    rest = {c: F.col(c) if c in given else F.lit(None).cast("string") for c in ("path", "reasons")}
    rows = duplicates.select("source_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("should_merge", "is_duplicate")), *(v.alias(c) for c, v in rest.items()))
    first = F.min_by(F.struct("should_merge", "is_duplicate", "path", "reasons"), F.struct(~F.col("should_merge"), ~F.col("is_duplicate"), "path")).alias("d")
    return rows.groupBy("source_id").agg(first).select("source_id", "d.*")


def publish_actions(new: DataFrame, duplicates: DataFrame, existing: DataFrame, changing: DataFrame | None = None) -> DataFrame:
    """(source_id, file_path, action, reason): failed, updated, skipped_duplicate, skipped_exists or created.

    ``duplicates`` comes from ``detect_duplicates``. A duplicate never makes a file: it updates the file
    it is merged into if that changes anything (``changing`` has the source ids for which it does, as
    ``merge_steps`` tells; without it all do), else it is skipped; its file_path is that file's. Of the
    rows left, the first of a path (by ord) makes its file unless it is there.
    """
    path = event_file_path(F.col("start_ts"), T.slugify(F.col("name")))
    rows = new.withColumn("own_path", path).join(_decisions(duplicates), "source_id", "left")
    there = existing.select(F.col("path").alias("own_path"), F.lit(True).alias("there")).distinct()
    rows = rows.join(there, "own_path", "left")
    if changing is None:
        rows = rows.withColumn("changes", F.lit(True))
    else:
        rows = rows.join(changing.select("source_id").distinct().withColumn("changes", F.lit(True)), "source_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    early = (
        F.when((F.coalesce("name", F.lit("")) == "") | F.col("start_ts").isNull(), "failed")
        .when(flag("is_duplicate") & flag("should_merge") & flag("changes"), "updated")
        .when(flag("is_duplicate"), "skipped_duplicate")
    )
    # only rows that get as far as the file test count towards a path
    rows = rows.withColumn("early", early)
    nth = F.row_number().over(Window.partitionBy("own_path", F.col("early").isNull()).orderBy("ord"))
    late = F.when(flag("there") | (nth > 1), "skipped_exists").otherwise("created")
    rows = rows.withColumn("action", F.coalesce("early", late))
    because = lambda word: F.concat(F.lit(f"{word}: "), F.coalesce("reasons", F.lit("")))
    reason = F.when(F.col("action") == "updated", because("Merged")).when(F.col("action") == "skipped_duplicate", because("Duplicate"))
    reason = reason.when(F.col("action") == "skipped_exists", "File already exists").when(F.col("action") == "failed", "No name or date").otherwise("")
    target = F.when(F.col("action").isin("updated", "skipped_duplicate"), F.col("path")).otherwise(F.col("own_path"))
    return rows.select("source_id", target.alias("file_path"), "action", reason.alias("reason"))


def publish_stats(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def feed_rows(events: DataFrame) -> DataFrame:
    """What a feed shows of active events."""
    slug = T.slugify(F.col("name"))
    return events.select("event_id", F.col("name").alias("title"), U.event_permalink(F.col("start_ts"), slug).alias("link"), F.date_format("start_ts", "yyyy-MM-dd").alias("date"))


def feed_export(events: DataFrame, path: str, fmt: str = "json") -> None:
    """Write the feed as JSON lines or XML items."""
    writer = feed_rows(events).write.mode("overwrite")
    writer.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path) if fmt == "xml" else writer.json(path)


def term_feed_rows(events: DataFrame, taxonomies: dict[str, str], most: int = 20, salt: int = 16) -> DataFrame:
    """(taxonomy, term, nth, and the columns of ``feed_rows``): the newest ``most`` events of each term, ties by id.

    ``taxonomies`` names the array column of each. All terms are ranked in one pass: first within
    parts of a term, so that one that every event bears isn't one task, then over what is left.
    """
    shown = feed_rows(events).withColumnRenamed("event_id", "id")
    lists = F.map_from_arrays(F.array(*map(F.lit, taxonomies)), F.array(*(F.coalesce(c, F.array().cast("array<string>")) for c in taxonomies.values())))
    terms = events.select("event_id", "start_ts", F.explode(lists).alias("taxonomy", "terms")).select("event_id", "start_ts", "taxonomy", F.explode(F.array_distinct("terms")).alias("label"))
    terms = terms.withColumn("term", T.slugify(F.col("label"))).where("term <> ''").select("event_id", "start_ts", "taxonomy", "term").distinct()
    terms = terms.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(salt)))
    order = F.desc("start_ts"), F.asc("event_id")
    some = terms.withColumn("nth", F.row_number().over(Window.partitionBy("taxonomy", "term", "part").orderBy(*order))).where(F.col("nth") <= most)
    first = some.withColumn("nth", F.row_number().over(Window.partitionBy("taxonomy", "term").orderBy(*order))).where(F.col("nth") <= most)
    return first.join(shown, first["event_id"] == shown["id"]).select("taxonomy", "term", "nth", "event_id", "title", "link", "date")


def term_feeds(events: DataFrame, taxonomies: dict[str, str], path: str, most: int = 20, fmt: str = "json") -> None:
    """Write a feed for each term, in a folder of its taxonomy and term.

    A task writes its terms one after the other, so that one file is open at a time, however many terms there are.
    """
    rows = term_feed_rows(events, taxonomies, most).repartition("taxonomy", "term").sortWithinPartitions("taxonomy", "term", "nth")
    writer = rows.write.mode("overwrite").partitionBy("taxonomy", "term")
    writer.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path) if fmt == "xml" else writer.json(path)


def sitemap_rows(pages: DataFrame) -> DataFrame:
    """(loc, changefreq, priority) of all pages but taxonomy and term lists. ``pages`` has loc and kind."""
    return pages.where(~F.col("kind").isin("taxonomy", "term")).select("loc", F.lit("daily").alias("changefreq"), F.lit(0.5).alias("priority"))


def write_source_status(status: DataFrame) -> DataFrame:
    """The latest row of each source; of equal times the greatest accepted count, then the greatest status."""
    last = F.max_by(F.struct("status", "events_accepted", "events_rejected", "ts"), F.struct("ts", "events_accepted", "status"))
    return status.groupBy("source_id").agg(last.alias("x")).select("source_id", "x.*")
