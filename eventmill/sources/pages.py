"""Sources: page archives, fetch logs, API payloads, listings and published documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The page archive as it lies in a folder; its partitions are the parallelism."""
    return spark.read.format(fmt).load(path)


def filter_successful_fetches(fetches: DataFrame) -> DataFrame:
    return fetches.where("status_code >= 200 and status_code < 400 and error is null")


def _no_older(fetched: Column, at: Column, ttl_s: int) -> Column:
    """Whether a page was no older than ``ttl_s`` seconds; parts of a second count."""
    return F.timestamp_diff("MICROSECOND", fetched, at) <= ttl_s * 1_000_000


def latest_fresh_page(fetches: DataFrame, as_of: Column, ttl_s: int = 3600) -> DataFrame:
    """The newest successful response of each URL, if it is no older than ``ttl_s`` seconds."""
    w = Window.partitionBy("url").orderBy(F.desc("fetched_at"))
    newest = filter_successful_fetches(fetches).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return newest.where(_no_older(F.col("fetched_at"), as_of, ttl_s))


def fresh_page_at(requests: DataFrame, fetches: DataFrame, ttl_s: int = 3600, keep: tuple[str, ...] = (), slice_s: int = 86400) -> DataFrame:
    """``requests`` (url, requested_at) with the response that a cache held at the time of each request.

    That is the newest successful fetch at or before the request, if it is no older than ``ttl_s``
    seconds; fetched_at and the columns ``keep`` of it, null if there is none. Requests and fetches
    are merged in order of time within slices of ``slice_s`` seconds, so that a hot URL is many
    groups; the last success of each slice is carried on to later ones. Of fetches of one time, the
    one of the greatest kept columns counts. Nulls in url or time have no page.
    """
    page = F.struct("fetched_at", *keep)
    nth = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / F.lit(slice_s)).alias("__slice")
    own = F.struct(*requests.columns)
    ok = filter_successful_fetches(fetches).where("url is not null and fetched_at is not null").select("url", nth("fetched_at"), F.col("fetched_at").alias("__t"), page.alias("__page"))
    asked = requests.select("url", nth("requested_at"), F.col("requested_at").alias("__t"), own.alias("__own"))
    both = ok.unionByName(asked, allowMissingColumns=True)
    # at one time, the fetch comes before the request, and of fetches the greatest comes last
    order = Window.partitionBy("url", "__slice").orderBy("__t", F.col("__own").isNotNull(), "__page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__seen", F.last("__page", ignorenulls=True).over(order)).where("__own is not null").select("url", "__slice", "__own", "__seen")
    lasts = ok.groupBy("url", "__slice").agg(F.max("__page").alias("__last"))
    slices = lasts.unionByName(asked.select("url", "__slice").distinct(), allowMissingColumns=True).groupBy("url", "__slice").agg(F.max("__last").alias("__last"))
    earlier = Window.partitionBy("url").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("__carried", F.last("__last", ignorenulls=True).over(earlier)).select(F.col("url").alias("__url"), F.col("__slice").alias("__of"), "__carried")
    rows = seen.join(carried, (F.col("url") == F.col("__url")) & (F.col("__slice") == F.col("__of")), "left").withColumn("__seen", F.coalesce("__seen", "__carried"))
    fresh = _no_older(F.col("__seen.fetched_at"), F.col("__own.requested_at"), ttl_s)
    return rows.select("__own.*", *(F.when(fresh, F.col(f"__seen.{c}")).alias(c) for c in ("fetched_at", *keep)))


def enabled_sources(sources: DataFrame, source: str | None = None) -> DataFrame:
    """Enabled sources; or those of an id or, if no id fits, of a parser name."""
    if source is None:
        return sources.where("enabled")
    by_id = sources.where(F.col("id") == source)
    return by_id if not by_id.isEmpty() else sources.where(F.col("parser") == source)


def _first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ingest_article_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Articles of all page files, each id once, from the first file by name that has it.

    ``multi_line`` is for files that are one JSON value each; lines of JSON are read in parallel without.
    """
    rows = spark.read.schema(schema).json(path, multiLine=multi_line).withColumn("__file", F.input_file_name())
    return _first_by(rows, "id", "__file").drop("__file")


def ingest_event_api_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Events of all page envelopes, one to a file or, without ``multi_line``, one to a line."""
    return spark.read.schema(schema).json(path, multiLine=multi_line).select(F.explode("events").alias("event")).select("event.*")


def union_listing_pages(links: DataFrame, max_pages: int = 10) -> DataFrame:
    """(source_id, link): distinct links of the first pages of a listing. ``links``: source_id, page, link."""
    return links.where(F.col("page") <= max_pages).select("source_id", "link").distinct()


def new_urls_only(links: DataFrame, seen: DataFrame) -> DataFrame:
    return links.select("link").distinct().join(seen.select("link").distinct(), "link", "left_anti")


_DOCUMENT = "path string, name string, event_url string, date string, time string, location string, categories array<string>, source_id string, expired boolean, draft boolean, has_front_matter boolean, body string"


def _listed(value: object) -> list[str]:
    """A list of texts; a single value counts as a list of one."""
    values = value if isinstance(value, list) else [value]
    return [str(v) for v in values if v is not None and v != ""]


# a line of a head whose value is surely a text as it stands, quoted or not, or a truth value
_LINE = re.compile(r"([A-Za-z]+): (?:(true|false)|'([^'\n]*)'|(0[0-9]:[0-5][0-9]|[A-Za-z/](?:[A-Za-z0-9_/.\-]|:(?=[A-Za-z0-9/])|(?<! )#| (?=[A-Za-z0-9_/]))*))")
_WORDS = frozenset("y n yes no on off true false null".split())


def _plain_head(text: str) -> dict[str, object] | None:
    """The mapping of a head of plain lines; None if it takes a YAML parser to tell."""
    head: dict[str, object] = {}
    lines = text.split("\n")
    if lines.pop() or not lines:
        return None
    listed: list[str] | None = None
    for line in lines:
        item = line.startswith("- ")
        if item and listed is None:
            return None
        found = _LINE.fullmatch(f"x: {line[2:]}" if item else line)
        if found is None:
            if item or not re.fullmatch("[A-Za-z]+:", line):
                return None
            listed = head[line[:-1]] = []
            continue
        key, truth, quoted, plain = found.groups()
        if truth and item or plain and plain.lower() in _WORDS or key.lower() in _WORDS:
            return None
        value = truth == "true" if truth else plain if quoted is None else quoted
        if item:
            listed.append(value)
        else:
            head[key], listed = value, None
    return None if any(v == [] for v in head.values()) else head


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for frame in batches:
        rows = []
        for path, value in zip(frame["path"], frame["value"]):
            head, body = {}, value
            parts = value.split("---\n", 2) if value.startswith("---\n") else []
            if len(parts) == 3:
                try:
                    head, body = _plain_head(parts[1]) or yaml.load(parts[1], loader) or {}, parts[2]
                except (yaml.YAMLError, ValueError):  # the loader lets dates such as 2026-13-45 through as errors of their own
                    parts = []
            if not isinstance(head, dict):  # a list or a bare word isn't front matter
                head, body, parts = {}, value, []
            text = lambda *names: next((str(head[n]) for n in names if head.get(n)), None)  # noqa: B023, E731
            places, kinds = _listed(head.get("locations")), _listed(head.get("categories"))
            rows.append((path, text("name", "eventName", "title"), text("eventURL"), (text("date") or "")[:10] or None, text("startTime"), places[0] if places else None, kinds, text("sourceId"), bool(head.get("expired")), bool(head.get("draft")), len(parts) == 3, body))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _DOCUMENT.split(", ")])


def scan_event_documents(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """Published Markdown files (those whose name starts with _ aside), front matter parsed.

    A file whose head can't be read, or isn't a mapping, is a row without front matter; single values
    where lists are meant count as lists of one.
    With ``archive``, a format, the folder holds rows of path and value, one for each file: a site of
    millions of small files is better kept so.
    """
    if archive:
        rows = spark.read.format(archive).load(folder).where(~F.substring_index("path", "/", -1).startswith("_"))
        return rows.select("path", "value").mapInPandas(_parse, _DOCUMENT)
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="[!_]*.md").select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(_parse, _DOCUMENT)
