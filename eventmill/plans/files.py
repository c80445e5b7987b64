"""Queries of the readers and writers: files are written from the given tables, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import lifecycle as L
from ..operators import publish as P
from ..operators import search_index as SI
from ..sources import pages as S
from ..streaming.ingest import stream_ingest_pages as stream_ingest
from .scalars import _slug, _venue
from .views import EVENTS, as_of, events, query, shared_folder, table

_FILE = f"strftime(start_ts, '%Y/%m/%d/') || {_slug('name')} || '.fr.md'"


@query(f"""with {EVENTS} select event_id, name, event_url, strftime(start_ts, '%Y-%m-%d') as date, strftime(start_ts, '%H:%M') as time, source_id, false as expired, draft, description as body from ev""")
def scan_event_documents(spark, d):
    """Every event's page, written to an archive and read back by its front matter."""
    none = F.lit(None).cast("string")
    pages = P.render_event_markdown(events(spark, d).withColumns({"day_of": none, "event_group_id": none}), as_of())
    folder = shared_folder(spark, "documents")
    pages.select("path", F.col("page").alias("value")).write.parquet(folder)
    found = S.scan_event_documents(spark, folder, "parquet")
    number = F.regexp_extract("source_id", ":([0-9]+)$", 1).cast("long")
    return found.select(number.alias("event_id"), "name", "event_url", "date", "time", "source_id", "expired", "draft", "body")


@query("select o_custkey as id, strftime(min(o_orderdate), '%Y-%m-%d') as first_day from orders group by 1")
def ingest_article_json(spark, d):
    """Articles in page files by month; an article of several months counts with its first file."""
    folder = shared_folder(spark, "articles")
    day = F.date_format(F.min("o_orderdate"), "yyyy-MM-dd")
    rows = table(spark, d, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(day.alias("day"))
    rows.select("month", F.col("o_custkey").alias("id"), "day").repartition("month").write.partitionBy("month").json(folder)
    return S.ingest_article_json(spark, folder, "id long, day string", multi_line=False).select("id", F.col("day").alias("first_day"))


@query("select o_orderkey as id, 'Soirée ' || o_orderkey as title, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as start_date, lower(o_orderpriority) as category from orders")
def ingest_event_api_json(spark, d):
    """Envelopes of some hundred events each, written one to a line."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    event = F.struct(k.alias("id"), F.concat(F.lit("Soirée "), k.cast("string")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("start_date"), F.lower("o_orderpriority").alias("category"))
    folder = shared_folder(spark, "envelopes")
    page = F.floor(k / 400)
    o.groupBy(page.alias("page")).agg(F.collect_list(event).alias("events"), F.count("*").alias("total")).drop("page").write.json(folder)
    schema = "events array<struct<id long, title string, start_date string, category string>>, total long"
    return S.ingest_event_api_json(spark, folder, schema, multi_line=False)


@query(f"with {EVENTS} select event_id, name as title, '/events/' || strftime(start_ts, '%Y/%m/%d/') || {_slug('name')} || '/' as link, strftime(start_ts, '%Y-%m-%d') as date, fmt from ev cross join (values ('json'), ('xml')) as f(fmt) where not expired and not draft")
def feed_export(spark, d):
    """The feed in both formats, read back."""
    active = C.active_events(events(spark, d))
    folder = shared_folder(spark, "feeds")
    back = []
    for fmt in ("json", "xml"):
        P.feed_export(active, f"{folder}/{fmt}", fmt)
        reader = spark.read.schema("event_id long, title string, link string, date string")
        reader = reader.option("rowTag", "item").format("xml") if fmt == "xml" else reader.format("json")
        back.append(reader.load(f"{folder}/{fmt}").withColumn("fmt", F.lit(fmt)))
    return back[0].unionByName(back[1])


@query("select 'src' || (user_id % 40) || ':' || session as source_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen from (select user_id, ts, strftime(ts, '%Y%m%d%H') as session, event_type from events) where event_type <> 'error' group by 1")
def stream_ingest_pages(spark, d):
    """The event table as page files, streamed file by file into the published table."""
    folder = shared_folder(spark, "stream")
    rows = table(spark, d, "events").select("user_id", F.col("ts").alias("fetched_at"), "event_type")
    rows.repartitionByRange(6, "fetched_at").sortWithinPartitions("fetched_at").write.parquet(f"{folder}/pages")
    key = F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string"), F.lit(":"), F.date_format("fetched_at", "yyyyMMddHH"))
    extract = lambda df: df.where("event_type <> 'error'").select(key.alias("source_id"), "fetched_at")
    accept = lambda df: df.withColumn("accepted", F.lit(True))
    pages = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/pages")
    stream_ingest(pages, f"{folder}/published", f"{folder}/checkpoint", extract, accept).awaitTermination()
    return spark.read.parquet(f"{folder}/published").select("source_id", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


_TERMS = f"""t as (select event_id, start_ts, name, 'types' as taxonomy, {_slug("category")} as term from ev where not expired and not draft union select event_id, start_ts, name, 'tags', unnest(list_transform(tags, lambda x: {_slug("x")})) from ev where not expired and not draft),
r as (select *, row_number() over (partition by taxonomy, term order by start_ts desc, event_id) as nth from t where term <> '')"""


@query(f"with {EVENTS}, {_TERMS} select taxonomy, term, cast(nth as integer) as nth, event_id, name as title, '/events/' || strftime(start_ts, '%Y/%m/%d/') || {_slug('name')} || '/' as link, strftime(start_ts, '%Y-%m-%d') as date from r where nth <= 20")
def term_feeds(spark, d):
    """A feed for each type and tag, written as JSON lines and read back by its folder."""
    folder = shared_folder(spark, "term-feeds")
    P.term_feeds(C.active_events(events(spark, d)), {"types": "categories", "tags": "tags"}, folder)
    schema = "nth int, event_id long, title string, link string, date string, taxonomy string, term string"
    return spark.read.schema(schema).json(folder).select("taxonomy", "term", "nth", "event_id", "title", "link", "date")


@query(f"with {EVENTS} select event_id, expired or cast(start_ts as date) < date '1998-06-01' as expired from ev where cast(start_ts as date) >= date '1993-01-15'")
def expire_stored(spark, d):
    """Events stored by month: those up to a day removed, then the others marked up to the reference time."""
    folder = shared_folder(spark, "by-month")
    rows = events(spark, d).withColumn("month", F.to_date(F.date_trunc("month", "start_ts")))
    rows.repartition("month").write.partitionBy("month").parquet(folder)
    L.expire_stored(spark, folder, F.lit("1993-01-15").cast("date"), remove=True)
    L.expire_stored(spark, folder, as_of())
    return spark.read.parquet(folder).select("event_id", "expired")


_SEARCHED = _venue("name || ' ' || description || ' ' || location")


@query(f"with {EVENTS} select event_id from ev where not expired and not draft and cast(start_ts as date) between date '1998-06-01' and date '1998-06-30' and contains({_SEARCHED}, 'brand 1')")
def search_by_index(spark, d):
    """``search_events`` over an index of letter runs."""
    folder = shared_folder(spark, "search")
    SI.build(events(spark, d), folder, 8, 16)
    return SI.search(spark, folder, "Bränd#1", as_of(), 30).select("event_id")
