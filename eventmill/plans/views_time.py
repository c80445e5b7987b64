"""Queries of the calendar, the lifecycle and the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import calendar as C
from ..operators import lifecycle as L
from ..operators import publish as P
from ..operators import venues as V
from .scalars import _slug, _venue
from .views import AS_OF, EVENTS, as_of, events, query, table

_T = f"timestamp '{AS_OF}'"
_STATUS = """st as (select 'src' || (event_id % 23) as source_id, case when event_id % 17 = 0 then 'error' when event_id % 31 = 0 then 'pending' else 'success' end as status,
  user_id % 50 as events_accepted, event_id % 7 as events_rejected, strftime(ts - to_days(cast((event_id % 23) as integer)), '%Y-%m-%d %H:%M:%S') as ts from events),
so as (select 'src' || s_suppkey as source_id from supplier)"""
_NOW = "timestamp '2024-01-31 00:00:00'"


def _status(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    ts = F.date_format(F.col("ts").cast("timestamp_ntz") - F.make_dt_interval((k % 23).cast("int")), "yyyy-MM-dd HH:mm:ss")
    return e.select(F.concat(F.lit("src"), (k % 23).cast("string")).alias("source_id"), F.when(k % 17 == 0, "error").when(k % 31 == 0, "pending").otherwise("success").alias("status"), (F.col("user_id") % 50).alias("events_accepted"), (k % 7).alias("events_rejected"), ts.alias("ts"))


def _sources(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source_id"))


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


@query(f"""with {EVENTS}, b as (select * from ev), dd as (select event_id, o, date_trunc('day', start_ts) + to_days(cast(x as integer)) as day from (select event_id, start_ts, unnest([3, 0, 40]) as x, unnest([1, 2, 3]) as o from b)),
n as (select *, row_number() over (partition by event_id order by day, o) as nth, first_value(day) over (partition by event_id order by o) as listed from dd)
select b.event_id, {_slug('name')} || '-' || strftime(listed, '%Y%m') as event_group_id, 'Jour ' || nth || ' sur 3' as day_of, source_id || ':day' || nth as source_id, strftime(day + to_hours(hour(start_ts)), '%Y-%m-%d %H:%M') as start from b join n on n.event_id = b.event_id""")
def number_multi_day(spark, d):
    base = events(spark, d)
    days = base.select("event_id", F.col("start_ts").alias("t"), F.posexplode(F.array(F.lit(3), F.lit(0), F.lit(40))).alias("ord", "x"))
    listed = days.select("event_id", "ord", (F.date_trunc("day", "t").cast("timestamp_ntz") + F.make_dt_interval(F.col("x"))).alias("day"))
    out = C.number_multi_day(base.withColumns({"day_of": F.lit(None).cast("string"), "event_group_id": F.lit(None).cast("string")}), listed)
    return out.select("event_id", "event_group_id", "day_of", "source_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm").alias("start"))


@query(f"with {EVENTS} select source || '-' || category as event_group_id, count(*) as n, strftime(min(start_ts), '%Y-%m-%d') as first_day, strftime(max(start_ts), '%Y-%m-%d') as last_day from ev where event_id % 2 = 0 group by 1")
def multi_day_groups(spark, d):
    e = events(spark, d).withColumn("event_group_id", F.when(F.col("event_id") % 2 == 0, F.concat("source", F.lit("-"), "category")))
    return C.multi_day_groups(e)


@query(f"with {EVENTS} select event_id from ev where not expired and not draft")
def active_events(spark, d):
    return C.active_events(events(spark, d)).select("event_id")


@query(f"with {EVENTS} select event_id from ev where not draft and date_trunc('day', start_ts) + interval 1 day > {_T}")
def hide_after_expiry(spark, d):
    return C.hide_after_expiry(events(spark, d), as_of()).select("event_id")


_WEEK = f"w as (select unnest(generate_series(date_trunc('day', {_T}), date_trunc('day', {_T}) + interval 6 day, interval 1 day)) as day)"


@query(f"with {EVENTS}, {_WEEK} select strftime(w.day, '%Y-%m-%d') as day, case when w.day = date_trunc('day', {_T}) then 'Aujourd''hui' else (['Lun','Mar','Mer','Jeu','Ven','Sam','Dim'])[isodow(w.day)] end as label, count(event_id) as n from w left join ev on date_trunc('day', start_ts) = w.day group by w.day")
def week_view(spark, d):
    return C.week_view(events(spark, d), as_of())


@query(f"with {EVENTS} select event_id, name, strftime(start_ts, '%H:%M') as at from ev where cast(start_ts as date) = date '1998-06-01'")
def day_view(spark, d):
    return C.day_view(events(spark, d), F.lit("1998-06-01").cast("date")).select("event_id", "name", "at")


@query(f"with {EVENTS} select event_id, case when cast(start_ts as date) = date '1998-06-01' then 'Aujourd''hui' else (['Lun','Mar','Mer','Jeu','Ven','Sam','Dim'])[isodow(start_ts)] end as label from ev")
def day_labels(spark, d):
    from ..functions.dates import day_label

    return events(spark, d).select("event_id", day_label(F.to_date("start_ts"), F.to_date(as_of())).alias("label"))


@query(f"with {EVENTS} select strftime(start_ts, '%Y-%m-%d') as day, count(*) as n, case when count(*) = 1 then '1 événement' else count(*) || ' événements' end as label from ev group by 1")
def events_per_day(spark, d):
    return C.events_per_day(events(spark, d))


@query(f"with {EVENTS} select year(start_ts)::integer as year, count(*) as n, min(event_id) as first_id from ev group by 1")
def events_grouped_by_year(spark, d):
    return C.events_grouped_by_year(events(spark, d))


@query(f"with {EVENTS}, t as (select 'category' as taxonomy, unnest(list_distinct(categories)) as term from ev union all select 'location', unnest(list_distinct(locations)) from ev union all select 'tag', unnest(list_distinct(tags)) from ev) select taxonomy, term, count(*) as n from t group by all")
def taxonomy_term_counts(spark, d):
    return C.taxonomy_term_counts(events(spark, d), {"category": "categories", "location": "locations", "tag": "tags"})


@query("select l_orderkey, l_linenumber, l_partkey, cast(ceil(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) / 30.0) as integer) as page from lineitem")
def paginate(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return C.paginate(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"]).drop("l_suppkey")


@query("select l_suppkey, l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) as n from lineitem) where n <= 50")
def cap_per_source(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return C.cap_per_key(rows, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], 50).drop("l_shipdate")


@query(f"with {EVENTS} select event_id from ev where not expired and not draft and cast(start_ts as date) between date '1998-06-01' and date '1998-06-07' and contains({_venue('''name || ' ' || description || ' ' || location''')}, 'brand 1')")
def search_events(spark, d):
    return C.search_events(events(spark, d), "Bränd#1", as_of()).select("event_id")


@query("""with i as (select p_partkey as id, lower(p_type) as c, lower(p_brand) as l, split_part(p_name, ' ', 1) as t from part),
s as (select a.id, b.id as other, 100.0 * (a.c = b.c)::integer + 80.0 * (a.l = b.l)::integer + 40.0 * (a.t = b.t)::integer as score from i a join i b on a.id <> b.id where a.id % 50 = 0)
select id, other, score, nth from (select *, row_number() over (partition by id order by score desc, other) as nth from s where score > 0) where nth <= 5""")
def related_events(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.lower("p_type")).alias("categories"), F.array(F.lower("p_brand")).alias("locations"), F.array(F.substring_index("p_name", " ", 1)).alias("tags"))
    return C.related_events(items, items.where("id % 50 = 0"), {"categories": 100, "locations": 80, "tags": 40})


@query(f"with {EVENTS} select event_id, expired or cast(start_ts as date) < date '1998-06-01' as expired from ev")
def mark_expired(spark, d):
    return L.mark_expired(events(spark, d), as_of()).select("event_id", "expired")


@query(f"with {EVENTS} select event_id from ev where cast(start_ts as date) >= date '1998-06-01'")
def delete_expired(spark, d):
    return L.delete_expired(events(spark, d), as_of())[0].select("event_id")


@query(f"with {EVENTS} select distinct image from ev where cast(start_ts as date) < date '1998-06-01' and image <> ''")
def expired_images(spark, d):
    return L.delete_expired(events(spark, d), as_of())[1]


@query(f"with {EVENTS} select event_id, strftime(start_ts, '%Y-%m-%d') as day, case when expired then 'marked' else 'not marked' end as status from ev where cast(start_ts as date) < date '1998-06-01'")
def list_expired(spark, d):
    return L.list_expired(events(spark, d), as_of())


@query(f"with {EVENTS} select count(*) as total, count(*) filter (where expired) as expired, count(*) filter (where not expired and cast(start_ts as date) < date '1998-06-01') as processed from ev")
def expiration_summary(spark, d):
    return L.expiration_summary(events(spark, d), as_of())


@query(f"with {_STATUS}, l as (select source_id, max(ts) as last from st group by 1) select so.source_id, last as last_run from so left join l on l.source_id = so.source_id where last is null or date_diff('second', cast(last as timestamp), {_NOW}) > 10 * 86400")
def stale_sources(spark, d):
    return L.stale_sources(_sources(spark, d), _status(spark, d), 10, _now())


@query(f"with {_STATUS}, l as (select source_id, max(ts) as last from st group by 1), a as (select so.source_id, last, date_diff('second', cast(last as timestamp), {_NOW}) / 86400.0 as age from so left join l on l.source_id = so.source_id) select source_id, last as last_run, cast(floor(age) as bigint) as age_days, case when age is null then 'never' when age < 2 then 'recent' when age < 7 then 'ageing' else 'old' end as bucket from a")
def source_recency_report(spark, d):
    return L.source_recency_report(_sources(spark, d), _status(spark, d), _now())


@query(f"with {_STATUS} select source_id, arg_max(status, (ts, events_accepted, status)) as status, arg_max(events_accepted, (ts, events_accepted, status)) as events_accepted, arg_max(events_rejected, (ts, events_accepted, status)) as events_rejected, max(ts) as ts from st group by source_id")
def write_source_status(spark, d):
    return P.write_source_status(_status(spark, d))


@query(f"with {_STATUS} select count(*) as total, count(*) filter (where status <> 'pending') as processed, count(*) filter (where status = 'error') as errors, sum(events_accepted)::bigint as accepted, sum(events_rejected)::bigint as rejected from st")
def crawl_summary(spark, d):
    return A.crawl_summary(_status(spark, d))


@query("select event_type as outcome, count(*) as n from events group by 1")
def image_job_stats(spark, d):
    return A.image_job_stats(table(spark, d, "events").select(F.col("event_type").alias("outcome")))


@query(f"""with {EVENTS}, d as (select event_id % 50 <> 0 as h, case when event_id % 40 = 1 then '' else name end as title, case when event_id % 41 = 1 then '' when event_id % 42 = 1 then strftime(start_ts, '%d/%m/%Y') else strftime(start_ts, '%Y-%m-%d') end as dt, case when event_id % 43 = 1 then [] else categories end as c, image, event_id % 2 = 0 as x from ev),
r as (select 'error' as level, 'no_front_matter' as rule from d where not h union all select 'error', 'missing_title' from d where h and title = '' union all select 'error', 'missing_date' from d where h and dt = '' union all select 'error', 'missing_categories' from d where h and len(c) = 0
union all select 'warning', 'bad_date_format' from d where h and dt <> '' and not regexp_matches(dt, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') union all select 'warning', 'unknown_category' from d where h and len(list_filter(c, lambda y: y not in ('economy', 'promo', 'standard'))) > 0 union all select 'warning', 'missing_image' from d where h and image <> '' and not x)
select level, rule, count(*) as n from r group by all""")
def content_validation_report(spark, d):
    k = F.col("event_id")
    docs = events(spark, d).select(
        (k % 50 != 0).alias("has_front_matter"), F.when(k % 40 == 1, "").otherwise(F.col("name")).alias("title"),
        F.when(k % 41 == 1, "").when(k % 42 == 1, F.date_format("start_ts", "dd/MM/yyyy")).otherwise(F.date_format("start_ts", "yyyy-MM-dd")).alias("date"),
        F.when(k % 43 == 1, F.array().cast("array<string>")).otherwise(F.col("categories")).alias("categories"), "image", (k % 2 == 0).alias("image_exists"),
    )
    return A.content_validation_report(docs, ["economy", "promo", "standard"])


@query(f"with {EVENTS}, im as (select distinct '/images/' || c_custkey || '.jpg' as path from customer) select path from im where path not in (select image from ev where event_id % 4 = 1)")
def orphan_images(spark, d):
    images = table(spark, d, "customer").select(F.concat(F.lit("/images/"), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("path")).distinct()
    return A.orphan_images(images, events(spark, d).where("event_id % 4 = 1"))


@query(f"with {EVENTS} select event_id, image from ev where image <> '' and image not in (select '/images/' || c_custkey || '.jpg' from customer where c_custkey % 2 = 0)")
def missing_images(spark, d):
    images = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("/images/"), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("path"))
    return A.missing_images(events(spark, d), images).select("event_id", "image")


@query(f"with {EVENTS} select event_id, strftime(start_ts, '%H:%M') as at, row_number() over (partition by cast(start_ts as date) order by strftime(start_ts, '%H:%M'), event_id) as place from ev")
def sort_by_start_time(spark, d):
    from pyspark.sql import Window

    at = F.date_format("start_ts", "HH:mm")
    w = Window.partitionBy(F.to_date("start_ts")).orderBy(at, "event_id")
    return events(spark, d).select("event_id", at.alias("at"), F.row_number().over(w).cast("long").alias("place"))


@query(f"with {EVENTS} select event_url, min(event_id) as event_id from ev group by 1")
def first_wins_by_key(spark, d):
    return V.first_wins_by_key(events(spark, d).select("event_url", "event_id"), "event_url", ["event_id"])


@query(f"with {EVENTS} select source, string_agg(location, '|' order by n desc, location) as places from (select source, location, count(*) as n, row_number() over (partition by source order by count(*) desc, location) as r from ev group by 1, 2) where r <= 3 group by 1")
def top_places_by_source(spark, d):
    counts = events(spark, d).groupBy("source", "location").agg(F.count("*").alias("n")).withColumn("minus", -F.col("n"))
    top = C.cap_per_key(counts, "source", ["minus", "location"], 3)
    return top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("minus", "location"))), lambda x: x["location"]), "|").alias("places"))
