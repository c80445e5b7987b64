"""Queries of venues, duplicates and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import duplicate_index as I
from ..operators import duplicates as U
from ..operators import publish as P
from ..operators import venues as V
from ..sources.snapshots import SnapshotTable
from .scalars import _name, _slug, _url, _venue
from .views import EVENTS, VENUES, as_of, events, query, shared_folder, table, venues

_ART = r"'^((le|la|les|l|un|une|des|du|de|d)( +|$))+'"
_LOOKUP = f"""keys as (
  select ord, slug, unnest(list_distinct(list_concat(k, list_transform(k, lambda x: strip_accents(x))))) as key from (
    select ord, slug, list_concat([replace(slug, '-', ' '), {_venue('title')}, regexp_replace({_venue('title')}, {_ART}, '')], list_transform(aliases, lambda a: replace(split_part(trim(a, '/'), '/', 2), '-', ' ')), list_transform(search_names, lambda s: {_venue('s')})) as k from ve)
), lookup as (select key, arg_min(slug, ord) as slug from keys where key <> '' group by key)"""


@query(f"with {VENUES}, {_LOOKUP} select key, slug from lookup")
def build_venue_lookup(spark, d):
    return V.build_venue_lookup(venues(spark, d))


@query(f"""with {VENUES}, {_LOOKUP}, n as (select c_custkey, case c_custkey % 4 when 0 then 'L’Atelier ' || (c_custkey % 120) when 1 then 'Grande soirée au Théâtre ' || (c_custkey % 120) || ' demain' when 2 then 'Salle-' || (c_custkey % 120) else c_name end as raw from customer),
x as (select raw, {_venue('raw')} as norm from (select distinct raw from n)), m as (select raw, coalesce(l.slug, (select arg_max(slug, (length(key), -ascii(key))) from lookup k where contains(x.norm, k.key))) as slug from x left join lookup l on l.key = x.norm)
select c_custkey, coalesce(slug, n.raw) as venue from n join m on n.raw = m.raw""")
def resolve_venue(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    raw = F.when(k % 4 == 0, s("L’Atelier ", k % 120)).when(k % 4 == 1, s("Grande soirée au Théâtre ", k % 120, " demain")).when(k % 4 == 2, s("Salle-", k % 120)).otherwise(F.col("c_name"))
    return V.resolve_venue(c.select("c_custkey", raw.alias("raw")), "raw", V.build_venue_lookup(venues(spark, d))).select("c_custkey", "venue")


@query(f"with {VENUES} select distinct slug from (select slug from ve union all select split_part(trim(unnest(aliases), '/'), '/', 2) from ve) where slug <> ''")
def known_slug_set(spark, d):
    return V.known_slugs(venues(spark, d))


@query(f"with {EVENTS}, {VENUES} select distinct l as slug from (select unnest(locations) as l from ev) where l not in (select slug from ve where ord % 3 > 0 union all select split_part(trim(unnest(aliases), '/'), '/', 2) from ve where ord % 3 > 0)")
def discover_unmapped_locations(spark, d):
    return V.discover_unmapped_locations(events(spark, d), venues(spark, d).where("ord % 3 > 0"))


@query(f"with {EVENTS}, {VENUES} select slug, title, type from ve where ord % 3 > 0 union all select distinct l, 'Salle ' || split_part(l, '-', 2), 'Lieu' from (select unnest(locations) as l from ev) where l not in (select slug from ve where ord % 3 > 0)")
def append_venue_stubs(spark, d):
    known = venues(spark, d).where("ord % 3 > 0")
    return V.append_venue_stubs(known, events(spark, d).select(F.explode("locations").alias("slug"))).select("slug", "title", "type")


@query()
def find_duplicate_venues(spark, d):
    """A row a venue: its class, the number of its links, and all pairs of its class with later ones."""
    v = venues(spark, d).withColumn("address", F.when(F.col("ord") % 2 == 0, F.col("address")).otherwise(""))
    return V.link_duplicate_venues(v)


@query(f"""with {VENUES}, dm as (select ord, slug, split_part(regexp_replace(regexp_replace(lower(website), '^https?://', ''), '^www\\.', ''), '/', 1) as domain from ve where website <> '')
select f.slug as a, x.slug as b, x.domain from dm x join dm f on f.domain = x.domain and f.ord = (select min(ord) from dm m where m.domain = x.domain) where x.ord > f.ord""")
def duplicate_domains(spark, d):
    return V.duplicate_domains(venues(spark, d))


@query(f"with {VENUES}, m as (select slug, array_to_string(list_filter([case when title = '' then 'title' end, case when description = '' then 'description' end, case when address = '' then 'address' end, case when website = '' then 'website' end], lambda x: x is not null), ',') as missing from ve) select * from m where missing <> ''")
def audit_venues(spark, d):
    return V.audit_venues(venues(spark, d)).select("slug", F.array_join("missing", ",").alias("missing"))


_PAGE = "concat_ws(chr(10), '---', 'title: \"' || title || '\"', 'description: \"' || description || '\"', 'address: \"' || address || '\"', 'website: \"' || website || '\"', 'type: \"' || case when type = '' then 'Salle de spectacle' else type end || '\"', 'aliases:' || chr(10) || '  - ' || aliases[1], '---', body)"


@query(f"with {VENUES} select slug, {_PAGE} as page from ve")
def render_venue_page(spark, d):
    return V.render_venue_page(venues(spark, d))


@query(f"with {VENUES} select slug, case when ord % 2 = 0 then 'created' else 'skipped' end as action from ve")
def plan_venue_pages(spark, d):
    v = venues(spark, d)
    there = v.where("ord % 2 = 1").select("slug", F.lit("something else").alias("page"), F.lit("text").alias("body"))
    return V.plan_venue_pages(v, there)


@query(f"with {VENUES} select slug, case ord % 4 when 0 then 'created' when 1 then 'unchanged' when 2 then 'updated' else 'skipped' end as action from ve")
def plan_venue_pages_diff(spark, d):
    v = venues(spark, d)
    same = V.render_venue_page(v.where("ord % 4 = 1")).withColumn("body", F.lit("x"))
    old = v.where("ord % 4 > 1").select("slug", F.lit("old").alias("page"), F.when(F.col("ord") % 4 == 2, " ").otherwise("x").alias("body"))
    return V.plan_venue_pages(v, same.unionByName(old))


@query(f"""with {VENUES} select slug, '{{"slug":"' || slug || '","title":"' || title || '"' || case when website = '' then '' else ',"website":"' || website || '"' end || '}}' as venue from ve where ord % 2 = 0
union all select 'shared', '{{"slug":"shared","title":"' || (select title from ve where ord = 1) || '"' || (select case when website = '' then '' else ',"website":"' || website || '"' end from ve where ord = 1) || '}}'""")
def export_venues(spark, d):
    v = venues(spark, d).withColumn("slug", F.when(F.col("ord") % 2 == 0, F.col("slug")).otherwise("shared"))
    return V.export_venues(v.select("ord", "slug", "title", "website"))


_SPLIT = f"new as (select * from ev where event_id % 3 = 0), pub as (select *, strftime(start_ts, '%Y/%m/%d/') || event_id || '.md' as path from ev where event_id % 3 > 0)"


def _new(spark, d):
    return events(spark, d).where("event_id % 3 = 0")


def _published(spark, d):
    path = F.concat(F.date_format("start_ts", "yyyy/MM/dd/"), F.col("event_id").cast("string"), F.lit(".md"))
    return events(spark, d).where("event_id % 3 > 0").withColumn("path", path)


@query(f"with {EVENTS} select event_id from ev where event_id % 3 > 0")
def anti_join_source_id(spark, d):
    """All events are new, and those of the numbers that 3 divides are published."""
    e = events(spark, d)
    return U.anti_join_source_id(e, e.where("event_id % 3 = 0")).select("event_id")


@query(f"with {EVENTS}, {_SPLIT}, l as (select {_url('event_url')} as u, max(path) as path from pub group by 1) select source_id, path, 0.95 as confidence from new join l on {_url('event_url')} = l.u".replace("0.95 as", "0.95::double as"))
def match_by_url(spark, d):
    return U.match_by_url(_new(spark, d), _published(spark, d)).drop("reason")


def _coarse(e):
    """All events of a day at one place and time, so that names decide."""
    return e.withColumns({"start_ts": F.date_trunc("day", F.col("start_ts")).cast("timestamp_ntz"), "location": F.lit("Salle unique")})


@query()
def match_by_date_time_location(spark, d):
    return U.match_by_date_time_location(_coarse(_new(spark, d)), _coarse(_published(spark, d))).drop("reason")


@query(f"with {EVENTS}, {_SPLIT} select n.source_id, p.path, 0.75::double as confidence from new n join pub p on {_name('n.name')} = {_name('p.name')} and cast(n.start_ts as date) = cast(p.start_ts as date)")
def match_by_name_date(spark, d):
    return U.match_by_name_date(_new(spark, d), _published(spark, d)).drop("reason")


@query()
def detect_duplicates(spark, d):
    return U.detect_duplicates(_coarse(_new(spark, d)), _coarse(_published(spark, d)))


@query(f"""with {EVENTS}, {_SPLIT}, l as (select {_url('event_url')} as u, max(path) as path from pub group by 1),
m as (select source_id, path, 0.95 as c, 'url' as r from new join l on {_url('event_url')} = l.u union all select n.source_id, p.path, 0.75, 'name_date' from new n join pub p on {_name('n.name')} = {_name('p.name')} and cast(n.start_ts as date) = cast(p.start_ts as date)),
b as (select source_id, max(c) as c, arg_min(path, (-c, path)) as path from m group by 1)
select n.source_id, b.path, coalesce(b.c, 0)::double as confidence, coalesce(b.c, 0) >= 0.7 as is_duplicate, coalesce(b.c, 0) >= 0.8 as should_merge from new n left join b on b.source_id = n.source_id""")
def combine_exact_matches(spark, d):
    """The combination over the two matchers that SQL can say too."""
    new, pub = _new(spark, d), _published(spark, d)
    matches = U.match_by_url(new, pub).unionByName(U.match_first_names(new, U.name_entries(pub)))
    return U.combine_matches(new, matches).select("source_id", "path", "confidence", "is_duplicate", "should_merge")


def _lettered(e):
    """Names of one letter each, of which two are the same or have none in common, in the slots of ``_coarse``."""
    return _coarse(e).withColumn("name", F.repeat(F.chr(97 + F.col("event_id") % 23), F.lit(9)))


_LETTERED = """n as (select source_id, event_url, cast(start_ts as date) as day, repeat(chr(cast(97 + event_id % 23 as integer)), 9) as name from new), p as (select path, event_url, cast(start_ts as date) as day, repeat(chr(cast(97 + event_id % 23 as integer)), 9) as name from pub),
s as (select n.source_id, min(p.path) as path from n join p on n.day = p.day and n.name = p.name group by 1)"""


@query(f"with {EVENTS}, {_SPLIT}, {_LETTERED} select source_id, path, 0.85::double as confidence from s")
def match_by_slot_of_plain_names(spark, d):
    """The matcher of day, time and place where SQL can say how alike names are."""
    return U.match_by_date_time_location(_lettered(_new(spark, d)), _lettered(_published(spark, d))).drop("reason")


_FOUND = f"""l as (select {_url('event_url')} as u, max(path) as path from p group by 1), m as (select source_id, l.path, 0.95 as c from n join l on {_url('n.event_url')} = l.u union all select source_id, path, 0.85 from s),
b as (select source_id, max(c) as c, arg_min(path, (-c, path)) as path, count(*) filter (c = 0.95) > 0 as by_url, count(*) filter (c = 0.85) > 0 as by_slot from m group by 1)
select n.source_id, b.path, coalesce(b.c, 0)::double as confidence, concat_ws(',', case when by_slot then 'date_time_location' end, case when by_url then 'url' end) as reasons, coalesce(b.c, 0) >= 0.7 as is_duplicate, coalesce(b.c, 0) >= 0.8 as should_merge, false as is_near from n left join b on b.source_id = n.source_id"""


@query(f"with {EVENTS}, {_SPLIT}, {_LETTERED}, {_FOUND}")
def detect_duplicates_of_plain_names(spark, d):
    """All three matchers where SQL can say how alike names are."""
    return U.detect_duplicates(_lettered(_new(spark, d)), _lettered(_published(spark, d)))


@query(f"with {EVENTS}, {_SPLIT}, {_LETTERED}, {_FOUND}")
def duplicate_index(spark, d):
    """The same from an index that was built from a part of the published events and refreshed twice."""
    new, pub = _lettered(_new(spark, d)), _lettered(_published(spark, d))
    folder = shared_folder(spark, "index")
    index = I.DuplicateIndex(spark, folder, "index_" + folder.rpartition("-")[2], I.buckets_for(pub.count()))
    k = F.col("event_id")
    wrong = pub.where(k % 4 > 0).withColumns({"event_url": F.when(k % 4 == 1, "https://old.example.com/").otherwise(F.col("event_url")), "location": F.when(k % 4 == 2, "Autre salle").otherwise(F.col("location"))})
    index.refresh(wrong)
    index.refresh(pub.where(k % 4 == 0))
    index.refresh(pub.where(k % 4 > 0), wrong)
    return index.detect(new)


@query(f"with {EVENTS} select count(distinct {_url('event_url')}) as total_urls, count(distinct strftime(start_ts, '%Y-%m-%d|%H:%M|') || {_name('location')}) as total_date_locations, count(distinct {_name('name')}) as total_names from ev")
def duplicate_index_stats(spark, d):
    return U.duplicate_index_stats(events(spark, d))


@query(f"""with {EVENTS}, {_SPLIT}, l as (select {_url('event_url')} as u, max(path) as path from pub group by 1),
f as (select l.path, list(source_id order by event_id) as ids, arg_min(image, event_id) filter (where image <> '') as img from new join l on {_url('event_url')} = l.u group by 1)
select p.path, case when p.image = '' then coalesce(f.img, '') else p.image end as image, array_to_string(case when f.ids is null then [] else list_concat([p.source_id], f.ids) end, ',') as source_ids, (p.image = '' and f.img is not null)::integer + (f.ids is not null)::integer as n_changes from pub p left join f on f.path = p.path""")
def merge_duplicates(spark, d):
    new, pub = _new(spark, d), _published(spark, d)
    found = U.match_by_url(new, pub).select("source_id", "path").join(new, "source_id").select("path", F.col("event_id").alias("ord"), "description", "image", "event_url", "source_id")
    none = F.array().cast("array<string>")
    base = pub.withColumns({"alternate_sources": none, "source_ids": none, "last_crawled": F.lit(None).cast("timestamp_ntz")})
    merged = U.merge_duplicates(base, found, as_of())
    return merged.select("path", "image", F.array_join("source_ids", ",").alias("source_ids"), F.size("changes").alias("n_changes"))


@query(f"""with {EVENTS}, {_SPLIT}, l as (select {_url('event_url')} as u, max(path) as path from pub group by 1),
f as (select l.path, list(source_id order by event_id) as ids, arg_min(image, event_id) filter (where image <> '') as img from new join l on {_url('event_url')} = l.u group by 1)
select p.path, p.event_id, case when p.image = '' then coalesce(f.img, '') else p.image end as image, array_to_string(case when f.ids is null then [] else list_concat([p.source_id], f.ids) end, ',') as source_ids, case when f.ids is not null then '1998-06-01 12:00:00' end as last_crawled from pub p left join f on f.path = p.path""")
def merge_into_snapshots(spark, d):
    """The merge written back to a stored table in two changes, and its last version read."""
    new, pub = _new(spark, d), _published(spark, d)
    found = U.match_by_url(new, pub).select("source_id", "path").join(new, "source_id").select("path", F.col("event_id").alias("ord"), "description", "image", "event_url", "source_id")
    none = F.array().cast("array<string>")
    base = pub.withColumns({"alternate_sources": none, "source_ids": none, "last_crawled": F.lit(None).cast("timestamp_ntz")})
    # the matches are found once, not for the buckets and the rows of each change
    there = shared_folder(spark, "found")
    found.write.parquet(there)
    found = spark.read.parquet(there)
    table = SnapshotTable(spark, shared_folder(spark, "snapshots"), buckets=8)
    table.create(base)
    half = F.pmod(F.xxhash64("path"), F.lit(2))  # all rows of a path come at once
    for k in (0, 1):
        U.merge_into(table, found.where(half == k), as_of())
    return table.read().select("path", "event_id", "image", F.array_join("source_ids", ",").alias("source_ids"), F.date_format("last_crawled", "yyyy-MM-dd HH:mm:ss").alias("last_crawled"))


@query(f"""with {EVENTS}, {_SPLIT}, l as (select {_url('event_url')} as u, max(path) as path from pub group by 1),
f as (select l.path, new.* from new join l on {_url('event_url')} = l.u), p as (select f.*, pub.image as old_image, pub.source_id as old_id, pub.event_url as old_url,
  min(case when f.image <> '' then f.event_id end) over (partition by f.path) as first_image, row_number() over (partition by f.path, f.event_url order by f.event_id) as nth_url from f join pub on pub.path = f.path)
select path, event_id, source_id, source_id <> old_id or (old_image = '' and event_id = first_image) or (event_url <> old_url and nth_url = 1) as changed from p""")
def merge_steps(spark, d):
    new, pub = _new(spark, d), _published(spark, d)
    found = U.match_by_url(new, pub).select("source_id", "path").join(new, "source_id").select("path", F.col("event_id").alias("ord"), "description", "image", "event_url", "source_id")
    none = F.array().cast("array<string>")
    steps = U.merge_steps(pub.withColumns({"alternate_sources": none, "source_ids": none}), found)
    return steps.select("path", F.col("ord").alias("event_id"), "source_id", "changed")


_FILE = f"strftime(start_ts, '%Y/%m/%d/') || {_slug('name')} || '.fr.md'"
# a row is settled as failed, merged or a duplicate before files come in; what is left makes the first file of its path
_ACTIONS = f"""raw as (select *, event_id % 7 = 0 as nameless from ev where event_id % 3 = 0), new as (select *, case when not nameless then {_FILE} end as fp from raw),
old as (select distinct {_FILE} as fp from ev where event_id % 6 = 1),
settled as (select *, case when nameless then 'failed' when event_id % 30 = 0 and event_id % 4 = 0 then 'updated' when event_id % 30 = 0 or event_id % 5 = 1 then 'skipped_duplicate' end as v from new),
makers as (select fp, min(event_id) as maker from settled where v is null and fp not in (select fp from old) group by fp),
act as (select source_id, case when v in ('updated', 'skipped_duplicate') then 'pub' || (event_id % 10) || '.md' else s.fp end as file_path,
  coalesce(v, case when event_id = maker then 'created' else 'skipped_exists' end) as action,
  case v when 'failed' then 'No name or date' when 'updated' then 'Merged: url' when 'skipped_duplicate' then 'Duplicate: url' else case when event_id = maker then '' else 'File already exists' end end as reason
  from settled s left join makers m on m.fp = s.fp)"""


def _actions(spark, d):
    """Rows without a name, duplicates in front of others of their path, merges that change nothing, and decisions given twice."""
    e = events(spark, d)
    k = F.col("event_id")
    new = e.where("event_id % 3 = 0").withColumns({"ord": k, "name": F.when(k % 7 != 0, F.col("name"))})
    path = F.concat(F.lit("pub"), (k % 10).cast("string"), F.lit(".md"))
    dup = new.select("source_id", path.alias("path"), F.lit("url").alias("reasons"), ((k % 30 == 0) | (k % 5 == 1)).alias("is_duplicate"), (k % 30 == 0).alias("should_merge"))
    dup = dup.unionByName(dup.where("is_duplicate"))
    old = e.where("event_id % 6 = 1").select(P.event_file_path(F.col("start_ts"), T.slugify(F.col("name"))).alias("path"))
    return P.publish_actions(new, dup, old, new.where(k % 4 == 0).select("source_id"))


@query(f"with {EVENTS}, {_ACTIONS} select * from act")
def publish_actions(spark, d):
    return _actions(spark, d)


@query(f"with {EVENTS}, {_ACTIONS} select action, count(*) as n from act group by action")
def publish_stats(spark, d):
    return P.publish_stats(_actions(spark, d))


_DAYS = "['lundi','mardi','mercredi','jeudi','vendredi','samedi','dimanche']"
_PLAIN = "['janvier','fevrier','mars','avril','mai','juin','juillet','aout','septembre','octobre','novembre','decembre']"


@query(f"""with {EVENTS} select event_id, '{{"title":"' || name || '","slug":"' || {_slug('name')} || '","date":"' || strftime(start_ts, '%Y-%m-%dT%H:%M:%S') || '","draft":' || draft || ',"expiryDate":"' || strftime(date_trunc('day', start_ts) + interval 1 day, '%Y-%m-%dT%H:%M:%S') || '","name":"' || name || '","eventURL":"' || event_url || '","startTime":"' || strftime(start_ts, '%H:%M') || '","description":"' || description || '"'
 || case when image = '' then '' else ',"image":"' || image || '"' end || ',"sourceId":"' || source_id || '","dates":["' || ({_DAYS})[isodow(start_ts)] || '-' || strftime(start_ts, '%d') || '-' || ({_PLAIN})[month(start_ts)] || '"],"lastCrawled":"1998-06-01T12:00:00","expired":false}}' as front_matter from ev""")
def to_front_matter(spark, d):
    none = F.lit(None).cast("string")
    return P.to_front_matter(events(spark, d).withColumns({"day_of": none, "event_group_id": none}), as_of())


@query()
def render_event_markdown(spark, d):
    none = F.lit(None).cast("string")
    return P.render_event_markdown(events(spark, d).withColumns({"day_of": none, "event_group_id": none}), as_of())


@query(f"with {EVENTS} select event_id, strftime(date_trunc('day', start_ts) + case event_id % 3 when 0 then interval 20 hour when 1 then to_minutes(cast((event_id % 24) * 60 + 15 as integer)) else interval 0 hour end, '%Y-%m-%d %H:%M') as start from ev")
def to_event(spark, d):
    k = F.col("event_id")
    e = events(spark, d).withColumns({"date": F.col("start_ts"), "time": F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat((k % 24).cast("string"), F.lit("h15"))).otherwise("bientôt")})
    return P.to_event(e).select("event_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm").alias("start"))


@query(f"with {EVENTS} select event_id, concat_ws(',', case when event_id % 7 = 0 then 'name' end, case when event_id % 11 = 0 then 'event_url' end) as reason from ev where event_id % 7 = 0 or event_id % 11 = 0")
def validate_event(spark, d):
    k = F.col("event_id")
    e = events(spark, d).withColumns({"name": F.when(k % 7 != 0, F.col("name")), "event_url": F.when(k % 11 == 0, "").otherwise(F.col("event_url"))})
    return P.validate_event(e)[1].select("event_id", "reason")


@query(f"with {EVENTS} select event_id, name as title, '/events/' || strftime(start_ts, '%Y/%m/%d/') || {_slug('name')} || '/' as link, strftime(start_ts, '%Y-%m-%d') as date from ev where not expired and not draft")
def feed_rows(spark, d):
    from ..operators.calendar import active_events

    return P.feed_rows(active_events(events(spark, d)))


@query("select url as loc, 'daily' as changefreq, 0.5::double as priority from pages where page_id % 5 not in (1, 2)")
def sitemap_rows(spark, d):
    k = F.col("page_id") % 5
    return P.sitemap_rows(table(spark, d, "pages").select(F.col("url").alias("loc"), F.when(k == 1, "taxonomy").when(k == 2, "term").otherwise("page").alias("kind")))
