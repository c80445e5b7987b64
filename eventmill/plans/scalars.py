"""Queries of the column functions, over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U
from .views import AS_OF, EVENTS, as_of, events, query, table

# DuckDB spellings of the shared steps.
def _name(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def _venue(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(replace(replace(lower({x}), 'œ', 'oe'), 'æ', 'ae')), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _slug(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(replace(replace(replace(lower({x}), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '-')"


def _url(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '^https?://', ''), '^www\.', ''), '/+$', ''), '\?utm_.*$', ''), '\?ref=.*$', '')"


_MONTHS = "['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre']"
_PLAIN = "['janvier','fevrier','mars','avril','mai','juin','juillet','aout','septembre','octobre','novembre','decembre']"
_DAYS = "['lundi','mardi','mercredi','jeudi','vendredi','samedi','dimanche']"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _digest(df: DataFrame, c: F.Column) -> DataFrame:
    return df.select("doc_id", F.md5(c.cast("binary")).alias("digest"), F.length(c).alias("n"))


@query(r"select doc_id, md5(x) as digest, length(x) as n from (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as x from documents)")
def clean_text(spark, d):
    return _digest(_docs(spark, d), T.clean_text(F.col("text")))


@query("select doc_id, md5(x) as digest, length(x) as n from (select doc_id, case when length(text) <= 160 then text else regexp_replace(left(text, 157), ' [^ ]*$', '') || '...' end as x from documents)")
def truncate_words(spark, d):
    return _digest(_docs(spark, d), T.truncate_words(F.col("text")))


@query("select doc_id, case when length(text) <= 160 then text else left(text, 157) || '...' end as cut from documents")
def truncate_chars(spark, d):
    return _docs(spark, d).select("doc_id", T.truncate_chars(F.col("text")).alias("cut"))


@query(r"""select page_id, md5(x) as digest from (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#8217;', chr(39)), '&#8216;', chr(39)), '&#8220;', chr(34)), '&#8221;', chr(34)), '&nbsp;', ' '), '\s+', ' ', 'g')) as x from pages)""")
def clean_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.clean_html(F.col("html")).cast("binary")).alias("digest"))


@query(r"select doc_id, md5(x) as digest from (select doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g') || ' été &amp; <fin>', '\s+', ' ', 'g')) as x from documents)")
def sanitize_description(spark, d):
    """Texts with entities, a script link and a handler behind them."""
    added = """ <b>&eacute;t&#233;</b> &amp;amp; href="javascript:run()" onclick='go()' &lt;fin&#x3E;"""
    return _docs(spark, d).select("doc_id", F.md5(T.sanitize_description(F.concat(F.coalesce("text", F.lit("")), F.lit(added))).cast("binary")).alias("digest"))


@query("select doc_id, md5(strip_accents(text)) as digest from documents")
def strip_accents(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.strip_accents(F.col("text")).cast("binary")).alias("digest"))


@query(f"select doc_id, md5(x) as digest from (select doc_id, {_venue('text')} as x from documents)")
def normalize_venue_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalize_venue_text(F.col("text")).cast("binary")).alias("digest"))


@query(f"select doc_id, md5(x) as digest from (select doc_id, {_name('text')} as x from documents)")
def normalize_name(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalize_name(F.col("text")).cast("binary")).alias("digest"))


@query(f"select page_id, {_url('url')} as url_key from pages")
def normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url_key"))


@query(r"select page_id, split_part(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '^www\.', ''), '/', 1) as domain from pages")
def extract_domain(spark, d):
    return table(spark, d, "pages").select("page_id", U.extract_domain(F.col("url")).alias("domain"))


@query(f"select doc_id, md5(x) as digest from (select doc_id, {_slug('text')} as x from documents)")
def slugify(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.slugify(F.col("text")).cast("binary")).alias("digest"))


@query(r"select doc_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 50) as slug from documents")
def sanitize_slug(spark, d):
    return _docs(spark, d).select("doc_id", T.sanitize_slug(F.col("text")).alias("slug"))


@query("select page_id, replace(replace(url, '/', '-'), '-', ' ') as words from pages")
def slug_to_words(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug_to_words(F.replace("url", F.lit("/"), F.lit("-"))).alias("words"))


@query(f"""with s as (select doc_id, string_split({_slug("left(text, 60)")}, '-') as w from documents)
select doc_id, array_to_string(list_transform(w, lambda x, i: case when i > 1 and list_contains(['de','des','du','d','la','le','les','l','et','en','a','au','aux'], x) then x else upper(left(x, 1)) || lower(substr(x, 2)) end), ' ') as title from s""")
def slug_to_title(spark, d):
    return _docs(spark, d).select("doc_id", T.slug_to_title(T.slugify(F.left("text", F.lit(60)))).alias("title"))


@query(r"with s as (select page_id, '/locations/' || split_part(url, '/', 3) || '/' as p from pages union all select page_id, url as p from pages) select page_id, regexp_extract(p, '^/*locations/([^/]+)', 1) as slug from s")
def alias_to_slug(spark, d):
    pages = table(spark, d, "pages")
    paths = pages.select("page_id", F.concat(F.lit("/locations/"), F.get(F.split("url", "/"), F.lit(2)), F.lit("/")).alias("p")).unionByName(pages.select("page_id", F.col("url").alias("p")))
    return paths.select("page_id", T.alias_to_slug(F.col("p")).alias("slug"))


@query(rf"select doc_id, regexp_replace({_venue('left(text, 80)')}, '^((le|la|les|l|un|une|des|du|de|d)( +|$))+', '') as bare from documents")
def strip_articles(spark, d):
    return _docs(spark, d).select("doc_id", T.strip_articles(T.normalize_venue_text(F.left("text", F.lit(80)))).alias("bare"))


@query(r"select page_id, 'src' || (page_id % 15) || ':' || split_part(trim(regexp_extract(url, '^[^/?#]*//[^/?#]*([^?#]*)', 1), '/'), '/', -1) as segment_id, 'src' || (page_id % 15) || ':' || regexp_replace(trim(regexp_extract(url, '^[^/?#]*//[^/?#]*([^?#]*)', 1), '/'), '\.html$', '') as path_id from pages")
def source_id_from_url(spark, d):
    source = F.concat(F.lit("src"), (F.col("page_id") % 15).cast("string"))
    return table(spark, d, "pages").select("page_id", U.source_id_from_url(source, F.col("url")).alias("segment_id"), U.source_id_from_url(source, F.col("url"), "path").alias("path_id"))


@query(f"with {EVENTS} select event_id, source_id || ':' || strftime(start_ts, '%Y%m%d-%H%M') as with_time, source_id || ':' || strftime(start_ts, '%Y%m%d') as with_day from ev")
def showtime_id(spark, d):
    return events(spark, d).select("event_id", U.showtime_id(F.col("source_id"), F.col("start_ts")).alias("with_time"), U.showtime_id(F.col("source_id"), F.col("start_ts"), False).alias("with_day"))


@query(rf"with {EVENTS} select event_id, strftime(start_ts, '%Y/%m/') || (case when {_slug('name')} = '' then 'image' else {_slug('name')} end) || '-' || left(md5(image), 8) || '.jpg' as file from ev where image <> ''")
def image_file_name(spark, d):
    rows = events(spark, d).where("image <> ''")
    return rows.select("event_id", U.image_file_name(F.col("image"), T.slugify(F.col("name")), F.col("start_ts")).alias("file"))


@query("""with u as (select page_id, case page_id % 6 when 0 then url when 1 then 'ftp' || substr(url, 5) when 2 then 'http://10.0.' || (page_id % 250) || '.7/x' when 3 then 'http://172.' || (page_id % 40) || '.0.1/' when 4 then 'http://localhost/' || page_id else 'https://93.184.' || (page_id % 250) || '.34/' end as u from pages)
select page_id, u as url, case page_id % 6 when 0 then true when 3 then page_id % 40 not between 16 and 31 when 5 then true else false end as safe from u""")
def is_safe_url(spark, d):
    k = F.col("page_id")
    s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    made = (
        F.when(k % 6 == 0, F.col("url")).when(k % 6 == 1, s("ftp", F.expr("substr(url, 5)"))).when(k % 6 == 2, s("http://10.0.", k % 250, ".7/x"))
        .when(k % 6 == 3, s("http://172.", k % 40, ".0.1/")).when(k % 6 == 4, s("http://localhost/", k)).otherwise(s("https://93.184.", k % 250, ".34/"))
    )
    return table(spark, d, "pages").select("page_id", made.alias("url"), U.is_safe_url(made).alias("safe"))


@query(rf"with {EVENTS} select event_id, name || case when draft then ' - brouillon' else '' end as title, {_slug('name')} as slug, strftime(start_ts, '%H:%M') as start_time, strftime(start_ts, '%Y/%m/%d/') || {_slug('name')} || '.fr.md' as path, '/events/' || strftime(start_ts, '%Y/%m/%d/') || {_slug('name')} || '/' as permalink from ev")
def event_fields(spark, d):
    from ..operators.publish import event_file_path, event_title

    slug = T.slugify(F.col("name"))
    return events(spark, d).select("event_id", event_title(F.col("name"), F.when(F.col("draft"), "brouillon")).alias("title"), slug.alias("slug"), D.start_time(F.col("start_ts")).alias("start_time"), event_file_path(F.col("start_ts"), slug).alias("path"), U.event_permalink(F.col("start_ts"), slug).alias("permalink"))


@query(f"with {EVENTS} select event_id, strftime(date_trunc('day', start_ts) + interval 1 day, '%Y-%m-%d %H:%M:%S') as expires from ev")
def expiry_ts(spark, d):
    return events(spark, d).select("event_id", F.date_format(D.expiry_ts(F.col("start_ts")), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query(f"select o_orderkey, ({_DAYS})[isodow(o_orderdate)] || '-' || strftime(o_orderdate, '%d') || '-' || ({_PLAIN})[month(o_orderdate)] as term, day(o_orderdate) || ' ' || ({_MONTHS})[month(o_orderdate)] || ' ' || year(o_orderdate) as spoken from orders")
def french_date_terms(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.french_date_term(F.col("o_orderdate")).alias("term"), D.format_french_date_long(F.col("o_orderdate")).alias("spoken"))


@query("select o_orderkey, strftime(case when o_orderkey % 5 = 4 then make_timestamp(1998, month(o_orderdate), day(o_orderdate), 0, 0, 0) else date_trunc('day', o_orderdate) end, '%Y-%m-%d') as day from (select o_orderkey, case when o_orderkey % 5 = 4 and month(o_orderdate) = 2 and day(o_orderdate) = 29 then null else o_orderdate end as o_orderdate from orders)")
def parse_date_generic(spark, d):
    """Dates written in five ways and read back; the last has no year, so that 29 February is no date in 1998."""
    o = table(spark, d, "orders")
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, D.format_french_date_long(t)).when(k == 1, F.date_format(t, "dd/MM/yyyy")).when(k == 2, F.date_format(t, "dd-MM-yyyy")).when(k == 3, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "dd/MM"))
    return o.select("o_orderkey", F.date_format(D.parse_date_generic(text, as_of()), "yyyy-MM-dd").alias("day"))


@query("select o_orderkey, lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':' || (case when o_orderkey % 3 = 2 then '00' else lpad(cast(o_custkey % 60 as varchar), 2, '0') end) as generic, case when o_orderkey % 3 = 1 or o_orderkey % 3 = 0 then (o_orderkey % 24) * 60 + o_custkey % 60 else (o_orderkey % 24) * 60 end as minutes from orders")
def parse_times(spark, d):
    o = table(spark, d, "orders")
    h, m, k = (F.col("o_orderkey") % 24).cast("string"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"), F.col("o_orderkey") % 3
    text = F.concat(F.lit("ouverture à "), h, F.when(k == 0, F.concat(F.lit("h"), m)).when(k == 1, F.concat(F.lit(":"), m)).otherwise(F.lit("h")), F.lit(" précises"))
    return o.select("o_orderkey", D.parse_time_generic(text).alias("generic"), D.parse_french_time(text).cast("long").alias("minutes"))


@query("select o_orderkey, strftime(date_trunc('day', o_orderdate) + case o_orderkey % 3 when 0 then interval 20 hour when 1 then to_minutes(cast((o_orderkey % 24) * 60 + 30 as integer)) else interval 20 hour end, '%Y-%m-%d %H:%M') as start from orders")
def parse_french_date(spark, d):
    """With the default time, with a time, and as the start of a range."""
    o = table(spark, d, "orders")
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    long = D.format_french_date_long(t)
    month = F.element_at(F.split(long, " "), 2)
    text = F.when(k == 0, F.concat(F.lit("Mardi "), long)).when(k == 1, F.concat(long, F.lit(" à "), (F.col("o_orderkey") % 24).cast("string"), F.lit("h30"))).otherwise(F.concat(F.lit("Du "), F.dayofmonth(t).cast("string"), F.lit(" "), month, F.lit(" au 28 décembre "), F.year(t).cast("string")))
    return o.select("o_orderkey", F.date_format(D.parse_french_date(text, as_of()), "yyyy-MM-dd HH:mm").alias("start"))


@query(f"select o_orderkey, case when floor(date_diff('second', make_timestamp(1998, month(o_orderdate), day(o_orderdate), 0, 0, 0), timestamp '{AS_OF}') / 86400.0) > 30 then 1999 else 1998 end as year from (select o_orderkey, case when month(o_orderdate) = 2 and day(o_orderdate) = 29 then null else o_orderdate end as o_orderdate from orders)")
def infer_year(spark, d):
    """29 February is no day of 1998, so that no year can be told."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", D.infer_year(F.month("o_orderdate"), F.dayofmonth("o_orderdate"), as_of()).cast("long").alias("year"))


@query("""with o as (select o_orderkey as k, year(o_orderdate) as y, month(o_orderdate) as m, cast(1 + o_orderkey % 20 as integer) as a, cast(3 + o_orderkey % 20 as integer) as b from orders),
d as (select k, y, m, unnest(case k % 3 when 0 then generate_series(a, b) when 1 then [a, a + 1, b] else [b] end) as dd from o)
select k as o_orderkey, strftime(make_timestamp(y, m, cast(dd as bigint), 20, 0, 0), '%Y-%m-%d %H:%M') as start from d""")
def expand_french_dates(spark, d):
    """Ranges, lists and ends written in French and unfolded to one row a date."""
    o = table(spark, d, "orders")
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    a, b = (1 + k % 20).cast("string"), (3 + k % 20).cast("string")
    tail = F.concat(F.lit(" "), F.element_at(F.split(D.format_french_date_long(t), " "), 2), F.lit(" "), F.year(t).cast("string"))
    text = F.when(k % 3 == 0, F.concat(F.lit("Du "), a, F.lit(" au "), b, tail)).when(k % 3 == 1, F.concat(a, F.lit(", "), (2 + k % 20).cast("string"), F.lit(" et "), b, tail)).otherwise(F.concat(F.lit("Jusqu'au "), b, tail))
    return o.select("o_orderkey", F.explode(D.expand_french_dates(text, as_of())).alias("t")).select("o_orderkey", F.date_format("t", "yyyy-MM-dd HH:mm").alias("start"))


@query("select o_orderkey, strftime(o_orderdate + to_hours(cast(o_orderkey % 24 as integer)), '%Y-%m-%d %H:%M:%S') as local from orders")
def parse_iso_local(spark, d):
    """Naive texts, texts with an offset of zero in a zone of zero, and dates at midnight."""
    o = table(spark, d, "orders")
    t = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("o_orderkey") % 3 == 0, iso).when(F.col("o_orderkey") % 3 == 1, F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit(".000000Z")))
    return o.select("o_orderkey", F.date_format(D.parse_iso_local(text, "UTC"), "yyyy-MM-dd HH:mm:ss").alias("local"))


@query(f"with {EVENTS} select event_id, strftime(case when hour(start_ts) = 0 and minute(start_ts) = 0 then start_ts + interval 20 hour else start_ts end, '%Y-%m-%d %H:%M') as start from ev")
def default_midnight_to_20h(spark, d):
    return events(spark, d).select("event_id", F.date_format(D.default_midnight_to_20h(F.col("start_ts")), "yyyy-MM-dd HH:mm").alias("start"))


@query("select doc_id, regexp_matches(lower(text), 'janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|fevrier|aout|decembre') or regexp_matches(lower(text), '^du\\s+[0-9]') or starts_with(lower(text), 'jusqu') as dated from documents".replace("\\\\", "\\"))
def looks_like_date(spark, d):
    return _docs(spark, d).select("doc_id", D.looks_like_date(F.col("text")).alias("dated"))


@query()
def name_similarity(spark, d):
    """Matching-block similarity of every event's name to its description; SQL has no such function."""
    ratio = T.name_similarity(F.col("name"), F.col("description"))
    return events(spark, d).select("event_id", F.round(ratio, 6).alias("ratio"))


@query(f"with {EVENTS}, x as (select event_id, event_id % 9 + 1 as n, event_id % 7 as m, event_id % 5 as k from ev) select event_id, round(2.0 * n / (2 * n + m + k), 6)::double as ratio from x")
def similarity_of_plain_names(spark, d):
    """The same of names that begin alike and then have no letter in common, where SQL can say how alike they are."""
    e, k = events(spark, d), F.col("event_id")
    letters = lambda c, n: F.repeat(F.lit(c), n.cast("int"))
    ratio = T.name_similarity(F.concat(letters("a", k % 9 + 1), letters("b", k % 7)), F.concat(letters("a", k % 9 + 1), letters("c", k % 5)))
    return e.select("event_id", F.round(ratio, 6).alias("ratio"))


@query(f"with {EVENTS}, x as (select event_id, {_name('name')} as a, {_name('description')} as b from ev) select event_id, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) as ratio from x")
def edit_similarity(spark, d):
    """The built-in alternative over the same pairs."""
    ratio = T.edit_similarity(T.normalize_name("name"), T.normalize_name("description"))
    return events(spark, d).select("event_id", F.round(ratio, 6).alias("ratio"))
