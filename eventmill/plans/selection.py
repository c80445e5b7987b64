"""Queries of selection, categories and classification, over orders read as events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import classify as C
from ..operators import rules as R
from ..operators import select as S
from .views import AS_OF, EVENTS, as_of, events, query, table

RULES = R.SelectionRules(
    include_types=("economy", "standard", "promo", "medium"), exclude_types=("LARGE",), positive=("red", "small", "Widget"), negative=("bolt machinery", "AUTOMOBILE"),
    exclude_locations=("brand#2 ", "Salle 13"), local_keywords=("salle-1", "salle 2"), category_mapping=(("econ", "musique"), ("promo", "danse"), ("m", "theatre")),
    default_category="communaute", min_days_ahead=0, max_days_ahead=900,
)
CLASSES = R.ClassifierRules(
    source=(("promo", "art"),), venue=(("salle 7", None), ("salle 1", "musique"), ("salle 2", "danse")),
    words={"danse": ("red", "blue ring"), "musique": ("widget", "ring", "brand#1"), "theatre": ("small", "household"), "art": ("gear", "economy"), "communaute": ("bolt", "building")},
)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]::varchar[]"


_TEXT = "lower(concat_ws(' ', coalesce(name, ''), coalesce(location, ''), coalesce(description, ''), coalesce(category, '')))"
_FIRST = lambda words, text="t": f"list_filter({_list(words)}, lambda k: contains({text}, lower(k)))[1]"
_CHECKS = f"""sel as (
  select *, {_FIRST(RULES.negative)} as neg, {_FIRST(RULES.exclude_types)} as typ,
    case when not (location <> '' and len(list_filter({_list(RULES.local_keywords)}, lambda k: contains(lower(location), replace(lower(k), '-', ' ')) or contains(replace(lower(k), '-', ' '), lower(location)))) > 0) then {_FIRST(RULES.exclude_locations)} end as loc,
    case when start_ts < date_trunc('day', timestamp '{AS_OF}') then 'past_date' when start_ts > date_trunc('day', timestamp '{AS_OF}') + interval {RULES.max_days_ahead} day then 'max_days' end as dat,
    len(list_filter({_list(RULES.include_types)}, lambda k: contains(t, lower(k)))) > 0 as inc,
    array_to_string(list_filter({_list(RULES.positive)}, lambda k: contains(t, lower(k))), ', ') as pos
  from (select *, {_TEXT} as t from ev)
), judged as (
  select *, case when neg is not null then 'negative_keyword' when typ is not null then 'excluded_type' when loc is not null then 'excluded_location' when dat is not null then dat when not inc then 'no_included_type' end as failed from sel
)"""


@query(f"with {EVENTS}, {_CHECKS} select event_id, failed is null as accepted, coalesce(failed, case when pos <> '' then 'positive_keywords' else 'all_criteria' end) as criterion, case when failed is null then pos else coalesce(neg, typ, loc, '') end as detail from judged")
def select_events(spark, d):
    return S.select_events(events(spark, d), RULES, as_of()).select("event_id", "accepted", "criterion", "detail")


@query(f"with {EVENTS} select event_id, array_to_string(list_filter([case when event_id % 7 = 0 then 'name' end, case when event_id % 11 = 0 then 'date' end, case when event_id % 13 = 0 then 'location' end], lambda x: x is not null), ',') as missing from ev")
def check_required_fields(spark, d):
    e = events(spark, d).withColumns({"name": F.when(F.col("event_id") % 7 != 0, F.col("name")), "start_ts": F.when(F.col("event_id") % 11 != 0, F.col("start_ts")), "location": F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("location"))})
    rules = R.SelectionRules(required=("name", "date", "location"))
    return e.select("event_id", F.array_join(S.missing_fields(rules), ",").alias("missing"))


@query(f"with {EVENTS}, {_CHECKS} select event_id, neg as keyword from judged where neg is not null")
def check_negative_keywords(spark, d):
    return events(spark, d).select("event_id", R.first_hit(S.event_text(), RULES.negative).alias("keyword")).where("keyword is not null")


@query(f"with {EVENTS}, {_CHECKS} select event_id, typ as keyword from judged where typ is not null")
def check_excluded_types(spark, d):
    return events(spark, d).select("event_id", R.first_hit(S.event_text(), RULES.exclude_types).alias("keyword")).where("keyword is not null")


@query(f"with {EVENTS}, {_CHECKS} select event_id, loc as keyword from judged where loc is not null")
def check_excluded_locations(spark, d):
    return events(spark, d).select("event_id", S.excluded_location(RULES).alias("keyword")).where("keyword is not null")


@query(f"with {EVENTS}, {_CHECKS} select event_id, dat as fault from judged where dat is not null")
def check_date_window(spark, d):
    return events(spark, d).select("event_id", S.date_fault(RULES, as_of()).alias("fault")).where("fault is not null")


@query(f"with {EVENTS}, {_CHECKS} select event_id, inc as included from judged")
def check_included_types(spark, d):
    return events(spark, d).select("event_id", S.included_type(RULES).alias("included"))


@query(f"with {EVENTS}, {_CHECKS} select event_id, pos as words from judged where pos <> ''")
def find_positive_keywords(spark, d):
    return events(spark, d).select("event_id", F.array_join(R.hits(S.event_text(), RULES.positive), ", ").alias("words")).where("words <> ''")


_TERMS = "k as (select lower(p_name) as word from part union select lower(p_brand) from part union select lower(p_type) from part union select lower(p_brand) || '0' from part union select 'absent ' || (r_regionkey * 30 + i) from region, range(30) s(i))"


@query(f"with {EVENTS}, {_TERMS}, t as (select event_id, {_TEXT} as t from ev) select event_id, string_agg(word, ', ' order by word) as words from t join k on contains(t.t, k.word) group by 1")
def find_many_keywords(spark, d):
    """A rule list of some hundred words, more than a plan should hold, read by an automaton."""
    p = table(spark, d, "part")
    brand = F.lower("p_brand")
    words = p.select(F.explode(F.array(F.lower("p_name"), brand, F.lower("p_type"), F.concat(brand, F.lit("0")))).alias("w")).distinct()
    absent = table(spark, d, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i")).select(F.concat(F.lit("absent "), (F.col("r_regionkey") * 30 + F.col("i")).cast("string")).alias("w"))
    rules = sorted(r["w"] for r in words.unionByName(absent).collect())  # configuration: names, brands and types have few values
    return events(spark, d).select("event_id", F.array_join(R.hits(S.event_text(), rules), ", ").alias("words")).where("words <> ''")


@query(f"with {EVENTS} select event_id, case when contains(category, 'econ') then 'musique' when contains(category, 'promo') then 'danse' when contains(category, 'm') then 'theatre' else 'communaute' end as mapped from ev")
def map_category(spark, d):
    return events(spark, d).select("event_id", S.map_category(F.col("category"), RULES).alias("mapped"))


@query("""with k as (select page_id, url, case page_id % 4 when 0 then 'MusicEvent' when 1 then 'DanceEvent' when 2 then 'special' else 'Event' end as kind from pages)
select page_id, case when kind = 'special' then 'art' when kind = 'MusicEvent' then 'musique' when kind = 'DanceEvent' then 'danse' when split_part(url, '/', 4) = 'fr' then 'theatre' when split_part(url, '/', 4) = 'de' then 'art' else 'communaute' end as category from k""")
def map_category_schema_type(spark, d):
    k = F.col("page_id") % 4
    kind = F.when(k == 0, "MusicEvent").when(k == 1, "DanceEvent").when(k == 2, "special").otherwise("Event")
    mapped = S.map_category_schema_type(kind, F.col("url"), [("MusicEvent", "musique"), ("DanceEvent", "danse")], [("fr", "theatre")], [("special", "art"), ("de", "art")], "communaute")
    return table(spark, d, "pages").select("page_id", mapped.alias("category"))


@query("select o_orderkey, case when o_orderkey % 9 in (1, 4) then 'musique' when (o_orderkey + 1) % 9 in (1, 4) then 'musique' when o_orderkey % 9 = 7 or (o_orderkey + 1) % 9 = 7 then 'art' end as category from orders")
def map_category_ids(spark, d):
    ids = F.array((F.col("o_orderkey") % 9).cast("int"), ((F.col("o_orderkey") + 1) % 9).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", S.map_category_ids(ids, [(1, "musique"), (4, "musique"), (7, "art")]).alias("category"))


@query(f"""with {EVENTS}, m as (select event_id, list_transform(tags, lambda t: case when t = 'brand#7' then 'art' when contains(t, 'brand#1') then 'musique' when contains(t, 'red') or contains(t, 'small') then 'danse' end) as c from ev)
select event_id, list_filter(c, lambda x: x is not null)[1] as category from m""")
def map_category_tags(spark, d):
    mapped = S.map_category_tags(F.col("tags"), [("Brand#7", "art")], [("musique", ["brand#1"]), ("danse", ["red", "small"])])
    return events(spark, d).select("event_id", mapped.alias("category"))


@query("select doc_id, case when contains(text, 'the ') then 'theatre' when contains(text, 'les ') then 'musique' when contains(text, 'Und') then 'danse' else 'communaute' end as category from documents")
def category_from_text(spark, d):
    return table(spark, d, "documents").select("doc_id", S.category_from_text(F.col("text"), [("the ", "theatre"), ("les ", "musique"), ("Und", "danse")], "communaute").alias("category"))


@query(f"""with {EVENTS}, m as (select event_id, list_transform([name, description, category], lambda x: case when x = '' then 'communaute' when contains(lower(x), 'econ') then 'musique' when contains(lower(x), 'promo') then 'danse' when contains(lower(x), 'm') then 'theatre' else 'communaute' end) as c from ev)
select event_id, coalesce(list_filter(c, lambda x: x <> 'communaute')[1], 'art') as category from m""")
def category_ignoring_default(spark, d):
    return events(spark, d).select("event_id", S.category_ignoring_default(F.array("name", "description", "category"), RULES, "art").alias("category"))


def _score(c: str) -> str:
    words = _list(CLASSES.words[c])
    return f"(case when place = '{c}' then 3.0 else 0.0 end + 2.0 * len(list_filter({words}, lambda k: contains(n, k))) + 1.0 * len(list_filter({words}, lambda k: contains(x, k) and not contains(n, k))))"


@query(f"""with {EVENTS}, p as (select event_id, lower(name) as n, lower(description) as x, case when contains(category, 'promo') then 'art' end as src,
  case when contains(lower(location), 'salle 7') then null when contains(lower(location), 'salle 1') then 'musique' when contains(lower(location), 'salle 2') then 'danse' end as place,
  case when contains(lower(location), 'salle 7') then null when contains(lower(location), 'salle 1') then 'salle 1' when contains(lower(location), 'salle 2') then 'salle 2' end as hall, category as given from ev),
s as (select *, [{', '.join("{'m': -" + _score(c) + f", 'o': {i}, 'c': '{c}'" + "}" for i, c in enumerate(CLASSES.categories))}] as l from p),
r as (select *, list_sort(l) as r, -list_sum(list_transform(l, lambda e: e.m)) as total, case when hall is null then 0 else 3 end as venue, chr(39) as q from s),
c as (select event_id, case when src is not null then src when total = 0 then 'communaute' else r[1].c end as category,
  round(case when src is not null then 0.95 when total = 0 then 0.3 else least(-r[1].m / total + case when -r[1].m >= 5 then 0.1 else 0 end, 0.95) end, 6) as confidence,
  case when src is not null or total = 0 then '' else array_to_string(list_transform(list_filter(r[2:4], lambda e: e.m < 0), lambda e: e.c || ':' || cast(-e.m as integer)), ',') end as alternatives,
  case when src is not null then 'Source category mapped: ' || q || given || q || ' → ' || src when total = 0 then 'No category keywords matched, using default'
    else 'Matched ' || concat_ws(', ', 'venue ' || q || hall || q, case when -r[1].m > venue then cast(-r[1].m - venue as integer) || ' keyword(s)' end) || ' for ' || q || r[1].c || q end as reason from r)
select *, confidence >= 0.7 as is_confident, confidence < 0.5 as is_uncertain from c""")
def classify_events(spark, d):
    e = events(spark, d).withColumnRenamed("category", "source_category")
    return C.classify_events(e, CLASSES).select("event_id", "category", "confidence", "alternatives", "reason", "is_confident", "is_uncertain")


@query("select page_id, len(list_filter(string_split(regexp_extract(url, '//[^/?#]*/?([^?#]*)', 1), '/'), lambda p: p <> '')) < 3 or coalesce(list_filter(string_split(regexp_extract(url, '//[^/?#]*/?([^?#]*)', 1), '/'), lambda p: p <> '')[2] in ('marseille', 'aubagne'), false) or contains(lower(url), 'aubagne') as inside from pages")
def is_in_area_url(spark, d):
    return table(spark, d, "pages").select("page_id", S.is_in_area_url(F.col("url"), F.col("url"), ["marseille", "aubagne"]).alias("inside"))


@query(f"with {EVENTS} select event_id, lower(location) in ('salle 3', 'salle 5') or contains(lower(description), 'brand#1') or contains(lower(description), 'promo hall') or contains(replace(event_url, '-', ''), 'brand#1') or contains(replace(event_url, '-', ''), 'promohall') or contains(lower(description), 'salle 3') as inside from ev")
def is_in_area_text(spark, d):
    return events(spark, d).select("event_id", S.is_in_area_text(F.col("description"), F.col("event_url"), F.col("location"), ["salle 3", "salle 5"], ["brand#1", "promo hall"]).alias("inside"))


@query("select doc_id, case when contains(lower(text), 'aix') then 'Aix' when contains(lower(text), 'aubagne') then 'Aubagne' when contains(lower(text), 'cassis') then 'Cassis' end as city from documents")
def extract_city(spark, d):
    return table(spark, d, "documents").select("doc_id", S.extract_city(F.col("text"), ["aix", "aubagne", "cassis"]).alias("city"))


@query("select doc_id from documents where not (contains(lower(text), 'pages') or contains(lower(text), 'eur') or contains(lower(text), 'roman'))")
def drop_book_blocks(spark, d):
    return S.without_markers(table(spark, d, "documents"), "text", ["pages", "eur", "roman"]).select("doc_id")


@query("select doc_id from documents where not (contains(lower(text), 'complet') or contains(lower(text), 'annulé'))")
def drop_unavailable(spark, d):
    return S.without_markers(table(spark, d, "documents"), "text", ["complet", "annulé"]).select("doc_id")


@query("select page_id from pages where not (contains(html, 'track(1') or contains(html, 'Just a moment'))")
def drop_challenge_pages(spark, d):
    return S.without_markers(table(spark, d, "pages"), "html", ["track(1", "Just a moment"], any_case=False).select("page_id")


@query(f"with {EVENTS} select event_id from ev where not contains(lower(location), 'salle 1') or contains(lower(location), 'salle 12')")
def drop_external_venues(spark, d):
    return S.drop_external_venues(events(spark, d), "location", ["salle 1"], ["salle 12"]).select("event_id")


@query(f"with {EVENTS} select event_id from ev where start_ts >= timestamp '{AS_OF}'")
def future_only(spark, d):
    return S.future_only(events(spark, d), as_of()).select("event_id")


@query(f"with {EVENTS} select event_id, strftime(case when start_ts < timestamp '{AS_OF}' then date_trunc('day', timestamp '{AS_OF}') + interval 10 hour else start_ts end, '%Y-%m-%d %H:%M') as start from ev where start_ts >= timestamp '{AS_OF}' or start_ts + interval 30 day > timestamp '{AS_OF}'")
def roll_ongoing_to_today(spark, d):
    e = events(spark, d).withColumn("end_ts", F.col("start_ts") + F.make_dt_interval(F.lit(30)))
    return S.roll_ongoing_to_today(e, as_of()).select("event_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm").alias("start"))


@query(f"with {EVENTS}, {_CHECKS} select source as source_id, count(*) filter (where failed is null) as accepted, count(*) filter (where failed is not null) as rejected from judged group by source")
def selection_stats(spark, d):
    chosen = S.select_events(events(spark, d), RULES, as_of())
    return A.selection_stats(chosen.select(F.col("source").alias("source_id"), "accepted"))
