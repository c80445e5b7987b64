"""Extraction from page tables with built-in functions: links, headings, structured data, showtimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U

_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
_NONE = "array<string>"


def extract_links(pages: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(page_url, link): absolute links, each once a page, of those that fit ``include`` and not ``exclude``."""
    raw = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), 1))
    out = pages.select(F.col("url").alias("page_url"), F.explode(raw).alias("href")).where("href <> ''")
    out = out.select("page_url", U.absolute_url(F.col("page_url"), F.col("href")).alias("link"))
    out = out.where(F.col("link").rlike(include)) if include else out
    return (out.where(~F.col("link").rlike(exclude)) if exclude else out).distinct()


def select_text(html: Column, tag: str) -> Column:
    """Text of the first element of a tag; empty without one."""
    return T.clean_html(F.regexp_extract(F.coalesce(html, F.lit("")), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def select_attr(html: Column, tag: str, attr: str) -> Column:
    return F.regexp_extract(F.coalesce(html, F.lit("")), rf"""(?is)<{tag}\s[^>]*?{attr}\s*=\s*["']([^"']*)["']""", 1)


def extract_image_url(html: Column, base: Column) -> Column:
    """Of the first image: its source, or where that is missing or inline its lazy sources; absolute."""
    image = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<img\s[^>]*>", 0)
    attr = lambda name: F.nullif(F.regexp_extract(image, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    direct = F.when(~attr("src").startswith("data:"), attr("src"))
    return U.absolute_url(base, F.coalesce(direct, attr("data-src"), attr("data-lazy-src")))


def extract_meta_tags(html: Column) -> Column:
    """A struct of og_image, og_description and description; null where a tag is missing."""

    def content(kind: str, name: str) -> Column:
        tag = F.regexp_extract(F.coalesce(html, F.lit("")), rf"""(?is)<meta\s[^>]*?{kind}\s*=\s*["']{name}["'][^>]*>""", 0)
        return F.nullif(F.regexp_extract(tag, r"""(?is)content\s*=\s*["']([^"']*)["']""", 1), F.lit(""))

    return F.struct(content("property", "og:image").alias("og_image"), content("property", "og:description").alias("og_description"), content("name", "description").alias("description"))


def extract_json_ld(pages: DataFrame, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, pos, item): every linked-data value of a page as VARIANT; lists and graphs flattened, bad JSON left out.

    ``key`` are the columns that tell one page from another: more than the URL where a URL was fetched twice.
    """
    raw = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    rows = pages.select(*key, F.posexplode(raw).alias("block", "text"))
    text = F.trim(F.regexp_replace("text", r"[\r\n\t]+", " "))
    rows = rows.select(*key, "block", F.try_parse_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))).alias("v")).where("v is not null")
    values = rows.sparkSession.tvf.variant_explode(F.col("v").outer())
    flat = rows.lateralJoin(values).select(*key, "block", F.col("pos").alias("inner_pos"), F.col("value").alias("item"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("block", "inner_pos"))
    return flat.select(*key, nth.alias("pos"), "item")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("item"), path, kind)


def pick_event_json_ld(items: DataFrame, types: list[str], key: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, item): the first value of a page whose type is listed, else the first main entity that has one."""
    inner = items.withColumn("main", F.try_variant_get("item", "$.mainEntity", "variant"))
    own = _get("$['@type']").isin(*types)
    main = F.try_variant_get(F.col("main"), "$['@type']", "string").isin(*types)
    rows = inner.withColumn("rank", F.when(own, 0).when(main, 1)).where("rank is not null")
    w = Window.partitionBy(*key).orderBy("rank", "pos")
    first = rows.withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.select(*key, F.when(F.col("rank") == 0, F.col("item")).otherwise(F.col("main")).alias("item"))


def coerce_polymorphic(item: Column, field: str, inner: str = "url") -> Column:
    """A text field that may be a list (its first value), an object (its ``inner``) or a plain text."""
    get = lambda path: F.try_variant_get(item, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))
    first = F.when(F.schema_of_variant(F.try_variant_get(item, f"$.{field}[0]", "variant")).startswith("OBJECT"), get(f"$.{field}[0].{inner}")).otherwise(get(f"$.{field}[0]"))
    return F.when(kind.startswith("ARRAY"), first).when(kind.startswith("OBJECT"), get(f"$.{field}.{inner}")).otherwise(get(f"$.{field}"))


def json_ld_to_event(picked: DataFrame, unnamed: bool = False) -> DataFrame:
    """(url, name, start_ts, description, image, location, performers): the event that a value describes.

    Values without a start are no events; those without a name stay with ``unnamed`` only, their name empty.
    """
    performer = F.coalesce(F.try_variant_get("item", "$.performer", "array<struct<name string>>"), F.array(F.try_variant_get("item", "$.performer", "struct<name string>")))
    names = F.slice(F.array_distinct(F.transform(F.filter(performer, lambda p: p["name"].isNotNull()), lambda p: F.lower(p["name"]))), 1, 5)
    return picked.select(
        "url", T.clean_text(_get("$.name")).alias("name"), D.parse_iso_local(_get("$.startDate")).alias("start_ts"), T.truncate_chars(T.sanitize_description(_get("$.description"))).alias("description"),
        coerce_polymorphic(F.col("item"), "image").alias("image"), _get("$.location.name").alias("location"), names.alias("performers"),
    ).where(F.col("start_ts").isNotNull() & (F.lit(unnamed) | (F.col("name") != "")))


def json_ld_to_venue(picked: DataFrame) -> DataFrame:
    """(url, name, website, street, postal_code, city, latitude, longitude): organizer, else the place up to its first comma."""
    name = F.coalesce(_get("$.organizer.name"), F.split(_get("$.location.name"), ",")[0])
    part = lambda f: _get(f"$.location.address.{f}")
    geo = lambda f: _get(f"$.location.geo.{f}").try_cast("double")
    return picked.select("url", F.trim(name).alias("name"), _get("$.organizer.url").alias("website"), part("streetAddress").alias("street"), part("postalCode").alias("postal_code"), part("addressLocality").alias("city"), geo("latitude").alias("latitude"), geo("longitude").alias("longitude"))


def decode_class_metadata(cards: DataFrame, categories: dict[str, str], genres: dict[str, str]) -> DataFrame:
    """``cards`` (with classes, an array) with day, categories and tags that the classes stand for."""
    mapped = lambda table: F.array_distinct(F.array_compact(F.transform("classes", lambda c: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c))))
    day = F.get(F.filter("classes", lambda c: c.rlike(r"^d-[0-9]{8}$")), F.lit(0))
    ts = D.make_ts(F.substring(day, 3, 4).cast("int"), F.substring(day, 7, 2).cast("int"), F.substring(day, 9, 2).cast("int"))
    return cards.withColumns({"start_ts": ts, "categories": mapped(categories), "tags": mapped(genres)})


def _line_flags(line: Column, as_of: Column) -> dict[str, Column]:
    month = "|".join(dict.fromkeys((*D.MONTHS, *D.PLAIN_MONTHS)))
    dated = line.rlike(rf"(?i)[0-9]{{1,2}}\s+(?:{month})\s+[0-9]{{4}}")
    return {"date": F.when(dated, D.parse_french_date(line, as_of)), "time": F.when(~dated & line.rlike(r"(?i)^[0-9]{1,2}h([0-9]{2})?$"), D.parse_french_time(line))}


def extract_showtimes_lines(lines: DataFrame, key: str, order: str, text: str, as_of: Column, venue_like: str, labels: str, ahead: int = 5) -> DataFrame:
    """(key, start_ts, venue): the last date line before each time line, and the first venue in the lines after it.

    One row a line; lines of a key are ordered by ``order``. A moment is given once a key.
    """
    w = Window.partitionBy(key).orderBy(order)
    line = F.trim(F.col(text))
    rows = lines.where(line != "").select(key, order, line.alias("line"))
    rows = rows.withColumns(_line_flags(F.col("line"), as_of))
    low = F.lower("line")
    venue = F.when(low.rlike(venue_like) & ~low.rlike(labels), F.col("line"))
    rows = rows.withColumns({"venue": venue, "day": F.last("date", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("venue", F.first("venue", ignorenulls=True).over(w.rowsBetween(1, ahead))).where("time is not null and day is not null")
    start = F.date_trunc("day", F.col("day")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("time"))
    first = Window.partitionBy(key, "start_ts").orderBy(order)
    return rows.withColumn("start_ts", start).withColumn("n", F.row_number().over(first)).where("n = 1").select(key, "start_ts", "venue")


def extract_showtimes_pattern(pages: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, start_ts) of every ``DD mois YYYY à HHh[MM]`` in a text, each moment once."""
    month = "|".join(dict.fromkeys((*D.MONTHS, *D.PLAIN_MONTHS)))
    pattern = rf"([0-9]{{1,2}})\s+({month})\s+([0-9]{{4}})\s+(?:[àa]\s*|·\s*)([0-9]{{1,2}})h([0-9]{{2}})?"
    hits = pages.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)).alias("hit"))
    part = lambda i: F.nullif(F.regexp_extract("hit", pattern, i), F.lit("")).cast("int")
    start = D.make_ts(part(3), D.month_number(F.regexp_extract("hit", pattern, 2)), part(1), part(4), F.coalesce(part(5), F.lit(0)))
    return hits.select(key, start.alias("start_ts")).where("start_ts is not null").distinct()


def parse_header_dates(text: Column, as_of: Column) -> Column:
    """Dates of a header: ``2 avril 2026 • 14:30``, ``2 avril 2026``, ``19 • 20 mars 2026`` (all days) or ``10 avril • 3 mai 2026`` (both ends)."""
    month = "|".join(dict.fromkeys((*D.MONTHS, *D.PLAIN_MONTHS)))
    low = F.lower(F.trim(text))
    num = lambda p, i: F.nullif(F.regexp_extract(low, p, i), F.lit("")).cast("int")
    mon = lambda p, i: D.month_number(F.regexp_extract(low, p, i))
    single = rf"^([0-9]{{1,2}})\s+({month})\s+([0-9]{{4}})(?:\s*[•·]\s*([0-9]{{1,2}}):([0-9]{{2}}))?$"
    within = rf"^([0-9]{{1,2}})\s*[•·]\s*([0-9]{{1,2}})\s+({month})\s+([0-9]{{4}})$"
    across = rf"^([0-9]{{1,2}})\s+({month})\s*[•·]\s*([0-9]{{1,2}})\s+({month})\s+([0-9]{{4}})$"
    hour = F.lit(D.DEFAULT_HOUR)
    one = D.make_ts(num(single, 3), mon(single, 2), num(single, 1), F.coalesce(num(single, 4), hour), F.coalesce(num(single, 5), F.lit(0)))
    days = F.when(num(within, 1) <= num(within, 2), F.transform(F.sequence(num(within, 1), num(within, 2)), lambda d: D.make_ts(num(within, 4), mon(within, 3), d, hour)))
    ends = F.array_compact(F.array(D.make_ts(num(across, 5), mon(across, 2), num(across, 1), hour), D.make_ts(num(across, 5), mon(across, 4), num(across, 3), hour)))
    return F.when(one.isNotNull(), F.array(one)).when(days.isNotNull(), F.array_compact(days)).otherwise(ends)


def join_listing_detail(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """Listing rows with what their detail page (by url) adds: the detail wins, the listing fills its gaps."""
    d = detail.select("url", *(F.col(c).alias(f"__{c}") for c in detail.columns if c != "url"))
    shared = [c for c in detail.columns if c != "url"]
    out = listing.join(d, "url", "left")
    some = lambda c: F.nullif(F.col(f"__{c}"), F.lit("")) if dict(detail.dtypes)[c] == "string" else F.col(f"__{c}")
    return out.select(*(c for c in listing.columns if c not in shared), *((F.coalesce(some(c), F.col(c)) if c in listing.columns else some(c)).alias(c) for c in shared))


def first_non_empty(candidates: list[tuple[Column, int]], unwanted: list[str] | None = None) -> Column:
    """The first candidate longer than its floor that isn't an unwanted heading."""
    fit = lambda c, n: (F.length(c) > n) & (~F.lower(c).isin(*unwanted) if unwanted else F.lit(True))
    return F.coalesce(*(F.when(fit(T.clean_text(c), n), T.clean_text(c)) for c, n in candidates), F.lit(""))


def extract_tags(candidates: Column, stop_words: list[str], most: int = 5) -> Column:
    """Lower-case tags under 50 characters in their order, each once; genre lists are split, ``promo-`` tags dropped."""
    parts = F.flatten(F.transform(F.coalesce(candidates, F.array().cast(_NONE)), lambda t: F.split(F.lower(t), r"\s+[-–]\s+|[/,]")))
    clean = F.transform(parts, lambda t: F.trim(t))
    kept = F.filter(clean, lambda t: (t != "") & (F.length(t) < 50) & ~t.startswith("promo-") & (~t.isin(*stop_words) if stop_words else F.lit(True)))
    return F.slice(F.array_distinct(kept), 1, most)


def api_event_to_event(rows: DataFrame) -> DataFrame:
    """Events of API rows (id, title, description, excerpt, url, start_date, categories, tags)."""
    text = F.coalesce(F.nullif(T.sanitize_description(F.col("description")), F.lit("")), T.sanitize_description(F.col("excerpt")))
    names = lambda c: F.slice(F.array_distinct(F.transform(F.coalesce(c, F.array()), lambda x: F.lower(x["name"]))), 1, 5)
    return rows.select(
        F.col("id").alias("event_id"), T.clean_html(F.col("title")).alias("name"), F.col("url").alias("event_url"), T.truncate_chars(text).alias("description"),
        F.col("start_date").try_cast("timestamp_ntz").alias("start_ts"), names(F.col("categories")).alias("categories"), names(F.col("tags")).alias("tags"),
    )


def articles_to_events(articles: DataFrame, blocks: DataFrame, as_of: Column) -> DataFrame:
    """One event for each date of each block of an article.

    ``articles``: id, title, link, published; ``blocks``: id, block, date_text, venue. The id is the
    article's alone if it makes one event, else ``id-block-date``. Years come from the publication.
    """
    a = articles.select(F.col("id"), T.clean_html(F.col("title")).alias("title"), "link", F.coalesce("published", as_of).alias("seen"))
    rows = blocks.join(a, "id").select("id", "block", "title", "link", "venue", F.explode(D.expand_french_dates(F.col("date_text"), F.col("seen"))).alias("start_ts"))
    n = F.count("*").over(Window.partitionBy("id"))
    long = F.concat_ws("-", F.col("id").cast("string"), F.col("block").cast("string"), F.date_format("start_ts", "yyyyMMdd"))
    return rows.withColumn("event_id", F.when(n == 1, F.col("id").cast("string")).otherwise(long)).select("event_id", F.col("title").alias("name"), F.col("link").alias("event_url"), "venue", "start_ts")
