"""The venue dimension: lookup keys, resolution of free-text places, duplicates, stubs and audit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import similar

DUPLICATE_RATIO = 0.85
MIN_ADDRESS = 10
MATCHES = ("name", "address", "website")
LINKS = tuple(f"by_{m}" for m in MATCHES)


def build_venue_lookup(venues: DataFrame) -> DataFrame:
    """(key, slug): every spelling of every venue; the first venue (by ord) owns a spelling.

    ``venues`` has ord, slug, title, aliases (paths) and search_names.
    """
    title = T.normalize_venue_text(F.coalesce("title", F.lit("")))
    alias = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: T.slug_to_words(T.alias_to_slug(a)))
    named = F.transform(F.coalesce("search_names", F.array().cast("array<string>")), T.normalize_venue_text)
    keys = F.concat(F.array(T.slug_to_words(F.col("slug")), title, T.strip_articles(title)), alias, named)
    keys = F.array_distinct(F.concat(keys, F.transform(keys, T.strip_accents)))
    rows = venues.where("slug is not null and slug <> ''").select("ord", "slug", F.explode(keys).alias("key")).where("key <> ''")
    return rows.groupBy("key").agg(F.min_by("slug", F.struct("ord", "slug")).alias("slug"))


def resolve_venue(df: DataFrame, col: str, lookup: DataFrame) -> DataFrame:
    """``df`` with ``venue``: by exact key, else by the longest key inside the name, else the name as it is.

    Each distinct name is resolved once. Names without an exact key meet the keys through their
    substrings of the lengths that keys have, so that it is an equi join at any size.
    """
    names = df.select(F.col(col).alias("__raw")).where("__raw is not null and __raw <> ''").distinct().withColumn("norm", T.normalize_venue_text(F.col("__raw")))
    exact = names.join(lookup.select(F.col("key").alias("norm"), F.col("slug").alias("exact")), "norm", "left")
    lengths = lookup.agg(F.sort_array(F.collect_set(F.length("key"))).alias("lengths"))  # one row, bounded by the longest key
    lengths = lengths.first()["lengths"] or []
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length("norm") - n + 1), lambda i: F.substring(F.col("norm"), i, n))
    inside = lambda n: F.when(F.length("norm") >= n, runs(n)).otherwise(F.array().cast("array<string>"))
    pieces = F.flatten(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), inside))
    part = exact.where("exact is null").select("__raw", F.explode(F.array_distinct(pieces)).alias("key")).join(lookup, "key")
    longest = part.groupBy("__raw").agg(F.min_by("slug", F.struct(-F.length("key"), "key")).alias("inner"))
    known = exact.select("__raw", "exact").join(longest, "__raw", "left").select("__raw", F.coalesce("exact", "inner").alias("__slug"))
    return df.join(known, df[col] == known["__raw"], "left").withColumn("venue", F.coalesce("__slug", F.col(col))).drop("__raw", "__slug")


def known_slugs(venues: DataFrame) -> DataFrame:
    """Slugs of venues and of their aliases."""
    alias = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.alias_to_slug)
    return venues.select(F.explode(F.array_append(alias, F.col("slug"))).alias("slug")).where("slug <> ''").distinct()


def discover_unmapped_locations(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Places of events that are no venue's slug or alias. ``events`` has locations, an array."""
    used = events.select(F.explode("locations").alias("slug")).where("slug <> ''").distinct()
    return used.join(known_slugs(venues), "slug", "left_anti")


def append_venue_stubs(venues: DataFrame, slugs: DataFrame) -> DataFrame:
    """``venues`` with a stub row for each slug it doesn't know."""
    new = slugs.select("slug").where("slug <> ''").distinct().join(known_slugs(venues), "slug", "left_anti")
    stubs = new.select("slug", T.slug_to_title(F.col("slug")).alias("title"), F.lit("Lieu").alias("type"))
    return venues.unionByName(stubs, allowMissingColumns=True)


def _compared(venues: DataFrame) -> DataFrame:
    """(ord, slug, name, place, domain): what venues are compared by, empty where there is nothing to compare."""
    text = lambda c: T.normalize_venue_text(F.coalesce(c, F.lit("")))
    place = text("address")
    place = F.when(F.length(place) > MIN_ADDRESS, T.normalize_name(place)).otherwise("")
    return venues.select("ord", "slug", T.normalize_name(text("title")).alias("name"), place.alias("place"), F.coalesce(U.extract_domain("website"), F.lit("")).alias("domain"))


def find_duplicate_venues(venues: DataFrame, threshold: float = DUPLICATE_RATIO, expand: bool = True) -> DataFrame:
    """(a, b, match, score) of venue pairs alike in name, else in address, else in website domain.

    All pairs of distinct names and addresses are compared, in blocks; domains are joined. Without
    ``expand``, a venue stands for all that have its name, address or domain: the first of each is
    paired with the firsts of those alike, and every other one with the first of its own, so that
    the rows don't grow with the square of a group of copies. Of venues that are nearly all alike
    there are about as many pairs as there can be; ``count_duplicate_venues`` gives a row a venue.
    """
    v = _compared(venues)

    def equals(own: DataFrame, col: str) -> DataFrame:
        """Pairs of venues with an equal value, or each venue but the first with the first of its value."""
        if expand:
            return own.alias("l").join(own.alias("r"), col).where("l.ord < r.ord").select(F.col("l.slug").alias("a"), F.col("r.slug").alias("b"))
        first = own.groupBy(col).agg(F.min(F.struct("ord", "slug")).alias("f"), F.count("*").alias("n")).where("n > 1")
        return own.join(first, col).where("ord > f.ord").select(F.col("f.slug").alias("a"), F.col("slug").alias("b"))

    def rated(x: pd.DataFrame, y: pd.DataFrame, same: bool) -> pa.Table:
        """Pairs of texts in the orders in which their venues come, as matching blocks may depend on it."""
        out = [(np.empty(0, object), np.empty(0, object), np.empty(0))]
        for l, r in ((x, y),) if same else ((x, y), (y, x)):
            l = l[l["ord"] < r["last"].max()]
            (tl, tr), start, last = (s["t"].to_numpy(object) for s in (l, r)), l["ord"].to_numpy(), r["last"].to_numpy()
            for i, j, score in similar.alike(tl.tolist(), tr.tolist(), threshold):
                good = (start[i] < last[j]) & (tl[i] != tr[j])
                out.append((tl[i[good]], tr[j[good]], score[good]))
        x, y, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"x": pa.array(x, pa.string()), "y": pa.array(y, pa.string()), "score": score})

    def alike(col: str) -> DataFrame:
        own = v.where(F.col(col) != "").select("ord", "slug", F.col(col).alias("t"))
        firsts = own.groupBy("t").agg(F.min(F.struct("ord", "slug")).alias("f"), F.max("ord").alias("last")).select("t", "f.ord", "f.slug", "last")
        texts = similar.meet(firsts.select("t", "ord", "last" if expand else F.col("ord").alias("last")), "ord", rated, "x string, y string, score double")
        named = own if expand else firsts
        l, r = (named.select(F.col("ord").alias(f"ord_{k}"), F.col("slug").alias(k), F.col("t").alias(x)) for k, x in (("a", "x"), ("b", "y")))
        pairs = texts.join(l, "x").join(r, "y").where("ord_a < ord_b").select("a", "b", "score")
        return pairs.unionByName(equals(own, "t").withColumn("score", F.lit(1.0)))

    same = equals(v.where("domain <> ''").select("ord", "slug", "domain"), "domain").withColumn("score", F.lit(1.0))
    found = alike("name").withColumn("rank", F.lit(0)).unionByName(alike("place").withColumn("rank", F.lit(1))).unionByName(same.withColumn("rank", F.lit(2)))
    first = found.groupBy("a", "b").agg(F.min_by(F.struct("rank", "score"), "rank").alias("m"))
    return first.select("a", "b", _match(F.col("m.rank")).alias("match"), F.col("m.score").alias("score"))


def _match(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, MATCHES)), rank)


def link_duplicate_venues(venues: DataFrame, threshold: float = DUPLICATE_RATIO) -> DataFrame:
    """(slug, class_id, by_name, by_address, by_website, links, linked): a row a venue, with all links there are.

    Venues of one name, address and domain are a class, whose id is the slug of its first, and are
    linked to each other. The row of the first holds the class's pairs: ``linked`` is an array of
    (class_id, match, score), one for each class of which a venue comes after one of this class and
    is linked to it; all such two venues are. So the pairs of ``find_duplicate_venues`` with ``expand``
    are those of ``linked``, times the members of both classes of which the own comes first, and those
    inside classes. Other members have no ``linked``; it is that of their class.

    The numbers are of the venues that a venue is linked to by name, else by address, else by domain,
    and in all; a link of two of their venues counts with all venues of the other class.
    All pairs of classes are compared, in blocks, and leave a task as arrays, one for a class and block.
    """
    v = _compared(venues)
    keys = ["name", "place", "domain"]
    classes = v.groupBy(*keys).agg(F.min(F.struct("ord", "slug")).alias("f"), F.max("ord").alias("last"), F.count("*").alias("n"))
    classes = classes.select(*keys, "f.ord", F.col("f.slug").alias("class_id"), "last", "n")
    none = len(MATCHES)

    def compared(x: pd.DataFrame, y: pd.DataFrame, same: bool) -> pa.Table:
        # a venue of the class x is before one of y, and one of y before one of x
        ahead, behind = x["ord"].to_numpy()[:, None] < y["last"].to_numpy(), x["last"].to_numpy()[:, None] > y["ord"].to_numpy()
        if same:
            ahead, behind = np.triu(ahead, 1), np.triu(behind, 1)
        mixed = np.flatnonzero(behind.any(axis=1))
        behind = behind[mixed]

        def rated(col: str) -> tuple[np.ndarray, np.ndarray]:
            forth = similar.ratings(x[col].to_numpy(), y[col].to_numpy(), threshold)
            forth[~ahead] = -1
            back = similar.ratings(y[col].to_numpy(), x[col].to_numpy()[mixed], threshold).T if len(mixed) else np.empty(behind.shape)
            return forth, np.where(behind, back, -1)

        (name, name_back), (place, place_back), domain = rated("name"), rated("place"), similar.are_equal(x["domain"].to_numpy(), y["domain"].to_numpy())

        def listed(name: np.ndarray, place: np.ndarray, domain: np.ndarray, other: pd.DataFrame, block: int) -> dict[str, pa.Array]:
            """The links of each row of a matrix to rows of the other block, and which block that is."""
            match = np.select([name >= 0, place >= 0, domain], np.arange(none, dtype=np.int8), np.int8(none))
            i, j = np.nonzero(match < none)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(match)))]), pa.int32())
            match = match[i, j]
            score = np.where(match == 0, name[i, j], np.where(match == 1, place[i, j], 1.0))
            values = {"ids": pa.array(other["class_id"], pa.string()).take(pa.array(j)), "match": pa.array(match), "score": pa.array(score)}
            return {k: pa.ListArray.from_arrays(ends, c) for k, c in values.items()} | {"block": pa.array(np.full(len(name), block))}

        def counts(links: np.ndarray, other: pd.DataFrame) -> np.ndarray:
            return links.astype(np.int64) @ other["n"].to_numpy()

        both_name, both_place, met = name >= 0, place >= 0, ahead.copy()
        both_name[mixed] |= name_back >= 0
        both_place[mixed] |= place_back >= 0
        met[mixed] |= behind
        kinds = both_name, both_place & ~both_name, domain & met & ~both_name & ~both_place
        blocks = [int(own["ord"].min()) if len(own) else 0 for own in (x, y)]
        pairs = listed(name, place, domain & ahead, y, blocks[1]), listed(name_back.T, place_back.T, (domain[mixed] & behind).T, x.iloc[mixed], blocks[0])
        out = []
        for own, other, turned, linked in ((x, y, kinds, pairs[0]), (y, x, [m.T for m in kinds], pairs[1])):
            rows = {k: pa.array(own[k], pa.string()) for k in [*keys, "class_id"]} | {k: pa.array(own[k], pa.int64()) for k in ("ord", "n")}
            out.append(pa.table(rows | {k: counts(m, other) for k, m in zip(LINKS, turned)} | linked))
        return pa.concat_tables(out)

    schema = [*(f"{k} string" for k in [*keys, "class_id"]), *(f"{k} long" for k in ("ord", "n", *LINKS)), "ids array<string>", "match array<tinyint>", "score array<double>", "block long"]
    met = similar.meet(classes.select(*keys, F.col("ord").cast("long"), "class_id", "last", "n"), "ord", compared, ", ".join(schema))
    parts = F.sort_array(F.collect_list(F.when(F.size("ids") > 0, F.struct("block", "ids", "match", "score"))))
    whole = met.groupBy(*keys).agg(*(F.first(k).alias(k) for k in ("class_id", "ord", "n")), *(F.sum(k).alias(k) for k in LINKS), parts.alias("parts"))
    flat = F.arrays_zip(*(F.flatten(F.transform("parts", lambda p: p[k])).alias(k) for k in ("ids", "match", "score")))
    linked = F.transform(flat, lambda z: F.struct(z["ids"].alias("class_id"), _match(z["match"].cast("int")).alias("match"), z["score"].alias("score")))
    # copies are linked by the first of the three that they have
    has = [F.col(k) != "" for k in keys]
    kinds = F.when(has[0], LINKS[0]).when(has[1], LINKS[1]).when(has[2], LINKS[2])
    own = whole.select(*keys, "class_id", F.col("ord").alias("first"), *(F.when(kinds == k, F.col(k) + F.col("n") - 1).otherwise(F.col(k)).alias(k) for k in LINKS), linked.alias("linked"))
    # the venues are the side that is kept, so that the arrays aren't sorted
    rows = own.join(v.hint("shuffle_hash"), keys)
    return rows.select("slug", "class_id", *LINKS, sum((F.col(k) for k in LINKS[1:]), F.col(LINKS[0])).alias("links"), F.when((F.col("ord") == F.col("first")) & (F.col("slug") == F.col("class_id")), F.col("linked")).alias("linked"))


def count_duplicate_venues(venues: DataFrame, threshold: float = DUPLICATE_RATIO) -> DataFrame:
    """``link_duplicate_venues`` without the links themselves."""
    return link_duplicate_venues(venues, threshold).drop("linked")


def duplicate_domains(venues: DataFrame) -> DataFrame:
    """Venues that share a website's domain, each beside the first of them: linear, however many share it."""
    d = venues.select("ord", "slug", U.extract_domain(F.coalesce("website", F.lit(""))).alias("domain")).where("domain <> ''")
    first = d.groupBy("domain").agg(F.min(F.struct("ord", "slug")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, "domain").where("ord > first.ord").select(F.col("first.slug").alias("a"), F.col("slug").alias("b"), "domain")


def audit_venues(venues: DataFrame) -> DataFrame:
    """(slug, missing): the fields that are empty, of title, description, address and website."""
    fields = ("title", "description", "address", "website")
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f), F.lit("")) == "", f) for f in fields)))
    return venues.select("slug", missing.alias("missing")).where(F.size("missing") > 0)


def first_wins_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def render_venue_page(venues: DataFrame) -> DataFrame:
    """(slug, page): the text of each venue's page."""
    alias = F.when(F.size("aliases") > 0, F.concat(F.lit("aliases:\n"), F.array_join(F.transform("aliases", lambda a: F.concat(F.lit("  - "), a)), "\n")))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("Salle de spectacle"))
    fields = [line(c, text(c)) for c in ("title", "description", "address", "website")]
    page = F.concat_ws("\n", F.lit("---"), *fields, line("type", kind), alias, F.lit("---"), F.coalesce("body", F.lit("")))
    return venues.select("slug", page.alias("page"))


def plan_venue_pages(venues: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """(slug, action) against the pages there are: created, unchanged, updated (a stub, or forced) or skipped."""
    pages = existing.select("slug", F.col("page").alias("old"), (F.trim(F.coalesce("body", F.lit(""))) == "").alias("stub"))
    both = render_venue_page(venues).join(pages, "slug", "left")
    action = F.when(F.col("old").isNull(), "created").when(F.trim("old") == F.trim("page"), "unchanged").when(F.col("stub") | F.lit(force), "updated").otherwise("skipped")
    return both.select("slug", action.alias("action"))


def export_venues(venues: DataFrame) -> DataFrame:
    """(slug, venue): the first venue of each slug as JSON without empty fields."""
    one = first_wins_by_key(venues, "slug", ["ord"])
    fields = [c for c in one.columns if c != "ord"]
    filled = [F.nullif(F.col(c), F.lit("")).alias(c) if dict(one.dtypes)[c] == "string" else F.col(c) for c in fields]
    return one.select("slug", F.to_json(F.struct(*filled)).alias("venue"))
