"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

A text turns into lower-case word tokens. A number becomes one placeholder, a unit behind a number
another, and a capitalised word inside a sentence a third. Windows of ``WINDOW`` tokens with at
least ``LITERALS`` plain words are hash-joined between documents and benchmark items, which also
finds questions whose numbers or names were changed. The matched windows of a document, an item
and an offset between the two must then agree on their names: one name of the item stands for one
name in the document, and the other way round. If they don't, only windows with no changed slot
count. Items with tokens that no such window covers (short ones, and those full of numbers, units
or names) are also matched as written. Everything is a built-in expression.

Whether names agree depends on which slots of the item bear the same name, not on the names, and
numbers are free: items of one template and one such pattern are a class (``item_classes``), judged
once for a document, and its least item stands for it. Windows without a slot, and windows as
written, are one key each, whatever the number of items that hold them. A window that occurs again
in its class with the same names counts at its first place.

Defined results: null or empty texts match nothing; items of fewer than ``WINDOW`` tokens are
matched as a whole, those of fewer than ``LITERALS`` as written only; repeated rows with one id count as one document; null ids are
left out; other columns are ignored. A text's tokens and windows are arrays of one row, so that a task
holds about 100 bytes for each byte of its longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_text import let, windows
from .scratch import Scratch

WINDOW = 8
LITERALS = 5
#: Units that may stand behind a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents degree degrees watt watts volt volts meter meters metre metres kilometer kilometers"
).split()
#: Rows up to this number are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Windows and slots of documents' open spans that are broadcast (60 bytes each).
BROADCAST_PLACES = 500_000

_NAME, _NUMBER, _UNIT, _INNER = "\ue000", "\ue001", "\ue002", "\ue003"
_SPLIT = r"[^\p{L}\p{M}\p{N}\x{E000}-\x{E003}]+"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, _SPLIT), lambda w: w != "")


def template_tokens(text: Column) -> Column:
    """Canonical tokens, one for each token of ``surface_tokens``."""
    text = F.coalesce(text, F.lit(""))
    named = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;] )\p{Lu}[\p{L}\p{M}]*", _NAME)
    numbered = F.regexp_replace(F.lower(named), r"\p{N}+(?:[.,:/]\p{N}+)*", _NUMBER)
    unit = rf"(?<={_NUMBER} ?)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}\p{{N}}])"
    return let(numbered, lambda t: _tokens(F.when(F.contains(t, F.lit(_NUMBER)), F.regexp_replace(t, unit, _UNIT)).otherwise(t)))


def surface_tokens(text: Column) -> Column:
    """The tokens as written, in lower case."""
    return _tokens(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\p{N})[.,:/](?=\p{N})", _INNER)))


def _is_slot(token: Column) -> Column:
    return token.startswith(_NAME) | token.startswith(_NUMBER) | token.startswith(_UNIT)


_WINDOWS = "array<struct<hash:bigint,pos:int>>"
_TOLD_WINDOWS = "array<struct<hash:bigint,pos:int,slotted:boolean>>"


def _windows(tokens: Column, n: int, exact: bool = False, told: bool = False) -> Column:
    """(hash, position) of the windows of ``n`` tokens: of those with enough plain words, or of all for exact matches.

    ``told`` adds whether a window has a slot, as no exact one does.
    """

    def build(t: Column) -> Column:
        coded = F.transform(t, lambda w: F.struct(F.xxhash64(w).alias("h"), (F.lit(exact) | ~_is_slot(w)).cast("int").alias("plain")))

        def over(c: Column) -> Column:
            seed = F.lit(-n if exact else n)
            rows = windows(c, n, lambda w: F.struct(F.xxhash64(seed, *[x["h"] for x in w]).alias("hash"), sum((x["plain"] for x in w[1:]), w[0]["plain"]).alias("plain")))
            rows = F.transform(rows, lambda r, i: F.struct(r["hash"].alias("hash"), i.alias("pos"), r["plain"].alias("plain")))
            rows = rows if exact else F.filter(rows, lambda r: r["plain"] >= LITERALS)
            more = lambda r: [(r["plain"] < n).alias("slotted")] if told else []
            return F.transform(rows, lambda r: F.struct(r["hash"].alias("hash"), r["pos"].alias("pos"), *more(r)))

        return let(coded, over)

    return let(tokens, build)


def _bench(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, tokens, values, names, class): names has, for each name slot, the first slot with its name, else 0."""
    bench = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null")
    bench = bench.select("item_id", template_tokens(F.col("text")).alias("tokens"), surface_tokens(F.col("text")).alias("values")).where("size(tokens) > 0")
    own = F.transform("tokens", lambda t, i: F.when(t.startswith(_NAME), F.get("values", i)))
    names = let(own, lambda held: F.transform(held, lambda v: F.coalesce(F.array_position(held, v), F.lit(0)).cast("int")))
    return bench.withColumn("names", names)


def item_classes(items: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, class) of every item with a token: the least item of its template and pattern of names."""
    bench = _bench(items, item_col, item_text_col)
    least = bench.groupBy("tokens", "names").agg(F.min("item_id").alias("class"))
    return bench.join(least, ["tokens", "names"]).select("item_id", "class").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that match: doc_id, item_id, windows, slots, contaminated.

    item_id is the least item that holds a window, if that has no slot or is unchanged, or the least of
    a class that the document re-parameterises (``item_classes`` has the others). What thousands of
    items have in common costs a document one row, not thousands.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "templates")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    bench = _bench(items, item_col, item_text_col).groupBy("tokens", "values", "names").agg(F.min("item_id").alias("item_id"))
    bench = scratch.keep(bench.withColumn("n", F.least(F.size("tokens"), F.lit(WINDOW))), "items")
    none = F.array().cast(_TOLD_WINDOWS)

    def by_length(lengths: list[int], col: str, exact: bool) -> Column:
        picked = none
        for n in lengths:
            picked = F.when(F.col("n") == n, _windows(F.col(col), n, exact, told=True)).otherwise(picked)
        return picked

    lengths = sorted(r["n"] for r in bench.select("n").distinct().collect())  # 1 to WINDOW, no more
    long = [n for n in lengths if n >= LITERALS]
    templates = scratch.keep(bench.select("item_id", "n", "tokens", "values", "names", by_length(long, "tokens", False).alias("w")), "item-templates")
    # items with tokens that no template covers are matched as written, too
    covered = F.flatten(F.transform("w", lambda x: F.sequence(x["pos"], x["pos"] + F.col("n") - 1)))
    bare = templates.where(F.size(F.array_except(F.sequence(F.lit(0), F.size("tokens") - 1), covered)) > 0)
    bare = bare.select("item_id", "n", F.filter(by_length(lengths, "values", True), lambda x: ~F.array_contains(F.transform("w", lambda y: y["pos"]), x["pos"])).alias("w"))
    bare = scratch.keep(bare, "item-exact")
    written = sorted(r["n"] for r in bare.select("n").distinct().collect())

    # a window: its hash, its place, the slots of names in it, and its words as written
    span = F.slice("tokens", F.col("x.pos") + 1, F.col("n"))
    at = F.filter(F.transform(span, lambda t, k: F.when(t.startswith(_NAME), k)), lambda k: k.isNotNull())
    place = ["item_id", "n", F.col("x.hash").alias("hash"), F.col("x.pos").alias("item_pos"), "tokens", "names", "values", at.alias("at")]
    slotted = templates.select("item_id", "n", "tokens", "values", "names", F.explode(F.filter("w", lambda x: x["slotted"])).alias("x")).select(*place)
    slotted = scratch.keep(slotted, "item-slots")
    plain = templates.select("item_id", "n", F.explode(F.filter("w", lambda x: ~x["slotted"])).alias("x")).unionByName(bare.select("item_id", "n", F.explode("w").alias("x")))
    plain = plain.groupBy(F.col("x.hash").alias("hash")).agg(F.min("item_id").alias("item_id"), F.first("n").alias("n"))
    open_keys = slotted.groupBy("hash").agg(F.first("n").alias("n"), F.first("at").alias("at"))  # equal for equal hashes
    keys = plain.withColumn("at", F.lit(None).cast("array<int>")).unionByName(open_keys, allowMissingColumns=True)
    keys = scratch.keep(keys, "keys")
    small = keys.count() <= BROADCAST_ROWS

    own = []
    if long:
        own.append(let(template_tokens(F.col("text")), lambda t: F.concat(*[_windows(t, n) for n in long])))
    if written:
        own.append(let(surface_tokens(F.col("text")), lambda t: F.concat(*[_windows(t, n, True) for n in written])))
    rows = source.select("doc_id", F.explode(F.concat(F.array().cast(_WINDOWS), *own)).alias("w")).select("doc_id", F.col("w.hash").alias("hash"), F.col("w.pos").alias("pos"))
    hits = scratch.keep(rows.join(F.broadcast(keys) if small else keys, "hash").distinct(), "hits")
    told = hits.where("item_id is not null").groupBy("doc_id", "item_id").agg(F.count_distinct("pos").alias("plain"))

    # the document's own words are read once for all of its open places, of which there are no more than tokens
    places = hits.where("item_id is null").groupBy("doc_id").agg(F.collect_set(F.struct("pos", "n", "hash", "at")).alias("places"))
    places = scratch.keep(places, "places")
    few = (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES

    def read(values: Column) -> Column:
        window = lambda p: F.slice(values, p["pos"] + 1, p["n"])
        names = lambda p: F.transform(p["at"], lambda k: F.xxhash64(F.get(values, p["pos"] + k)))
        return F.transform("places", lambda p: F.struct(p["pos"].alias("pos"), p["hash"].alias("hash"), F.xxhash64(p["hash"], window(p)).alias("written"), names(p).alias("found")))

    joined = source.join(F.broadcast(places) if few else places, "doc_id")
    found = scratch.keep(joined.select("doc_id", F.explode(let(surface_tokens(F.col("text")), read)).alias("x")).select("doc_id", "x.*").distinct(), "open")

    # windows whose slots hold an item's own values count whatever the other slots say
    written_keys = slotted.groupBy(F.xxhash64("hash", F.slice("values", F.col("item_pos") + 1, F.col("n"))).alias("written")).agg(F.min("item_id").alias("item_id"))
    same = found.join(written_keys, "written").groupBy("doc_id", "item_id").agg(F.count_distinct("pos").alias("slotted"))

    # the others count for a class if names agree in all windows of one offset
    least = bench.groupBy("tokens", "names").agg(F.min("item_id").alias("class"))
    firsts = F.transform("at", lambda k: F.get("names", F.col("item_pos") + k))
    of_class = slotted.join(least, ["tokens", "names"]).select("class", "hash", "item_pos", firsts.alias("asked")).groupBy("class", "hash", "asked").agg(F.min("item_pos").alias("item_pos"))
    of_class = scratch.keep(of_class, "class-windows")
    pairs = F.transform(F.arrays_zip("asked", "found"), lambda x: F.struct(x["asked"].alias("asked"), x["found"].alias("found")))
    spans = found.join(of_class, "hash").groupBy("doc_id", F.col("class").alias("item_id"), (F.col("pos") - F.col("item_pos")).alias("shift"))
    spans = spans.agg(F.count_distinct("pos").alias("windows"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    count = lambda name: F.size(F.array_distinct(F.transform("pairs", lambda x: x[name])))
    agree = spans.where((F.size("pairs") == count("asked")) & (F.size("pairs") == count("found")))
    agree = agree.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("slotted"), F.max(F.size("pairs")).cast("long").alias("slots"))

    kept = told.unionByName(same, allowMissingColumns=True).unionByName(agree, allowMissingColumns=True).groupBy("doc_id", "item_id")
    kept = kept.agg((F.coalesce(F.sum("plain"), F.lit(0)) + F.coalesce(F.max("slotted"), F.lit(0))).alias("windows"), F.coalesce(F.max("slots"), F.lit(0)).alias("slots"))
    return kept.withColumn("contaminated", F.lit(True))
