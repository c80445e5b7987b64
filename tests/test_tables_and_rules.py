"""Long rule lists, requests and caches, feeds of terms, expiry of stored tables, search by index, selectors of sources."""

import datetime
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from eventmill.functions import text
from eventmill.operators import automaton, calendar, html_rows, lifecycle, publish, rules, search_index, table_functions
from eventmill.sources import pages

DAY = datetime.datetime(2026, 1, 27, 20)
EVENT = "event_id long, name string, description string, location string, start_ts timestamp_ntz, expired boolean, draft boolean, categories array<string>, image string"


def _events(spark, rows):
    return spark.createDataFrame([(i, name, "d", "Salle", start, False, False, terms, image) for i, name, start, terms, image in rows], EVENT)


def test_automaton_gives_what_contains_gives(spark, monkeypatch):
    r = random.Random(1)
    words = ["".join(r.choice("abé ") for _ in range(r.randint(0, 4))) for _ in range(150)] + ["AB", "ab", ""]
    texts = ["".join(r.choice("abé c") for _ in range(r.randint(0, 30))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    mapping = [(w, f"to{k}") for k, w in enumerate(words) if len(w) > 2]
    text = F.col("t")
    columns = lambda: (rules.hits(text, words), rules.first_hit(text, words), rules.any_hit(text, words), rules.first_mapped(text, mapping), rules.first_mapped(text, mapping, F.lit("x")))
    read = lambda: df.select("t", *(c.alias(f"c{k}") for k, c in enumerate(columns()))).collect()
    long = read()
    monkeypatch.setattr(automaton, "FROM", 10_000)
    assert long == read()


def test_a_hundred_thousand_keywords(spark):
    words = [f"w{i * 7919 % 100_000:05d}" for i in range(100_000)]
    df = spark.range(500).select(F.concat(F.lit("x w"), F.lpad("id", 5, "0"), F.lit(" w"), F.lpad(F.col("id") + 50_000, 5, "0")).alias("t"))
    order = {w: k for k, w in enumerate(words)}
    for row in df.select("t", rules.hits(F.col("t"), words).alias("h")).collect():
        assert row["h"] == sorted(row["t"].split()[1:], key=order.get)


def test_pages_at_the_time_of_each_request(spark):
    r = random.Random(3)
    at = lambda s: DAY + datetime.timedelta(seconds=s)
    fetched = [(r.choice("abc") if r.random() < 0.5 else "hot", at(r.randrange(20_000)), r.choice([200, 200, 500]), None, f"page {k}") for k in range(200)] + [("a", None, 200, None, "x"), (None, at(5), 200, None, "y")]
    asked = [(k, r.choice(["a", "b", "c", "hot", "none"]), at(r.randrange(25_000))) for k in range(200)] + [(900, None, at(9)), (901, "a", None), (902, "a", at(0))]
    requests, fetches = spark.createDataFrame(asked, "n int, url string, requested_at timestamp_ntz"), spark.createDataFrame(fetched, "url string, fetched_at timestamp_ntz, status_code int, error string, html string")
    for slice_s in (500, 86400):
        got = {x["n"]: (x["fetched_at"], x["html"]) for x in pages.fresh_page_at(requests, fetches, 900, ("html",), slice_s).collect()}
        for n, url, t in asked:
            seen = max(((f[1], f[4]) for f in fetched if f[0] == url and url and f[2] == 200 and f[1] and t and f[1] <= t), default=(None, None))
            assert got[n] == (seen if seen[0] and (t - seen[0]).total_seconds() <= 900 else (None, None))


def test_feeds_of_terms(spark, tmp_path):
    rows = [(i, f"N{i}", DAY + datetime.timedelta(days=i % 7), ["Éveil", "Jazz"] if i % 5 else ["Jazz", "jazz", "!!"], None) for i in range(300)]
    publish.term_feeds(_events(spark, [*rows, (999, "x", DAY, None, None)]), {"types": "categories"}, f"{tmp_path}/f", most=4)
    got = spark.read.json(f"{tmp_path}/f").collect()
    for term, own in (("eveil", [x for x in rows if x[0] % 5]), ("jazz", rows)):
        first = sorted(own, key=lambda x: (-x[2].timestamp(), x[0]))[:4]
        assert [x["event_id"] for x in sorted((g for g in got if g["term"] == term), key=lambda g: g["nth"])] == [x[0] for x in first]
    assert len(got) == 8
    publish.term_feeds(_events(spark, rows), {"types": "categories"}, f"{tmp_path}/x", most=1, fmt="xml")
    assert len(list((tmp_path / "x" / "taxonomy=types").iterdir())) == 2


def test_expiry_writes_only_partitions_with_something_to_do(spark, tmp_path):
    rows = [(i, f"N{i}", datetime.datetime(2026, 1 + i % 4, 1 + i % 20), [], f"img{i % 6}") for i in range(40)]
    folder = f"{tmp_path}/t"
    _events(spark, rows).withColumn("month", F.to_date(F.date_trunc("month", "start_ts"))).repartition("month").write.partitionBy("month").parquet(folder)
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "t").glob("month=*/*.parquet")}
    before, cutoff = files(), F.lit("2026-02-10").cast("date")
    done = {str(x["month"]): x["events"] for x in lifecycle.expire_stored(spark, folder, cutoff).collect()}
    early = [x for x in rows if x[2] < datetime.datetime(2026, 2, 10)]
    assert sum(done.values()) == len(early) and set(done) == {"2026-01-01", "2026-02-01"}
    assert {k for k, v in files().items() if before[k] != v} == {"month=2026-01-01", "month=2026-02-01"}
    assert {x["event_id"] for x in spark.read.parquet(folder).where("expired").collect()} == {x[0] for x in early}
    again = files()
    assert lifecycle.expire_stored(spark, folder, cutoff).count() == 0 and files() == again
    gone = lifecycle.expire_stored(spark, folder, cutoff, remove=True).collect()
    stay = [x for x in rows if x not in early]
    assert {x["event_id"] for x in spark.read.parquet(folder).collect()} == {x[0] for x in stay} and "month=2026-01-01" not in files()
    assert {i for x in gone for i in x["images"]} == {x[4] for x in early} - {x[4] for x in stay}


def test_search_by_index_equals_the_scan_and_reads_less(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["Jazz", "été", "Opéra", "la", "nuit", "x"]) for _ in range(4)) + f" n{i}", DAY + datetime.timedelta(days=r.randrange(12)), [], None) for i in range(400)]
    events, folder = _events(spark, rows), f"{tmp_path}/index"
    search_index.build(events, folder, 4, 64)
    now = F.lit(DAY).cast("timestamp_ntz")
    for query in ("jazz", "OPERA la", "n39", "n123", "nuit x n1", "xy", "", "zzz", "a"):
        same = lambda df: sorted(x["event_id"] for x in df.select("event_id").collect())
        assert same(search_index.search(spark, folder, query, now)) == same(calendar.search_events(events, query, now))
    found = search_index.candidates(spark, folder, "n123")
    assert found.select("__slice").distinct().count() < 5 and "PartitionFilters: [part" in found._jdf.queryExecution().executedPlan().toString()


def test_selectors_of_many_sources(spark):
    card = '<div class="{}"><b class="{}">{}</b><a href="/{}">x</a></div>'
    rows = [("s1", "u1", card.format("one", "n1", "First", 1)), ("s2", "u2", card.format("two", "n2", "Second", 2) * 2), ("s3", "u3", card.format("event", "title", "Third", 3)), ("s9", "u9", None), (None, "u0", card.format("event", "title", "None", 0))]
    selectors = [("s1", "item", ".one"), ("s1", "name", ".n1"), ("s2", "item", ".two"), ("s2", "name", ".n2"), ("s2", "name", ".a"), ("s4", "item", "p"), (None, "item", "p"), ("s3", None, "x")]
    got = html_rows.extract_by_source_selectors(spark.createDataFrame(rows, "source_id string, url string, html string"), spark.createDataFrame(selectors, "source_id string, field string, selector string"), {"item": ".event", "name": ".title", "link": "a"})
    assert sorted((str(x["source_id"]), x["name"], x["link"]) for x in got.collect()) == [("None", "None", "/0"), ("s1", "First", "/1"), ("s2", "Second", "/2"), ("s2", "Second", "/2"), ("s3", "Third", "/3")]


def test_extractors_as_table_functions(spark):
    table_functions.register(spark)
    card = '<div class="event"><h2>{}</h2><a href="/{}">x</a></div>'
    rows = [("s1", "u1", card.format("A", 1)), ("s1", "u2", card.format("A", 1) + card.format("B", 2)), ("s2", "u3", card.format("A", 1)), ("s3", "u4", None)]
    spark.createDataFrame(rows, "source_id string, url string, html string").createOrReplaceTempView("some_pages")
    got = spark.sql("select p.source_id, x.name, x.link from some_pages p, lateral extract_page('listing', p.url, p.html) x").collect()
    want = html_rows.extract_by_selectors(spark.table("some_pages"), table_functions.LISTING)
    assert sorted((r["name"], r["link"]) for r in got) == sorted((r["name"], r["link"]) for r in want.collect()) and len(got) == 4
    assert spark.sql("select * from some_pages p, lateral extract_page('links', p.url, p.html)").columns[-2:] == ["link", "label"]
    told = spark.sql("select source_id, url, name, fresh from extract_pages('listing', table(some_pages) partition by source_id order by url)").collect()
    assert sorted(map(tuple, told)) == [("s1", "u1", "A", True), ("s1", "u2", "A", False), ("s1", "u2", "B", True), ("s2", "u3", "A", True)]
    for wrong in ("select * from some_pages p, lateral extract_page('nothing', p.url, p.html)", "select * from extract_pages('nothing', table(some_pages))", "select * from extract_pages('links', table(select 1 as x))"):
        with pytest.raises(AnalysisException):
            spark.sql(wrong).schema


def test_slugs_of_other_scripts(spark):
    texts = {"Вечер джаза": "vecher-dzhaza", "Щелкунчик, 3 часть": "shchelkunchik-3-chast", "Ξένος Ψυχή": "xenos-psukhe", "Été à Москва": "ete-a-moskva", "日本": "", "Ёлка": "iolka"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", text.slugify(F.col("t")).alias("s")).collect()} == texts
