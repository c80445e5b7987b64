"""Faults that a review of round 3 found."""

import datetime as dt
import difflib
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventmill.functions import text
from eventmill.operators import duplicate_index, duplicates, publish, search_index, similar, venues
from eventmill.sources import pages, snapshots


def test_age_of_a_page_counts_parts_of_a_second(spark):
    at = dt.datetime(2024, 1, 1, 12)
    fetches = spark.createDataFrame([("u", at + dt.timedelta(microseconds=200_000), 200, None)], "url string, fetched_at timestamp_ntz, status_code int, error string")
    asked = [(k, "u", at + dt.timedelta(seconds=s)) for k, s in enumerate((10.1, 10.2, 10.9, 11.2))]
    got = pages.fresh_page_at(spark.createDataFrame(asked, "k int, url string, requested_at timestamp_ntz"), fetches, 10)
    assert {r["k"]: r["fetched_at"] is not None for r in got.collect()} == {0: True, 1: True, 2: False, 3: False}


def _both(spark, name, folder, columns):
    """Rows of a query and of its SQL, over a page table."""
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    ours = [tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect()]
    return sorted(ours), sorted(con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall())


def _page_table(spark, folder):
    html = '<html lang="fr"><title>a &quot;b&quot;</title><h1>Jazz &quot;live&quot; &#8217;</h1>'
    rows = [(k, "http://x.org/same" if k < 4 else f"http://x.org/{k}", html) for k in range(8)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


def test_linked_data_of_two_pages_of_one_url(spark, tmp_path):
    _page_table(spark, tmp_path)
    for name, columns in {"extract_json_ld": ["url", "n"], "pick_event_json_ld": ["url"], "coerce_polymorphic_field": ["url", "image"], "json_ld_to_venue": ["url", "name"]}.items():
        ours, sql = _both(spark, name, tmp_path, columns)
        assert len(ours) == 6 and ours == sql, name


def test_all_plain_entities_in_code_and_sql(spark, tmp_path):
    _page_table(spark, tmp_path)
    ours, sql = _both(spark, "select_text_and_attr", tmp_path, ["page_id", "heading", "title", "lang"])
    assert ours == sql and ours[0] == (0, "Jazz \"live\" '", 'a "b"', "fr")
    ours, sql = _both(spark, "json_ld_to_event", tmp_path, ["url", "name", "start", "image"])
    assert ours == sql and len(ours) == 6 and {r[1] for r in ours} == {"Jazz live"}


def test_name_matches_are_all_pairs_of_a_name_and_day(spark):
    at = dt.datetime(2024, 1, 1, 12)
    side = lambda own, key, n: spark.createDataFrame([(f"{own}{k}", "Jazz!" if own == "n" else "jazz", at) for k in range(n)], f"{key} string, name string, start_ts timestamp_ntz")
    got = duplicates.match_by_name_date(side("n", "source_id", 2), side("p", "path", 3)).collect()
    assert sorted((r["source_id"], r["path"]) for r in got) == [(f"n{i}", f"p{j}") for i in range(2) for j in range(3)]


def test_plain_heads_skip_the_yaml_machinery_and_agree_with_it(monkeypatch):
    import yaml

    fields = {"title": "hot bolt", "date": "1998-02-06T00:00:00", "draft": False, "eventURL": "https://x.org/a/1/", "startTime": "10:00", "sourceId": "s:1", "dates": ["jeudi-05-mars"], "expired": True}
    odd = {"title": "yes", "name": "a: b", "image": "x #y", "description": "é " * 60, "dates": [], "startTime": "1e5"}
    whole = [yaml.dump(f, Dumper=yaml.CSafeDumper, allow_unicode=True, sort_keys=False) for f in (fields, odd)]
    assert [publish.front_matter_yaml(f, yaml.CSafeDumper) for f in (fields, odd)] == whole
    assert pages._plain_head(whole[0]) == fields and pages._plain_head(whole[1]) is None
    monkeypatch.setattr(yaml, "dump", None)
    assert publish.front_matter_yaml(fields, yaml.CSafeDumper) == whole[0]


def test_each_pair_of_names_is_rated_once(spark, tmp_path, monkeypatch):
    """Two pairs of names that meet on ten days."""

    def rated(a, b):
        def note(x, y):
            with open(tmp_path / "rated", "a") as f:
                f.write("x\n")
            return 0.9

        return F.udf(note, "double").asNondeterministic()(a, b)

    monkeypatch.setattr(duplicates.T, "normalized_similarity", rated)
    side = lambda own, key, names: spark.createDataFrame([(f"{own}{d}{n}", n, dt.datetime(2024, 1, 1 + d, 12), "Salle") for d in range(10) for n in names], f"{key} string, name string, start_ts timestamp_ntz, location string")
    got = duplicates.match_by_date_time_location(side("n", "source_id", ["jazz a"]), side("p", "path", ["jazz b", "jazz c"])).collect()
    assert len(got) == 10 and {r["path"] for r in got} == {f"p{d}jazz b" for d in range(10)}
    assert len((tmp_path / "rated").read_text().split()) == 2


def test_runs_take_the_text_once(spark):
    """The text isn't worked out anew for each of its runs, and runs are those of its places."""
    df = spark.createDataFrame([("abcabcd",), ("é𝒜bc",), ("ab",), ("",)], "t string")
    runs = search_index._runs(F.col("t"))
    assert [r[0] for r in df.select(runs).collect()][::3] == [["abc", "bca", "cab", "bcd"], []]
    plan = df.select(runs)._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan and "regexp_extract_all" in plan


def test_entities_alone_go_to_python(spark):
    import html

    texts = ["&amp;eacute;", "a&eacute b&#233;&notit;", "&&lt;\n&#10;", "x" * 50, "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    out = rows.select("k", text.unescape_entities(F.col("t")).alias("u"))
    assert [r["u"] for r in out.orderBy("k").collect()] == [html.unescape(t) if t is not None else None for t in texts]
    assert "regexp_extract_all" in out._jdf.queryExecution().optimizedPlan().toString()


def test_few_buckets_are_written_by_many_tasks(spark, tmp_path):
    table = snapshots.SnapshotTable(spark, str(tmp_path / "t"), buckets=2)
    table.create(spark.range(1000).selectExpr("cast(id as string) as path", "id"))
    files = list((tmp_path / "t").rglob("*.parquet"))
    assert len(files) > 2 and table.read().count() == 1000


def test_buckets_of_an_index_grow_with_its_rows():
    assert [duplicate_index.buckets_for(n) for n in (0, 100_000, 2_000_001, 36_000_000)] == [8, 8, 9, 144]


def _words(r, letters, most):
    return "".join(r.choice(letters) for _ in range(r.randint(1, most)))


def test_pairs_rated_at_once_are_those_of_the_matcher():
    """Short and long texts, few and many letters, in ratios too."""
    r = random.Random(1)
    for letters, most, n in (("ab", 12, 40), ("abcdé ", 25, 40), ("abc ", 260, 20), ("".join(map(chr, range(200, 600))), 30, 30)):
        xs = [_words(r, letters, most) for _ in range(n)]
        ys = ["".join(c + (r.choice(letters) if r.random() < 0.1 else "") for c in x) for x in xs]
        for threshold in (0.85, 0.5):
            ratios = ((i, j, difflib.SequenceMatcher(None, x, y).ratio()) for i, x in enumerate(xs) for j, y in enumerate(ys))
            got = [(i, j, score) for lot in similar.alike(xs, ys, threshold) for i, j, score in zip(*(a.tolist() for a in lot))]
            assert sorted(got) == [p for p in ratios if p[2] >= threshold]


def _odd_places(spark):
    r = random.Random(7)
    names = [_words(r, "abc", 7) for _ in range(40)] + ["salle verte", "la salle verte", "abc" * 80, "abc" * 80 + "d", "", None]
    places = ["", None, "rue", "12 rue verte", "13 rue verte", "12 quai vert"]
    sites = ["", None, "http://x.org/a", "https://www.x.org", "http://y.org"]
    rows = [(k, f"v{k}", r.choice(names), r.choice(places), r.choice(sites)) for k in range(150)]
    return rows, spark.createDataFrame(rows, "ord long, slug string, title string, address string, website string")


def _links_of(x, y):
    """Whether two venues, the earlier first, are alike in name, in address and in domain."""
    ratio = lambda a, b: difflib.SequenceMatcher(None, a or "", b or "").ratio()
    domain = [(v[4] or "").split("//")[-1].removeprefix("www.").split("/")[0] for v in (x, y)]
    far = all(len(v[3] or "") > 10 for v in (x, y))
    return bool(x[2] and y[2]) and ratio(x[2], y[2]) >= 0.85, far and ratio(x[3], y[3]) >= 0.85, domain[0] != "" and domain[0] == domain[1]


def test_links_of_venues_are_counted_as_all_pairs_give_them(spark, monkeypatch):
    """Copies, empty fields, and venues in many blocks; a class has the links of any of its venues."""
    rows, df = _odd_places(spark)
    key = lambda v: (v[2] or "", v[3] if len(v[3] or "") > 10 else "", (v[4] or "").split("//")[-1].removeprefix("www.").split("/")[0])
    classes, found = {}, {}
    for v in rows:
        classes.setdefault(key(v), []).append(v)
    for k, x in enumerate(rows):
        for y in rows[k + 1 :]:
            kinds, both = _links_of(x, y), frozenset((key(x), key(y)))
            if any(kinds):
                found[both] = min(found.get(both, 2), kinds.index(True))
    want = {}
    for own, members in classes.items():
        n = [0, 0, 0]
        for both, kind in found.items():
            if own in both:
                other = next(iter(both - {own}), own)
                n[kind] += len(classes[other]) - (other == own)
        want |= {v[1]: (members[0][1], *n, sum(n)) for v in members}
    for small in (similar.SMALL, 9):
        monkeypatch.setattr(similar, "SMALL", small)
        got = venues.count_duplicate_venues(df).collect()
        assert len(got) == len(rows) and {r["slug"]: tuple(r)[1:] for r in got} == want


def test_pairs_of_venues_over_many_blocks(spark, monkeypatch):
    rows, df = _odd_places(spark)
    want = {(x[1], y[1]): ("name", "address", "website")[kinds.index(True)] for k, x in enumerate(rows) for y in rows[k + 1 :] if any(kinds := _links_of(x, y))}
    monkeypatch.setattr(similar, "SMALL", 9)
    got = venues.find_duplicate_venues(df).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["match"] for r in got} == want


def test_venues_that_are_all_alike_give_a_row_each(spark, tmp_path):
    spark.range(300).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["find_duplicate_venues"](spark, str(tmp_path)).collect()
    assert len(got) == 300 and {r["slug"] for r in got} == {f"salle-{k}" for k in range(300)} and min(r["links"] for r in got) > 50
