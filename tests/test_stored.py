"""Stored tables: snapshots, merges written back, the duplicate index, odd front matter, hot keys."""

import datetime

import pytest
from pyspark.sql import functions as F

from eventmill.operators import duplicate_index, duplicates
from eventmill.sources import pages
from eventmill.sources.snapshots import Conflict, SnapshotTable

PUBLISHED = "path string, name string, event_url string, start_ts timestamp_ntz, location string, description string, image string, source_id string, alternate_sources array<string>, source_ids array<string>, last_crawled timestamp_ntz"
FOUND = "path string, ord long, description string, image string, event_url string, source_id string"
DAY = datetime.datetime(2026, 1, 27, 20)


def _published(n):
    return [(f"p{i}.md", f"Name {i}", f"https://e.org/{i}", DAY, "Salle", "" if i % 2 else "text", None, f"s:{i}", [], [], None) for i in range(n)]


def _files(table):
    return {r[0] for r in table.read().select("_metadata.file_path").distinct().collect()}


def test_merge_is_written_back_and_other_buckets_stay(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path), buckets=8)
    table.create(spark.createDataFrame(_published(40), PUBLISHED))
    before, files = table.read(), _files(table)
    found = spark.createDataFrame([("p3.md", 1, "new text", "i.jpg", "https://o.org/3", "t:3"), ("p3.md", 2, "later", "j.jpg", "https://o.org/4", "t:4"), ("gone.md", 1, "x", "", "", "t:9")], FOUND)
    as_of = F.lit("2026-02-01 00:00:00").cast("timestamp_ntz")
    assert duplicates.merge_into(table, found, as_of) == 2
    want = duplicates.merge_duplicates(before, found, as_of).drop("changes")
    same = lambda df: sorted(map(str, df.select(*before.columns).collect()))
    assert same(table.read()) == same(want) and same(table.read(1)) == same(before)
    assert len(files & _files(table)) >= len(files) - 2 and files != _files(table)
    row = table.read().where("path = 'p3.md'").first()
    assert (row["description"], row["image"], row["source_ids"], row["last_crawled"]) == ("new text", "i.jpg", ["s:3", "t:3", "t:4"], datetime.datetime(2026, 2, 1))
    rows = same(want)
    table.vacuum()
    assert table.versions() == [2] and same(table.read()) == rows
    with pytest.raises(FileExistsError):
        SnapshotTable(spark, str(tmp_path)).create(table.read())


def test_two_writers_and_a_failure_before_the_commit(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path), buckets=4)
    table.create(spark.createDataFrame([(f"k{i}", 0) for i in range(40)], "path string, n int"))
    place = {r["path"]: r["b"] for r in table.read().select("path", table._bucket("path").alias("b")).collect()}
    first, same, other = "k0", next(k for k in place if k != "k0" and place[k] == place["k0"]), next(k for k in place if place[k] != place["k0"])
    keys = lambda k: spark.createDataFrame([(k,)], "path string")
    add = lambda k: lambda rows: rows.withColumn("n", F.when(F.col("path") == k, F.col("n") + 1).otherwise(F.col("n")))
    one, two, three = (table.prepare(keys(k), add(k)) for k in (first, same, other))
    assert table.version() == 1 and table.read().agg(F.sum("n")).first()[0] == 0  # nothing counts yet
    assert table.commit(one) == 2
    assert table.commit(three) == 3  # another bucket: taken up
    with pytest.raises(Conflict):
        table.commit(two)
    assert table.rewrite(keys(same), add(same)) == 4
    assert {r["path"] for r in table.read().where("n = 1").collect()} == {first, same, other} and table.read().count() == 40

    def broken(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.rewrite(keys(first), broken)
    assert table.version() == 4
    # a change that fails after it is written leaves folders that nobody reads
    table.prepare(keys(first), lambda rows: rows.where("false"))
    assert table.read().count() == 40 and len(table.vacuum(1)) > 0 and table.read().count() == 40
    assert table.rewrite(keys(first), lambda rows: rows.where("false")) == 5 and table.read().count() == sum(b != place[first] for b in place.values())


def test_index_joins_the_published_side_where_it_lies(spark, tmp_path):
    index = duplicate_index.DuplicateIndex(spark, str(tmp_path), "lying_index", 8)
    published = spark.createDataFrame(_published(50), PUBLISHED)
    index.refresh(published)
    new = spark.createDataFrame([("n:1", "name 7", "http://www.e.org/7/", DAY, "salle"), ("n:2", "Autre", "https://x.org", DAY, "Ailleurs")], "source_id string, name string, event_url string, start_ts timestamp_ntz, location string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = duplicates.match_urls(new, index.entries("url"))._jdf.queryExecution().executedPlan().toString()
        above, scan = plan.index("Join"), plan.index("Bucketed: true")
        assert plan.count("Exchange hashpartitioning") == 1  # that of the new side
        assert above < scan
        plan = duplicates.match_names(new, index.entries("name"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.enabled")
    same = lambda x: sorted(map(tuple, x.collect()), key=str)
    assert same(index.detect(new)) == same(duplicates.detect_duplicates(new, published))
    moved = published.where("path = 'p7.md'").withColumns({"event_url": F.lit("https://moved.org"), "location": F.lit("Loin")})
    index.refresh(moved, published.where("path = 'p7.md'"))
    index.refresh(spark.createDataFrame([], PUBLISHED), published.where("path = 'p8.md'"))
    now = published.where("path not in ('p7.md', 'p8.md')").unionByName(moved)
    assert same(index.detect(new)) == same(duplicates.detect_duplicates(new, now))


def test_hot_keys_give_one_match_an_event(spark):
    """100,000 equal names in one slot on either side."""
    side = lambda own: spark.range(100_000).select(F.concat(F.lit(own), F.lpad("id", 6, "0")).alias("source_id" if own == "n" else "path"), F.lit("Même nom").alias("name"), F.lit("").alias("event_url"), F.lit(DAY).cast("timestamp_ntz").alias("start_ts"), F.lit("Salle").alias("location"))
    got = duplicates.detect_duplicates(side("n"), side("p")).agg(F.count("*"), F.min("path"), F.max("path"), F.min("confidence")).first()
    assert tuple(got) == (100_000, "p000000", "p000000", 0.85)


def test_odd_front_matter(spark, tmp_path):
    heads = {"list": "- a\n- b", "word": "just words", "single": "name: N\nlocations: salle\ncategories: danse", "numbers": "name: 7\nlocations: [3, null]\ncategories: [1, x]\ndate: 2026-01-02", "day": "name: N\ndate: 2026-13-45", "null": "null", "none": "locations:\ncategories: ''"}
    for name, head in heads.items():
        (tmp_path / f"{name}.md").write_text(f"---\n{head}\n---\nbody")
    got = {r["path"].rpartition("/")[2][:-3]: r for r in pages.scan_event_documents(spark, str(tmp_path)).collect()}
    assert not any(got[k]["has_front_matter"] for k in ("list", "word")) and got["list"]["body"].startswith("---")
    assert (got["single"]["location"], got["single"]["categories"]) == ("salle", ["danse"])
    assert (got["numbers"]["name"], got["numbers"]["location"], got["numbers"]["categories"], got["numbers"]["date"]) == ("7", "3", ["1", "x"], "2026-01-02")
    assert got["none"]["location"] is None and got["none"]["categories"] == [] and got["null"]["body"] == "body"
    assert len(got) == len(heads)
