"""Reading and writing: documents, payloads, feeds, and the stream against the batch."""

import json

from pyspark.sql import functions as F

from eventmill.operators import publish
from eventmill.sources import pages as S
from eventmill.streaming.ingest import stream_ingest_pages


def test_documents_and_markdown_round_trip(spark, tmp_path):
    events = spark.sql("select 1L as event_id, 'Été & \"fête\"' as name, 'u' as event_url, timestamp_ntz'2026-01-26 20:00:00' as start_ts, 'texte' as description, cast(null as string) as image, cast(null as string) as event_group_id, cast(null as string) as day_of, 's:1' as source_id, false as draft")
    page = publish.render_event_markdown(events, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).first()
    assert page["path"] == "2026/01/26/ete-fete.fr.md"
    for name, text in (("a/ok.md", page["page"]), ("_index.md", page["page"]), ("a/old.md", "---\neventName: Vieux\ndate: 2026-01-02T20:00:00\nlocations: [x, y]\n---\n"), ("bare.md", "no head"), ("bad.md", "---\na: [\n---\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"].rpartition("/")[2]: r for r in S.scan_event_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"ok.md", "old.md", "bare.md", "bad.md"}
    assert (got["ok.md"]["name"], got["ok.md"]["date"], got["ok.md"]["body"]) == ('Été & "fête"', "2026-01-26", "texte")
    assert (got["old.md"]["name"], got["old.md"]["location"]) == ("Vieux", "x")
    assert not got["bare.md"]["has_front_matter"] and not got["bad.md"]["has_front_matter"]


def test_payloads(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps([{"id": 1, "link": "first"}, {"id": 2, "link": "b"}]))
    (tmp_path / "p2.json").write_text(json.dumps([{"id": 1, "link": "second"}, {"id": 3, "link": "c"}]))
    got = {r["id"]: r["link"] for r in S.ingest_article_json(spark, f"{tmp_path}/p*.json", "id long, link string").collect()}
    assert got == {1: "first", 2: "b", 3: "c"}
    (tmp_path / "e1.json").write_text(json.dumps({"events": [{"id": 1}, {"id": 2}], "total": 2}))
    assert S.ingest_event_api_json(spark, f"{tmp_path}/e*.json", "events array<struct<id long>>, total int").count() == 2


def test_feeds(spark, tmp_path):
    events = spark.sql("select 1L as event_id, 'Été' as name, timestamp_ntz'2026-01-26 20:00:00' as start_ts")
    publish.feed_export(events, f"{tmp_path}/json")
    publish.feed_export(events, f"{tmp_path}/xml", "xml")
    assert spark.read.json(f"{tmp_path}/json").first()["link"] == "/events/2026/01/26/ete/"
    assert spark.read.format("xml").option("rowTag", "item").load(f"{tmp_path}/xml").first()["title"] == "Été"


def test_stream_equals_batch_over_the_union(spark, tmp_path):
    schema = "url string, ok boolean, fetched_at timestamp"
    extract = lambda df: df.select(F.col("url").alias("source_id"), "ok", "fetched_at")
    select = lambda df: df.withColumn("accepted", F.col("ok"))

    def run():
        pages = spark.readStream.schema(schema).parquet(f"{tmp_path}/pages")
        stream_ingest_pages(pages, f"{tmp_path}/published", f"{tmp_path}/checkpoint", extract, select).awaitTermination()

    days = [[("a", True, 1), ("b", False, 2), ("a", True, 3)], [("a", True, 50), ("c", True, 51)]]
    for rows in days:
        df = spark.createDataFrame([(u, ok) for u, ok, _ in rows], "url string, ok boolean").withColumn("fetched_at", F.timestamp_seconds(F.lit(1_700_000_000)))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
        run()
    assert sorted(r["source_id"] for r in spark.read.parquet(f"{tmp_path}/published").collect()) == ["a", "c"]


def test_stream_keeps_late_files(spark, tmp_path):
    schema = "url string, fetched_at timestamp"
    extract = lambda df: df.select(F.col("url").alias("source_id"), "fetched_at")
    select = lambda df: df.withColumn("accepted", F.lit(True))
    for rows in ([("a", 1_700_000_000), ("b", 1_700_000_100)], [("d", 1_700_100_000)], [("c", 1_600_000_000), ("c", 1_600_000_001), ("a", 1_600_000_000)]):
        df = spark.createDataFrame(rows, "url string, t long").select("url", F.timestamp_seconds("t").alias("fetched_at"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
        pages = spark.readStream.schema(schema).parquet(f"{tmp_path}/pages")
        stream_ingest_pages(pages, f"{tmp_path}/published", f"{tmp_path}/checkpoint", extract, select).awaitTermination()
    assert sorted(r["source_id"] for r in spark.read.parquet(f"{tmp_path}/published").collect()) == ["a", "b", "c", "d"]
