"""The stream against the batch over the union, whatever the order and cut of the files."""

import random

import pytest
from pyspark.sql import functions as F

from eventmill.streaming.ingest import put_batch, stream_ingest_pages

SCHEMA = "url string, ok boolean, t long, payload struct<a:array<string>,d:decimal(10,2)>, day date, at timestamp_ntz"


def _extract(df):
    return df.select(F.col("url").alias("source_id"), "ok", F.timestamp_seconds("t").alias("fetched_at"), "payload", "day", "at", "t")


def _select(df):
    return df.withColumn("accepted", F.col("ok"))


def _frame(spark, rows):
    some = F.struct(F.array(F.col("url"), F.lit("é")).alias("a"), (F.col("t") / 7).cast("decimal(10,2)").alias("d")).alias("payload")
    return spark.createDataFrame(rows, "url string, ok boolean, t long").select("*", some, F.date_add(F.lit("2026-01-01").cast("date"), F.col("t").cast("int")).alias("day"), F.timestamp_seconds("t").cast("timestamp_ntz").alias("at"))


def _run(spark, folder, per_trigger=1):
    pages = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(f"{folder}/pages")
    stream_ingest_pages(pages, f"{folder}/published", f"{folder}/checkpoint", _extract, _select, buckets=3).awaitTermination()
    return spark.read.parquet(f"{folder}/published")


def _want(rows):
    out = {}
    for url, ok, t in rows:
        if ok and url:
            out[url] = min(t, out.get(url, t))
    return sorted(out.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_files_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [("a", False, 1), ("a", True, 5), ("b", True, 9), ("a", True, 3), ("c", True, 7), ("b", True, 2), ("c", True, 7), ("d", False, 1), ("b", False, 1), ("a", True, 4), ("e", True, 3), ("e", False, 9), ("e", True, 1)]
    r.shuffle(rows)
    cut = sorted(r.sample(range(1, len(rows)), 4))
    parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]
    for k, part in enumerate(parts):
        _frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/pages/{k}")
        if k in (1, 4):  # two runs of the query, each of several batches
            got = _run(spark, tmp_path)
            done = [x for p in parts[: k + 1] for x in p]
            assert sorted((x["source_id"], x["t"]) for x in got.collect()) == _want(done)
    # what is published is the row as it came, of all types
    first = {u: t for u, t in _want(rows)}
    want = _extract(_frame(spark, sorted({x for x in rows if x[1] and first.get(x[0]) == x[2]})))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_rejected_first_row_hides_nothing_and_rows_without_id_stay(spark, tmp_path):
    rows = [("a", False, 1), ("a", True, 2), ("b", True, 3), (None, True, 1), (None, True, 1), ("", True, 2), (None, False, 2)]
    _frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/pages/0")
    got = sorted((x["source_id"] or "", x["t"]) for x in _run(spark, tmp_path).collect())
    assert got == [("", 1), ("", 1), ("", 2), ("a", 2), ("b", 3)]


def test_no_files(spark, tmp_path):
    _frame(spark, []).write.parquet(f"{tmp_path}/pages/0")
    assert _run(spark, tmp_path).count() == 0


def test_a_batch_published_twice_and_files_that_stay(spark, tmp_path):
    folder = f"{tmp_path}/published"
    frame = lambda rows: spark.createDataFrame(rows, "source_id string, t long, batch long, replaces long")
    put_batch(frame([(f"id{i}", 5, 1, None) for i in range(20)]), folder, 8)
    put_batch(frame([("x", 5, 2, None)]), folder, 8)
    files = lambda: {r[0] for r in spark.read.parquet(folder).select("_metadata.file_path").distinct().collect()}
    before, again = files(), frame([("id3", 2, 3, 1), ("x", 1, 3, 2)])
    for _ in range(2):
        put_batch(again, folder, 8)
        got = {r["source_id"]: r["t"] for r in spark.read.parquet(folder).collect()}
        assert got == {f"id{i}": 2 if i == 3 else 5 for i in range(20)} | {"x": 1} and spark.read.parquet(folder).count() == 21
    assert len(before & files()) == len(before) - 2  # one file lost a row, one its only one
