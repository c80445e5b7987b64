"""Search over an index of letter runs instead of over all texts.

``build`` writes two tables: the events, in slices by a hash of their text, and postings, each run of
three letters of a normal text with the text's hash, in partitions by a hash of the run and in order
within them. Events that recur share a text, whose runs are taken and posted once. A search reads the
postings of its own runs only, intersects them by counting, and reads the events of the slices that
hold what is left. Whatever the index lets through (as hashes may clash, too much, but never too
little) is judged by the same test as a scan, so that results are equal. Queries under three letters
are a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.folders import create_text, delete, read_text
from .calendar import search_events

RUN = 3


def _runs(text: Column) -> Column:
    # one pass of a regular expression: a function over places would work the text out anew at each of them
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{RUN}}}))"), 1))


TEXT = ("name", "description", "location")


def _text() -> Column:
    return T.normalize_venue_text(F.concat_ws(" ", *TEXT))


def _slice(slices: int) -> Column:
    return F.pmod("__text", F.lit(slices)).cast("int")


def _part(partitions: int) -> Column:
    return F.pmod("run", F.lit(partitions)).cast("int")


def build(events: DataFrame, folder: str, partitions: int = 64, slices: int = 256) -> None:
    """Write the index of ``events`` (with event_id and what ``search_events`` reads) to ``folder``."""
    spark = events.sparkSession
    stored = events.withColumn("__text", F.xxhash64(*TEXT)).withColumn("__slice", _slice(slices))
    # a text that most events have is dealt by id, too, and so is a run that most texts have
    salt = F.pmod(F.xxhash64("event_id"), F.lit(4))
    stored.repartition("__slice", salt).sortWithinPartitions("__slice", "event_id").write.mode("overwrite").partitionBy("__slice").parquet(f"{folder}/events")
    delete(spark, f"{folder}/sizes")
    create_text(spark, f"{folder}/sizes", f"{partitions} {slices}")
    # all columns tell texts apart, as two of one hash have their own runs
    texts = spark.read.parquet(f"{folder}/events").select("__text", *TEXT).distinct()
    runs = texts.select("__text", F.explode(_runs(_text())).alias("run")).select("__text", F.xxhash64("run").alias("run")).withColumn("part", _part(partitions))
    salt = F.pmod(F.xxhash64("__text"), F.lit(16))
    runs.repartition("part", salt).sortWithinPartitions("part", "run", "__text").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """(__text, __slice) of the texts that have all runs of the query; None if it is too short to tell."""
    runs = F.explode(_runs(T.normalize_venue_text(F.lit(query)))).alias("run")
    partitions, slices = map(int, read_text(spark, f"{folder}/sizes").split())
    asked = spark.range(1).select(runs).select(F.xxhash64("run").alias("run")).distinct().select("run", _part(partitions).alias("part")).collect()
    if not asked:
        return None
    own = spark.read.parquet(f"{folder}/postings").where(F.col("part").isin(sorted({r["part"] for r in asked})) & F.col("run").isin([r["run"] for r in asked]))
    found = own.groupBy("__text").agg(F.count_distinct("run").alias("n")).where(F.col("n") == len(asked))
    return found.select("__text", _slice(slices).alias("__slice"))


def search(spark: SparkSession, folder: str, query: str, as_of: Column, days: int = 7) -> DataFrame:
    """``search_events`` of the indexed events."""
    stored = spark.read.parquet(f"{folder}/events")
    found = candidates(spark, folder, query)
    if found is not None:
        slices = [r[0] for r in found.select("__slice").distinct().collect()]  # no more than slices
        stored = stored.where(F.col("__slice").isin(slices)).join(found, ["__text", "__slice"], "left_semi")
    return search_events(stored, query, as_of, days).drop("__slice", "__text")
