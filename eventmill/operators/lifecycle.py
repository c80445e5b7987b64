"""Expiry of published events, and how recent the sources are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import delete


def _passed(cutoff: Column) -> Column:
    """Whether the event's day is before the cutoff; a row without a day never is."""
    return F.coalesce(F.to_date("start_ts") < F.to_date(cutoff), F.lit(False))


def mark_expired(events: DataFrame, cutoff: Column) -> DataFrame:
    return events.withColumn("expired", F.coalesce("expired", F.lit(False)) | _passed(cutoff))


def delete_expired(events: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, images of what goes)."""
    gone = events.where(_passed(cutoff))
    return events.where(~_passed(cutoff)), gone.where("coalesce(image, '') <> ''").select("image").distinct()


def expire_stored(spark: SparkSession, folder: str, cutoff: Column, by: str = "month", remove: bool = False) -> DataFrame:
    """Mark, or ``remove``, the events before the cutoff in a stored table in partitions ``by`` their first day.

    Only partitions that begin before the cutoff are read, and only those with something to do are
    written anew, or deleted if nothing stays; all others keep their files. A run that fails can be
    run again. Returns, for each partition, how many events were treated, and the images of removed
    events that no event that stays shows. Events without a day never expire.
    """
    table = spark.read.parquet(folder)
    early = table.where(F.col(by).cast("date") < F.to_date(cutoff))
    due = _passed(cutoff) if remove else _passed(cutoff) & ~F.coalesce("expired", F.lit(False))
    images = F.collect_set(F.when(due, F.nullif("image", F.lit(""))) if remove else F.lit(None).cast("string"))
    told = early.groupBy(by).agg(F.count_if(due).alias("events"), F.count("*").alias("rows"), images.alias("images")).where("events > 0")
    shown = table.where(~_passed(cutoff)).select(F.col("image").alias("shown")).distinct()
    each = told.select(by, "events", "rows", F.explode_outer("images").alias("image")).join(shown, F.col("image") == F.col("shown"), "left")
    told = each.groupBy(by, "events", "rows").agg(F.array_sort(F.collect_set(F.when(F.col("shown").isNull(), F.col("image")))).alias("images"))
    done = told.collect()  # a row for each partition that changes
    part = [r[by] for r in done if not (remove and r["events"] == r["rows"])]
    if part:
        rows = early.where(F.col(by).isin(part))
        rows = rows.where(~_passed(cutoff)) if remove else mark_expired(rows, cutoff)
        rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)
    for r in done:
        if remove and r["events"] == r["rows"]:
            delete(spark, f"{folder.rstrip('/')}/{by}={r[by]}")
    return spark.createDataFrame(done, told.schema).drop("rows")


def list_expired(events: DataFrame, cutoff: Column) -> DataFrame:
    status = F.when(F.coalesce("expired", F.lit(False)), "marked").otherwise("not marked")
    return events.where(_passed(cutoff)).select("event_id", F.date_format("start_ts", "yyyy-MM-dd").alias("day"), status.alias("status"))


def expiration_summary(events: DataFrame, cutoff: Column) -> DataFrame:
    was = F.coalesce("expired", F.lit(False))
    return events.agg(F.count("*").alias("total"), F.count_if(was).alias("expired"), F.count_if(_passed(cutoff) & ~was).alias("processed"))


def stale_sources(sources: DataFrame, status: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Sources that never ran, whose time can't be read, or whose last run is more than ``days`` days ago."""
    last = status.groupBy("source_id").agg(F.max(F.col("ts").try_cast("timestamp_ntz")).alias("last"))
    age = F.timestamp_diff("SECOND", F.col("last"), as_of)
    return sources.join(last, "source_id", "left").where(F.col("last").isNull() | (age > days * 86400)).select("source_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_run"))


def source_recency_report(sources: DataFrame, status: DataFrame, as_of: Column) -> DataFrame:
    """(source_id, last_run, age_days, bucket), never run first, then the oldest."""
    last = status.groupBy("source_id").agg(F.max(F.col("ts").try_cast("timestamp_ntz")).alias("last"))
    age = F.timestamp_diff("SECOND", F.col("last"), as_of) / 86400
    bucket = F.when(age.isNull(), "never").when(age < 2, "recent").when(age < 7, "ageing").otherwise("old")
    out = sources.join(last, "source_id", "left").withColumns({"age_days": F.floor(age), "bucket": bucket})
    return out.orderBy(F.col("last").asc_nulls_first(), "source_id").select("source_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_run"), "age_days", "bucket")
