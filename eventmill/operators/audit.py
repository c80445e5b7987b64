"""Reports over links, images, documents and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def _local_path(base: Column, link: Column) -> Column:
    """Path of a link's page: without fragment, query, index page and slash at the end."""
    path = U.url_path(U.absolute_url(base, link))
    return F.regexp_replace(F.regexp_replace(path, r"/index\.html$", ""), r"/+$", "")


def broken_internal_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_url, link) of local links without a page. ``links``: page_url, link; ``pages``: path.

    Fragments, scripts, mail and telephone links and whole URLs are left out.
    """
    local = links.where(~F.col("link").rlike(r"^(?:#|javascript:|mailto:|tel:|https?://)") & (F.col("link") != ""))
    there = pages.select(F.regexp_replace(F.regexp_replace("path", r"/index\.html$", ""), r"/+$", "").alias("target")).distinct()
    return local.withColumn("target", _local_path(F.col("page_url"), F.col("link"))).join(there, "target", "left_anti").select("page_url", "link")


def external_link_inventory(links: DataFrame) -> DataFrame:
    return links.where(F.col("link").rlike(r"^https?://")).select("link").distinct()


def _base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def orphan_images(images: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored images (path) that no document (image) names."""
    used = docs.where("coalesce(image, '') <> ''").select(_base_name(F.col("image")).alias("leaf")).distinct()
    return images.withColumn("leaf", _base_name(F.col("path"))).join(used, "leaf", "left_anti").select("path")


def missing_images(docs: DataFrame, images: DataFrame) -> DataFrame:
    """Documents whose image isn't stored."""
    return docs.where("coalesce(image, '') <> ''").join(images.select(F.col("path").alias("image")).distinct(), "image", "left_anti")


def content_validation_report(docs: DataFrame, categories: list[str]) -> DataFrame:
    """(level, rule, n): errors and warnings over documents (has_front_matter, title, date, categories, image, image_exists)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    head = F.coalesce("has_front_matter", F.lit(False))
    issue = lambda level, rule, cond: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule")))
    none = F.size(F.coalesce("categories", F.array().cast("array<string>"))) == 0
    issues = F.array_compact(
        F.array(
            issue("error", "no_front_matter", ~head),
            issue("error", "missing_title", head & empty("title")),
            issue("error", "missing_date", head & empty("date")),
            issue("error", "missing_categories", head & none),
            issue("warning", "bad_date_format", head & ~empty("date") & ~F.col("date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")),
            issue("warning", "unknown_category", head & F.exists("categories", lambda c: ~c.isin(*categories))),
            issue("warning", "missing_image", head & ~empty("image") & ~F.col("image_exists")),
        )
    )
    return docs.select(F.explode(issues).alias("x")).groupBy("x.level", "x.rule").agg(F.count("*").alias("n"))


def selection_stats(selected: DataFrame) -> DataFrame:
    """(source_id, accepted, rejected)."""
    return selected.groupBy("source_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def crawl_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") != "pending").alias("processed"), F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("events_accepted").alias("accepted"), F.sum("events_rejected").alias("rejected"),
    )


def image_job_stats(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
