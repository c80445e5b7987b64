"""The keys of published events, kept between runs in bucketed tables and refreshed by what changed.

Three tables hold (URL), (day, time, place) and (name, day) with the paths that bear them, bucketed by
these keys: new events are shuffled to the buckets, the published side is joined where it lies. A
refresh appends what a run changed, rows that are there and rows that went; the last entry of a path
tells, which is found within a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import create_text, names
from . import duplicates as U

#: Table, its keys, and what else tells an entry.
TABLES = {"url": (U.url_entries, ["url"], ["path"]), "slot": (U.slot_entries, ["day", "time", "place"], ["norm", "path"]), "name": (U.name_entries, ["key", "day"], ["path"])}

#: Rows of a bucket, which one task sorts and groups.
BUCKET_ROWS = 250_000


def buckets_for(rows: int) -> int:
    """Buckets for an index of so many published events, so that a task's share doesn't grow with them."""
    return max(8, -(-rows // BUCKET_ROWS))


class DuplicateIndex:
    """Tables ``name``_url, _slot and _name in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, name: str, buckets: int = 64):
        self.spark, self.folder, self.name, self.buckets = spark, folder.rstrip("/"), name, buckets

    def _append(self, rows: DataFrame, live: bool, stamp: int) -> None:
        for table, (entries, keys, rest) in TABLES.items():
            own = entries(rows).select(*keys, *rest, F.lit(live).alias("live"), F.lit(stamp).alias("stamp"))
            writer = own.repartition(self.buckets, *keys).write.mode("append").bucketBy(self.buckets, *keys).sortBy(*keys)
            writer.option("path", f"{self.folder}/{table}").saveAsTable(f"{self.name}_{table}")

    def refresh(self, now: DataFrame, before: DataFrame | None = None) -> None:
        """Take in published events as they are ``now``, in place of those rows as they were ``before``.

        The first call takes in all. A refresh that fails half way is harmless when it is run again.
        """
        stamp = len(names(self.spark, f"{self.folder}/log")) + 1
        if before is not None:
            self._append(before, False, 2 * stamp)
        self._append(now, True, 2 * stamp + 1)
        create_text(self.spark, f"{self.folder}/log/{stamp:09d}", "")

    def entries(self, table: str) -> DataFrame:
        """Entries that are there now; keys and what else tells them."""
        _, keys, rest = TABLES[table]
        last = self.spark.table(f"{self.name}_{table}").groupBy(*keys, *rest).agg(F.max_by("live", "stamp").alias("live"))
        return last.where("live").drop("live")

    def matches(self, new: DataFrame) -> DataFrame:
        """What the three matchers find; columns source_id, path, confidence, reason."""
        url, slot, name = U.match_urls(new, self.entries("url")), U.match_slots(new, self.entries("slot")), U.match_first_names(new, self.entries("name"))
        return url.unionByName(slot).unionByName(name)

    def detect(self, new: DataFrame) -> DataFrame:
        return U.combine_matches(new, self.matches(new))
