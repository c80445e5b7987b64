"""A stored table that is changed a bucket at a time, with snapshots, and one file that makes a change count.

Rows lie in buckets by a hash of their key, each bucket in a folder that is never written again. A
version is a manifest: one small file with the folder of each bucket, so that its size is that of the
buckets, not of the data. A change reads and writes the buckets that its keys fall into, beside the
ones in use, and then puts the next manifest in place; until then no reader sees it, and a job that
fails before leaves only folders that no manifest names (``vacuum``). Two writers race for the name of
the next manifest: the later one takes up the other's version if they changed different buckets, and
begins anew if not. Manifests are put in place by a rename that doesn't replace, which the file system
has to offer (HDFS does; on a local disk it is a check before the rename).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import create_text, delete, names, read_text


class Conflict(Exception):
    """Another writer changed a bucket of this change since it was read."""


@dataclass(frozen=True)
class Change:
    """A change that is written but doesn't count yet: the folder of each bucket, None for one that is empty now."""

    base: int
    folders: dict[int, str | None]


class SnapshotTable:
    """The table in ``folder``, by ``key``, a column of text; ``buckets`` counts when it is created."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "path", buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        if self.versions():
            self.buckets = self._manifest(self.version())["buckets"]

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.folder}/manifests") if n.endswith(".json")]

    def version(self) -> int:
        return self.versions()[-1]

    def _manifest(self, version: int) -> dict:
        found = json.loads(read_text(self.spark, f"{self.folder}/manifests/{version:012d}.json"))
        return found | {"folders": {int(k): v for k, v in found["folders"].items()}}

    def _put(self, version: int, folders: dict[int, str], schema: T.StructType) -> bool:
        manifest = {"version": version, "buckets": self.buckets, "folders": folders, "schema": schema.jsonValue()}
        return create_text(self.spark, f"{self.folder}/manifests/{version:012d}.json", json.dumps(manifest))

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[int, str]:
        place = f"data/{uuid.uuid4().hex}"
        # a bucket is dealt to several tasks, so that few buckets don't mean few tasks
        parts = max(1, -(-2 * self.spark.sparkContext.defaultParallelism // self.buckets))
        part = F.pmod(F.hash(F.col(self.key)), F.lit(parts))
        rows.withColumn("__bucket", self._bucket(self.key)).repartition(self.buckets * parts, "__bucket", part).write.partitionBy("__bucket").parquet(f"{self.folder}/{place}")
        return {int(n.rpartition("=")[2]): f"{place}/{n}" for n in names(self.spark, f"{self.folder}/{place}") if n.startswith("__bucket=")}

    def create(self, rows: DataFrame) -> int:
        if self.versions() or not self._put(1, self._write(rows), rows.schema):
            raise FileExistsError(self.folder)
        return 1

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the last one by default, or of some of its buckets."""
        found = self._manifest(self.version() if version is None else version)
        schema = T.StructType.fromJson(found["schema"])
        places = [f"{self.folder}/{v}" for k, v in sorted(found["folders"].items()) if buckets is None or k in buckets]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def prepare(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Change:
        """Write what ``change`` makes of the buckets in which ``keys`` lie. It may add rows of these keys."""
        base = self.version()
        touched = sorted(r[0] for r in keys.select(self._bucket(self.key)).distinct().collect())  # as many as buckets
        if not touched:
            return Change(base, {})
        own = self.read(base, touched)
        return Change(base, dict.fromkeys(touched) | self._write(change(own).select(*own.columns)))

    def commit(self, change: Change) -> int:
        """Make ``change`` count; the version that has it."""
        before = self._manifest(change.base)
        version = change.base
        if not change.folders:
            return version
        while True:
            newer = self.version()
            last = self._manifest(newer)
            if any(last["folders"].get(b) != before["folders"].get(b) for b in change.folders):
                raise Conflict(f"{self.folder}: version {newer} changed a bucket of a change to version {change.base}")
            merged = {k: v for k, v in (last["folders"] | change.folders).items() if v is not None}
            if self._put(version := newer + 1, merged, T.StructType.fromJson(last["schema"])):
                return version

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
        """``prepare`` and ``commit``, anew from the last version when another writer was faster."""
        for k in range(attempts):
            try:
                return self.commit(self.prepare(keys, change))
            except Conflict:
                if k == attempts - 1:
                    raise
        raise ValueError("attempts must be positive")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` versions and the folders that none of them names. No writer may be at work."""
        versions = self.versions()
        used = {v for n in versions[-keep:] for v in self._manifest(n)["folders"].values()}
        gone = []
        for place in names(self.spark, f"{self.folder}/data"):
            for bucket in names(self.spark, f"{self.folder}/data/{place}"):
                if bucket.startswith("__bucket=") and (own := f"data/{place}/{bucket}") not in used:
                    delete(self.spark, f"{self.folder}/{own}")
                    gone.append(own)
        for n in versions[:-keep]:
            delete(self.spark, f"{self.folder}/manifests/{n:012d}.json")
        return gone
