"""Tables written between the jobs of one operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_folders: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one where none is set and all tasks run on this machine, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if found:
        return found.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"{_KEY} must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Hold settings of the session for jobs that run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, size: str = "2m") -> None:
    """Let Arrow batches end at ``size``, unless the session already says where.

    Rows here are whole documents: the default of 64 MB is several times as much in each task. A batch
    holds one row more than fits. Results are lazy, so that this holds for the session from here on.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(key, size)


class Scratch:
    """One operator call's tables.

    ``keep`` writes a frame as Parquet and reads it back, which cuts the lineage in a way that a
    lost executor can't undo and gives the optimiser true sizes. ``drop`` frees a table that
    nothing lazy reads any more; whatever is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _folders.append((spark, self.path))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.path}/{name}")
            self.names.discard(name)

    def drop_others(self, *names: str) -> None:
        """Free all tables but those named."""
        self.drop(*(self.names - set(names)))


@atexit.register
def _tidy() -> None:
    for spark, path in _folders:
        with contextlib.suppress(Exception):
            remove(spark, path)
