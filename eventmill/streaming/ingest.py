"""Incremental ingestion: new page files through the batch operators into the published table.

The stream gives the rows that the batch over the union of all files would give, whatever the order
of the files and however they are cut into batches: rows are selected first, and of the accepted rows
of a source id the least by time (and content) is published. State keyed by source id holds which row
that is so far and the batch that published it. If an earlier row comes later, it is published and the
one it replaces is taken back from the files of its batch and bucket; other files stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.folders import delete, exists, held

#: Files of a batch by source id; a correction rewrites one of them.
BUCKETS = 16
#: Groups of the rows without a source id, which are all published.
UNNAMED = 64

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_ADDED = ("__key", "__time", "__tie", "__named", "__batch")


def least_rows(keys: pd.Series, times: np.ndarray, ties: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Places of the first row of each key by time and tie, and of all rows that aren't named."""
    order = np.lexsort((ties, times))
    first = order[~keys.iloc[order].duplicated().to_numpy()]
    return np.sort(np.concatenate([first[named[first]], np.flatnonzero(~named)]))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before rows are dealt by source id: of the rows of a batch, those that may be published, so that a hot id costs a row a batch."""
    for batch in batches:
        keys, times, ties, named = (batch.column(batch.schema.get_field_index(c)) for c in _ADDED[:4])
        yield batch.take(pa.array(least_rows(keys.to_pandas(), times.to_numpy(), ties.to_numpy(), named.to_numpy(zero_copy_only=False))))


class FirstAccepted(StatefulProcessor):
    """The least accepted row of a source id: gives it when it changes, with the batch whose row it replaces."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("first", "time long, tie long, batch long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best = None
        for r in rows:
            if not r["__named"]:
                yield self._published(r, None)
            elif best is None or (r["__time"], r["__tie"]) < (best["__time"], best["__tie"]):
                best = r
        if best is None:
            return
        before = self.state.get()
        if before is None or (best["__time"], best["__tie"]) < (before[0], before[1]):
            self.state.update((best["__time"], best["__tie"], best["__batch"]))
            yield self._published(best, None if before is None else before[2])

    def _published(self, row: Row, replaces: int | None) -> Row:
        own = {k: v for k, v in row.asDict().items() if k not in _ADDED}
        return Row(**own, batch=row["__batch"], replaces=replaces)

    def close(self) -> None:
        pass


def _micros(time: Column, kind: T.DataType) -> Column:
    time = F.unix_micros(time.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)) else time.cast("long")
    return F.coalesce(time, F.lit((1 << 63) - 1))


def first_accepted(accepted: DataFrame, time_col: str) -> DataFrame:
    """The stream of published rows: those of ``accepted`` with batch, and replaces for a row that takes the place of one published before."""
    fields = accepted.schema.fields
    named = F.coalesce(F.col("source_id") != "", F.lit(False))
    content = F.xxhash64(*(F.col(f.name) for f in fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))
    key = F.when(named, F.concat(F.lit("+"), F.col("source_id"))).otherwise(F.concat(F.lit("-"), F.pmod(content, F.lit(UNNAMED)).cast("string")))
    rows = accepted.withColumns({"__time": _micros(F.col(time_col), accepted.schema[time_col].dataType), "__tie": content, "__named": named, "__batch": F.unix_millis(F.current_timestamp())}).withColumn("__key", key)
    # the time of a batch is that of its first run when it is run again
    folded = rows.mapInArrow(_fold, rows.schema)
    out = T.StructType([*fields, T.StructField("batch", T.LongType()), T.StructField("replaces", T.LongType())])
    return folded.groupBy("__key").transformWithState(FirstAccepted(), out, "Append", "None")


def put_batch(staged: DataFrame, published: str, buckets: int = BUCKETS) -> None:
    """Publish the rows of one batch, then take back those that they replace. To do so again changes nothing.

    A row is known by its batch, bucket and source id, so that only files that hold a replaced row are
    read and written. Between the two steps a reader may see both rows of an id.
    """
    spark = staged.sparkSession
    bucket = F.pmod(F.hash(F.coalesce("source_id", F.lit(""))), F.lit(buckets)).cast("int")
    rows = staged.withColumn("bucket", bucket)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(published)
    gone = rows.where("replaces is not null and replaces <> batch").select(F.col("replaces").alias("batch"), "bucket", "source_id").distinct()
    places = [(r["batch"], r["bucket"]) for r in gone.select("batch", "bucket").distinct().collect()]  # at most batches x buckets
    if not places:
        return
    here = spark.createDataFrame(places, "batch long, bucket int")
    table = spark.read.schema(rows.schema).parquet(published).where(F.col("batch").isin(sorted({b for b, _ in places})))
    old = table.join(F.broadcast(here), ["batch", "bucket"], "left_semi")
    kept = old.join(gone, ["batch", "bucket", "source_id"], "left_anti").select(*rows.columns)
    full = {(r["batch"], r["bucket"]) for r in kept.select("batch", "bucket").distinct().collect()}
    if full:
        kept.repartition("batch", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(published)
    for batch, b in places:  # nothing is written for a file that has lost all of its rows
        if (batch, b) not in full:
            delete(spark, f"{published}/batch={batch}/bucket={b}")


def stream_ingest_pages(pages: DataFrame, published: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], select: Callable[[DataFrame], DataFrame], time_col: str = "fetched_at", buckets: int = BUCKETS) -> StreamingQuery:
    """Start a query that publishes the first accepted event of each source id to the Parquet table ``published``.

    ``extract`` gives events with source_id (and keeps ``time_col``); ``select`` adds accepted. Both are
    applied to the stream, row by row, before rows meet, so that a rejected row hides nothing. Rows
    without a source id are all published; a null time counts as the latest. The table has batch (the
    time of the micro-batch), bucket and replaces beside the columns of the events.
    """
    spark = pages.sparkSession
    accepted = select(extract(pages)).where("accepted").drop("accepted")

    def publish(batch: DataFrame, number: int) -> None:
        staged = f"{checkpoint}/staged/{number}"
        batch.write.mode("overwrite").parquet(staged)  # state is read once
        put_batch(batch.sparkSession.read.schema(batch.schema).parquet(staged), published, buckets)
        delete(batch.sparkSession, staged)

    # a table without a row can be read, too
    with held(spark, _STORE):
        rows = first_accepted(accepted, time_col)
        if not exists(spark, published):
            columns = [f for f in rows.schema.fields if f.name != "batch"]
            spark.createDataFrame([], T.StructType(columns)).write.parquet(f"{published}/batch=0/bucket=0")
        return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
