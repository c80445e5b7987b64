"""How the filters of a corpus interact, counted by a stream that takes back what smaller ids make wrong.

All files are read as micro-batches of an available-now stream. A task turns each whole text into a
digest and the mask of the filters that it fails by itself; rows are then folded (``folded``), so that
a text of which a batch has many copies leaves its least id and sums. State keyed by the text's digest
holds its least id so far and the rows that bear it: rows with a greater id fail the filter for copies.
When a smaller id arrives, the masks of the rows that were least are retracted from the counters of
their parts and counted anew as copies. What each batch adds and takes back is written as rows of
(part, mask, labels, n); their sums are the counters, from which every order of the filters follows.

State is kept by Spark in its checkpointed store, so that a lost executor loses nothing and a batch
that is run again replaces its own rows. It holds one small row for each different text. Counters are
part x 128 rows at most.

Null text is empty. Rows without an id are never copies and make none. Rows of one id that have one
text bear its least id together. Labels of one id that differ count as good or toxic if any of them
is. The stream needs columns doc_id, text and source; others aren't read, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import permutations
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .scratch import Scratch, settings

FILTERS = "ABCDE"
#: The bit of a filter in a mask; the last one is the filter for copies.
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
COPY = BIT["E"]

#: Rows (without texts) that a task folds at once.
FOLD = 100_000
#: Keys that the sums of a mask are dealt to.
SALT = 16
#: Micro-batches that all files are dealt to, if there are so many files.
BATCHES = 4
#: State lies on the executors' disks, not in their heaps, and goes to the checkpoint by its changes.
_STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # stores are many and small
}

_UPPER = bytes(range(65, 91))
_TAIL = bytes(range(128, 192))  # bytes of UTF-8 that don't begin a character
_MARKS = re.compile(rb"[#$%&*|]")


def own_mask(data: bytes) -> int:
    """Filters that a text fails by itself: A, under 200 words; B, under half of its words differ; C, over 2 % capitals; D, marks."""
    words = data.split()  # bytes are split at space and tab to carriage return only
    n, size = len(words), len(data)
    fails = n < 200, 100 * len(set(words)) < 50 * n, 100 * (size - len(data.translate(None, _UPPER))) > 2 * len(data.translate(None, _TAIL)), _MARKS.search(data) is not None
    return sum(f << k for k, f in enumerate(fails))


_JUDGED = "key binary, doc_id long, part string, mask int"
_FOLDED = "key binary, doc_id long, part string, mask int, good boolean, toxic boolean, n long"
_DELTA = "part string, mask int, good boolean, toxic boolean, n long"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2)]
        keys = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([keys, batch.column(0), batch.column(1), pa.array(map(own_mask, texts), pa.int32())], ["key", "doc_id", "part", "mask"])


def folded(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows with the least id of their text, as they are, and sums of all others, which are copies; ``n`` counts rows.

    Sums have keys of two bytes, which no text has, dealt by one text of the fold, and no id. Rows without
    an id are sums that aren't copies.
    """
    least = rows.groupby("key")["doc_id"].transform("min")
    first = (rows["doc_id"] == least).fillna(False).astype(bool)  # a text whose rows have no id has none
    rest = rows[~first].copy()
    rest["mask"] = np.where(rest["doc_id"].isna(), rest["mask"], rest["mask"] | COPY)
    by = ["part", "mask", "good", "toxic"]
    sums = rest.groupby(by, as_index=False).size().rename(columns={"size": "n"})
    salt = bytes(rows["key"].iloc[0])[0] % SALT if len(rows) else 0
    sums["key"] = [bytes([m, salt]) for m in sums["mask"]]
    sums["doc_id"] = pd.Series(pd.NA, index=sums.index, dtype="Int64")
    kept = rows[first].groupby(["key", "doc_id", *by], as_index=False).size().rename(columns={"size": "n"})
    columns = [x.split()[0] for x in _FOLDED.split(", ")]
    return pd.concat([kept[columns], sums[columns]]) if len(sums) else kept[columns]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for frame in batches:
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        held.append(frame)
        if sum(map(len, held)) >= FOLD:
            yield folded(pd.concat(held))
            held = []
    if held:
        yield folded(pd.concat(held))


class LeastId(StatefulProcessor):
    """The least id of a text and the rows that bear it; gives what is to be added to the counters, and taken back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("least", "doc_id long, mask int, holders array<struct<part:string,good:boolean,toxic:boolean,n:long>>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        out: dict[tuple, int] = defaultdict(int)
        new = []
        for r in rows:
            if r["doc_id"] is None:
                out[r["part"], r["mask"], r["good"], r["toxic"]] += r["n"]
            else:
                new.append(r)
        if new:
            self._judge(new, out)
        for (part, mask, good, toxic), n in out.items():
            if n:
                yield Row(part=part, mask=mask, good=good, toxic=toxic, n=n)

    def _judge(self, new: list[Row], out: dict[tuple, int]) -> None:
        before = self.state.get()
        least, mask, n = min(r["doc_id"] for r in new), new[0]["mask"], len(new)
        holders: dict[tuple, int] = defaultdict(int)
        if before is not None:
            for part, good, toxic, count in before[2]:
                if least < before[0]:
                    out[part, mask, good, toxic] -= count
                    out[part, mask | COPY, good, toxic] += count
                elif least == before[0]:
                    holders[part, good, toxic] += count
            if before[0] < least:
                least = before[0]
        for r in new:
            copy = r["doc_id"] > least
            out[r["part"], mask | COPY if copy else mask, r["good"], r["toxic"]] += r["n"]
            if not copy:
                holders[r["part"], r["good"], r["toxic"]] += r["n"]
                n -= 1
        if n < len(new):
            self.state.update((least, mask, [(*key, n) for key, n in holders.items()]))

    def close(self) -> None:
        pass


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    by, held = ["part", "mask", "good", "toxic"], []
    for frame in batches:
        held.append(frame)
        if sum(map(len, held)) >= FOLD:
            held = [pd.concat(held).groupby(by, as_index=False)["n"].sum()]
            if len(held[0]) > FOLD // 2:
                yield held.pop()
    if held:
        yield pd.concat(held).groupby(by, as_index=False)["n"].sum()


def count_masks(docs: DataFrame, labels: DataFrame, checkpoint: str, counters: str) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by the filters that they fail, from the stream ``docs``.

    The query runs to the end of what is there now. A later call with the same folders takes up new
    files only, retracts what they make wrong, and returns the counters of all.
    """
    spark = docs.sparkSession
    known = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    no = F.lit(False)
    judged = rows.mapInArrow(_judge, _JUDGED).join(known, "doc_id", "left")
    labelled = judged.select("key", "doc_id", "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    deltas = labelled.mapInPandas(_fold, _FOLDED).groupBy("key").transformWithState(LeastId(), _DELTA, "Append", "None").mapInPandas(_summed, _DELTA)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{counters}/batch={number}")

    with settings(spark, _STREAM):
        query = deltas.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.schema(f"{_DELTA}, batch int").parquet(counters)
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def interactions(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the counters of ``count_masks``.

    Counters become arrays by mask, one row for each part, which the 600 steps of all orders read.
    """
    masks = range(1 << len(FILTERS))
    at = lambda m, cond: F.coalesce(F.sum(F.when((F.col("mask") == m) & cond, F.col("n"))), F.lit(0)).cast("long")
    yes = F.lit(True)
    by_part = counts.groupBy("part").agg(*(F.array(*(at(m, cond) for m in masks)).alias(name) for name, cond in (("all", yes), ("good", F.col("good")), ("bad", F.col("toxic")))))
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(before).alias("before"), F.lit(BIT[f]).alias("own")))
            before |= BIT[f]
    rows = by_part.withColumn("s", F.explode(F.array(*steps))).select("part", "all", "good", "bad", "s.*")
    before, own = F.col("before"), F.col("own")

    def total(counts_by_mask: str, keep: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.zip_with(F.col(counts_by_mask), F.array(*map(F.lit, masks)), lambda n, m: F.when(keep(m), n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)

    clear = lambda m: m.bitwiseAND(before) == 0
    fails = lambda m: m.bitwiseAND(own) != 0
    removed = lambda m: clear(m) & fails(m)
    # of the orders, the filter comes first among those that a document fails in as many as for any other of them
    shares = F.array(*(F.lit(120 // max(1, m.bit_count())).cast("long") for m in masks))
    share = F.aggregate(F.zip_with(F.col("all"), F.array(*map(F.lit, masks)), lambda n, m: F.when(fails(m), n * F.element_at(shares, m + 1)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "part", "filter_order", "step", total("all", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"), total("all", removed).alias("removed"),
        total("all", lambda m: ~clear(m) & fails(m)).alias("redundant"), total("all", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("bad", removed).alias("toxic_lost"), share.alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``interactions`` of all files of the Parquet table at ``path``, in about so many micro-batches."""
    table = spark.read.parquet(path)
    files = len(table.inputFiles())
    # as a pattern (of one name), the path may be a single file as well as a folder
    docs = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{path[:-1]}[{path[-1]}]")
    scratch = Scratch(spark, "filter-audit")
    return interactions(count_masks(docs, labels, f"{scratch.path}/checkpoint", f"{scratch.path}/counters"))
