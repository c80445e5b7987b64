"""A small table of bits that keeps rows out of a shuffle when the other side of a join has no row for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bits of the table: a million rows of 64 at most, 24 bytes each, whatever the size of the input.
MARKS = 1 << 26


def marked(rows: DataFrame, found: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``rows`` with __marked, false only for rows whose ``key`` (a hash) ``found`` doesn't have.

    The table is broadcast and doesn't grow with the input; once it is full it merely marks all rows.
    """
    bit = f"pmod({key}, {MARKS})"
    one = f"shiftleft(1L, cast({bit} % 64 as int))"
    marks = found.groupBy(F.expr(f"{bit} div 64").alias("__word")).agg(F.bit_or(F.expr(one)).alias("__bits"))
    marks = scratch.keep(marks, f"marks-{key}")
    joined = rows.withColumn("__word", F.expr(f"{bit} div 64")).join(F.broadcast(marks), "__word", "left")
    return joined.withColumn("__marked", F.expr(f"(coalesce(__bits, 0L) & {one}) <> 0")).select(*rows.columns, "__marked")
