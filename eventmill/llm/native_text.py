"""Text expressions from built-in functions only, shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once for a row however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def windows(items: Column, n: int, of: Callable[[list[Column]], Column]) -> Column:
    """``of`` applied to each run of ``n`` items; empty if there are fewer."""
    last = F.size(items) - n
    steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: of([F.get(items, i + k) for k in range(n)]))
