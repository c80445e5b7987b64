"""Quality rules: counts of a document's faults, and a hashed n-gram likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` counters. Two multinomials are counted over whole
texts: one over the documents trusted as target, one over all documents. A document's score is the
mean over its n-grams of the log ratio of the two; it is kept from ``THRESHOLD`` on, always by the
same rule and never by a draw. Everything is a built-in expression, and what comes to the driver
are the counters, whose number is fixed.

Defined results: null or blank text has no words and fails; without trusted documents every score
is 0; repeated rows count each time; other columns are ignored. A text's words and hashes are arrays of
one row, so that a task holds about 100 bytes for each byte of its longest text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_text import let, windows, words

BUCKETS = 1 << 14
#: Least mean log ratio of a kept document; -0.1 is nine tenths of the likelihood per n-gram.
THRESHOLD = -0.1
MIN_WORDS = 50
#: Trusted ids up to this number are broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def _repeated_positions(hashes: Column) -> Column:
    """Positions, ascending, of the windows whose hash is not unique in the array."""
    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def pick(s: Column) -> Column:
        twin = lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(twin(k), F.lit(False))), lambda k: F.get(s, k)["i"]))

    return let(order, pick)


def repeat_words(items: Column, n: int = 3) -> Column:
    """Words inside windows of ``n`` words that occur at least twice among ``items``."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))

    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["total"] + (p + n - F.greatest(p, acc["end"]))).cast("long").alias("total"), (p + n).alias("end"))

    def count(h: Column) -> Column:
        unique = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(unique, F.lit(0).cast("long")).otherwise(F.aggregate(_repeated_positions(h), zero, step)["total"])

    return let(windows(items, n, lambda w: F.xxhash64(*w)), count)


def ngram_buckets(items: Column) -> Column:
    """Buckets of all words and word pairs, letter case aside."""
    lower = F.transform(items, lambda w: F.lower(w))
    bucket = lambda w: F.pmod(F.xxhash64(*w), F.lit(BUCKETS)).cast("int")
    return let(lower, lambda s: F.concat(F.transform(s, lambda w: bucket([w])), windows(s, 2, bucket)))


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, id_col: str, text_col: str) -> list[float]:
    """For each bucket log p(trusted) - log p(all), with one count added everywhere."""
    ids = trusted_ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = source.join(F.broadcast(ids) if small else ids, source["doc"] == ids["id"], "left")
    grams = marked.select(F.col("id").isNotNull().cast("long").alias("target"), F.explode(ngram_buckets(words(F.col("text")))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw)]


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the four counts, base_failed, the mean log ratio ``llr``, and kept."""
    import numpy as np

    weights = F.lit(np.array(log_ratios(docs, trusted_ids, id_col, text_col)))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    score = lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(weights, b)) / F.size(g))
    measured = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
            let(ngram_buckets(w), score).alias("llr"),
        ),
    )
    out = source.select(
        "doc_id",
        measured.alias("m"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        out.select("doc_id", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.llr")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
    )
