"""Connected components of an edge table by alternating large-star and small-star rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _stars(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """One rewriting. ``edges`` holds (u, v) with u > v.

    Small star links every smaller neighbour of u, and u, to the least of them; large star links
    every larger neighbour to the least neighbour (u included). The least neighbours are written
    before the join, so that both sides are shuffled for it and a hub's rows can be split.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = scratch.keep(least, f"{name}-least")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return scratch.keep(out.where("u > v").distinct(), name)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for every node of ``edges`` (columns a, b): root is the least id reachable.

    Work and rows of a round are linear in the edges; the number of rounds is logarithmic. Nothing
    but a row count and a checksum of each round comes to the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = scratch.keep(edges, "edges-0")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first())
    before, k = state(edges), 0
    while before[0]:
        k += 1
        large = _stars(edges, scratch, f"large-{k}", True)
        edges = _stars(large, scratch, f"edges-{k}", False)
        after = state(edges)
        scratch.drop(f"edges-{k - 1}", f"large-{k}", f"large-{k}-least", f"edges-{k}-least")
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
