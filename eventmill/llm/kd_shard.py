"""Shards of near equal bytes from a k-d tree over document metadata.

Documents of one text are a group and one weighted point: its dimensions are the text's bytes and
words, and the language and source of the group (the most frequent of its rows' values), numbered by
frequency. A node is split along its widest dimension (relative to the whole table's width) at the
weighted median, weighted by bytes; with an odd number of leaves below it the cut is at that share.

One pass over the rows sums the bytes of every open node in ``CELLS`` cells of each dimension; the
next one looks into the cells that the cuts fall into. Only sums come to the driver. Points that
share the median's value are cut by a hash of the group, so a value that holds a third of all bytes
is no obstacle, and a group is never parted. Only groups heavier than the slack that shards have
anyway (the largest document, or the share ``SLACK`` of a shard) are points row by row.

Defined results: null text has size 8 and is one group with empty text; null languages and sources
are values of their own, and those beyond the ``ORDINALS`` most frequent share the last number; of
a heavy group, rows equal in id and text stay in one shard; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CELLS = 1024
#: Cells that a cell with a cut is looked at in.
INNER_CELLS = 1 << 14
#: A cut may miss its place by this share of a shard's bytes, so that most need one inner pass.
TOLERANCE = 5e-4
#: Groups over this share of a shard's bytes may be parted.
SLACK = 0.01
#: Values of a metadata column with a number of their own.
ORDINALS = 1000
#: Rows that are numbered together.
SLOT_ROWS = 20_000
BROADCAST_ROWS = 500_000
_TIE_BITS = 28
DIMENSIONS = ("d_size", "d_words", "d_lang", "d_source")


@dataclass
class Node:
    """A subtree of shards first .. first + leaves - 1, and its cut once that is known."""

    first: int
    leaves: int
    dim: str = DIMENSIONS[0]
    value: int = 0
    tie: int = 0
    left: Node | None = None
    right: Node | None = None

    def goes_left(self) -> Column:
        v = F.col(self.dim)
        return (v < self.value) | ((v == self.value) & (F.col("tie") < self.tie))

    def place(self) -> Column:
        """The first shard of the lowest known subtree that holds a row."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(self.goes_left(), self.left.place()).otherwise(self.right.place())


@dataclass
class Search:
    """The range in which a node's cut lies: values below ``lo`` weigh ``below``, those in range ``inside``."""

    node: Node
    column: str
    lo: int
    hi: int
    below: int
    inside: int
    target: float
    done: bool = False

    @property
    def step(self) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // INNER_CELLS))

    def narrow(self, cells: dict[int, tuple[int, int, int]], most: float) -> None:
        """Go down to the cell (bytes, least and greatest value) that the target falls into; stop when that is close enough."""
        at = self.below
        for cell in sorted(cells):
            if at + cells[cell][0] > self.target or cell == max(cells):
                break
            at += cells[cell][0]
        self.inside, self.lo, self.hi = cells[cell]
        self.below = at
        self.done = self.inside <= most or self.lo == self.hi

    def cut(self) -> int:
        """The nearer end of the range: everything below it goes left."""
        return self.lo if self.target - self.below <= self.below + self.inside - self.target else self.hi + 1


_SUMS = (F.sum, "bytes"), (F.min, "lo"), (F.max, "hi")


def _profile(table: DataFrame, root: Node, spans: dict[str, tuple[int, int]]) -> dict[int, dict[str, dict[int, tuple[int, int, int]]]]:
    """For every open node and dimension, the cells with (bytes, least, greatest value): one pass."""
    points = [F.struct(F.lit(k).alias("dim"), F.col(d).alias("v"), F.floor((F.col(d) - spans[d][0]) / F.lit(max(1, -(-(spans[d][1] - spans[d][0] + 1) // CELLS)))).alias("cell")) for k, d in enumerate(DIMENSIONS)]
    rows = table.select(root.place().alias("node"), "size", F.explode(F.array(*points)).alias("x"))
    rows = rows.groupBy("node", "x.dim", "x.cell").agg(*(f("size" if n == "bytes" else "x.v").alias(n) for f, n in _SUMS)).collect()
    out: dict[int, dict[str, dict[int, tuple[int, int, int]]]] = {}
    for r in rows:
        out.setdefault(r["node"], {}).setdefault(DIMENSIONS[r["dim"]], {})[int(r["cell"])] = (r["bytes"], r["lo"], r["hi"])
    return out


def _inner(table: DataFrame, root: Node, searches: list[Search], most: float) -> None:
    """Narrow the open searches, all of them in each pass, until each is done."""
    while live := [s for s in searches if not s.done]:
        value = cell = F.lit(None).cast("long")
        for s in live:
            v = F.col(s.column)
            here = (F.col("node") == s.node.first) & v.between(s.lo, s.hi)
            if s.column == "tie":
                here &= F.col(s.node.dim) == s.node.value
            value, cell = F.when(here, v).otherwise(value), F.when(here, F.floor((v - s.lo) / F.lit(s.step))).otherwise(cell)
        rows = table.withColumn("node", root.place()).select("node", "size", value.alias("v"), cell.alias("cell")).where("cell is not null")
        found: dict[int, dict[int, tuple[int, int, int]]] = {}
        for r in rows.groupBy("node", "cell").agg(*(f("size" if n == "bytes" else "v").alias(n) for f, n in _SUMS)).collect():
            found.setdefault(r["node"], {})[int(r["cell"])] = (r["bytes"], r["lo"], r["hi"])
        for s in live:
            s.narrow(found[s.node.first], most) if s.node.first in found else setattr(s, "done", True)
            if s.done and s.column != "tie" and s.lo == s.hi and s.inside > most:  # the cut goes through one value
                s.node.value = s.lo
                s.column, s.lo, s.hi, s.done = "tie", 0, (1 << _TIE_BITS) - 1, False


def build_tree(table: DataFrame, shards: int) -> Node:
    """The tree over ``table``, which has size, tie and the dimensions."""
    root = Node(0, shards)
    whole = table.agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for f, n in _SUMS[1:])).first()
    if whole["bytes"] is None:
        return root
    spans = {d: (whole[f"lo_{d}"], whole[f"hi_{d}"]) for d in DIMENSIONS}
    most = TOLERANCE * whole["bytes"] / shards
    level = [root]
    while level := [n for n in level if n.leaves > 1]:
        found = _profile(table, root, spans)
        searches = []
        for n in level:
            if n.first not in found:  # nothing here: any cut will do
                continue
            cells = found[n.first]
            width = {d: (max(c[2] for c in cells[d].values()) - min(c[1] for c in cells[d].values())) / max(1, spans[d][1] - spans[d][0]) for d in DIMENSIONS}
            n.dim = max(DIMENSIONS, key=lambda d: width[d])
            total = sum(c[0] for c in cells[n.dim].values())
            s = Search(n, n.dim, 0, 0, 0, total, total * (n.leaves // 2) / n.leaves)
            s.narrow(cells[n.dim], most)
            if s.lo == s.hi and s.inside > most:
                n.value = s.lo
                s.column, s.lo, s.hi, s.done = "tie", 0, (1 << _TIE_BITS) - 1, False
            searches.append(s)
        _inner(table, root, searches, most)
        for s in searches:
            if s.column == "tie":
                s.node.tie = s.cut()
            else:
                s.node.value = s.cut()
        for n in level:
            n.left, n.right = Node(n.first, n.leaves // 2), Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2)
        level = [x for n in level for x in (n.left, n.right)]
    return root


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with d_<column>, the place of a value in the order of frequency; only ``ORDINALS`` values come to the driver."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(ORDINALS).collect()
    known = rows.sparkSession.createDataFrame([(r[column], k) for k, r in enumerate(counts)], f"{column} string, d_{column} long")
    return rows.join(F.broadcast(known), column, "left").withColumn(f"d_{column}", F.coalesce(f"d_{column}", F.lit(ORDINALS)).cast("long"))


def points(docs: DataFrame, scratch: Scratch, shards: int, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, t1, t2 (the group), the dimensions, tie and row, written."""
    given = F.col(text_col).cast("string")
    text = F.coalesce(given, F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(1), text).alias("t2"),
        (F.length(text) - F.length(F.translate(text, " \n\t", ""))).cast("long").alias("d_words"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(k) for c, k in zip(meta_cols, ("lang", "source"))),
        F.monotonically_increasing_id().alias("nth"),
    )
    rows = scratch.keep(rows, "texts")
    rows = _numbered(_numbered(rows, "lang"), "source").drop("lang", "source")
    whole = rows.agg(F.sum("size").alias("bytes"), F.max("size").alias("largest")).first()
    slack = max(SLACK * (whole["bytes"] or 0) / shards, whole["largest"] or 0)
    # the least number is that of the most frequent value
    groups = rows.groupBy("t1", "t2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("d_lang").alias("g_lang"), F.min("d_source").alias("g_source"))
    groups = groups.where("n > 1").select("t1", "t2", "g_lang", "g_source", (F.col("bytes") > slack).alias("heavy"))
    groups = scratch.keep(groups, "groups")
    small = groups.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(groups) if small else groups, ["t1", "t2"], "left")
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\0"), F.col("nth").cast("string"))), "t1")
    tie = F.pmod(F.when(F.coalesce("heavy", F.lit(False)), row).otherwise(F.xxhash64("t2", "t1")), F.lit(1 << _TIE_BITS))
    dims = [F.col("size").alias("d_size"), "d_words", F.coalesce("g_lang", "d_lang").alias("d_lang"), F.coalesce("g_source", "d_source").alias("d_source")]
    return scratch.keep(joined.select("doc_id", "size", "text_crc32", "t1", "t2", *dims, tie.alias("tie"), row.alias("row")), "rows")


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; slots count from 0 in each shard."""
    scratch = Scratch(docs.sparkSession, "shards")
    table = points(docs, scratch, shards, id_col, text_col, meta_cols)
    rows = table.count()
    placed = table.withColumn("shard", build_tree(table, shards).place().cast("int")).select("doc_id", "size", "text_crc32", "shard", "row")
    # a shard's rows are numbered in parts, by the rows of the parts before
    parts = max(1, -(-rows // SLOT_ROWS))
    placed = placed.withColumn("part", F.pmod(F.col("row"), F.lit(parts)))
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = scratch.keep(sizes.select("shard", "part", before.alias("start")), "starts")
    scratch.drop_others("rows", "starts")
    small = starts.count() <= BROADCAST_ROWS
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row", "doc_id")) - 1
    numbered = placed.withColumn("nth", nth).join(F.broadcast(starts) if small else starts, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))
