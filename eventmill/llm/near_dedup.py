"""Near-duplicate documents: fast similarity sketches, banding, exact verification on whole sets.

The sketch fills ``COORDINATES`` bins. In round i every shingle is thrown into one bin with a value
that is larger in later rounds, and a bin keeps its least value; after as many rounds as there are
bins, a still empty bin takes the least hash over all shingles. Every coordinate is so filled, also
for sets of one shingle, and the share of equal coordinates of two sketches concentrates around the
Jaccard similarity of the sets. Bands of coordinates give candidate groups; links are decided on
the full shingle sets only.

Words are hashed eight bytes at a time and shingles word by word, every step mixed, so that unlike
words or shingles are the same by chance only (64 bits), whatever they are built like; sets are told
apart by their size and 128 bits.

Defined results: null or blank text has no shingles and no links; a text under five words is one
shingle; repeated rows link with each other; rows of one id with different texts are one document
that is linked by any of them; a row without id belongs to the component of its set, is ``kept``,
and never stands for others, and if all rows of a set lack an id, they have no links. Input columns
other than the id and text columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import buffers as B
from .components import components
from .marks import marked
from .scratch import Scratch

SHINGLE_WORDS = 5
COORDINATES = 128
ROWS_PER_BAND = 4
#: Documents that one task compares with each other; larger groups are cut into blocks of this size.
BLOCK = 512
#: Bytes of the shingle sets of a block, of which a larger set is one alone.
BLOCK_BYTES = 32 << 20
#: Shingles whose intersections are counted at once; more are cut by ranges of their hashes.
AT_ONCE = 1 << 20
#: Ids up to this number are broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Counters of shingles, hashed, by which rare ones are told; only these come to the driver.
COUNTERS = 1 << 18
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their offsets."""
    data = B.lower_ascii(data)
    starts, ends, first = B.words(data, offsets)
    word = B.word_hash(data, starts, ends)
    sets, at = [], np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        w = word[first[i] : first[i + 1]]
        if len(w):
            k = min(len(w), SHINGLE_WORDS)
            m = len(w) - k + 1
            h = np.full(m, k, np.uint64)
            for j in range(k):
                h = B.mix(h + w[j : j + m], j)
            sets.append(np.unique(h))
            at[i + 1] = len(sets[-1])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(at)


def sketches(values: np.ndarray, at: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: one row of ``t`` coordinates each."""
    n = len(at) - 1
    sizes = np.diff(at)
    owner = np.repeat(np.arange(n), sizes)
    out = np.full((n, t), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    live = sizes > 0
    for i in range(t):
        rows = live[owner]
        if not rows.any():
            break
        own, h = owner[rows], B.mix(values[rows], 1000 + i)
        # the round stands above the value, so that a later round never replaces an earlier one
        value = (h >> np.uint64(16)) | np.uint64(i << 48)
        np.minimum.at(flat, own * t + (h & np.uint64(t - 1)).astype(np.int64), value)
        live &= (out == _EMPTY).any(axis=1)
    for d in np.flatnonzero(live):
        mine = values[at[d] : at[d + 1]]
        for j in np.flatnonzero(out[d] == _EMPTY).tolist():
            out[d, j] = (B.mix(mine, 1000 + t + j).min() >> np.uint64(16)) | np.uint64(t << 48)
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    n, t = sketch.shape
    key = np.zeros((n, t // ROWS_PER_BAND), np.uint64) + np.arange(t // ROWS_PER_BAND, dtype=np.uint64)
    for j in range(ROWS_PER_BAND):
        key = B.mix(key + sketch[:, j::ROWS_PER_BAND], j)
    return key


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in B.slices(batch.column(1)):
            values, at = shingle_sets(data, offsets)
            sizes = np.diff(at)
            some = np.flatnonzero(sizes)
            fp = np.zeros((hi - lo, 2), np.uint64)
            if len(some):
                fp[some, 0] = np.bitwise_xor.reduceat(B.mix(values, 7), at[:-1][some])
                fp[some, 1] = np.add.reduceat(B.mix(values, 8), at[:-1][some])
            keys = band_keys(sketches(values, at))
            width = keys.shape[1]
            list_at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, width, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(list_at), pa.array(keys[sizes > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)), bands],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in B.slices(batch.column(1)):
            values, at = shingle_sets(data, offsets)
            sets = pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], ["rep", "shingles"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted distinct arrays.

    Large lists are cut by ranges of values, whose partial intersections add up.
    """
    whole = sum(map(len, left)) + sum(map(len, right))
    if whole <= AT_ONCE:
        return _intersections(left, right)
    parts = -(-whole // AT_ONCE)
    cuts = np.array([k * (1 << 64) // parts for k in range(1, parts)], np.uint64)
    at = [[np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]]) for s in x] for x in (left, right)]
    out = np.zeros((len(left), len(right)), np.int64)
    for k in range(parts):
        out += _intersections(*([s[a[k] : a[k + 1]] for s, a in zip(x, own)] for x, own in zip((left, right), at))).astype(np.int64)
    return out


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """A shingle of one set only never counts, so what is held is a 0/1 matrix over shared shingles, a few thousand columns at a time."""
    both = np.concatenate([*left, *right])
    side = np.concatenate([np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)])
    cut = sum(map(len, left))
    names, code, seen = np.unique(both, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(seen > 1)
    column = np.full(len(names), -1)
    column[shared] = np.arange(len(shared))
    code = column[code]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    order = order[code[order] >= 0]
    for lo in range(0, len(shared), 4096):
        a, b = np.searchsorted(code[order], [lo, lo + 4096])
        part = order[a:b]
        x, y = (np.zeros((len(s), min(4096, len(shared) - lo)), np.float32) for s in (left, right))
        l, r = part[part < cut], part[part >= cut]
        x[side[l], code[l] - lo] = 1
        y[side[r], code[r] - lo] = 1
        out += x @ y.T
    return out


def _verifier(percent: int):
    def links(group: pa.Table) -> pa.Table:
        """Links between the two sides of a block pair, a spanning forest of them only.

        Pairs already in one component are left alone; so are pairs that this block has joined.
        """
        rep, half = group.column("rep").to_numpy(), group.column("half").to_numpy()
        # a hub may stand twice; an id with several texts has a row for each
        shingles = group.column("shingles").to_pylist()
        first = np.unique(np.stack([half, rep, np.array([hash(s) for s in shingles])]), axis=1, return_index=True)[1]
        rep, half, comp = rep[first], half[first], group.column("comp").to_numpy()[first]
        sets = [np.frombuffer(shingles[i], np.uint64) for i in first]
        one = half.min() == half.max()
        sides = []
        for h in (0, 1):
            rows = np.flatnonzero(half == h) if not one else np.arange(len(rep))
            sides.append((rep[rows], comp[rows], [sets[i] for i in rows]))
        (ids_a, comp_a, a), (ids_b, comp_b, b) = sides
        size_a, size_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
        same = intersections(a, b).astype(np.int64)
        union = size_a[:, None] + size_b[None, :] - same
        hit = (100 * same >= percent * union) & (comp_a[:, None] != comp_b[None, :])
        x, y = np.nonzero(hit)
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        out = []
        for u, v in zip(comp_a[x].tolist(), comp_b[y].tolist()):
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
                out.append((u, v))
        ends = np.array(out, np.int64).reshape(-1, 2)
        del sets, sides, a, b, same, union, hit
        B.give_back()
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return links


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links within groups; ``members`` has (key, part, half, rep, comp)."""
    rows = members.join(sets, "rep").select("key", "part", "half", "rep", "comp", "shingles")
    return rows.groupBy("key", "part").applyInArrow(_verifier(percent), "a long, b long").distinct()


def _block_pairs(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, part, half, rep, comp): members (key, rep, comp, and m for a key's members) of each pair of blocks to compare.

    Members of a key are dealt into lots of about eight blocks, numbered by component in each lot and
    cut every ``BLOCK`` rows or ``BLOCK_BYTES`` (of ``size`` shingles), so that no window grows with a
    group and a component of any size fills blocks of its own. A pair of blocks of one and the same component is left out, and where one
    side is of one component, so are the other side's members of it, before sets are joined.
    """
    if "size" not in placed.columns:
        placed = placed.withColumn("size", F.lit(0))
    # what a member fills of a block, in millionths
    placed = placed.withColumn("fill", F.greatest(F.lit(1_000_000 // BLOCK), F.floor(F.col("size") * 8e6 / BLOCK_BYTES)).cast("long"))
    filled = scratch.keep(placed.groupBy("key").agg(F.sum("fill").alias("filled")), "filled")
    lot = F.pmod(F.xxhash64("rep"), F.ceil(F.col("filled") / F.lit(8_000_000)))
    order = Window.partitionBy("key", "lot").orderBy("comp", "rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.floor((F.sum("fill").over(order) - 1) / F.lit(1_000_000))
    placed = placed.join(filled, "key").withColumn("lot", lot).select("key", "rep", "comp", F.xxhash64("lot", nth).alias("blk"))
    placed = scratch.keep(placed, "blocked")
    ends = scratch.keep(placed.groupBy("key", "blk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "blocks")
    x, y = (ends.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("blk", "lo", "hi"))) for side in "xy")
    both = x.join(y, "key").where("blk_x <= blk_y and not (lo_x = hi_x and lo_y = hi_y and lo_x = lo_y)")
    part = F.xxhash64("blk_x", "blk_y").alias("part")
    sides = [pairs.select("key", part, F.lit(half).alias("half"), F.col(f"blk_{a}").alias("blk"), F.when(F.col(f"lo_{b}") == F.col(f"hi_{b}"), F.col(f"lo_{b}")).alias("only")) for pairs, half, a, b in ((both, 0, "x", "y"), (both.where("blk_x < blk_y"), 1, "y", "x"))]
    sides = sides[0].unionByName(sides[1])
    return placed.join(sides, ["key", "blk"]).where("only is null or comp <> only").select("key", "part", "half", "rep", "comp")


def _groups(entries: DataFrame, scratch: Scratch, tag: str) -> tuple[DataFrame, DataFrame]:
    """(key, m, w, hub) and (key, m, w, hub, rep, size) of the keys that several documents have, one of each membership.

    ``entries`` has key, rep and size; w sums the sizes. Most keys are of one document: a table of bits keeps their entries
    out of the join's shuffle.
    """
    keys = scratch.keep(entries.groupBy("key").agg(F.count("*").alias("m"), F.sum("size").alias("w"), F.min("rep").alias("hub")).where("m > 1"), f"keys{tag}")
    several = marked(entries, keys, "key", scratch).where("__marked").drop("__marked")
    several = scratch.keep(several.join(keys, "key").select("key", "m", "w", "hub", "rep", "size"), f"several{tag}")
    # a hash is summed by halves, since 64-bit sums of whole hashes overflow in large groups
    h = F.xxhash64("rep")
    sums = F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("sig1"), F.sum(F.shiftrightunsigned(h, 32)).alias("sig2"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("sig3")
    groups = several.groupBy("key", "m", "w", "hub").agg(*sums).groupBy("m", "w", "sig1", "sig2", "sig3", "hub").agg(F.min("key").alias("key"))
    groups = scratch.keep(groups.select("key", "m", "w", "hub"), f"groups{tag}")
    members = scratch.keep(several.join(groups.select("key"), "key", "left_semi"), f"members{tag}")
    scratch.drop(f"keys{tag}", f"several{tag}")
    return groups, members


def _bucket(values: np.ndarray) -> np.ndarray:
    return (B.mix(values, 9) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
        bucket, n = np.unique(_bucket(values), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])


def rare_ends(sets: list[np.ndarray], counts: np.ndarray, percent: int) -> list[np.ndarray]:
    """The shingles of each set that come first in the order of frequency, as many as two linked sets have to share one of.

    Linked sets share at least ``percent`` per cent of either, so that no more than the rest of a
    set can come before the first shared shingle.
    """
    out = []
    for s in sets:
        order = np.lexsort((s, counts[_bucket(s)]))
        out.append(s[order[: len(s) + percent * len(s) // -100 + 1]])
    return out


def _rare_batches(counts: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = rare_ends([np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()], counts, percent)
            reps = np.repeat(batch.column(0).to_numpy(), [len(e) for e in ends])
            keys = np.concatenate(ends) if ends else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(reps)], ["key", "rep"])

    return run


def _sharing_rare(asked: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(key, rep, comp, size): the documents of ``asked`` (rep, comp, size) by the rare shingles that several components share."""
    own = scratch.keep(sets.join(asked.select("rep"), "rep", "left_semi").select("rep", "shingles"), "asked-sets")
    counts = np.zeros(COUNTERS, np.int64)
    for r in own.mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    ends = scratch.keep(own.mapInArrow(_rare_batches(counts, percent), "key long, rep long").withColumn("size", F.lit(0).cast("long")), "rare")
    _, members = _groups(ends, scratch, "-2")
    members = members.select("key", "rep").join(asked, "rep").select("key", "rep", "comp", "size")
    members = scratch.keep(members, "sharing")
    split = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return members.join(scratch.keep(split, "split-2"), "key", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets.
    Equal sets collapse into their least id first, so a large group of copies costs one row. A
    candidate group is compared in blocks of ``BLOCK`` with its least member in each. The documents
    of larger groups that are then still in several components are grouped anew, exactly, by the
    rarest shingles of their sets, of which linked sets share one; such groups are compared in pairs
    of blocks. So documents alike in their common words only don't meet, and no pair is ever a row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"
    sketched = scratch.keep(source.mapInArrow(_sketch_batches, schema), "sketches")
    fp = ["n_shingles", "fp1", "fp2"]
    classes = scratch.keep(sketched.where("n_shingles > 0").groupBy(*fp).agg(F.min("doc_id").alias("rep")), "classes")
    labelled = sketched.join(classes, fp, "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"), F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")
    )
    labelled = scratch.keep(labelled, "labelled")
    scratch.drop("sketches", "classes")

    entries = labelled.where("bands is not null and n_shingles > 0").select("rep", F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    groups, members = _groups(entries, scratch, "")
    ids = scratch.keep(members.select("rep").distinct(), "ids")
    n = ids.count()
    wanted = source.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, source["doc_id"] == ids["rep"], "left_semi")
    sets = scratch.keep(wanted.mapInArrow(_set_batches, "rep long, shingles binary").where("rep is not null"), "sets")

    blocks = F.ceil(F.greatest(F.col("m") / F.lit(BLOCK), F.col("w") * F.lit(8 / BLOCK_BYTES))).cast("int")
    dealt = members.select("key", "rep", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("part"))
    hubs = groups.where(blocks > 1).select("key", F.col("hub").alias("rep"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"))
    first = dealt.unionByName(hubs).select("key", "part", F.lit(0).alias("half"), "rep", F.col("rep").alias("comp"))
    named = labelled.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps")).where("size(reps) > 1")
    found = _links(first, sets, percent).unionByName(named.select("a", F.explode("reps").alias("b")))
    found = scratch.keep(found.where("a <> b"), "links-1")
    roots = scratch.keep(components(found, scratch), "roots-1")

    large = members.where(blocks > 1)
    if not large.isEmpty():
        placed = large.join(roots, large["rep"] == roots["id"], "left").select("key", "rep", "size", F.coalesce("root", "rep").alias("comp"))
        placed = scratch.keep(placed, "placed")
        split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        placed = placed.join(scratch.keep(split, "split"), "key", "left_semi")
        asked = scratch.keep(placed.select("rep", "comp", "size").distinct(), "asked")
        pairs = _block_pairs(_sharing_rare(asked, sets, scratch, percent), scratch)
        found = scratch.keep(found.unionByName(_links(pairs, sets, percent)), "links-2")
        roots = scratch.keep(components(found, scratch), "roots-2")

    out = labelled.drop("bands").join(roots, labelled["rep"] == roots["id"], "left")
    component = F.coalesce("root", "rep")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    # four numbers a row: the rest is freed before they are read
    out = scratch.keep(out, "judged")
    scratch.drop_others("judged")
    return out
