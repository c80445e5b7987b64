"""Removal of byte strings that occur more than once in a corpus, with suffix arrays over candidate contexts.

Every window of ``length`` bytes picks one anchor, the leftmost least hash among its short grams.
Equal windows pick the same gram at the same place, so only windows with an equal anchor need be
compared, and each window is compared once. The windows of one anchor form a context, the bytes
they cover together.

* A key (anchor gram) seen once has no repeats; one whose contexts are all equal repeats in full.
* The distinct contexts of the other keys are cut into blocks aligned to the anchor, and the suffix
  array of the block sequences (built by linear grouping, see ``lyndon``) gives the classes of
  equal block runs; the bytes left and right of the run then decide for each window.
* A key with more distinct contexts than one task takes is split by the windows' distance from
  the anchor into keys of its own, again and again; a key of one window has equal contexts only.

Symbols are bytes, or words (64-bit hashes of runs without blanks) for passages of so many words.

Matches never cross documents. Null text is empty and has no windows. What is removed from a text
depends on the texts alone, so that a row's identity is its content (128 bits of hash), whatever its
id: rows with the same text, or the same id, or no id, are separate documents, and repeat each other
where their texts do. Long texts are taken in pieces. Other columns are carried along; columns named
like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import buffers as B
from .lyndon import suffix_array
from .marks import marked
from .scratch import Scratch

LENGTH = 400
GRAM = 50
BLOCK = 32
#: Bytes of a symbol, symbols of an anchor gram, and of a block of the suffix arrays.
UNITS = {"byte": (1, GRAM, BLOCK), "word": (8, 8, 8)}
#: Distinct contexts of one key that a task takes at once, and of one suffix array.
CONTEXTS = 2000
#: Parts into which the windows of a larger key are split.
PARTS = 8
#: Rows of two hashes up to this number are broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Places of contexts in documents up to this number are broadcast (56 bytes each); beyond it the join shuffles.
BROADCAST_PLACES = 1_000_000
#: Spans of texts up to this number are broadcast (32 bytes each); beyond it the join shuffles.
BROADCAST_SPANS = 1_000_000
#: Bytes of contexts that a task hands on at once.
OUT_BYTES = 4 << 20
#: Symbols of one text that are searched for anchors at once.
PIECE = 1 << 19
_ROW = "t1 long, t2 long, key long, ctx long, lo int, hi int, p int"
_TEXT = ["t1", "t2"]


def symbols(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, and where each text's begin."""
    if unit == "byte":
        return data, offsets
    starts, ends, first = B.words(data, offsets)
    return B.word_hash(data, starts, ends), first


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of all texts (bytes or word hashes): text, gram hash, context hash, first and last window, place of the gram."""
    empty = np.zeros(0, np.int64)
    none = {"doc": empty, "key": empty, "ctx": empty, "lo": empty, "hi": empty, "p": empty}
    if len(data) < length:
        return none
    prefix = B.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = B.range_hash(prefix, at, at + gram)
    # the place in the low bits makes the leftmost of equal hashes the least
    bits = max(1, int(len(data)).bit_length())
    mask = np.uint64((1 << bits) - 1)
    least, span, width = (grams & ~mask) | at.astype(np.uint64), 1, length - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & mask).astype(np.int64)
    start = np.arange(len(place))
    doc = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[doc + 1]
    start, place, doc = start[inside], place[inside], doc[inside]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    lo, hi, p, doc = start[first], start[np.append(first[1:], len(start)) - 1], place[first], doc[first]
    ctx = B.mix(B.field_hash(B.field_prefix(data), lo, hi + length) + (p - lo).astype(np.uint64), 3)
    base = offsets[doc]
    return {"doc": doc, "key": grams[p].view(np.int64), "ctx": ctx.view(np.int64), "lo": lo - base, "hi": hi - base, "p": p - base}


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first symbol, symbols, offsets): all texts at once, or one long text in pieces that share no window and miss none."""
    if len(data) <= PIECE or len(offsets) > 2:
        yield 0, data, offsets
        return
    for a in range(0, len(data) - length + 1, PIECE):
        part = data[a : a + PIECE + length - 1]
        yield a, part, np.array([0, len(part)])


def _anchor_batches(length: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(0), batch.column(1)
            for lo, _, data, offsets in B.slices(batch.column(2)):
                for base, part, at in _pieces(*symbols(data, offsets, unit), length):
                    a = anchors(part, at, length, UNITS[unit][1])
                    rows = pa.array(a["doc"] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [one.take(rows), two.take(rows), pa.array(a["key"]), pa.array(a["ctx"]), *(pa.array((a[k] + base).astype(np.int32)) for k in ("lo", "hi", "p"))],
                        [*_TEXT, "key", "ctx", "lo", "hi", "p"],
                    )

    return run


def repeated_windows(contexts: list[bytes], anchor: np.ndarray, windows: np.ndarray, length: int = LENGTH, block: int = BLOCK, width: int = 1) -> np.ndarray:
    """For each window of each context, in turn, whether another window has the same symbols (of ``width`` bytes).

    ``anchor`` is the place of the anchor in each context, ``windows`` the number of its windows.
    """
    sizes = np.array([len(c) // width for c in contexts], np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    prefix = B.field_prefix(np.frombuffer(b"".join(contexts), np.uint8 if width == 1 else np.uint64))
    skip = anchor % block
    blocks = np.maximum((sizes - skip) // block, 0)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = off[owner] + skip[owner] + block * nth
    symbol = np.unique(B.field_hash(prefix, at, at + block), return_inverse=True)[1] + 1
    # one separator behind the blocks of each context, lower than every block
    base = np.cumsum(blocks + 1) - (blocks + 1)
    text = np.zeros(int((blocks + 1).sum()), np.int64)
    text[base[owner] + nth] = symbol
    order = np.array(suffix_array(text.tolist()), np.int64)
    most = length // block
    padded = np.concatenate([text, np.zeros(most, np.int64)])
    common = np.zeros(len(order), np.int64)
    same = np.arange(1, len(order))
    for d in range(most):
        x, y = padded[order[same] + d], padded[order[same - 1] + d]
        same = same[(x == y) & (x > 0)]
        common[same] = d + 1
    classes = {}
    for m in (most - 1, most):
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(common < m)
        classes[m] = of
    own = np.repeat(np.arange(len(sizes)), windows)
    i = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    k = np.maximum(-(-(i - skip[own]) // block), 0)
    start, run = off[own] + i, off[own] + skip[own] + block * k
    m = (start + length - run) // block
    suffix = base[own] + k
    run_class = np.where(m == most, classes[most][suffix], classes[most - 1][suffix])
    code = B.mix(run_class.astype(np.uint64) * np.uint64(most + 1) + m.astype(np.uint64), 1)
    code = B.mix(code + B.field_hash(prefix, start, run), 2)
    code = B.mix(code + B.field_hash(prefix, run + block * m, start + length), 3)
    _, of, seen = np.unique(code, return_inverse=True, return_counts=True)
    return seen[of] > 1


def _bucket(length: int, unit: str):
    width, _, block = UNITS[unit]

    def spans(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = group["lo"].to_numpy(np.int64), group["hi"].to_numpy(np.int64)
        windows = hi - lo + 1
        hit = repeated_windows(group["bytes"].tolist(), group["p"].to_numpy(np.int64) - lo, windows, length, block, width)
        own = np.repeat(np.arange(len(lo)), windows)
        i = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        own, i = own[hit], i[hit]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (i[1:] != i[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(own)) - 1 if len(own) else first
        row = own[first]
        return pd.DataFrame({"t1": group["t1"].to_numpy()[row], "t2": group["t2"].to_numpy()[row], "start": lo[row] + i[first], "end": lo[row] + i[last] + length})

    return spans


def _slice_batches(length: int, unit: str):
    width = UNITS[unit][0]
    columns = [*_TEXT, "key", "weight", "lo", "hi", "p", "bytes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for frame in batches:
            for text, t1, t2, places in frame.itertuples(index=False):
                data = (text or "").encode()
                if unit == "word":
                    raw = np.frombuffer(data, np.uint8)
                    data = symbols(raw, np.array([0, len(raw)]), unit)[0].tobytes()
                for x in places:
                    out.append((t1, t2, x["key"], x["weight"], x["lo"], x["hi"], x["p"], data[x["lo"] * width : (x["hi"] + length) * width]))
                    size += len(out[-1][-1])
                    if size > OUT_BYTES:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
        yield pd.DataFrame(out, columns=columns)

    return run


def _split_batches(length: int, unit: str, depth: int):
    """Contexts of too large keys, cut by the windows' distance from the anchor."""
    step, width = max(1, -(-(length) // PARTS**depth)), UNITS[unit][0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for t1, t2, key, weight, lo, hi, p, data in frame[[*_TEXT, "key", "weight", "lo", "hi", "p", "bytes"]].itertuples(index=False):
                for part in range((p - hi) // step, (p - lo) // step + 1):
                    a, b = max(lo, p - part * step - step + 1), min(hi, p - part * step)
                    # what every window of the part covers, whatever its context
                    shared = data[(p - part * step - lo) * width : (p - part * step - step + 1 + length - lo) * width]
                    own = data[(a - lo) * width : (b + length - lo) * width]
                    out.append((t1, t2, _hash(shared, key + part), _hash(own, p - a), weight, a, b, p, own))
            yield pd.DataFrame(out, columns=[*_TEXT, "key", "ctx", "weight", "lo", "hi", "p", "bytes"])

    return run


def _hash(data: bytes, seed: int) -> int:
    raw = np.frombuffer(data, np.uint8)
    code = B.field_hash(B.field_prefix(raw), np.array([0]), np.array([len(raw)]))
    return int(B.mix(code + np.uint64(seed & 0xFFFFFFFFFFFFFFFF), 5).view(np.int64)[0])


def _resolve(rows: DataFrame, source: DataFrame, scratch: Scratch, length: int, unit: str, depth: int) -> list[DataFrame]:
    """Spans (t1, t2, start, end) of the repeated windows among ``rows``, contexts with key and ctx."""
    tag = f"-{depth}"
    keys = rows.groupBy("key").agg(F.sum("weight").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
    keys = scratch.keep(keys.where("n > 1").select("key", (F.col("c0") != F.col("c1")).alias("mixed")), "keys" + tag)
    found = scratch.keep(rows.join(keys, "key"), "found" + tag)
    span = lambda df: df.select(*_TEXT, F.col("lo").cast("long").alias("start"), (F.col("hi") + F.lit(length)).cast("long").alias("end"))
    out = [span(found.where("not mixed"))]
    mixed = found.where("mixed")
    one = F.struct(*_TEXT, "lo", "hi", "p", *(["bytes"] if depth else []))
    classes = mixed.groupBy("key", "ctx").agg(F.sum("weight").alias("weight"), F.min(one).alias("x")).select("key", "ctx", "weight", "x.*")
    classes = scratch.keep(classes, "classes" + tag)
    repeated = classes.where("weight > 1").select("key", "ctx")
    few = repeated.count() <= BROADCAST_ROWS
    out.append(span(mixed.join(F.broadcast(repeated) if few else repeated, ["key", "ctx"])))
    if not depth:
        places = classes.groupBy(*_TEXT).agg(F.collect_list(F.struct("key", "weight", "lo", "hi", "p")).alias("places"))
        places = scratch.keep(places, "places")
        small = (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES
        asked = source if small else marked(source, places, "t1", scratch).where("__marked").drop("__marked")
        texts = asked.join(F.broadcast(places) if small else places, _TEXT).dropDuplicates(_TEXT).select("text", *_TEXT, "places")
        schema = "t1 long, t2 long, key long, weight long, lo int, hi int, p int, bytes binary"
        classes = scratch.keep(texts.mapInPandas(_slice_batches(length, unit), schema), "contexts")
    sizes = scratch.keep(classes.groupBy("key").agg(F.count("*").alias("contexts")), "sizes" + tag)
    total = sizes.agg(F.sum("contexts")).first()[0] or 0
    if not total:
        return out
    buckets = max(1, -(-total // CONTEXTS))
    sized = classes.join(sizes, "key")
    dealt = sized.where(F.col("contexts") <= CONTEXTS).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    spans = dealt.select("bucket", *_TEXT, "lo", "hi", "p", "bytes").groupBy("bucket").applyInPandas(_bucket(length, unit), "t1 long, t2 long, start long, end long")
    out.append(spans)
    large = sized.where(F.col("contexts") > CONTEXTS)
    if not large.isEmpty():
        parts = large.mapInPandas(_split_batches(length, unit, depth + 1), "t1 long, t2 long, key long, ctx long, weight long, lo int, hi int, p int, bytes binary")
        out += _resolve(scratch.keep(parts, "parts" + tag), source, scratch, length, unit, depth + 1)
    return out


def _identity(text: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def repeated_spans(texts: DataFrame, text_col: str = "text", length: int = LENGTH, unit: str = "byte") -> DataFrame:
    """(t1, t2, spans): for each text with repeats, by its identity, the maximal ranges of symbols that repeated windows cover.

    The table is written; whatever else was written is dropped.
    """
    scratch = Scratch(texts.sparkSession, f"repeats-{unit}")
    source = texts.select(*_identity(F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    found = scratch.keep(source.mapInArrow(_anchor_batches(length, unit), _ROW), "anchors")
    parts = _resolve(found.withColumn("weight", F.lit(1).cast("long")), source, scratch, length, unit, 0)
    spans = parts[0]
    for x in parts[1:]:
        spans = spans.unionByName(x)
    spans = spans.groupBy(*_TEXT).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = scratch.keep(spans.mapInArrow(_merge_batches, "t1 long, t2 long, spans array<struct<start: long, end: long>>"), "spans")
    scratch.drop_others("spans")
    return spans


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in _merged(x.as_py())] for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], batch.schema.names)


def _in_bytes(data: bytes, spans: list[tuple[int, int]], unit: str) -> list[tuple[int, int]]:
    if unit == "byte" or not spans:
        return spans
    raw = np.frombuffer(data, np.uint8)
    starts, ends, _ = B.words(raw, np.array([0, len(raw)]))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in spans]


def _cut_batches(text_col: str, drop: list[str], unit: str, passages: bool, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.drop_columns(drop)
            column = lambda name: batch.column(batch.schema.names.index(name))  # noqa: B023, E731
            texts = column(text_col).cast(pa.large_binary())
            counts: dict[str, list[int]] = {x: [] for x in _COUNTS[: 5 if passages else 3]}
            kept = []
            for i, (text, own) in enumerate(zip(texts, column("__spans"))):
                data = text.as_py() or b""
                runs = _in_bytes(data, _merged(own.as_py()), unit)
                keep, at = [], 0
                for a, b in runs:
                    keep.append(data[at:a])
                    at = b
                rest = b"".join([*keep, data[at:]])
                row = [len(data), len(data) - len(rest), len(runs)]
                if passages:
                    more = _in_bytes(data, _merged(column("__passages")[i].as_py()), "word")
                    row += [sum(b - a for a, b in more), len(more)]
                for x, n in zip(counts, row):
                    counts[x].append(n)
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            cols = [*(pa.array(x, pa.int64()) for x in counts.values()), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([*frame.columns, *cols], [*frame.schema.names, *counts, "kept"])

    return run


_COUNTS = ("n_bytes", "n_removed", "n_spans", "passage_bytes", "n_passages")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, unit: str = "byte", passage_words: int = 0, as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept``, the bytes of no repeated window of ``length`` symbols.

    With ``unit`` word, a window is so many words, whatever stands between them, and what is removed
    reaches from a word's first byte to a word's last. ``passage_words`` adds passage_bytes and
    n_passages, what repeated windows of so many words cover; these are counted and not removed.
    ``as_text`` makes ``kept`` a string; a character of which a part is removed goes as a whole.
    """
    counts = _COUNTS[: 5 if passage_words else 3]
    docs = docs.drop(*counts, "kept")
    spans = {"__spans": repeated_spans(docs, text_col, length, unit)}
    if passage_words:
        spans["__passages"] = repeated_spans(docs, text_col, passage_words, "word")
    keyed = docs.withColumns(dict(zip(("__t1", "__t2"), _identity(F.col(text_col)))))
    scratch = Scratch(docs.sparkSession, "spans")
    found = None
    for name, table in spans.items():
        table = table.select("t1", "t2", F.col("spans").alias(name))
        found = table if found is None else found.join(table, _TEXT, "full")
    found = scratch.keep(found, "found")
    size = sum(F.coalesce(F.size(F.coalesce(x, F.array())), F.lit(0)) for x in spans)
    small = (found.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_SPANS
    found = found.withColumnsRenamed({"t1": "__t1", "t2": "__t2"})
    if small:
        joined = keyed.join(F.broadcast(found), ["__t1", "__t2"], "left").select(*keyed.columns, *spans)
    else:
        told = marked(keyed, found, "__t1", scratch)
        joined = told.where("__marked").join(found, ["__t1", "__t2"], "left").select(*keyed.columns, *spans)
        joined = joined.unionByName(told.where("not __marked").select(*keyed.columns).withColumns({x: F.lit(None).cast(found.schema[x].dataType) for x in spans}))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in counts), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    return joined.mapInArrow(_cut_batches(text_col, ["__t1", "__t2", *spans], unit, bool(passage_words), as_text), schema)
