"""Phrase collocations of a corpus by count transducers.

Every shard (task) builds minimal acyclic automata from its sorted n-grams, one for each prefix range
and language; ranges are united and their counts summed where they meet; candidates are then cut, and
the counts of the parts are found by composing an automaton of the parts asked for with the range's
counts. Only automata, as arrays, are shuffled, and a range is a run of neighbouring phrases, not a
word: its bounds are quantiles of a drawn sample of n-grams (``SAMPLE``; it only balances ranges).

What can't reach ``least`` never enters an automaton. Before that, each level of n-grams is counted
by hash in a table, which never counts too little: an n-gram goes on only if its bucket, and those of
all its parts, reach ``least`` over the whole corpus. That is exact at any size; a table that has
filled up lets more n-grams through. So tables have ``BUCKETS`` entries, and from two words on more
where the corpus has more than ``least`` / 2 words a bucket, up to ``MOST``: that many counters (of one
byte for counts up to 255) a level and task, and bits a level at the driver. A task hands on what it
counted, in blocks of counters or, where few of a block were met, the places of those.

Null text is empty, null languages are ``und``. Rows are read one by one: repeated rows and ids count
each. Texts are read in chunks of ``CHUNK`` bytes, a longer one alone, at about 15 bytes a byte.
Columns other than text and language aren't read, so clashing names don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import buffers as B
from .scratch import Scratch
from .transducer import FIELDS, Key, Transducer, union

#: Counters of a level, a power of two, and how far they grow.
BUCKETS, MOST = 1 << 22, 1 << 26
#: Counters of a row.
BLOCK = 1 << 14
#: Bytes of text that are cut into words at once.
CHUNK = 8 << 20
#: N-grams that a task holds before it hands automata on.
HELD = 400_000
#: Drawn n-grams from which the bounds of ranges are taken, and those of one chunk and level.
SAMPLE, DRAWN = 20_000, 32
#: The first ranks of a language are taken from this many parts of its phrases.
SALT = 64

# A piece ends at these characters; blanks part words.
_ENDS, _BLANK = b".,;:!?\n\x0b\x0c\r", b"\t"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _ENDS else 32 if c in _BLANK else c for c in range(256))


class _Words:
    """Words of one language's texts: ``ids`` (-1 where a piece ends), ``words`` and ``hashes`` by id, ``n`` words in all."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.lang = lang
        line = b" \n ".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
        found = pc.list_flatten(pc.split_pattern(pa.array([line], pa.large_binary()), " ")).dictionary_encode()
        del line
        self.words = found.dictionary.to_pylist()
        ids = found.indices.to_numpy()
        role = np.array([2 if w == b"" else 1 if w == b"\n" else 0 for w in self.words], np.int8)[ids]
        self.ids = np.where(role == 1, -1, ids)[role < 2].astype(np.int64)
        self.n = int((role == 0).sum())
        _, at, data = found.dictionary.buffers()
        at = np.frombuffer(at, np.int64)[: len(self.words) + 1]
        prefix = B.prefix_hash(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))
        self.hashes = B.mix(B.range_hash(prefix, at[:-1], at[1:]) ^ np.uint64(zlib.crc32(lang.encode("utf-8", "replace"))), 7)

    def windows(self, marks: dict[int, np.ndarray], upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, hashes) of the n-grams of k words, up to ``upto``, whose parts, and which themselves as far as they are known, are marked."""
        valid = self.ids >= 0
        own = self.hashes[self.ids]  # that of id -1 is never used
        hashes = own
        for k in range(1, upto + 1):
            if k > 1:
                valid = valid[:-1] & valid[1:]
                hashes = B.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[k - 1 :], k)
            places = np.flatnonzero(valid)
            if k in marks:
                bucket = _bucket(hashes[places], 8 * len(marks[k]))
                kept = (marks[k][bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1
                valid = np.zeros(len(valid), bool)
                valid[places := places[kept]] = True
            yield k, places, hashes[places]

    def grams(self, marks: dict[int, np.ndarray], upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) of all that are marked in full, by length: a row an n-gram, -1 after its end."""
        number = self.ids.copy()  # of the n-gram that starts at a place
        for k, places, _ in self.windows(marks, upto):
            if k > 1:
                number[places] = number[places] * len(self.words) + self.ids[places + k - 1]
            _, first, again, counts = np.unique(number[places], return_index=True, return_inverse=True, return_counts=True)
            number[places] = again
            ids = np.full((len(first), upto), -1, np.int64)
            ids[:, :k] = self.ids[places[first][:, None] + np.arange(k)]
            yield ids, counts


class _Held:
    """N-grams of one language with their counts, as rows of numbers of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n = 0

    def add(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        """``ids`` are places in ``words``."""
        used, at = np.unique(ids, return_inverse=True)
        own = np.array([-1 if w < 0 else self.known.setdefault(words[w], len(self.known)) for w in used.tolist()], np.int32)
        self.ids.append(own[at.reshape(ids.shape)])
        self.counts.append(counts)
        self.n += len(counts)

    def fold(self) -> None:
        """Each n-gram once."""
        if self.n:
            ids, counts = np.concatenate(self.ids), np.concatenate(self.counts)
            order = np.lexsort(ids.T[::-1])
            ids = ids[order]
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
            self.ids, self.counts, self.n = [ids[first]], [np.add.reduceat(counts[order], first)], len(first)

    def items(self) -> list[tuple[Key, int]]:
        """All n-grams in order, each once."""
        if not self.n:
            return []
        words = sorted(self.known)
        rank = np.empty(len(words) + 1, np.int32)
        rank[[self.known[w] for w in words]], rank[-1] = np.arange(len(words)), -1
        self.ids = [rank[ids] for ids in self.ids]
        self.known = dict(zip(words, range(len(words))))
        self.fold()
        sizes = (self.ids[0] >= 0).sum(axis=1).tolist()
        return [(tuple([words[i] for i in row[:k]]), n) for row, k, n in zip(self.ids[0].tolist(), sizes, self.counts[0].tolist())]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[_Words]:
    """Words of the rows (lang, text as bytes), some texts of one language at a time."""
    waiting: dict[str, list[bytes]] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            if held and held + len(data) > chunk:
                for own in list(waiting):
                    yield _Words(own, waiting.pop(own))
                held = 0
            waiting.setdefault(lang, []).append(data)
            held += len(data)
    for own in list(waiting):
        yield _Words(own, waiting.pop(own))


def _packed(counts: np.ndarray) -> bytes:
    """A block of counters, or its places that were met and their counters if that is shorter."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].tobytes() if len(at) * (2 + counts.itemsize) < counts.nbytes else counts.tobytes()


def _add(own: np.ndarray, data: bytes, kind: np.dtype) -> None:
    """Add a packed block."""
    if len(data) == len(own) * kind.itemsize:
        own += np.frombuffer(data, kind)
    else:
        n = len(data) // (2 + kind.itemsize)
        own[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, kind, n, 2 * n)


def _count(levels: range, least: int, marks: Broadcast, longest: int, buckets: int, chunk: int):  # noqa: ANN202
    """Task: counts by bucket of the n-grams of ``levels``, and n-grams drawn for the bounds of ranges."""
    kind = np.uint8 if least < 256 else np.uint16 if least < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.zeros(buckets, kind) for k in levels}
        drawn: list[tuple[str, list[bytes]]] = []
        words = 0
        for part in _chunks(batches, chunk):
            words += part.n
            for k, places, hashes in part.windows(marks.value, levels[-1]):
                if k in tables:
                    bucket, n = np.unique(_bucket(hashes, buckets), return_counts=True)
                    tables[k][bucket] = np.minimum(tables[k][bucket] + n, least).astype(kind)  # more than enough is enough
                elif len(places) and levels[-1] == longest:
                    _, first = np.unique(hashes, return_index=True)
                    some = places[first[:: max(1, len(first) // DRAWN)]]
                    drawn += [(part.lang, [part.words[i] for i in part.ids[p : p + k].tolist()]) for p in some.tolist()]
            if len(drawn) > 10_000:
                yield _batch(_COUNTED, [(0, 0, None, lang, key, 0) for lang, key in drawn])
                drawn = []
        yield _batch(_COUNTED, [(0, 0, None, lang, key, 0) for lang, key in drawn])
        yield _batch(_COUNTED, [(-1, 0, None, None, None, words)])
        for k, table in tables.items():
            blocks = table.reshape(-1, BLOCK)
            met = np.flatnonzero(blocks.any(1))
            for some in range(0, len(met), 256):
                yield _batch(_COUNTED, [(k, int(b), _packed(blocks[b]), None, None, 0) for b in met[some : some + 256]])

    return run, kind


_PLAIN = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_ARROW = _PLAIN | {f"array<{name}>": pa.list_(kind) for name, kind in _PLAIN.items()}


def _batch(ddl: str, rows: list) -> pa.RecordBatch:
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(schema.types)], schema=schema)


_COUNTED = "level int, block int, counts binary, lang string, drawn array<binary>, words long"
_MARKED = "level int, block int, bits binary"
_SHARD = f"rng int, lang string, n long, {FIELDS}"


def _marks(counted: DataFrame, levels: range, least: int, kind: type, buckets: int) -> dict[int, np.ndarray]:
    """Bits of the buckets that reach ``least`` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(BLOCK, np.int64)
        bits = lambda: _batch(_MARKED, [(*at, np.packbits(own >= least, bitorder="little").tobytes())])
        for batch in batches:
            for level, block, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (level, block) != at:
                    if at and (own >= least).any():
                        yield bits()
                    at = level, block
                    own[:] = 0
                _add(own, data, np.dtype(kind))
        if at and (own >= least).any():
            yield bits()

    found = counted.where("level > 0").select("level", "block", "counts").repartition("level", "block").sortWithinPartitions("level", "block")
    out = {k: np.zeros(buckets // 8, np.uint8) for k in levels}
    for r in found.mapInArrow(run, _MARKED).collect():
        out[r["level"]][r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _shard_automata(marks: Broadcast, bounds: list[tuple[str, Key]], longest: int, chunk: int, most: int):  # noqa: ANN202
    """Task: automata of the task's n-grams by language and range, and each language's number of words."""

    def automata(held: dict[str, _Held]) -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            found = own.items()
            lo = 0
            while lo < len(found):
                rng = bisect_right(bounds, (lang, found[lo][0]))
                hi = len(found) if rng == len(bounds) or bounds[rng][0] != lang else bisect_right(found, bounds[rng][1], key=lambda x: x[0])
                if hi > lo and rng < len(bounds) and found[hi - 1][0] == bounds[rng][1]:
                    hi -= 1  # a bound begins the next range
                yield _rows([(rng, lang, 0, Transducer.build(found[lo:hi]))])
                lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        size: dict[str, int] = {}
        for part in _chunks(batches, chunk):
            size[part.lang] = size.get(part.lang, 0) + part.n
            own = held.setdefault(part.lang, _Held())
            for ids, counts in part.grams(marks.value, longest):
                own.add(part.words, ids, counts)
            if sum(x.n for x in held.values()) > 2 * most:
                for x in held.values():
                    x.fold()
                if sum(x.n for x in held.values()) > most:
                    yield from automata(held)
                    held.clear()
        yield from automata(held)
        yield _rows([(-1, lang, n, Transducer.build([])) for lang, n in size.items()])

    return run


def _rows(rows: list[tuple[int, str, int, Transducer]]) -> pa.RecordBatch:
    return _batch(_SHARD, [(rng, lang, n, *t.row().values()) for rng, lang, n, t in rows])


def _read(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[dict, Transducer]]:
    for row in table.to_pylist():
        yield row, Transducer.of(row)


def _united(least: int):  # noqa: ANN202
    """Task over shards in order of range and language: one automaton for each, of the n-grams that reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for row, own in _read(batch):
                if (key := (row["rng"], row["lang"])) != at:
                    if parts:
                        yield _rows([(*at, 0, union(parts, least))])
                    at, parts = key, []
                parts.append(own)
                if len(parts) == 64:
                    parts = [union(parts)]
        if parts:
            yield _rows([(*at, 0, union(parts, least))])

    return run


def _asks(bounds: list[tuple[str, Key]]):  # noqa: ANN202
    """Task: for each range and language, automata of the parts of its phrases, one for each range that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, own in _read(batch):
                parts = {p for key, _ in own.items() for k in range(1, len(key)) for p in (key[:k], key[k:])}
                asked: dict[int, list[tuple[Key, int]]] = {}
                for p in sorted(parts):
                    asked.setdefault(bisect_right(bounds, (row["lang"], p)), []).append((p, 0))
                yield _rows([(rng, row["lang"], row["rng"], Transducer.build(x)) for rng, x in asked.items()])

    return run


def _answers(counts: pa.Table, asks: pa.Table) -> pa.Table:
    """The automata asked for, composed with the counts of the range; n is the range that asked."""
    own = [t for _, t in _read(counts)]
    out = [(row["n"], row["lang"], 0, Transducer.build(t.compose(own[0]))) for row, t in _read(asks)] if own else []
    return pa.Table.from_batches([_rows(out)])


_PHRASE = "lang string, phrase string, size int, a long, l long, r long, n long, score long"


def _scored(counts: pa.Table, answers: pa.Table) -> pa.Table:
    """Each phrase at its lowest cut. Integers here have no bound."""
    part = {key: f for _, t in _read(answers) for key, f in t.items()}
    out = []
    for row, t in _read(counts):
        n = row["n"]
        for key, a in t.items():
            if len(key) > 1:
                cuts = ((1000 * a * n // (part[key[:k]] * part[key[k:]]), k) for k in range(1, len(key)))
                score, k = min(cuts)
                out.append((row["lang"], b" ".join(key).decode("utf-8", "replace"), len(key), a, part[key[:k]], part[key[k:]], n, score))
    return pa.Table.from_batches([_batch(_PHRASE, out)])


def candidates(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, chunk: int = CHUNK, held: int = HELD) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of every phrase of 2 to ``longest`` words that occurs ``least`` times or more in its language."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    marks: dict[int, np.ndarray] = {}
    # beyond two words few n-grams are left to count, so that one reading does for all of them
    for levels in [range(1, 2), range(2, 3), *([range(3, longest + 1)] if longest > 2 else [])]:
        task, kind = _count(levels, least, spark.sparkContext.broadcast(dict(marks)), max(longest, 2), buckets, chunk)
        counted = scratch.keep(texts.mapInArrow(task, _COUNTED), "counted")
        marks |= _marks(counted, levels, least, kind, buckets)
        if levels[0] == 1:
            words = counted.where("level = -1").agg(F.sum("words")).first()[0] or 0
            while buckets < MOST and 2 * words > buckets * least:
                buckets *= 2
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = counted.where("level = 0").select("lang", "drawn").distinct().orderBy(F.xxhash64("lang", "drawn"), "lang", "drawn").limit(SAMPLE).collect()
    keys = sorted((r["lang"], tuple(map(bytes, r["drawn"]))) for r in drawn)
    bounds = sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []
    shards = scratch.keep(texts.mapInArrow(_shard_automata(spark.sparkContext.broadcast(marks), bounds, longest, chunk, held), _SHARD), "shards")
    scratch.drop("counted")
    words = shards.where("rng < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    by_range = shards.where("rng >= 0").repartition("rng", "lang").sortWithinPartitions("rng", "lang")
    counts = scratch.keep(by_range.mapInArrow(_united(least), _SHARD), "counts")
    asks = scratch.keep(counts.mapInArrow(_asks(bounds), _SHARD), "asks")
    answers = scratch.keep(counts.groupBy("rng", "lang").cogroup(asks.groupBy("rng", "lang")).applyInArrow(_answers, _SHARD), "answers")
    whole = counts.drop("n").join(words, "lang").select(*counts.columns)
    out = scratch.keep(whole.groupBy("rng", "lang").cogroup(answers.groupBy("rng", "lang")).applyInArrow(_scored, _PHRASE), "phrases")
    scratch.drop_others("phrases")
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """The first ``top`` phrases of each language by score, ties by phrase, without those that hardly occur outside a longer one.

    A phrase falls if a longer one that holds it occurs at ``percent`` % of its count or more. Counts
    don't grow from a phrase to a longer one, so that the one-word longer ones tell. ``sizes``: those
    of ``candidates`` (buckets, chunk, held), which don't change the result.
    """
    found = candidates(docs, least, longest, text_col, lang_col, **sizes)
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, 1, F.size(words) - 1), " "), F.array_join(F.slice(words, 2, F.size(words) - 1), " "))
    longer = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {percent} * a").drop("longer")
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
