"""Byte-level BPE encoding and decoding with a public vocabulary of ranks.

A text is cut into pieces by the tokenizer's pattern. The merge order inside a piece is kept in a
segment tree over its byte positions: a leaf holds the rank of the pair that starts there and the
root the leftmost least one. A merge changes three leaves (the pair's right half dies, the merged
symbol and its live left neighbour get new ranks), each by one climb to the root. Many pieces of
similar length are merged in step, as rows of numpy arrays, and each distinct piece is encoded once
per worker while it stays in a bounded cache.

Null text is empty and has no ids. Special tokens are ordinary text. Other columns are carried
along; columns named like a result are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import buffers as B

#: Pieces whose ids a worker remembers; the cache starts afresh when it is full.
CACHE = 200_000
#: Pieces of more bytes than this are merged one by one.
LONG = 256
#: Bytes of pieces that are merged in step.
STEP_BYTES = 1 << 20
_NONE = np.int64(1 << 62)


class Vocabulary:
    """Ranks, and for each pair of tokens the rank of their concatenation."""

    def __init__(self, file: bytes):
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        size = max(rank.values()) + 1
        self.bytes = [b""] * size
        for token, r in rank.items():
            self.bytes[r] = token
        self.single = np.array([rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary needs all single bytes")
        left, right, out = [], [], []
        for token, r in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(r)
        self.width = size
        key = np.array(left, np.int64) * size + np.array(right, np.int64)
        order = np.argsort(key)
        self.pairs, self.ranks = key[order], np.array(out, np.int64)[order]
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.rank_of = dict(zip(self.pairs.tolist(), self.ranks.tolist()))
        self.whole = rank
        self.cache: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (as 32-bit integers) of pieces of one size class, merged in step."""
        n = np.array([len(p) for p in pieces], np.int64)
        leaves = 1 << int(n.max() - 1).bit_length() if n.max() > 1 else 1
        count = len(pieces)
        raw = np.zeros((count, leaves), np.uint8)
        inside = np.arange(leaves) < n[:, None]
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.single[raw]
        live = inside.copy()
        following = np.tile(np.arange(1, leaves + 1), (count, 1))
        following[following >= n[:, None]] = leaves
        before = np.tile(np.arange(-1, leaves - 1), (count, 1))
        tree = np.full((count, 2 * leaves), _NONE)
        if leaves > 1:
            pair = inside[:, 1:]
            rank = np.full((count, leaves - 1), _NONE)
            rank[pair] = self.pair_ranks(ids[:, :-1][pair], ids[:, 1:][pair])
            place = np.broadcast_to(np.arange(leaves - 1), rank.shape)
            tree[:, leaves:-1] = np.where(rank < _NONE, rank * leaves + place, _NONE)
            k = leaves // 2
            while k:
                tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
                k //= 2

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + leaves
            tree[rows, node] = value
            while node[0] > 1 if len(node) else False:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            at = tree[rows, 1] % leaves
            ids[rows, at] = tree[rows, 1] // leaves
            gone = following[rows, at]
            after = following[rows, gone]
            live[rows, gone] = False
            following[rows, at] = after
            some = after < leaves
            before[rows[some], after[some]] = at[some]
            put(rows, gone, np.full(len(rows), _NONE))
            value = np.full(len(rows), _NONE)
            rank = self.pair_ranks(ids[rows[some], at[some]], ids[rows[some], after[some]])
            value[some] = np.where(rank < _NONE, rank * leaves + at[some], _NONE)
            put(rows, at, value)
            back = before[rows, at]
            some = back >= 0
            r, b = rows[some], back[some]
            rank = self.pair_ranks(ids[r, b], ids[r, at[some]])
            put(r, b, np.where(rank < _NONE, rank * leaves + b, _NONE))
            rows = rows[tree[rows, 1] < _NONE]
        flat = ids[live].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one long piece: the same tree without arrays, which pay off for many rows only."""
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        ids: list[int] = self.single[np.frombuffer(piece, np.uint8)].tolist()
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, rank_of, width = int(_NONE), self.rank_of, self.width
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = rank_of.get(ids[i] * width + ids[i + 1])
            if rank is not None:
                tree[leaves + i] = rank * leaves + i
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int) -> None:
            """Rank the pair that starts at ``leaf`` and climb while an inner node changes."""
            after = following[leaf] if ids[leaf] >= 0 else n
            rank = rank_of.get(ids[leaf] * width + ids[after]) if after < n else None
            node, value = leaf + leaves, none if rank is None else rank * leaves + leaf
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            at, rank = tree[1] % leaves, tree[1] // leaves
            gone = following[at]
            after = following[gone]
            ids[at], ids[gone], following[at] = rank, -1, after
            if after < n:
                before[after] = at
            put(gone)
            put(at)
            if before[at] >= 0:
                put(before[at])
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of all ``pieces`` into the cache."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(pieces)
        raw = []
        for data, p in sorted(((p.encode(), p) for p in new), key=lambda x: len(x[0])):
            rank = self.whole.get(data)  # a piece that is a token needs no merges
            if rank is None:
                raw.append((data, p))
            else:
                self.cache[p] = np.int32(rank).tobytes()
        at = len(raw)
        while at and len(raw[at - 1][0]) > LONG:
            at -= 1
            self.cache[raw[at][1]] = self.merge_long(raw[at][0])
        del raw[at:]
        at = 0
        while at < len(raw):
            leaves, end = 1 << (len(raw[at][0]) - 1).bit_length(), at
            while end < len(raw) and len(raw[end][0]) <= leaves and (end - at + 1) * leaves <= max(STEP_BYTES // 8, leaves):
                end += 1
            for (_, piece), ids in zip(raw[at:end], self.merge([b for b, _ in raw[at:end]])):
                self.cache[piece] = ids
            at = end

    def encode_long(self, pieces: Iterator[str], most: int = 100_000) -> np.ndarray:
        """Ids of one text's pieces, of which no more than ``most`` are held at once."""
        out = []
        while own := list(islice(pieces, most)):
            self.learn(set(own))
            out.append(np.frombuffer(b"".join(map(self.cache.__getitem__, own)), np.int32))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - self.start[ids], sizes)
        return self.flat[place].tobytes()


_vocabularies: dict[int, Vocabulary] = {}


def _vocabulary(file: bytes) -> Vocabulary:
    key = hash(file)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(file)
    return _vocabularies[key]


def _read(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def _encoder(file: Broadcast, pattern: str, column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut, known = regex.compile(pattern), _vocabulary(file.value)
        find = cut.findall
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(column)):
                raw = data.tobytes()
                part = batch.slice(lo, hi - lo)
                if hi == lo + 1 and len(raw) > B.SLICE_BYTES:  # one long text, some pieces at a time
                    values = pa.array(known.encode_long(m.group() for m in cut.finditer(raw.decode("utf-8", "replace"))))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], [*part.schema.names, "ids"])
                    continue
                pieces = [find(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                known.learn(set(chain.from_iterable(pieces)))
                look = known.cache.__getitem__
                ids = [np.frombuffer(b"".join(map(look, p)), np.int32) for p in pieces]
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at), values)], [*part.schema.names, "ids"])
        known.cache.clear()  # the worker lives on when this task is done
        B.give_back()

    return run


def _decoder(file: Broadcast, column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(file.value)
        for batch in batches:
            col = batch.column(column)
            at = col.offsets.to_numpy()
            values = col.values.to_numpy()
            out = [known.decode(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return run


_IDS, _DECODED = T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of each whole text.

    The vocabulary file (base64 token and rank in each line) is read once and broadcast; its size is
    that of the tokenizer and doesn't depend on the data.
    """
    file = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))
    docs = docs.drop("ids")
    return docs.mapInArrow(_encoder(file, pattern, docs.columns.index(text_col)), T.StructType([*docs.schema.fields, _IDS]))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that the ids stand for."""
    file = encoded.sparkSession.sparkContext.broadcast(_read(vocabulary))
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decoder(file, encoded.columns.index(ids_col)), T.StructType([*encoded.schema.fields, _DECODED]))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and, decoded from them, ``decoded``: ``encode`` and ``decode`` in one worker a task instead of two, and without the text."""
    file = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))
    docs = docs.drop("ids", "decoded")
    column, others = docs.columns.index(text_col), [k for k, c in enumerate(docs.columns) if c != text_col]
    encoder, decoder = _encoder(file, pattern, column), _decoder(file, len(others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoder(batch.select([*others, len(batch.schema) - 1]) for batch in encoder(batches))

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[k] for k in others), _IDS, _DECODED]))
