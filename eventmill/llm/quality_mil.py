"""Quality scores by attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its hashed byte
n-grams by a learned layer; a gate and a tanh branch give every passage its attention weight, and
the weighted mean of the passage codes is scored. Only document labels are learned from: the
attention finds the passages that decide. Training uses a bounded sample (``SAMPLE`` documents of
each label, drawn by a hash of the row); scoring reads every whole text.

Defined results: null or blank text is a bag without passages and gets the score of an all-zero
representation; labels other than 0 and 1 are left out; of several labels for one id the least
counts; without any labelled text all scores are 0.5. Other columns are carried along; columns
named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import buffers as B

PASSAGE = 64
DIMENSIONS = 512
CODE, ATTENTION = 32, 16
PRIOR = 20.0
#: About so many documents of each label are learned from, and never more than four times that.
SAMPLE = 1000
#: Bytes of the texts that are learned from.
SAMPLE_BYTES = 64 << 20
EPOCHS = 12


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, one row a passage, and each document's first passage."""
    starts, ends, first = B.words(data, offsets)
    words = np.diff(first)
    count = -(-words // PASSAGE)
    at = np.concatenate([[0], np.cumsum(count)])
    if not at[-1]:
        return np.zeros((0, DIMENSIONS), np.float32), at
    nth = np.arange(at[-1]) - np.repeat(at[:-1], count)
    owner = np.repeat(np.arange(len(words)), count)
    w0 = first[owner] + nth * PASSAGE
    w1 = np.minimum(w0 + PASSAGE, first[owner + 1])
    lo, hi = starts[w0], ends[w1 - 1]
    # a text's last n-grams are short: they don't see the text behind it
    wide = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint32)
    second, third = wide[1:-1].copy(), wide[2:].copy()
    last = offsets[1:][np.diff(offsets) > 0] - 1
    second[last] = third[last] = 0
    third[np.maximum(last - 1, 0)] = 0
    code = ((wide[:-2] * np.uint32(0x9E3779B1) ^ second * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) ^ third * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    code = (code >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64)
    size = hi - lo
    where = np.repeat(np.arange(len(lo)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - lo, size)
    x = np.bincount(where * DIMENSIONS + code[place], minlength=len(lo) * DIMENSIONS).reshape(len(lo), DIMENSIONS)
    return x.astype(np.float32), at


def shares(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Square roots of n-gram shares, drawn towards ``prior`` by ``PRIOR`` n-grams: a few words tell little."""
    return np.sqrt((counts + PRIOR * prior) / (counts.sum(axis=1, keepdims=True) + PRIOR))


def _segment_softmax(e: np.ndarray, at: np.ndarray) -> np.ndarray:
    sizes = np.diff(at)
    top = np.maximum.reduceat(e, at[:-1])
    e = np.exp(e - np.repeat(top, sizes))
    return e / np.repeat(np.add.reduceat(e, at[:-1]), sizes)


class Model:
    """Encoder, gated attention and output layer."""

    def __init__(self, seed: int = 7):
        self.prior = np.full(DIMENSIONS, 1 / DIMENSIONS, np.float32)
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "encode": 3 * draw(DIMENSIONS, CODE), "encode_0": np.zeros(CODE, np.float32), "tanh": draw(CODE, ATTENTION), "gate": draw(CODE, ATTENTION),
            "weigh": draw(ATTENTION, 1)[:, 0], "out": draw(CODE, 1)[:, 0], "out_0": np.zeros(1, np.float32),
        }

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What is known of each passage by itself: its code, both halves of the gate, and its energy."""
        p, v = self.p, {}
        v["h"] = np.maximum(x @ p["encode"] + p["encode_0"], 0)
        v["t"] = np.tanh(v["h"] @ p["tanh"])
        v["g"] = 1 / (1 + np.exp(-(v["h"] @ p["gate"])))
        v["e"] = (v["t"] * v["g"]) @ p["weigh"]
        return v

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """All documents of ``at`` have a passage."""
        return self.pool(self.encode(x), at)

    def pool(self, v: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
        """Attention over the encoded passages of each document, and its score."""
        p = self.p
        v["a"] = _segment_softmax(v["e"], at)
        v["z"] = np.add.reduceat(v["a"][:, None] * v["h"], at[:-1])
        v["y"] = 1 / (1 + np.exp(-np.clip(v["z"] @ p["out"] + p["out_0"], -30, 30)))
        return v

    def gradient(self, x: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, v = self.p, self.forward(x, at)
        own = np.repeat(np.arange(len(label)), np.diff(at))
        d = (v["y"] - label) * weight
        g = {"out": v["z"].T @ d, "out_0": d.sum(keepdims=True)}
        dz = (d[:, None] * p["out"])[own]
        da = (dz * v["h"]).sum(axis=1)
        de = v["a"] * (da - np.add.reduceat(v["a"] * da, at[:-1])[own])
        g["weigh"] = (v["t"] * v["g"]).T @ de
        du = de[:, None] * p["weigh"]
        dt, dg = du * v["g"] * (1 - v["t"] ** 2), du * v["t"] * v["g"] * (1 - v["g"])
        g["tanh"], g["gate"] = v["h"].T @ dt, v["h"].T @ dg
        dh = (v["a"][:, None] * dz + dt @ p["tanh"].T + dg @ p["gate"].T) * (v["h"] > 0)
        g["encode"], g["encode_0"] = x.T @ dh, dh.sum(axis=0)
        return g

    def score_long(self, data: np.ndarray, words: int = 1 << 15) -> float:
        """The score of one long text: passages are encoded some at a time, and only their codes are kept."""
        starts, ends, _ = B.words(data, np.array([0, len(data)]))
        step = words // PASSAGE * PASSAGE
        codes = []
        for k in range(0, len(starts), step):
            part = data[starts[k] : ends[min(k + step, len(ends)) - 1]]
            v = self.encode(shares(passages(part, np.array([0, len(part)]))[0], self.prior))
            codes.append((v["h"], v["e"]))
        h, e = (np.concatenate(x) for x in zip(*codes))
        return float(self.pool({"h": h, "e": e}, np.array([0, len(e)]))["y"][0])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 2 and len(data) > B.SLICE_BYTES and (~B.blank(data)).any():
            return np.array([self.score_long(data)])
        x, at = passages(data, offsets)
        some = np.flatnonzero(np.diff(at))
        out = np.full(len(offsets) - 1, 1 / (1 + np.exp(-float(self.p["out_0"][0]))))
        if len(some):
            out[some] = self.forward(shares(x, self.prior), np.append(at[:-1][some], at[-1]))["y"]
        return out


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam over small batches of documents; both labels weigh the same in all.

    ``bags`` holds the counts of each document's passages. The prior is the mean passage of label 1.
    """
    model = Model(seed)
    if not len(bags) or labels.min() == labels.max():
        model.p["out"][:] = 0
        return model
    mean = sum(b.sum(axis=0, dtype=np.float64) for b, y in zip(bags, labels) if y)
    model.prior = (mean / mean.sum()).astype(np.float32)
    bags = [shares(b.astype(np.float32), model.prior).astype(np.float16) for b in bags]
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = r.permutation(len(bags))
        for i in range(0, len(order), 32):
            rows = order[i : i + 32]
            at = np.concatenate([[0], np.cumsum([len(bags[k]) for k in rows])])
            g = model.gradient(np.concatenate([bags[k] for k in rows]).astype(np.float32), at, labels[rows].astype(np.float32), weight[rows] / len(rows))
            step += 1
            for k, v in g.items():
                v = v + 1e-4 * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                model.p[k] = (model.p[k] - 0.003 * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in B.slices(batch.column(1), 1 << 18):
            x, at = passages(data, offsets)
            bags = pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 2)), bags], ["label", "key", "bag"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on about ``SAMPLE`` labelled documents of each label.

    Texts are drawn in the order of a hash as far as they come to ``SAMPLE_BYTES`` together; one that is
    longer by itself isn't drawn, none is cut. A bag has 1 KB for 64 words.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = lambda k: F.lit(min(1_000_000, 1_000_000 * SAMPLE // max(1, counts.get(k, 0))))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.when(F.col("label") == 1, share(1)).otherwise(share(0)))
    # a limit with an order, so that the same rows are learned from however the table is cut
    drawn = drawn.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(4 * SAMPLE)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    texts = texts.groupBy("label", F.xxhash64("id", "text").alias("key")).agg(F.min("text").alias("text")).select("label", "text", "key")
    sizes = texts.select("key", F.octet_length("text").alias("size")).where(F.col("size") <= SAMPLE_BYTES).orderBy("key").limit(4 * SAMPLE).collect()
    whole, last = 0, None
    for r in sizes:
        whole += r["size"]
        if whole > SAMPLE_BYTES:
            break
        last = r["key"]
    texts = texts.where((F.octet_length("text") <= SAMPLE_BYTES) & (F.col("key") <= F.lit(last).cast("long")))
    bags = texts.mapInArrow(_bag_batches, "label int, key long, bag binary").where("length(bag) > 0")
    got = bags.orderBy("key").limit(4 * SAMPLE).select("label", "bag").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, DIMENSIONS) for r in got]
    return fit(bags, np.array([r["label"] for r in got]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1."""
    docs = docs.drop("score")
    column = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(column), 1 << 19):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.score(data, offsets).astype(np.float64))], [*part.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
