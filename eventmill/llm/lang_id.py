"""Language identification in two steps: the family first, then linear machines between its languages.

Texts are seen as shares of hashed byte n-grams, lower-cased. A set of one-versus-one linear support
vector machines chooses the family; another set, one for each pair of languages of that family,
chooses the language by votes, then by margins. Training uses a bounded sample of labelled rows
(``SAMPLE`` a language, drawn by a hash of the row); prediction reads every whole text.

Defined results: null text, or text without a letter, is ``und`` with score 0; a text too short for
an n-gram is judged by the machines' offsets; ties go to the first name; without any labelled
text everything is ``und``. Other columns are carried along; columns named like a result are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import buffers as B

DIMENSIONS = 1 << 12
#: About so many rows of each language are learned from, and never more than twice that in all.
SAMPLE = 400
#: Languages that are learned, and rows of all of them (16 KB each at the driver).
LANGUAGES, ROWS = 200, 8000
ORDERS = (2, 3)
#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def gram_codes(data: np.ndarray, order: int) -> np.ndarray:
    """Hashed codes of the byte n-grams that start at each position (the last few are short)."""
    wide = np.concatenate([data, np.zeros(order, np.uint8)]).astype(np.uint32)
    code = np.full(len(data), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        code = (code ^ wide[k : k + len(data)]) * np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(15)
    return (code & np.uint32(DIMENSIONS - 1)).astype(np.int32)


def _ends(offsets: np.ndarray, order: int) -> np.ndarray:
    return np.maximum(offsets[:-1], offsets[1:] - order + 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of all n-grams, one row a text. For the bounded training sample only."""
    data = B.lower_ascii(data)
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    for order in ORDERS:
        code = gram_codes(data, order)
        for i, (a, b) in enumerate(zip(offsets[:-1], _ends(offsets, order))):
            out[i] += np.bincount(code[a:b], minlength=DIMENSIONS)
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lower = B.lower_ascii(data)
    seen = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def train_machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> np.ndarray:
    """Weights and offset (last) of a linear machine with squared hinge loss; y is 1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    scale = 1 / np.maximum(np.sqrt(np.einsum("i,ij,ij->j", weight, x, x)), 1e-4)
    scale /= np.sqrt(x.shape[1])
    w = np.zeros(x.shape[1], np.float32)
    offset, ahead, ahead_offset, momentum = 0.0, w, 0.0, 1.0
    step = 0.4
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ (ahead * scale) + ahead_offset)) * y * weight
        new = ahead + step * (scale * (slack @ x) - penalty * ahead)
        new_offset = ahead_offset + step * float(slack.sum())
        m = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_offset = new + (momentum - 1) / m * (new - w), new_offset + (momentum - 1) / m * (new_offset - offset)
        w, offset, momentum = new, new_offset, m
    return np.append(w * scale, offset).astype(np.float32)


@dataclass
class Model:
    """names of each contest, and a machine for each pair: families under "", languages under a family."""

    contests: dict[str, list[str]]
    machines: dict[tuple[str, str, str], np.ndarray]


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """A model of counts ``x``, which become shares in place."""
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    names = np.array(langs)
    families = np.array([family(g) for g in langs])
    contests = {"": sorted(set(families))}
    contests |= {f: sorted(set(names[families == f])) for f in contests[""]}
    machines = {}
    for contest, members in contests.items():
        label = names if contest else families
        for a, b in itertools.combinations(members, 2):
            rows = np.flatnonzero((label == a) | (label == b))
            own = x if len(rows) == len(x) else x[rows]
            machines[contest, a, b] = train_machine(own, np.where(label[rows] == a, 1, -1).astype(np.float32))
    return Model(contests, machines)


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every text."""
    n = len(offsets) - 1
    known = has_letter(data, offsets)
    lower = B.lower_ascii(data)
    codes = [(gram_codes(lower, k), _ends(offsets, k)) for k in ORDERS]
    total = np.maximum(sum(end - offsets[:-1] for _, end in codes), 1)

    def margins(machine: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for code, end in codes:
            run = np.concatenate([[0.0], np.cumsum(machine[code], dtype=np.float64)])
            out += run[end] - run[offsets[:-1]]
        return out / total + machine[-1]

    def contest(name: str) -> tuple[np.ndarray, np.ndarray]:
        members = model.contests[name]
        votes, sure = np.zeros((n, len(members))), np.ones((n, len(members)))
        for i, j in itertools.combinations(range(len(members)), 2):
            p = 1 / (1 + np.exp(-np.clip(3 * margins(model.machines[name, members[i], members[j]]), -30, 30)))
            votes[:, i] += (p >= 0.5) + 1e-3 * p
            votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
            sure[:, i] = np.minimum(sure[:, i], p)
            sure[:, j] = np.minimum(sure[:, j], 1 - p)
        best = votes.argmax(axis=1)
        return best, sure[np.arange(n), best]

    lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
    if model.contests[""]:
        chosen, sure = contest("")
        for k, f in enumerate(model.contests[""]):
            rows = known & (chosen == k)
            if rows.any():
                best, own = contest(f)
                lang[rows] = np.array(model.contests[f], object)[best[rows]]
                score[rows] = np.minimum(sure, own)[rows]
    return lang, score


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in B.slices(batch.column(1), 1 << 18):
            x = features(data, offsets)
            rows = [np.flatnonzero(r) for r in x]
            at = pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary())
            count = pa.array([x[i, r].tobytes() for i, r in enumerate(rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 2)), at, count], ["lang", "key", "at", "count"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", row_key: Column | None = None) -> Model:
    """Fit on about ``SAMPLE`` rows of each language; ``row_key`` only spreads the draw.

    No more than ``LANGUAGES`` values of ``lang_col`` are learned, the most frequent ones (a column with
    more holds dirt; texts of the others are told as the learned language that they look like most),
    and no more than about ``ROWS`` rows over all of them, so that what the driver holds is bounded.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.xxhash64(F.lit(1)) if row_key is None else row_key).alias("key"))
    rows = rows.where("lang is not null and text is not null")
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    if not counts:
        return Model({"": []}, {})
    most = min(SAMPLE, max(1, ROWS // (2 * len(counts))))
    shares = [F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1_000_000, 1_000_000 * most // n))]
    share = F.coalesce(F.try_element_at(F.create_map(*shares), F.col("lang")), F.lit(0))
    # equal rows count once, and the limit has an order, so that the same rows are learned from however the table is cut
    drawn = rows.withColumn("key", F.xxhash64("key", "text")).where(F.pmod("key", F.lit(1_000_000)) < share)
    drawn = drawn.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text", "key")
    got = drawn.mapInArrow(_feature_batches, "lang string, key long, at binary, count binary").orderBy("key", "lang").limit(2 * most * len(counts)).drop("key").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["count"])))
    x = np.zeros((len(got), DIMENSIONS), np.float32)
    langs = [r["lang"] for r in got]
    for i in range(len(got)):
        r, got[i] = got[i], None  # the rows go as the matrix fills
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["count"], np.float32)
    return fit(x, langs)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    column = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column(column)):
                lang, score = predict(held.value, data, offsets)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
