"""All pairs of similar texts: blocks of rows meet block by block, and a task rates many pairs at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# rows of a block: so many on average at most, and so many at least before there are more blocks than tasks need
BLOCK, SMALL, BLOCKS = 2048, 128, 24
# tasks at most; texts from LONG letters on are rated one by one, as the matcher ignores frequent letters of those from 200 on
TASKS, LONG = 2000, 200
# letters with a column of their own; pairs that are filtered at once, and letters that are matched at once
LETTERS, PAIRS, CELLS = 63, 1 << 20, 1 << 18


def meet(rows: DataFrame, order: str, run: Callable[[pd.DataFrame, pd.DataFrame, bool], pa.Table], schema: str) -> DataFrame:
    """What ``run`` gives for each two blocks of ``rows``, and for each block with itself.

    Blocks are ranges of ``order``. ``run`` gets the rows of the earlier and of the later block, each
    sorted by it, and whether they are one. A task holds two blocks, however many rows there are.
    """
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(BLOCKS, n // SMALL))
    bounds = rows.stat.approxQuantile(order, [k / blocks for k in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    own = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda x: x < F.col(order))).cast("long")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    pair = F.least("own", "other") * blocks + F.greatest("own", "other")

    def both(key: tuple, table: pa.Table) -> pa.Table:
        first, last = divmod(key[0].as_py(), blocks)
        group = table.to_pandas().sort_values(order, kind="stable")
        x, y = (group[group["own"] == b].reset_index(drop=True) for b in (first, last))
        return run(x, y, first == last)

    tasks = min(TASKS, blocks * (blocks + 1) // 2)
    # the count of tasks is fixed: little data may be much work here, so that it isn't put together by size
    return dealt.withColumn("pair", pair).drop("other").repartition(tasks, "pair").groupBy("pair").applyInArrow(both, schema)


def _codes(xs: list[str], ys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters as numbers by their frequency, a column a text, and counts of the frequent ones; nothing equals what fills a column."""
    both = [*xs, *ys]
    sizes = np.array([len(t) for t in both])
    flat, at = np.unique(np.frombuffer("".join(both).encode("utf-32-le"), np.uint32), return_inverse=True)
    rank = np.empty(len(flat), np.int64)
    rank[np.argsort(-np.bincount(at), kind="stable")] = np.arange(len(flat))
    letters = rank[at]
    text = np.repeat(np.arange(len(both)), sizes)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.empty((int(sizes.max()), len(both)), np.uint8 if len(flat) < 254 else np.uint32)
    out[:, : len(xs)], out[:, len(xs) :] = np.iinfo(out.dtype).max, np.iinfo(out.dtype).max - 1
    out[place, text] = letters
    counts = np.zeros((min(len(flat), LETTERS + 1), len(both)), np.uint8)
    np.add.at(counts, (np.minimum(letters, LETTERS), text), 1)
    return out[:, : len(xs)], out[:, len(xs) :], counts


def _part(letters: np.ndarray, which: np.ndarray, start: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    """The letters of each column ``which`` from ``start`` on, ``size`` of them."""
    row = np.arange(size.max())[:, None]
    out = letters[np.minimum(start + row, len(letters) - 1), which]
    out[row >= size] = fill
    return out


def _matched(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each column: letters in matching blocks as ``SequenceMatcher`` finds them, or fewer than ``need``.

    The longest block counts, the first in x and then in y among equals; then what is left and right
    of it on both sides. A pair is given up when it can't come to ``need`` any more.
    """
    total, owner = np.zeros(len(nx), np.int64), np.arange(len(nx))
    fills = np.iinfo(x.dtype).max, np.iinfo(x.dtype).max - 1
    while len(owner):
        late = (255 - np.arange(len(y), dtype=np.uint16))[:, None]
        runs, best, end = np.zeros(y.shape, np.uint16), np.full(len(owner), 255, np.uint16), np.zeros(len(owner), np.int64)
        # a run of r letters that ends at j is 256 r here, and 256 r + 255 - j where runs are compared
        for i in range(len(x)):
            longer = np.full(y.shape, 256, np.uint16)
            longer[1:] += runs[:-1]
            runs = longer * (y == x[i])
            top = (runs + late).max(axis=0)
            better = top >> 8 > best >> 8
            best[better], end[better] = top[better], i
        size, end_y = (best >> 8).astype(np.int64), 255 - (best & 255).astype(np.int64)
        total += np.bincount(owner, size, len(total)).astype(np.int64)
        hit = np.flatnonzero(size)
        size, end, end_y, none = size[hit], end[hit], end_y[hit], np.zeros(len(hit), np.int64)
        which = np.concatenate([hit, hit])
        from_x, from_y = np.concatenate([none, end + 1]), np.concatenate([none, end_y + 1])
        nx, ny = np.concatenate([end + 1 - size, nx[hit] - end - 1]), np.concatenate([end_y + 1 - size, ny[hit] - end_y - 1])
        left = np.bincount(owner[which], np.minimum(nx, ny), len(total))
        go = np.flatnonzero((nx > 0) & (ny > 0) & (total + left >= need)[owner[which]])
        if not len(go):
            break
        which, nx, ny = which[go], nx[go], ny[go]
        x, y = _part(x, which, from_x[go], nx, fills[0]), _part(y, which, from_y[go], ny, fills[1])
        owner = owner[which]
    return total


def alike(xs: list[str], ys: list[str], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in xs, places in ys, ratios) of the pairs whose ``SequenceMatcher`` ratio reaches ``threshold``, in lots.

    All texts have letters. What their letters and lengths allow is worked out for all pairs, matching blocks
    where these don't keep a pair apart.
    """
    size_x, size_y = (np.array([len(t) for t in s], np.int64) for s in (xs, ys))
    for j in range(len(ys)):
        rest = np.flatnonzero((size_x >= LONG) | (size_y[j] >= LONG))
        matcher = SequenceMatcher(None, "", ys[j]) if len(rest) else None
        for i in rest:
            matcher.set_seq1(xs[i])
            if matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold and (ratio := matcher.ratio()) >= threshold:
                yield np.array([i]), np.array([j]), np.array([ratio])
    at_x, at_y = np.flatnonzero(size_x < LONG), np.flatnonzero(size_y < LONG)
    if not (len(at_x) and len(at_y)):
        return
    x, y, counts = _codes([xs[i] for i in at_x], [ys[j] for j in at_y])
    size_x, size_y, of_x, of_y = size_x[at_x], size_y[at_y], counts[:, : len(at_x)], counts[:, len(at_x) :]
    needs = np.ceil(threshold / 2 * np.arange(2 * LONG) - 1e-9).astype(np.int64)
    step, lot = max(1, PAIRS // len(at_y)), max(64, CELLS // len(y))
    for start in range(0, len(at_x), step):
        part = slice(start, start + step)
        common = np.zeros((len(size_x[part]), len(at_y)), np.uint8)
        for a, b in zip(of_x, of_y):
            common += np.minimum.outer(a[part], b)
        i, j = np.nonzero(common >= needs[size_x[part, None] + size_y])
        i += start
        for k in range(0, len(i), lot):
            a, b = i[k : k + lot], j[k : k + lot]
            both = size_x[a] + size_y[b]
            ratio = 2.0 * _matched(x[: size_x[a].max(), a], y[: size_y[b].max(), b], size_x[a], size_y[b], needs[both]) / both
            good = np.flatnonzero(ratio >= threshold)
            yield at_x[a[good]], at_y[b[good]], ratio[good]


def ratings(xs: np.ndarray, ys: np.ndarray, threshold: float) -> np.ndarray:
    """The ratio of each x to each y as a matrix, -1 under ``threshold`` and for empty texts; each pair of texts is rated once."""
    (ix, tx), (iy, ty) = (pd.factorize(s) for s in (xs, ys))
    kx, ky = (np.flatnonzero(t != "") for t in (tx, ty))
    out = np.full((len(tx), len(ty)), -1.0)
    for i, j, ratio in alike(tx[kx].tolist(), ty[ky].tolist(), threshold):
        out[kx[i], ky[j]] = ratio
    return out[ix][:, iy]


def are_equal(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Whether each x equals each y, as a matrix; empty ones don't."""
    at, known = pd.factorize(np.concatenate([xs, ys]))
    x, y = at[: len(xs)], at[len(xs) :]
    return (x[:, None] == y) & (known[x] != "")[:, None]
