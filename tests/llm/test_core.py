"""The parts that run inside tasks, without Spark, against brute force."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from eventmill.llm import buffers as B
from eventmill.llm import near_dedup as N
from eventmill.llm import suffix_dedup as S
from eventmill.llm.lyndon import suffix_array
from eventmill.llm.warc import LoserTree


@given(st.lists(st.integers(0, 4), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_long_runs():
    for text in ([7] * 500, [1, 2] * 300, list(range(300)), list(range(300, 0, -1))):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree(runs):
    runs = [sorted((x,) for x in r) for r in runs]
    assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_slices_cover_all_rows():
    texts = ["a" * n for n in (0, 5, 100, 0, 3)] + [None]
    seen = [(lo, hi) for lo, hi, _, _ in B.slices(pa.array(texts), 10)]
    assert seen[0][0] == 0 and seen[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(seen, seen[1:]))


def test_every_coordinate_is_filled_and_estimates_similarity():
    r = np.random.default_rng(1)
    for size in (1, 2, 10, 300):
        a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], r.integers(0, 2**63, size - size // 2, dtype=np.uint64)]))
        s = N.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (s != N._EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.2


def test_intersections_by_ranges(monkeypatch):
    r = np.random.default_rng(5)
    sets = [np.unique(r.choice(r.integers(0, 2**64 - 1, 400, dtype=np.uint64), n)) for n in (0, 1, 50, 300, 200, 399)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    monkeypatch.setattr(N, "AT_ONCE", 100)
    assert N.intersections(sets, sets).tolist() == want


def test_intersections():
    r = random.Random(2)
    sets = [np.unique(np.array([r.randrange(40) for _ in range(r.randrange(1, 30))], np.uint64)) for _ in range(12)]
    got = N.intersections(sets[:5], sets[5:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()


def test_anchors_place_each_window_once_and_agree_on_equal_windows():
    r = random.Random(4)
    shared = bytes(r.choice(b"abcdef ") for _ in range(90))
    texts = [bytes(r.choice(b"abcdef ") for _ in range(n)) + shared + bytes(r.choice(b"abcdef ") for _ in range(50)) for n in (0, 31, 70)] + [b"short"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    a = S.anchors(np.frombuffer(b"".join(texts), np.uint8), offsets, 60, 8)
    seen = {}
    for doc, key, lo, hi, p in zip(a["doc"], a["key"], a["lo"], a["hi"], a["p"]):
        for s in range(lo, hi + 1):
            assert (doc, s) not in seen and s <= p <= s + 52
            seen[doc, s] = (key, p - s)
    assert len(seen) == sum(max(0, len(t) - 59) for t in texts)
    by_content = {}
    for (doc, s), v in seen.items():
        assert by_content.setdefault(texts[doc][s : s + 60], v) == v


def test_repeated_windows():
    r = random.Random(5)
    for _ in range(20):
        middle = bytes(r.choice(b"ab") for _ in range(40))
        contexts, anchor, windows = [], [], []
        for _ in range(8):
            left, right = (bytes(r.choice(b"ab") for _ in range(r.randrange(0, 40))) for _ in range(2))
            text = left[-30:] + middle + b"x" * 30 + right
            contexts.append(text)
            anchor.append(len(left[-30:]))
            windows.append(min(len(left[-30:]), len(text) - 64) + 1)
        got = S.repeated_windows(contexts, np.array(anchor), np.array(windows), length=64, block=16)
        all_windows = [c[i : i + 64] for c, n in zip(contexts, windows) for i in range(n)]
        assert got.tolist() == [all_windows.count(w) > 1 for w in all_windows]


def test_linked_sets_share_a_rare_end():
    r = random.Random(7)
    counts = np.array([r.randrange(1, 9) for _ in range(N.COUNTERS)])
    for percent in (80, 85):
        sets = []
        for _ in range(60):
            base = [r.randrange(60) for _ in range(r.randrange(1, 30))]
            sets += [np.unique(np.array([x if r.random() > 0.05 else r.randrange(60) for x in base], np.uint64)) for _ in range(2)]
        ends = N.rare_ends(sets, counts, percent)
        for a, x in zip(sets, ends):
            assert len(x) == len(a) - -(-percent * len(a) // 100) + 1
            for b, y in zip(sets, ends):
                if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                    assert len(np.intersect1d(x, y))
