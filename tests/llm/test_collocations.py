"""Count transducers and phrase collocations, against plain counters."""

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventmill.llm import collocations as C
from eventmill.llm.transducer import Transducer, union

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, words string"
_keys = st.dictionaries(st.lists(st.sampled_from([b"a", b"b", b"\xc3\xa9", b"dd"]), min_size=1, max_size=4).map(tuple), st.integers(1, 9), max_size=40)


@settings(max_examples=150, deadline=None)
@given(_keys, _keys)
def test_transducers(x, y):
    a, b = (Transducer.build(sorted(d.items())) for d in (x, y))
    assert list(a.items()) == sorted(x.items()) and list(Transducer.of(b.row()).items()) == sorted(y.items())
    assert sorted(a.compose(b)) == sorted((k, y[k]) for k in x if k in y)
    total = Counter(x) + Counter(y)
    assert list(union([a, b]).items()) == sorted(total.items())
    assert list(union([a, b], 6).items()) == sorted((k, c) for k, c in total.items() if c >= 6)


def test_transducers_share_ends_and_want_order():
    keys = [(a, b, b"x", b"y") for a in (b"p", b"q", b"r") for b in (b"s", b"t")]
    assert len(Transducer.build((k, 1) for k in sorted(keys)).arcs) == 5
    with pytest.raises(ValueError, match="ascend"):
        Transducer.build([((b"b",), 1), ((b"a",), 1)])


def _plain(rows, least, longest, percent, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def _corpus():
    r = random.Random(4)
    vocabulary = ["New", "york", "CITY", "the", "a", "of", "é", "日本", "x\x00y", "of the", "new york city", "in the middle of nowhere", "-", "É"]
    out = [(i, "".join(r.choice(vocabulary) + r.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "; "]) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "en", "fr", None])) for i in range(150)]
    return [*out, (7, None, "en"), (8, "", None), (9, " .\t. ", "de"), (9, "new york " * 3000, "en"), (None, "new york city", "fr"), (11, "a b a b a b a b a b", "und")]


@pytest.mark.parametrize(("least", "percent", "top", "buckets", "held"), [(4, 100, 2000, 1 << 14, 400_000), (3, 80, 25, 1 << 14, 50), (30, 100, 10, 1 << 18, 400_000)])
def test_against_plain_counts(spark, least, percent, top, buckets, held):
    rows = _corpus()
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(5)
    got = C.collocations(df, least, 5, percent, top, buckets=buckets, held=held, chunk=3000)
    assert sorted(map(tuple, got.collect())) == _plain(rows, least, 5, percent, top)


def test_products_over_64_bits():
    """The score of counts whose product with 1000 needs more than 64 bits, and ties of cuts."""
    key = (b"a", b"b", b"c")
    counts = C._rows([(0, "en", 10**15, Transducer.build([(key, 10**9)]))])
    parts = {(b"a",): 10**10, (b"b", b"c"): 10**9, (b"a", b"b"): 10**9, (b"c",): 10**10}
    answers = C._rows([(0, "en", 0, Transducer.build(sorted(parts.items())))])
    import pyarrow as pa

    got = C._scored(pa.Table.from_batches([counts]), pa.Table.from_batches([answers])).to_pylist()[0]
    assert got["score"] == 1000 * 10**9 * 10**15 // 10**19 and (got["l"], got["r"]) == (10**10, 10**9)


def test_empty_table_and_one_without_frequent_words(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, "a b c", "en", "", 1, "")], SCHEMA)).count() == 0
