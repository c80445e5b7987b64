"""Licence scans: places against a plain search, expressions against Python's own operators, edge cases."""

import random
import re

import pytest

from eventmill.llm import licences as L

from . import samples

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def _plain(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hits = [(i, label) for i in range(len(w)) for p, label in BASE.items() if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def _texts():
    r = random.Random(11)
    parts = ["MIT License", "mit  license", "the Apache-License", "GNU General Public License", "General public\nlicense", "licen", "mit", "license", "émit license", "mit license9", "x", "日本 mit", "ß", "CC BY-NC 4.0", "K"]
    out = [(i, " ".join(r.choice(parts) + r.choice(["", ".", "\t", ","]) for _ in range(r.randint(0, 30)))) for i in range(300)]
    return [*out, (400, None), (401, ""), (402, "mit license " * 20000), (402, "mit license mit license"), (None, "Apache License")]


def test_base_against_plain_search(spark):
    rows = _texts()
    got = L.licences(spark.createDataFrame(samples.rows(rows), samples.SCHEMA)).collect()
    base = lambda r: (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
    assert sorted(map(base, got), key=str) == sorted(((i, *_plain(t)) for i, t in rows), key=str)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == (r["labels"] != "")


def test_registered_query_on_whole_table(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = entry.queries()["op11_licences"](spark, folder).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == {i: _plain(t) for i, t in docs.items()}


@pytest.mark.parametrize(
    ("text", "labels", "freedom"),
    [
        ("mit or gpl-2.0-only", {"mit", "gpl"}, 1.0), ("mit and gpl-2.0-only", {"mit", "gpl"}, 0.5), ("gpl-2.0+ with classpath-exception-2.0", {"gpl"}, 0.7),
        ("mit and gpl-3.0-only or apache-2.0", {"mit", "gpl", "apache"}, 1.0), ("mit and (gpl-3.0-only or agpl-3.0-only)", {"mit", "gpl", "agpl"}, 0.5),
        ("licenseref-acme", {"other"}, 0.2), ("((cc-by-nc-sa-4.0))", {"cc-by-nc-sa"}, 0.2), ("apache-2.0 with llvm-exception", {"apache"}, 1.0),
    ],
)
def test_expressions(text, labels, freedom):
    assert L.evaluate(text) == (frozenset(labels), freedom)


@pytest.mark.parametrize("text", ["mit or", "or mit", "(mit", "mit)", "mit gpl-2.0", "()", "mit with gpl-2.0-only", "mit and and mit", "mit (isc)"])
def test_malformed_expressions(text):
    assert L.evaluate(text) is None


def test_random_expressions_against_python(spark):
    r = random.Random(2)
    names = ["mit", "gpl-3.0-only", "agpl-3.0-only", "cc-by-4.0", "mpl-2.0"]

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(names)
        return f"({make(depth - 1)} {r.choice(['and', 'or'])} {make(depth - 1)})" if r.random() < 0.5 else f"{make(depth - 1)} {r.choice(['and', 'or'])} {make(depth - 1)}"

    class F(float):
        __mul__ = lambda a, b: F(min(a, b))
        __add__ = lambda a, b: F(max(a, b))

    for _ in range(300):
        text = make(4)
        plain = re.sub(r"[a-z0-9.-]+-[0-9][a-z0-9.-]*|\bmit\b", lambda m: f"F({L.FREEDOM[L.identifier(m.group())]})", text).replace(" and ", " * ").replace(" or ", " + ")
        assert L.evaluate(text)[1] == eval(plain, {"F": F})  # noqa: S307


def test_tags_and_notices():
    lab = lambda t: sorted({p[1] for p in L.scan(t.encode())[1]} | {x for e in L.scan(t.encode())[2] for x in e[1] or ()})
    assert lab("# SPDX-License-Identifier: Apache-2.0 OR MIT */") == ["apache", "mit"]
    assert lab('{"license": "BSD-3-Clause",') == ["bsd"] and lab("Driving license: required for all\nnone") == []
    assert lab("Licensed under CC BY-NC-SA 4.0.") == ["cc-by-nc-sa"] and lab("GNU Lesser General Public License") == ["gpl", "lgpl"]
    assert lab("Tous droits réservés") == ["proprietary"]
    assert [e[1] for e in L.scan(b"SPDX-License-Identifier: MIT OR\nSPDX-License-Identifier: (ISC)")[2]] == [None, frozenset(["isc"])]


def test_empty_table(spark):
    assert L.licences(spark.createDataFrame([], samples.SCHEMA)).count() == 0
