"""Licences of texts: notice phrases and identifier tags by Aho-Corasick, tag expressions by a shunting yard.

Two automata read each whole text once: one, over its words, finds notice phrases at every place
where their words stand consecutively; the other, over its bytes, finds tags such as
``SPDX-License-Identifier:``, whose value, to the end of the line, is an expression of identifiers
with ``or``, ``and``, ``with`` and parentheses. The expression is brought into postfix order by
operator precedence and evaluated: it carries the labels of all its licences, and its freedom is the
greater one of an ``or``, the lesser one of an ``and``; an exception after ``with`` lifts a copyleft
licence to the next freer class. Automata are built from the fixed lists below, once a worker.

Null and blank texts have no words, no labels and a score of 0. Rows are scanned one by one, so
repeated rows and ids need no rule; columns of the input whose names clash with those added give way.
A task holds about six times the bytes of its longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases and labels that the contract names.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Other notice phrases, by label.
NOTICES = {
    "agpl": ["affero general public license"],
    "lgpl": ["lesser general public license", "library general public license", "gnu lgpl"],
    "gpl": ["gnu gpl", "gnu general public licence", "general public licence"],
    "apache": ["apache licence", "apache software license"],
    "mit": ["mit licence", "mit licensed", "licensed under mit", "x11 license"],
    "bsd": ["bsd license", "bsd licence", "bsd 2 clause", "bsd 3 clause", "redistribution and use in source and binary forms"],
    "isc": ["isc license", "isc licence"],
    "mpl": ["mozilla public license", "mozilla public licence"],
    "epl": ["eclipse public license"],
    "eupl": ["european union public licence"],
    "zlib": ["zlib license"],
    "boost": ["boost software license"],
    "artistic": ["artistic license"],
    "unlicense": ["the unlicense", "unlicense org", "free and unencumbered software released into the public domain"],
    "cc0": ["cc0", "creative commons zero", "cc zero"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives"],
    "proprietary": ["all rights reserved", "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados"],
}

# Tags that an expression follows; those of the second list also stand in prose, where all identifiers have to be known.
TAGS = ["spdx-license-identifier:", "license-expression:"]
LOOSE_TAGS = ["license:", "licence:", '"license":', "license =", "@license"]

# Beginnings of identifiers and their labels; the longest that fits counts.
IDENTIFIERS = {
    "mit": "mit", "x11": "mit", "apache-": "apache", "gpl-": "gpl", "lgpl-": "lgpl", "agpl-": "agpl", "bsd-": "bsd", "0bsd": "bsd", "isc": "isc", "mpl-": "mpl",
    "epl-": "epl", "eupl-": "eupl", "zlib": "zlib", "bsl-": "boost", "artistic-": "artistic", "unlicense": "unlicense", "cc0-": "cc0", "cc-by-": "cc-by", "cc-by-sa-": "cc-by-sa",
    "cc-by-nc-": "cc-by-nc", "cc-by-nd-": "cc-by-nd", "cc-by-nc-sa-": "cc-by-nc-sa", "cc-by-nc-nd-": "cc-by-nc-nd",
}

# Identifiers of exceptions.
EXCEPTIONS = ["classpath-exception-", "gcc-exception-", "llvm-exception", "autoconf-exception-", "bison-exception-", "font-exception-", "openssl-exception", "linux-syscall-note", "gpl-cc-"]

#: What may be done with a text, from 1 (anything) to 0 (nothing known), by label. Fixed values of this library.
CLASSES = {
    1.0: ["mit", "apache", "bsd", "isc", "zlib", "boost", "unlicense", "cc0"], 0.9: ["cc-by", "artistic"], 0.7: ["lgpl", "mpl", "epl"], 0.5: ["gpl", "cc-by-sa", "eupl"],
    0.4: ["agpl"], 0.2: ["cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "other"], 0.1: ["proprietary"],
}
FREEDOM = {label: freedom for freedom, labels in CLASSES.items() for label in labels}
OTHER = "other"

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[^\s()]+")
_VALUE = re.compile(r"[^\r\n]*")
_AROUND = " \t\"'`,;*/#<>!{}[]-."

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def identifier(token: str) -> str | None:
    """Label of a licence identifier; None if it isn't known."""
    token = token.removesuffix("+")
    found = max((p for p in IDENTIFIERS if token == p or (p.endswith("-") and token.startswith(p))), key=len, default=None)
    return None if found is None else IDENTIFIERS[found]


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: operands and operators in postfix order; None if the expression isn't well formed."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for t in tokens:
        if t == "(":
            if not operand_next:
                return None
            waiting.append(t)
        elif t == ")" or t in _PRECEDENCE:
            if operand_next:
                return None
            least = 0 if t == ")" else _PRECEDENCE[t]
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= least:
                out.append(waiting.pop())
            if t != ")":
                waiting.append(t)
                operand_next = True
            elif not waiting:
                return None
            else:
                waiting.pop()
        else:
            if not operand_next:
                return None
            out.append(t)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(text: str, strict: bool = False) -> tuple[frozenset[str], float] | None:
    """(labels, freedom) of a lower-case expression; None if it is malformed or, when ``strict``, names unknown licences."""
    order = postfix(_TOKEN.findall(text))
    if order is None:
        return None
    done: list[tuple[str, frozenset[str], float]] = []  # the operand's own text, for exceptions
    for t in order:
        if t not in _PRECEDENCE:
            label = identifier(t)
            if label is None and strict and not any(t.startswith(e) for e in EXCEPTIONS):
                return None
            label = label or OTHER
            done.append((t, frozenset([label]), FREEDOM[label]))
            continue
        (right, more, y), (_, labels, x) = done.pop(), done.pop()
        if t == "with":
            if not any(right.startswith(e) for e in EXCEPTIONS):
                return None
            freer = [f for f in sorted(CLASSES) if f > x] if 0.2 < x < 0.9 else []
            done.append(("", labels, min(freer, default=x)))
        else:
            done.append(("", labels | more, max(x, y) if t == "or" else min(x, y)))
    return done[0][1:]


@lru_cache(1)
def _automata():  # noqa: ANN202
    """(over words, over bytes). Text is matched as Latin-1 characters, one for each byte."""
    import ahocorasick

    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    phrases = {p: (label, True) for p, label in BASE.items()}
    for label, own in NOTICES.items():
        phrases |= {p: (label, False) for p in own if p not in phrases}
    for p, (label, base) in phrases.items():
        raw = p.encode().decode("latin-1")
        words.add_word(f" {raw} ", (len(raw) + 2, label, base))
    for tag in [*TAGS, *LOOSE_TAGS]:
        tags.add_word(tag, (len(tag), tag in LOOSE_TAGS))
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def scan(data: bytes) -> tuple[int, list[tuple[int, str, bool]], list[tuple[str, frozenset[str] | None, float]]]:
    """(words, places as (word, label, base), expressions as (text, labels or None, freedom)) of one text.

    A notice that lies inside a longer one (``cc by`` in ``cc by nc``) isn't a place; base phrases always are.
    """
    phrases, tags = _automata()
    low = data.translate(_LOWER)
    split = low.translate(_WORDS).split()
    line = f" {b' '.join(split).decode('latin-1')} "
    found = [(end + 1 - size, end + 1, label, base) for end, (size, label, base) in phrases.iter(line)]
    found.sort(key=lambda x: (x[0], -x[1]))
    places, at, word, reach = [], 0, 0, -1
    for lo, hi, label, base in found:
        word += line.count(" ", at, lo)
        at = lo
        if base or hi > reach:
            places.append((word, label, base))
        reach = max(reach, hi)
    raw, expressions, done = low.decode("latin-1"), [], -1
    for end, (_, loose) in tags.iter(raw):
        if end < done:  # a tag inside another one's value
            continue
        value = _VALUE.match(raw, end + 1)
        done = value.end()
        text = value.group().encode("latin-1").decode("utf-8", "replace").strip(_AROUND).strip()
        got = evaluate(text, loose) if text else None
        if got is not None or not loose:
            expressions.append((text, *(got or (None, 0.0))))
    return len(split), places, expressions


_PLACE = pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])
_EXPRESSION = pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string())), ("freedom", pa.float64())])
_ADDED = "n_words long, places array<struct<word:long,label:string,base:boolean>>, expressions array<struct<text:string,labels:array<string>,freedom:double>>"


def scan_licences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, places (word, label, base) and expressions (text, labels, freedom) of each whole text.

    Expressions that are malformed after a plain tag are kept with null labels; after a loose tag they are prose and left out.
    """
    added = T.StructType.fromDDL(_ADDED).fields
    docs = docs.drop(*(f.name for f in added))
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(column)]
            places = pa.array([[dict(zip(("word", "label", "base"), p)) for p in x[1]] for x in got], pa.list_(_PLACE))
            told = pa.array([[{"text": t, "labels": None if own is None else sorted(own), "freedom": f} for t, own, f in x[2]] for x in got], pa.list_(_EXPRESSION))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in got], pa.int64()), places, told], [*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def _labels(places: Column, base_only: bool) -> Column:
    own = F.filter(places, lambda p: p["base"]) if base_only else places
    return F.transform(own, lambda p: p["label"])


def licences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``scan_licences`` and what follows from it: n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the freedom of the least free notice or expression, 0 for a text without any.
    """
    base = F.filter("places", lambda p: p["base"])
    at = F.transform(base, lambda p: p["word"])
    told = F.flatten(F.transform("expressions", lambda e: F.coalesce(e["labels"], F.array().cast("array<string>"))))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    freedom = F.create_map(*(F.lit(x) for pair in FREEDOM.items() for x in pair))
    all_free = F.concat(F.transform(_labels(F.col("places"), False), lambda x: freedom[x]), F.transform(F.filter("expressions", lambda e: e["labels"].isNotNull()), lambda e: e["freedom"]))
    out = {
        "n_base": F.size(base).cast("long"), "first_word": F.array_min(at), "last_word": F.array_max(at), "base_labels": joined(_labels(F.col("places"), True)),
        "labels": joined(F.concat(_labels(F.col("places"), False), told)), "score": F.coalesce(F.array_min(all_free), F.lit(0.0)),
    }
    return scan_licences(docs.drop(*out), text_col).withColumns(out)
