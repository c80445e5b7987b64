"""Long rule lists in one pass over each text, whatever their length.

The words of a list become the goto and failure table of an Aho-Corasick automaton, built once in a
worker; a text is then read once for all words, in Arrow batches. Short lists stay array literals in
generated code (see ``rules``), where a few comparisons are cheaper than a trip to Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lists of more words than this are read by an automaton.
FROM = 64

_built: dict[str, Any] = {}


def _automaton(name: str, words: Sequence[str]) -> tuple[Any, tuple[int, ...]]:
    """(automaton whose words give their places in the list, places of empty words), kept for the worker's life."""
    if name not in _built:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            places.setdefault(w.lower(), []).append(k)
        found = ahocorasick.Automaton()
        for w, own in places.items():
            if w:
                found.add_word(w, tuple(own))
        if len(found):
            found.make_automaton()
        _built.clear() if len(_built) > 16 else None
        _built[name] = (found, tuple(places.get("", ())))
    return _built[name]


def numbers(text: str, name: str, words: Sequence[str]) -> list[int]:
    """Places in ``words`` of all words inside ``text``, in order."""
    automaton, always = _automaton(name, words)
    hit = set(always)
    if len(automaton):
        for _, own in automaton.iter(text):
            hit.update(own)
    return sorted(hit)


def found(text: Column, words: Sequence[str], of: Callable[[list[int]], Any], kind: str, if_null: Any = None) -> Column:
    """``of`` the places of the words inside ``text`` (lower case), ``if_null`` for null text."""
    words = list(words)
    name = hashlib.blake2b("\0".join(words).encode(), digest_size=16).hexdigest()

    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([if_null if t is None else of(numbers(t, name, words)) for t in texts], index=texts.index, dtype=object)

    return F.pandas_udf(read, kind)(text)
