"""Small document tables for the tests: a corpus with copies, near copies and shared passages, and edge cases."""

from __future__ import annotations

import random

EXTRA = "key string, rep long, id long, h int, score double, kept string, host string, n_bytes long, ids string, lang_pred string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
_FILL = ("k", 1, 2, 3, 0.5, "x", "y", 4, "z", "w")


def rows(texts: list[tuple[int | None, str | None]], lang: str | None = "en") -> list[tuple]:
    return [(i, t, lang, "src", len(t) if t is not None else None, *_FILL) for i, t in texts]


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n)]


def corpus(seed: int = 3) -> list[tuple[int, str]]:
    r = random.Random(seed)
    passage = " ".join(words(r, 90))
    base = words(r, 120)
    out = []
    for i in range(40):
        w = words(r, r.randint(3, 150))
        if i % 4 == 1:  # near copies of one text, some under the threshold
            w = [x if r.random() > 0.004 * (i % 12) else "zz" + x for x in base]
        if i % 4 == 2:
            w[len(w) // 2 : len(w) // 2] = [passage]
        if i % 9 == 0:
            w = ["same", "old", "text"] * 60
        out.append((i, " ".join(w) + ("\nÉtait-ce é?" if i % 5 == 0 else "")))
    return out


EDGES: list[tuple[int | None, str | None]] = [
    (1, None), (2, ""), (3, " \t\n"), (4, "é"), (5, "a"), (6, "word " * 30000), (7, "x" * 50000), (8, "Same text here, twice over and again."),
    (8, "Same text here, twice over and again."), (9, "Same text here, twice over and again."), (None, "No id but some words in the text"), (10, "日本語 😀 \u0000 nul"),
    (11, "!!! ??? 123"), (12, "\u00a0"),
]
