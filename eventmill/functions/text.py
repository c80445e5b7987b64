"""Text columns: cleaning, truncation, accent folding, names and slugs."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

WORD = r"\p{L}\p{M}\p{N}_"

# Words that never lead a venue's name, and words that stay small in a title.
ARTICLES = ("le", "la", "les", "l", "un", "une", "des", "du", "de", "d")
MINOR_WORDS = ("de", "des", "du", "d", "la", "le", "les", "l", "et", "en", "a", "au", "aux")
# The entities that plain cleaning knows.
PLAIN_ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#8217;", "'"),
    ("&#8216;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&nbsp;", " "),
)
# Letters that no accent rule takes apart.
LIGATURES = (("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("ø", "o"), ("đ", "d"), ("ł", "l"))


# How letters of two other scripts are written in Latin ones, in alphabetical order; hard and soft signs aren't.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e iu ia".split()))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    return collapse(F.coalesce(c, F.lit("")))


def truncate_words(c: Column, most: int = 160) -> Column:
    """Long text is cut before the word that doesn't fit; without a space the whole cut stays."""
    cut = F.regexp_replace(F.left(c, F.lit(most - 3)), r" [^ ]*$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("...")))


def truncate_chars(c: Column, most: int = 160) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most - 3)), F.lit("...")))


@F.pandas_udf(ArrayType(StringType()))
def _unescape(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda row: [html.unescape(x) for x in row], na_action="ignore")


# Fixed value: what may be an entity, as Python's ``html`` has it.
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescape_entities(c: Column) -> Column:
    """All named and numeric HTML entities; Spark has no function for them, so that they, not the texts, go to Python."""
    decoded = _unescape(F.regexp_extract_all(c, F.lit(_ENTITY), 0))
    between = F.split(c, _ENTITY, -1)
    return F.array_join(F.flatten(F.zip_with(between, decoded, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def sanitize_description(c: Column, decode: Callable[[Column], Column] = unescape_entities) -> Column:
    """Tags to spaces, entities decoded, script links and handlers dropped, white space collapsed."""
    plain = decode(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))
    plain = F.regexp_replace(plain, r"""(?i)href\s*=\s*["']?javascript:[^"'\s>]*["']?""", "")
    return collapse(F.regexp_replace(plain, r"""(?i)\bon\w+\s*=\s*["'][^"']*["']""", ""))


def clean_html(c: Column) -> Column:
    """Tags removed without a trace, and the plain entities decoded."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "")
    for entity, char in PLAIN_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


@cache
def _accents() -> tuple[str, str]:
    """Every Latin letter that decomposes into a base letter and marks, beside that letter."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_accents()), r"[̀-ͯ]", "")


def _ligatures(c: Column, which: tuple[tuple[str, str], ...] = LIGATURES) -> Column:
    for a, b in which:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize_venue_text(c: Column | str) -> Column:
    """Lower case without accents; everything but letters, digits and underscores is a space."""
    folded = strip_accents(_ligatures(F.lower(c), LIGATURES[:2]))
    return collapse(F.regexp_replace(folded, rf"[^{WORD}\s]", " "))


def normalize_name(c: Column) -> Column:
    """Lower case, punctuation removed without a trace."""
    return collapse(F.regexp_replace(F.lower(c), rf"[^{WORD}\s]", ""))


def _latin(c: Column) -> Column:
    """Cyrillic and Greek letters in Latin ones; a row without any isn't searched letter by letter."""
    table = {k: "" if v == "-" else v for k, v in (CYRILLIC | GREEK).items()}
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for letter, latin in table.items():
        if letter not in single:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return F.when(F.regexp_like(c, F.lit(r"[\u0370-\u03FF\u0400-\u04FF]")), out).otherwise(c)


def slugify(c: Column) -> Column:
    """ASCII words joined by hyphens. Covers Latin, Cyrillic and Greek scripts; other letters fall out."""
    # accents of Greek and Cyrillic letters are marks of their own once they are taken apart
    apart = F.translate(F.lower(c), "άέήίόύώϊϋΐΰ", "αεηιουωιυιυ")
    folded = strip_accents(_ligatures(_latin(apart)))
    plain = F.regexp_replace(F.regexp_replace(folded, r"(?<=[0-9]),(?=[0-9])", ""), r"[^a-z0-9]+", "-")
    return F.regexp_replace(plain, r"^-+|-+$", "")


def sanitize_slug(c: Column, most: int = 50) -> Column:
    joined = F.regexp_replace(F.lower(c), r"[\s_]+", "-")
    kept = F.regexp_replace(F.regexp_replace(joined, r"[^a-z0-9-]", ""), r"-+", "-")
    return F.left(F.regexp_replace(kept, r"^-|-$", ""), F.lit(most))


def slug_to_words(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(" "))


def slug_to_title(c: Column) -> Column:
    def word(w: Column, i: Column) -> Column:
        big = F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))
        return F.when((i > 0) & w.isin(*MINOR_WORDS), w).otherwise(big)

    return F.array_join(F.transform(F.split(c, "-"), word), " ")


def alias_to_slug(c: Column) -> Column:
    """The last part of ``/locations/x/``; empty for other paths."""
    return F.regexp_extract(c, r"^/*locations/([^/]+)", 1)


def strip_articles(c: Column) -> Column:
    return F.regexp_replace(c, rf"^(?:(?:{'|'.join(ARTICLES)})(?: +|$))+", "")


def similarity(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``similarity`` of each pair; what the matcher prepares for a second text serves all of its pairs in the batch."""
    a, b = a.fillna("").to_numpy(), b.fillna("")
    out = np.empty(len(a))
    for text, rows in b.groupby(b, sort=False).indices.items():
        matcher = SequenceMatcher(None, "", text)
        for i in rows:
            matcher.set_seq1(a[i])
            out[i] = matcher.ratio()
    return pd.Series(out)


# or the optimizer would rate a pair twice where the result is filtered and kept
_ratio = _ratio.asNondeterministic()


def name_similarity(new: Column, existing: Column) -> Column:
    """Share of matching blocks of two normalised names; it isn't symmetric. Use it on blocked pairs only."""
    return _ratio(normalize_name(new), normalize_name(existing))


def normalized_similarity(a: Column, b: Column) -> Column:
    """``name_similarity`` of names that are in normal form already."""
    return _ratio(a, b)


_LETTERS = "abcdefghijklmnopqrstuvwxyz "


def letter_counts(c: Column) -> Column:
    """How often each letter and the space stand in a text, and how many other characters."""
    c = F.coalesce(c, F.lit(""))
    counts = [F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in _LETTERS]
    return F.array(*counts, F.length(F.translate(c, _LETTERS, "")))


def most_similarity(x: Column, y: Column) -> Column:
    """What the similarity of two texts with these letter counts can't exceed; 1 for two empty ones."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v)
    both = total(F.zip_with(x, y, lambda a, b: F.least(a, b)))
    size = total(x) + total(y)
    return F.when(size == 0, 1.0).otherwise(2.0 * both / size)


def edit_similarity(a: Column, b: Column) -> Column:
    """A built-in alternative: one less the edit distance over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)
