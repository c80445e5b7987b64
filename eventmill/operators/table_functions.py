"""Extractors as table functions of SQL: one name, whose result columns depend on the extractor asked for.

``extract_page('listing', url, html)`` is used in a lateral join, a page at a time; ``extract_pages``
takes a whole table of pages (``TABLE(pages) PARTITION BY source_id``) and tells the rows of each
source apart by what was seen in its earlier pages. The extractor has to be a constant, as the
columns follow from it when the query is analysed; an unknown one is an error of the analysis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import html_rows as H

#: Where the fields of a card are looked for if a source doesn't say.
LISTING = {"name": "h2, h3, .title, .event-title", "link": "a", "date": ".date, .event-date, time", "time": ".time, .event-time, .hour", "location": ".location, .venue, .event-venue", "description": ".description, .excerpt, p", "image": "img", "category": ".category, .tag, .type", "tags": ".tag, .label, .keyword"}


def _links(url: str, root: H.Node) -> Iterator[tuple]:
    for a in H.find(root, "a"):
        if a.attrs.get("href"):
            yield url, a.attrs["href"], a.text()


#: Extractors by name: their columns, and the rows of a parsed page.
EXTRACTORS: dict[str, tuple[str, Callable[[str, H.Node], Iterator[tuple]]]] = {
    "listing": (H.RAW_EVENT, lambda url, root: H.raw_events(url, root, LISTING)),
    "microdata": (H.CARD, H.cards),
    "links": ("url string, link string, label string", _links),
}


_TYPES = {"string": StringType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}


def _columns(text: str) -> StructType:
    """A result's columns; the analysis runs outside of a session, which could parse them."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


def _known(extractor: AnalyzeArgument) -> str:
    name = extractor.value if extractor.isConstantExpression else None
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {name!r}; there are {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[name][0]


class ExtractPage:
    """Rows of one page."""

    @staticmethod
    def analyze(extractor: AnalyzeArgument, url: AnalyzeArgument, html: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=_columns(_known(extractor)))

    def eval(self, extractor: str, url: str, html: str) -> Iterator[tuple]:
        yield from EXTRACTORS[extractor][1](url, H.parse(html))


class ExtractPages:
    """Rows of the pages of a partition, with source_id and fresh: whether no earlier page of the partition had the row."""

    @staticmethod
    def analyze(extractor: AnalyzeArgument, pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or not {"source_id", "url", "html"} <= {f.name for f in pages.dataType.fields}:
            raise ValueError("a table of pages has source_id, url and html")
        return AnalyzeResult(schema=_columns(f"source_id string, fresh boolean, {_known(extractor)}"))

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def eval(self, extractor: str, page: Row) -> Iterator[tuple]:
        for row in EXTRACTORS[extractor][1](page["url"], H.parse(page["html"])):
            key = hash((page["source_id"], *map(str, row[1:])))
            yield page["source_id"], key not in self.seen, *row
            self.seen.add(key)


def register(spark: SparkSession) -> None:
    """Make ``extract_page`` and ``extract_pages`` known to the session's SQL."""
    spark.udtf.register("extract_page", udtf(ExtractPage))
    spark.udtf.register("extract_pages", udtf(ExtractPages))
