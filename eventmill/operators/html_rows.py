"""Extraction where a page's structure matters: a small tree over the standard parser, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.dates import MONTHS, PLAIN_MONTHS

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Where items are looked for, in this order, if the configured selector finds none.
ITEM_SELECTORS = (".event-card", ".event-item", ".event", "article.event", "[class*='event']", ".agenda-item", "[class*='agenda']")
#: Elements that one of their own kind ends, and the elements that such an end doesn't reach beyond.
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = frozenset("ul ol dl table select div section article nav aside header footer main body html".split())
#: Blocks that end an open paragraph.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def _all(self) -> Iterator[Node | str]:
        """What lies below the node, in the order of the page; pages nest too deeply for recursion."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                yield c
                if isinstance(c, Node):
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def walk(self) -> Iterator[Node]:
        return (c for c in self._all() if isinstance(c, Node))

    def text(self) -> str:
        return " ".join(" ".join(c for c in self._all() if isinstance(c, str)).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def _close(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[node.tag] -= 1
        del self.open[at:]

    def _end_before(self, tags: set[str]) -> None:
        """Close the innermost open element of ``tags``, unless a container lies between."""
        if any(self.count.get(t) for t in tags):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in tags:
                    return self._close(i)
                if self.open[i].tag in _FENCE:
                    return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSED_BY:
            self._end_before(_CLOSED_BY[tag])
        if tag in _BLOCKS:
            self._end_before({"p"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if self.count.get(tag):
            self._close(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag))

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    return builder.root


def _fits(node: Node, selector: str) -> bool:
    """tag, .class, #id, [attr], [attr=x] and [attr*=x], in any combination."""
    for kind, value in re.findall(r"([.#]?)([\w-]+)|\[", re.sub(r"\[[^\]]*\]", "", selector)):
        if kind == "." and value not in node.attrs.get("class", "").split():
            return False
        if kind == "#" and node.attrs.get("id") != value:
            return False
        if not kind and value and node.tag != value:
            return False
    for name, op, value in re.findall(r"""\[([\w-]+)(\*?=)?["']?([^"'\]]*)["']?\]""", selector):
        own = node.attrs.get(name)
        if own is None or (op == "=" and own != value) or (op == "*=" and value not in own):
            return False
    return True


def _chain(node: Node, steps: list[str]) -> Iterator[Node]:
    """Nodes that fit the last step below nodes that fit the ones before it, in one walk."""
    stack = [(iter(node.children), 0)]
    while stack:
        rest, done = stack[-1]
        for c in rest:
            if isinstance(c, Node):
                if done == len(steps) - 1 and _fits(c, steps[-1]):
                    yield c
                stack.append((iter(c.children), done + (done < len(steps) - 1 and _fits(c, steps[done]))))
                break
        else:
            stack.pop()


def find(node: Node, selector: str) -> list[Node]:
    """All nodes below ``node`` that fit one of the alternatives, each a chain of descendants."""
    chains = [s.split() for s in selector.split(",") if s.strip()]
    return list(dict.fromkeys(x for steps in chains for x in _chain(node, steps)))


def _rows(pages: DataFrame, schema: str, make: Callable[[str, Node], Iterator[tuple]]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [r for url, html in zip(frame["url"], frame["html"]) for r in make(url, parse(html))]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("url", "html").mapInPandas(run, schema)


RAW_EVENT = "url string, name string, link string, raw_date string, raw_time string, location string, description string, image string, category string, tags array<string>"


def raw_events(url: str, root: Node, selectors: dict[str, str]) -> Iterator[tuple]:
    box = (find(root, selectors["container"]) if selectors.get("container") else []) or [root]
    items = [x for b in box for x in find(b, selectors.get("item", "") or ".event")]
    for fallback in ITEM_SELECTORS:
        items = items or [x for b in box for x in find(b, fallback)]
    for item in items:
        first = lambda key: next(iter(find(item, selectors[key])), None) if selectors.get(key) else None  # noqa: B023, E731
        text = lambda key: (first(key).text() if first(key) else None)  # noqa: B023, E731
        link, image = first("link") or (item if item.tag == "a" else None), first("image")
        name, href = text("name"), link.attrs.get("href") if link else None
        if name and href:
            src = image.attrs.get("src", "") if image else ""
            src = src if src and not src.startswith("data:") else (image.attrs.get("data-src") or image.attrs.get("data-lazy-src") if image else None)
            tags = [t for t in (x.text().lower() for x in find(item, selectors["tags"])) if t and len(t) < 50][:5] if selectors.get("tags") else []
            yield url, name, href, text("date"), text("time"), text("location"), (text("description") or "")[:160], src, text("category"), tags


def extract_by_selectors(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Raw events of listing pages. ``selectors``: container, item, name, link, date, time, location, description, image, category, tags.

    An item needs a name and a link. Descriptions end at 160 characters; of the tags the first five
    under 50 characters are kept.
    """
    return _rows(pages, RAW_EVENT, lambda url, root: raw_events(url, root, selectors))


def extract_by_source_selectors(pages: DataFrame, selectors: DataFrame, default: dict[str, str] | None = None) -> DataFrame:
    """``extract_by_selectors`` for pages of many sources in one pass: source_id and the raw events.

    ``selectors`` has source_id, field and selector, a row for each field that a source sets (of
    equal fields the greatest selector counts); ``default`` fills the fields that it doesn't. Sources
    without rows have the defaults. The table is joined by source id, each page is parsed once.
    """
    common = {**(default or {})}
    own = selectors.where("source_id is not null and field is not null").groupBy("source_id", "field").agg(F.max("selector").alias("selector"))
    own = own.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "selector"))).alias("own"))
    rows = pages.select("source_id", "url", "html").join(own, "source_id", "left").select("source_id", "url", "html", F.to_json("own").alias("own"))
    names = ["source_id", *(x.split()[0] for x in RAW_EVENT.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str | None, dict[str, str]] = {None: common}
        for frame in batches:
            out = []
            for source, url, html, told in zip(frame["source_id"], frame["url"], frame["html"], frame["own"]):
                if told not in known:
                    known[told] = common | {k: v for k, v in json.loads(told).items() if v}
                out += [(source, *r) for r in raw_events(url, parse(html), known[told])]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, f"source_id string, {RAW_EVENT}")


CARD = "url string, name string, link string, start_date string, location string, image string"


def cards(url: str, root: Node) -> Iterator[tuple]:
    for card in find(root, "[itemscope]"):
        kind = card.attrs.get("itemtype", "")
        inner = {id(x) for sub in find(card, "[itemscope]") for x in sub.walk()}
        prop = lambda name: next((x for x in find(card, f"[itemprop={name}]") if id(x) not in inner), None)  # noqa: B023, E731
        value = lambda x: (x.attrs.get("content") or x.attrs.get("datetime") or x.attrs.get("href") or x.attrs.get("src") or x.text()) if x else None
        name, link = prop("name"), prop("url")
        if "Place" not in kind and "Event" in kind and name and link:
            place = next(iter(find(card, "[itemprop=location] [itemprop=name]")), None) or prop("location")
            yield url, value(name) if name.attrs.get("content") else name.text(), value(link), value(prop("startDate")), place.text() if place else None, value(prop("image"))


def extract_microdata(pages: DataFrame) -> DataFrame:
    """Events of schema.org cards: name, link, startDate, location, image; cards of places are left out."""
    return _rows(pages, CARD, cards)


def microdata_to_event(cards: DataFrame) -> DataFrame:
    """Events of cards; midnight, which stands for an unknown time, becomes 20:00."""
    start = D.default_midnight_to_20h(D.parse_iso_local(F.col("start_date")))
    return cards.select("name", F.col("link").alias("event_url"), start.alias("start_ts"), "location", "image").where("start_ts is not null")


def extract_verse_blocks(pages: DataFrame, venue_words: list[str], book_words: list[str]) -> DataFrame:
    """(url, block, date_text, venue, link) of an article's announcement blocks.

    A block is a ``<pre>`` or ``verse`` element with a line that looks like a date. The venue is its
    link's text, else a bold text with a known word, else the first bold text; book notices go.
    """
    dated = re.compile(rf"(?i){'|'.join(dict.fromkeys((*MONTHS, *PLAIN_MONTHS)))}|^du \d|^jusqu")

    def make(url: str, root: Node) -> Iterator[tuple]:
        n = 0
        for block in find(root, ".wp-block-verse, pre"):
            text = block.text()
            if any(w in text.lower() for w in book_words):
                continue
            lines = [x.text() if isinstance(x, Node) else x.strip() for x in block.children]
            date = next((x for x in lines if x and dated.search(x)), None)
            if date is None:
                continue
            link = next(iter(find(block, "a")), None)
            bold = [b.text() for b in find(block, "strong")]
            known = next((b for b in bold if any(w in b.lower() for w in venue_words)), None)
            venue = (link.text() if link else None) or known or next((b for b in bold if b != date), None)
            yield url, n, date, venue, link.attrs.get("href") if link else None
            n += 1

    return _rows(pages, "url string, block int, date_text string, venue string, link string", make)


#: Extractors by name; each takes a page table and gives a table of raw events.
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {"selectors": extract_by_selectors, "microdata": extract_microdata, "verse": extract_verse_blocks}


def extractor(name: str) -> Callable[..., DataFrame]:
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {name!r}; there are {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[name]
