"""What is read from one parsed page. Rules only; Spark hands the pages out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from .html import Node, elements, first, joined, named, strings, text_lengths
from .patterns import WHITESPACE

# Elements and attribute patterns that mark noise or content.
CODE_TAGS = ("script", "style", "noscript", "iframe", "embed", "object", "svg", "canvas")
FRAME_TAGS = ("nav", "header", "footer", "aside", "form", "button")
FRAME_NOISE = re.compile(
    r"(^|[\s_-])(nav|navbar|navigation|menu|advertisement|cookie|popup|modal|banner|social|share|"
    r"subscribe|newsletter|sponsored|promo|widget)($|[\s_-])", re.I)
CONTENT_REGION = re.compile(r"(main|content|article|post|body)", re.I)
READER_TAGS = ("script", "style", "noscript", "iframe", "svg", "canvas", "head", "footer", "nav")
READER_NOISE = re.compile(
    r"(sidebar|navbar|breadcrumb|cookie|popup|modal|advertisement|social|share|reflist|navbox|"
    r"noprint|hatnote|mbox|portal|toc|catlinks|header|footer)", re.I)
READER_ID = re.compile(r"^(content|main|primary|article|post|body)$", re.I)
READER_CLASS = re.compile(r"(article.body|post.content|main.content|entry.content|product.detail)", re.I)
WIKI_NOISE = frozenset([
    "toc", "navbox", "navbox-inner", "navbox-subgroup", "reflist", "refbegin", "mbox", "ambox", "tmbox", "hatnote",
    "navigation-not-searchable", "noprint", "mw-editsection", "reference", "portal", "sistersitebox", "metadata",
    "catlinks",
])
LIST_NOISE = ("script", "style", "nav", "footer", "header")
ITEM_CLASS = re.compile(r"(product|item|card|listing|result|article|post|job)", re.I)
TITLE_CLASS = re.compile(r"(title|name|heading)", re.I)
PRICE_CLASS = re.compile(r"(price|cost|amount)", re.I)
RATING_CLASS = re.compile(r"(rating|star|score)", re.I)
INFOBOX_CLASS = re.compile(r"infobox", re.I)
PRICE_TEXT = re.compile(r"[£$€₹¥]\s*[\d,]+\.?\d*")
SHORT_CONTENT = 50
_NO_NAME = re.compile(r"[^a-zA-Z0-9_]")


@dataclass(frozen=True)
class Limits:
    """What a report may cut: containers of a page, characters of a label and of a value; ``None`` keeps all."""

    items: int | None = None
    label: int | None = None
    value: int | None = None


def _squeezed(text: str) -> str:
    # Single spaces are left alone, which spares a replacement per word.
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}|\t", " ", text))
    return "\n".join(line.strip() for line in text.split("\n")).strip()


def clean_text(root: Node, main_only: bool = True) -> str:
    """Visible text of the page, or of its main region, one string per line."""
    noisy = {
        id(e) for e in elements(root)
        if e.name in CODE_TAGS or e.name in FRAME_TAGS
        and (FRAME_NOISE.search(" ".join(e.classes)) or FRAME_NOISE.search(e.attrs.get("id", "")))
    }
    target = None
    if main_only:
        for test in (
            named("main"), named("article"),
            lambda e: "id" in e.attrs and CONTENT_REGION.search(e.attrs["id"]),
            lambda e: e.class_matches(CONTENT_REGION),
        ):
            target = target or first(root, test, noisy)
    return _squeezed(joined(target or root, "\n", noisy))


def _few_breaks(text: str) -> str:
    return re.sub(r"\n{4,}", "\n\n\n", text)


def main_content(root: Node, url: str) -> str:
    """Reader's view: the main region if it is long enough, else the largest block, else the body."""
    if "wikipedia.org" in url:
        article = first(root, lambda e: e.attrs.get("id") == "mw-content-text")
        if article:
            noisy = {id(e) for e in elements(article) if not WIKI_NOISE.isdisjoint(e.classes)}
            return re.sub(r"\[\d+\]", "", _few_breaks(joined(article, "\n", noisy))).strip()
    noisy = {
        id(e) for e in elements(root)
        if e.name in READER_TAGS or READER_NOISE.search(e.attrs.get("id", "")) or READER_NOISE.search(" ".join(e.classes))
    }
    region = None
    for test in (
        named("main"), named("article"),
        lambda e: "id" in e.attrs and READER_ID.search(e.attrs["id"]),
        lambda e: e.class_matches(READER_CLASS),
    ):
        region = region or first(root, test, noisy)
    if region:
        text = joined(region, "\n", noisy)
        if len(text) > 500:
            return _few_breaks(text).strip()
    best, size = None, 0
    lengths = text_lengths(root, noisy)
    for block in elements(root, noisy):
        if block.name in ("div", "section") and lengths[id(block)] > size:
            best, size = block, lengths[id(block)]
    target = best if size > 200 else first(root, named("body"), noisy) or root
    return _few_breaks(joined(target, "\n", noisy)).strip()


def page_content(root: Node, url: str) -> str:
    """The reader's view, or all visible text where that is shorter than 50 characters."""
    content = main_content(root, url)
    if len(content) >= SHORT_CONTENT:
        return content
    return joined(root, "\n", {id(e) for e in elements(root) if e.name in ("script", "style", "noscript")})


def metadata(root: Node) -> dict[str, str]:
    """Title, description, keywords, canonical URL and Open Graph texts; the last tag of a kind wins."""
    found = dict.fromkeys(("title", "description", "keywords", "canonical_url", "og_title", "og_description"), "")
    title = first(root, named("title"))
    if title:
        found["title"] = joined(title)
    for tag in elements(root):
        if tag.name == "meta":
            name, prop = tag.attrs.get("name", "").lower(), tag.attrs.get("property", "").lower()
            if name in ("description", "keywords"):
                found[name] = tag.attrs.get("content", "")
            elif prop in ("og:title", "og:description"):
                found[prop.replace(":", "_")] = tag.attrs.get("content", "")
    canonical = first(root, lambda e: e.name == "link" and "canonical" in e.attrs.get("rel", "").split())
    if canonical:
        found["canonical_url"] = canonical.attrs.get("href", "")
    return found


def _field_name(text: str) -> str:
    return _NO_NAME.sub("_", text.lower()).strip("_")


def table_records(root: Node, limits: Limits = Limits()) -> list[tuple[int, int, dict[str, str]]]:
    """``(table, row, fields)`` of every table row; the first row's non-blank cells name the fields."""
    # One walk: a row belongs to every table around it, and a cell to every row.
    tables: list[list[list[str]]] = []
    stack = [(root, (), ())]
    while stack:
        here, around, rows = stack.pop()
        if here.name == "table":
            tables.append([])
            around = (*around, tables[-1])
        elif here.name == "tr" and around:
            row: list[str] = []
            for table in around:
                table.append(row)
            rows = (*rows, row)
        elif rows and here.name in ("td", "th"):
            text = joined(here)
            for row in rows:
                row.append(text)
        below = here.children
        if len(below) > 1 or below and below[0].__class__ is Node:
            stack += [(c, around, rows) for c in below[::-1] if c.__class__ is Node]
    found = []
    for number, cells in enumerate(tables):
        names = [_field_name(c) for c in cells[0] if c] if cells else []
        for i, values in enumerate(cells[1:]):
            # zip pairs names and cells by position: a blank heading shifts the names.
            if len(values) >= 2:
                fields = {name: value for name, value in zip(names, values) if value}
                if fields:
                    found.append((number, i, fields))
    return found


def list_records(root: Node, limits: Limits = Limits()) -> list[tuple[int, int, dict[str, str]]]:
    """Records of product-like elements that show at least two of title, price, rating, description and URL."""
    noisy = {id(e) for e in elements(root) if e.name in LIST_NOISE}
    items = [e for e in elements(root, noisy) if e.class_matches(ITEM_CLASS)][: limits.items]
    found = []
    for i, item in enumerate(items):
        fields = {}
        below = list(elements(item, noisy))
        inside = lambda test: next(filter(test, below), None)
        title = inside(named("h1", "h2", "h3", "h4")) or inside(lambda e: e.class_matches(TITLE_CLASS))
        if title:
            fields["title"] = joined(title, "", noisy)
        price = inside(lambda e: e.class_matches(PRICE_CLASS))
        amount = None if price else PRICE_TEXT.search("".join(strings(item, noisy)))
        if price or amount:
            fields["price"] = joined(price, "", noisy) if price else amount.group()
        rating = inside(lambda e: e.class_matches(RATING_CLASS))
        if rating:
            fields["rating"] = joined(rating, "", noisy)
        description = inside(named("p"))
        if description:
            fields["description"] = joined(description, "", noisy)[: limits.value]
        link = inside(named("a"))
        if link and link.attrs.get("href"):
            fields["url"] = link.attrs["href"]
        if len(fields) >= 2:
            found.append((0, i, fields))
    return found


def infobox_records(root: Node, limits: Limits = Limits()) -> list[tuple[int, int, dict[str, str]]]:
    """One record of the first infobox's label and value cells."""
    box = first(root, lambda e: e.name == "table" and e.class_matches(INFOBOX_CLASS))
    fields = {}
    for row in elements(box) if box else ():
        if row.name == "tr":
            cells = [joined(c) for c in elements(row) if c.name in ("th", "td")][:2]
            if len(cells) == 2 and all(cells) and (limits.label is None or len(cells[0]) <= limits.label):
                fields[_field_name(cells[0])] = cells[1][: limits.value]
    return [(0, 0, fields)] if fields else []


RECORD_RULES = {"infobox": infobox_records, "tables": table_records, "lists": list_records}


def page_records(root: Node, url: str, limits: Limits = Limits()) -> list[tuple[str, int, int, dict[str, str]]]:
    """Records of the first rule that finds any: infobox on Wikipedia only, tables, lists."""
    for rule, read in RECORD_RULES.items():
        if rule == "infobox" and "wikipedia.org" not in url:
            continue
        found = read(root, limits)
        if found:
            return [(rule, *record) for record in found]
    return []


def clean_records(records: Sequence[dict[str, str]], missing: float, fill: str) -> list[dict[str, str]]:
    """A page's distinct records in order, their fields by name: no record of fewer than two filled fields, unless
    all are such, and no field that is blank in more than the share ``missing`` of the records."""
    kept = [r for r in records if sum(map(bool, r.values())) >= 2]
    if kept:
        filled = Counter(name for r in kept for name, value in r.items() if value)
        common = {name for name, n in filled.items() if (len(kept) - n) / len(kept) <= missing}
        records = [{n: v.strip(WHITESPACE) if v else fill for n, v in r.items() if n in common} for r in kept]
    return [dict(r) for r in dict.fromkeys(tuple(sorted(r.items())) for r in records if r or not kept)]
