"""A small tolerant HTML tree on the standard library's parser, for use in tasks.

Pages of plain markup, which the parser can read in one way only, are split by one pattern and not
character by character; all others go through the parser. Both give the same tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

# Fixed value: elements without content.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
# Fixed value: elements whose text does not belong to the text around them.
HIDDEN = frozenset(["script", "style", "template", "rt", "rp"])
# Elements whose content the parser reads in a way of its own.
_RAW = frozenset(HTMLParser.CDATA_CONTENT_ELEMENTS) | frozenset(getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())) | {"plaintext"}

_WS = r"[ \t\n\r\f]"
_ATTRIBUTE = r"""([a-zA-Z_][a-zA-Z0-9_:.-]*)(?:=(?:"([^"<&]*)"|'([^'<&]*)'|([^\s"'<>=`/&]+)(?=[\s>]|\Z)))?"""
_ATTRIBUTES = rf"((?:{_WS}+{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*+)"
# Text, then an end tag, a whole script or style, a start tag, a comment or document type; or "<" for anything else.
_TOKEN = re.compile(
    rf"([^<]*)(?:</([a-zA-Z][a-zA-Z0-9]*){_WS}*>"
    rf"|<(script|style){_ATTRIBUTES}{_WS}*>([^<]*(?:<(?!(?i:/script|/style|!))[^<]*)*+)</\3{_WS}*>"
    rf"|<([a-zA-Z][a-zA-Z0-9]*){_ATTRIBUTES}{_WS}*(/?)>"
    rf"|(<!--[^->]*(?:-[^->]+)*+-->|<!(?:doctype|DOCTYPE)[^<>]*>)|(<)|\Z)")
_ATTRIBUTE = re.compile(_ATTRIBUTE)


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs = name, attrs
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def class_matches(self, pattern: re.Pattern) -> bool:
        if "class" not in self.attrs:
            return False
        names = self.classes
        if len(names) == 1:
            return bool(pattern.search(names[0]))
        return any(pattern.search(n) for n in names) or bool(names and pattern.search(" ".join(names)))


class _Builder(HTMLParser):
    """Keeps unclosed elements open; an end tag closes up to its nearest open element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {})
        self.open = [self.root]
        self.pending: list[str] = []
        self.fault: str | None = None

    def _settle(self) -> None:
        if self.pending:
            text = "".join(self.pending)
            self.pending = []
            if not text.strip() and not any(n.name in ("pre", "textarea") for n in self.open):
                text = "\n" if "\n" in text else " "
            self.open[-1].children.append(text)

    def handle_starttag(self, tag, attrs):
        self._settle()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._settle()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def updatepos(self, i, j):
        # Line numbers are not needed.
        return j

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._settle()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            # An unknown declaration is a comment up to the next closing bracket.
            self.fault = "malformed declaration"
            end = self.rawdata.find(">", i)
            self.handle_comment("")
            return end + 1

    def close(self):
        super().close()
        self._settle()


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(text)} if text else {}


def _plain(html: str) -> Node | None:
    """The tree that ``_Builder`` makes of a page of plain markup; nothing for any other page."""
    root = Node("[document]", {})
    opened, names, children = [root], [root.name], root.children
    for text, end, raw, raw_attributes, content, name, attributes, empty, skipped, other in _TOKEN.findall(html):
        if other:
            return None
        if text:
            if "&" in text:
                text = unescape(text)
            if text.isspace() and "pre" not in names and "textarea" not in names:
                text = "\n" if "\n" in text else " "
            children.append(text)
        if end:
            end = end.lower()
            if names[-1] == end:
                opened.pop(), names.pop()
                children = opened[-1].children
            elif end in names:
                i = len(names) - 1 - names[::-1].index(end)
                del opened[i:], names[i:]
                children = opened[-1].children
        elif name:
            name = name.lower()
            if name in _RAW:
                return None
            node = Node(name, _attributes(attributes))
            children.append(node)
            if not empty and name not in VOID:
                opened.append(node)
                names.append(name)
                children = node.children
        elif raw:
            node = Node(raw, _attributes(raw_attributes))
            children.append(node)
            if content:
                if content.isspace() and "pre" not in names and "textarea" not in names:
                    content = "\n" if "\n" in content else " "
                node.children.append(content)
    return root


def parse(html: str) -> tuple[Node, str | None]:
    """The page's tree, and what was wrong with its markup, if anything had to be skipped."""
    root = _plain(html)
    if root is not None:
        return root, None
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root, builder.fault


Dropped = frozenset | set


def elements(node: Node, dropped: Dropped = frozenset()) -> Iterator[Node]:
    """Descendant elements in document order, without dropped subtrees."""
    stack = [c for c in node.children[::-1] if c.__class__ is Node]
    while stack:
        here = stack.pop()
        if dropped and id(here) in dropped:
            continue
        yield here
        below = here.children
        if len(below) > 1 or below and below[0].__class__ is Node:
            stack += [c for c in below[::-1] if c.__class__ is Node]


def first(node: Node, test: Callable[[Node], bool], dropped: Dropped = frozenset()) -> Node | None:
    return next((e for e in elements(node, dropped) if test(e)), None)


def named(*names: str) -> Callable[[Node], bool]:
    return lambda e: e.name in names


def strings(node: Node, dropped: Dropped = frozenset()) -> Iterator[str]:
    """Visible strings below a node in document order."""
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        here = stack.pop()
        if isinstance(here, str):
            yield here
        elif here.name not in HIDDEN and id(here) not in dropped:
            stack.extend(reversed(here.children))


def joined(node: Node, separator: str = "", dropped: Dropped = frozenset()) -> str:
    """Stripped, non-empty strings joined."""
    if not node.children:
        return ""
    if len(node.children) == 1 and node.children[0].__class__ is str:
        return node.children[0].strip()
    return separator.join(s for s in (t.strip() for t in strings(node, dropped)) if s)


def text_lengths(node: Node, dropped: Dropped = frozenset()) -> dict[int, int]:
    """Length of the stripped visible text of every element, in one walk."""
    order, sizes = [node, *elements(node, dropped)], {}
    for here in reversed(order):
        # Children come after their parent in document order, so they are done.
        sizes[id(here)] = sum(
            len(c.strip()) if isinstance(c, str) else 0 if c.name in HIDDEN else sizes.get(id(c), 0)
            for c in here.children
        )
    return sizes
