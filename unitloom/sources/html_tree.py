"""A small HTML tree on the standard library's tokenizer, and the walk that yields blocks.

The tree follows the lenient rules of Python's own parser: nothing is closed implicitly, an end
tag closes up to the nearest open element of its name and is ignored without one, void elements
hold nothing, comments are text nodes of their own kind.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator, Mapping
from html.parser import HTMLParser

# Element names.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
NON_CONTENT = frozenset(["script", "style", "template", "noscript"])
BOILERPLATE = frozenset(["nav", "header", "footer", "aside"])
HEADINGS = {f"h{k}": k for k in range(1, 7)}
CONTAINERS = frozenset(["div", "section", "article"])
RECOGNIZED = frozenset([*HEADINGS, "p", "li", "table", "pre", "blockquote"])
ROW_GROUPS = frozenset(["thead", "tbody", "tfoot"])

# Python's own white space without the line feed, as in the text functions.
_RUNS = re.compile(r"[^\S\n]+")


class Node:
    """An element; children are nodes, strings, or comments."""

    __slots__ = ("children", "name", "parent")

    def __init__(self, name: str, parent: Node | None) -> None:
        self.name, self.parent = name, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order; no recursion, so depth is no limit."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def direct(self, names: frozenset[str] | set[str]) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.name in names]

    def inside(self, names: set[str]) -> bool:
        at = self.parent
        while at is not None:
            if at.name in names:
                return True
            at = at.parent
        return False


class Comment(str):
    """Text of a comment or declaration: part of structural text, not of preformatted text."""

    __slots__ = ()


class _Builder(HTMLParser):
    def __init__(self, raw: tuple[str, ...] = ()) -> None:
        super().__init__(convert_charrefs=True)
        self.CDATA_CONTENT_ELEMENTS = (*HTMLParser.CDATA_CONTENT_ELEMENTS, *raw)
        self.root = self.at = Node("[document]", None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: object) -> None:
        node = Node(tag, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: object) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        while True:
            closed = self.at.name
            self.open[closed] -= 1
            self.at = self.at.parent
            if closed == tag:
                return

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_comment(self, data: str) -> None:
        self.at.children.append(Comment(data))

    def handle_decl(self, decl: str) -> None:
        pass

    handle_pi = unknown_decl = handle_decl


def decode(raw: bytes, charset: str | None) -> tuple[str, bool | None, str]:
    """Text of a page, whether the declared charset is a known one, and the encoding used."""
    known = None
    order = []
    if charset is not None:
        try:
            order.append(codecs.lookup(charset).name)
            known = True
        except LookupError:
            known = False
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            order.append(name)
    if found := re.search(rb"""<meta[^>]+charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", raw[:2048], re.I):
        order.append(found[1].decode("ascii"))
    for name in [*order, "utf-8", "windows-1252"]:
        try:
            return raw.decode(name), known, name
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace"), known, "utf-8"


def parse(html: str, raw: tuple[str, ...] = ()) -> Node:
    """raw: elements that hold their source as one text, besides scripts and styles."""
    builder = _Builder(raw)
    builder.feed(html)
    builder.close()
    return builder.root


def text_of(node: Node, without: frozenset[str] | set[str] = frozenset(), comments: bool = True) -> str:
    """Strings below an element; a line break for br; nothing of the named elements."""
    out: list[str] = []
    stack: list = [iter(node.children)]
    while stack:
        for child in stack[-1]:
            if not isinstance(child, Node):
                if comments or not isinstance(child, Comment):
                    out.append(child)
            elif child.name == "br":
                if comments:
                    out.append("\n")
            elif child.name not in without:
                stack.append(iter(child.children))
                break
        else:
            stack.pop()
    return "".join(out)


def _unified(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")


def structural(text: str) -> str:
    """Single spaces in lines, stripped lines, at most one blank line, stripped ends."""
    lines = "\n".join(_RUNS.sub(" ", line).strip() for line in _unified(text).split("\n"))
    return re.sub("\n{3,}", "\n\n", lines).strip()


def preformatted(node: Node) -> str:
    return re.sub(r"\A\s*\n|\n\s*\Z", "", _unified(text_of(node, comments=False)))


def cell(node: Node) -> str:
    lines = _unified(text_of(node, {"table"})).split("\n")
    return "\n".join(re.sub(r"[ \f\v]+", " ", line).strip() for line in lines).strip()


def table_cells(table: Node) -> list[list[str]]:
    """Cells of the table's own rows; rows of its row groups are in their place."""
    rows: list[Node] = []
    for child in table.children:
        if isinstance(child, Node):
            if child.name == "tr":
                rows.append(child)
            elif child.name in ROW_GROUPS:
                rows += child.direct({"tr"})
    return [[cell(c) for c in row.direct({"th", "td"})] for row in rows]


class Page:
    """One page's blocks, in order of the document.

    ``title_references``: the only character references that are decoded in titles, whose source is
    text otherwise; without it titles are parsed as all else is.
    """

    def __init__(self, html: str, title_references: Mapping[str, str] | None = None) -> None:
        self.title_references = title_references or {}
        self.tree = parse(html, () if title_references is None else ("title",))
        self.removed = 0
        self._prune()
        self.root, self.strategy = self._root()
        self.kinds = {"heading": 0, "paragraph": 0, "code": 0, "table": 0, "list": 0, "item": 0}
        self.ignored = self.nested_tables = 0

    def _prune(self) -> None:
        for node in [self.tree, *self.tree.walk()]:
            stay = [c for c in node.children if not (isinstance(c, Node) and c.name in NON_CONTENT)]
            if len(stay) < len(node.children):
                gone = [c for c in node.children if isinstance(c, Node) and c.name in NON_CONTENT]
                self.removed += len(gone) + sum(x.name in NON_CONTENT for g in gone for x in g.walk())
                node.children = stay

    def _root(self) -> tuple[Node, str]:
        for name in ("main", "article"):
            usable = [n for n in self.tree.walk() if n.name == name and structural(text_of(n))]
            if len(usable) == 1:
                return usable[0], f"single_usable_{name}"
        body = next((n for n in self.tree.walk() if n.name == "body"), None)
        return (body, "body_fallback") if body is not None else (self.tree, "document_root")

    def _next(self, kind: str) -> int:
        self.kinds[kind] += 1
        return self.kinds[kind] - 1

    def blocks(self) -> Iterator[dict]:
        title = next((n for n in self.tree.walk() if n.name == "title"), None)
        if title is not None and (text := structural(self._title(title))):
            yield {"block_type": "document_title", "content_type": "paragraph", "content": text, "html_tag": "title"}
        yield from self._children(self.root, None)

    def _title(self, node: Node) -> str:
        known = self.title_references
        return re.sub("|".join(map(re.escape, known)), lambda x: known[x[0]], text_of(node)) if known else text_of(node)

    def _children(self, parent: Node, quoted: str | None) -> Iterator[dict]:
        # A stack of child iterators, as pages may nest deeper than Python recurses.
        stack = [iter(parent.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                continue
            if not isinstance(child, Node) or child.name in NON_CONTENT:
                continue
            if self.strategy == "body_fallback" and child.name in BOILERPLATE and not child.inside({"main", "article"}):
                self.ignored += 1
                continue
            own = self._block(child, quoted)
            if own is None:
                stack.append(iter(child.children))
            else:
                yield from own

    def _block(self, node: Node, quoted: str | None) -> Iterator[dict] | None:
        """Blocks of a recognized element; None if its children are to be looked at instead."""
        name = node.name
        base = {"html_tag": name, "nearest_semantic_container": quoted}
        if name in HEADINGS:
            return iter([base | {"block_type": "heading", "content_type": "paragraph", "content": structural(text_of(node)), "heading_level": HEADINGS[name], "heading_index": self._next("heading")}])
        if name == "p":
            return iter([base | {"block_type": "paragraph", "content_type": "paragraph", "content": structural(text_of(node)), "paragraph_index": self._next("paragraph")}])
        if name == "pre":
            return iter([base | {"block_type": "code_block", "content_type": "code", "content": preformatted(node), "code_block_index": self._next("code")}])
        if name == "table":
            return self._table(node, base)
        if name == "blockquote":
            return self._quote(node)
        if name in ("ul", "ol"):
            return self._list(node, 0, None, quoted)
        if name in CONTAINERS and leaf(node):
            return iter([base | {"block_type": "container_text", "content_type": "paragraph", "content": structural(text_of(node))}])
        return None

    def _table(self, node: Node, base: dict) -> Iterator[dict]:
        for caption in node.direct({"caption"})[:1]:
            yield base | {"html_tag": "caption", "block_type": "table_caption", "content_type": "paragraph", "content": structural(text_of(caption)), "table_index": self.kinds["table"]}
        self.nested_tables += sum(n.name == "table" for n in node.walk())
        yield base | {"block_type": "table", "content_type": "table", "cells": table_cells(node), "table_index": self._next("table")}

    def _list(self, node: Node, depth: int, parent: int | None, quoted: str | None) -> Iterator[dict]:
        container = self._next("list")
        for place, item in enumerate(node.direct({"li"})):
            index = self._next("item")
            text = structural(structural(text_of(item, {"ul", "ol"})).replace("\n", " "))
            yield {
                "html_tag": "li", "block_type": "list_item", "content_type": "list", "content": text, "nearest_semantic_container": quoted,
                "list_container_global_index": container, "list_item_global_index": index, "list_item_index_in_container": place,
                "list_depth": depth, "list_type": "ordered" if node.name == "ol" else "unordered", "parent_emitted_list_item_global_index": parent,
            }
            for nested in item.direct({"ul", "ol"}):
                yield from self._list(nested, depth + 1, index if text else None, quoted)

    def _quote(self, node: Node) -> Iterator[dict]:
        if not any(n.name in RECOGNIZED for n in node.walk()):
            yield {"html_tag": "blockquote", "block_type": "blockquote", "content_type": "paragraph", "content": structural(text_of(node))}
            return
        inner = {"block_type": "blockquote_text", "content_type": "paragraph", "nearest_semantic_container": "blockquote"}
        for child in node.children:
            if not isinstance(child, Node):
                if text := structural(child):
                    yield inner | {"html_tag": "blockquote", "content": text}
            elif child.name in NON_CONTENT:
                continue
            elif child.name in CONTAINERS and leaf(child):
                yield inner | {"html_tag": child.name, "content": structural(text_of(child))}
            else:
                own = self._block(child, "blockquote")
                yield from self._children(child, "blockquote") if own is None else own


def leaf(node: Node) -> bool:
    """Whether a container has text of its own and no element that makes a block."""
    own = "".join("\n" if isinstance(c, Node) else c for c in node.children if not isinstance(c, Node) or c.name == "br")
    return bool(structural(own)) and not any(n.name in RECOGNIZED for n in node.walk())
