"""HTML pages to their sections in depth-first order, with heading paths and contents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BODY = ("p", "ul", "ol", "table")
#: Pages whose sections a worker holds at once.
PAGES = 256
#: Sections that end a page.
TAIL = ("see also", "references", "external links", "further reading")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_EDIT = re.compile(r"\s*\(\s*edit\s*\)\s*$")

SCHEMA = "ord int, level int, title string, path array<string>, content string"


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "up")

    def __init__(self, tag: str, attrs: dict[str, str | None], up: Node | None):
        self.tag, self.attrs, self.up, self.children = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the page."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo.extend(reversed(c.children))
        return "".join(out)

    def only_string(self) -> str | None:
        """The one string inside, through elements that hold nothing else."""
        node = self
        while len(node.children) == 1:
            if isinstance(node.children[0], str):
                return node.children[0]
            node = node.children[0]
        return None

    def place(self) -> int:
        return next(i for i, c in enumerate(self.up.children) if c is self)

    def drop(self) -> None:
        del self.up.children[self.place()]
        self.up = None


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.up
        if node is not self.root:
            self.at = node.up

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    tree = _Tree()
    tree.feed(markup)
    tree.close()
    return tree.root


def prune(root: Node) -> None:
    """Cuts what stands before the first h1 beside it, the table of contents' node, and tail sections."""
    h1 = next((n for n in root.walk() if n.tag == "h1"), None)
    if h1 is not None:
        del h1.up.children[: h1.place()]
    toc = None
    for wanted in ("toc", "contents"):
        toc = toc or next((n for n in root.walk() if n.attrs.get("id") == wanted), None)
    toc = toc or next((n for n in root.walk() if n.tag == "h2" and "Contents" in (n.only_string() or "")), None)
    if toc is not None:
        toc.drop()
    for h2 in [n for n in root.walk() if n.tag == "h2"]:
        gone, top = False, h2
        while top is not root and not gone:
            gone, top = top.up is None, top.up
        low = _EDIT.sub("", h2.text().strip()).lower()
        if not gone and any(t in low for t in TAIL):
            cut, keep = h2.up, h2.place()
            for c in cut.children[keep:]:
                if isinstance(c, Node):
                    c.up = None
            del cut.children[keep:]


def _content(heading: Node) -> str:
    parts = []
    for c in heading.up.children[heading.place() + 1 :]:
        if isinstance(c, Node):
            if c.tag in HEADINGS:
                break
            if c.tag in BODY:
                parts.append(c.text().strip())
    return " ".join(parts)


class _Section:
    __slots__ = ("level", "title", "path", "content", "below")

    def __init__(self, level: int, title: str, content: str):
        self.level, self.title, self.content = level, title, content
        self.path, self.below = [], []


def sections(markup: str | None) -> tuple[str, list[dict]]:
    """The page's title and its sections depth first: ord, level, title, path (titles above) and content.

    A heading belongs to the newest open heading one level up; without one it stands at the top under
    the page's title.  Going up closes the levels from the previous heading's down, but not those in
    between, so a later deeper heading can still find an older parent there.
    """
    root = parse(markup or "")
    prune(root)
    first = next((n for n in root.walk() if n.tag == "h1"), None)
    title = first.text().strip() if first is not None else ""
    top: list[_Section] = []
    open_at: dict[int, _Section] = {}
    last = 0
    for node in [n for n in root.walk() if n.tag in HEADINGS]:
        name = _EDIT.sub("", node.text().strip())
        if name.lower() == "contents":
            continue
        level = int(node.tag[1])
        s = _Section(level, name, _content(node))
        # deeper: nothing below this level stays open; shallower: nothing from the last level on
        close = range(level + 1, 7) if level > last else range(last, 7) if level < last else ()
        for i in close:
            open_at.pop(i, None)
        parent = open_at.get(level - 1)
        if level == 1 and level > last:
            # the page's own heading: no path above it
            top.append(s)
        elif parent is not None and level > 1:
            s.path = [*parent.path, parent.title]
            parent.below.append(s)
        else:
            s.path = [title]
            top.append(s)
        open_at[level] = s
        last = level
    out, todo = [], list(reversed(top))
    while todo:
        s = todo.pop()
        out.append({"ord": len(out), "level": s.level, "title": s.title, "path": s.path, "content": s.content})
        todo.extend(reversed(s.below))
    return title, out


def _parsed(batches: Iterator[pd.DataFrame], rest: list[str], markup: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), PAGES):
            rows = batch.iloc[at : at + PAGES]
            parsed = [sections(None if m is None or m != m else m) for m in rows[markup]]
            out = rows[rest].copy()
            out["title"] = [t for t, _ in parsed]
            out["sections"] = [s for _, s in parsed]
            yield out


def parse_sections(docs: DataFrame, markup: str = "document_text") -> DataFrame:
    """docs with the markup column replaced by `title` and `sections` (an array of SCHEMA structs).

    Columns of docs pass through.  Null markup has the title '' and no sections.
    """
    rest = [c for c in docs.columns if c not in (markup, "title", "sections")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _parsed(batches, rest, markup)

    schema = f"{fields}{', ' if fields else ''}title string, sections array<struct<ord:int,level:int,title:string,path:array<string>,content:string>>"
    return docs.select(*rest, markup).mapInPandas(run, schema)


def titles(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Adds `title`, the first h1's text; native, for pages whose h1 is well formed."""
    from quern.functions.text import html_title

    return pages.withColumn("title", html_title(F.col(markup)))
