"""Titles, sections and text of HTML pages, by an Arrow-batched walk over a small element tree."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION_LEAST = 120
# Elements that end a line, have no end tag, or hold no text.
BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li ul ol table tr br pre blockquote figure figcaption header footer dl dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "template", "head"))

OUT = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("sections", T.ArrayType(T.StructType([
        T.StructField("heading", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()),
    ]))),
])


class Node:
    __slots__ = ("tag", "classes", "parts", "parent")

    def __init__(self, tag: str, classes: frozenset[str], parent: Node | None) -> None:
        self.tag, self.classes, self.parts, self.parent = tag, classes, [], parent

    def walk(self):  # noqa: ANN201
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def inside(self, tag: str) -> bool:
        up = self.parent
        while up is not None:
            if up.tag == tag:
                return True
            up = up.parent
        return False


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", frozenset(), None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = frozenset((dict(attrs).get("class") or "").split())
        node = Node(tag, classes, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def text_of(node: Node, without_nested: bool = False) -> str:
    """Visible text: blocks on lines of their own, runs of blanks as one space."""
    out: list[str] = []
    stack: list[Node | str] = [node]  # strings are put out as they are: text, or the end of an element
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n.tag in HIDDEN and n.tag != "head" or without_nested and n is not node and n.tag == "section":
            continue
        end = "\n" * ((n.tag in BLOCKS) + (n.tag in ("p", "section", "article") or bool(re.fullmatch("h[1-6]", n.tag))))
        if n.tag in BLOCKS:
            out.append("\n")
        stack.append(end)
        stack += [p if isinstance(p, Node) else re.sub(r"\s+", " ", p) for p in reversed(n.parts)]
    text = re.sub(r" *\n *", "\n", "".join(out))
    return clean(text)


def clean(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text.replace("\\uselogo", "")).strip()


def first(nodes: list[Node], *choices) -> Node | None:  # noqa: ANN002
    return next((n for choose in choices for n in nodes if choose(n)), None)


def read_page(html: str | None, least: int = SECTION_LEAST) -> tuple[str, str, list[tuple[str, str, int]]]:
    """Title, main text, sections (heading, text, level) of a page; a page that is null or empty has none."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    nodes = list(tree.root.walk())
    title = ""
    within = lambda tag: lambda n: n.tag == "h1" and n.inside(tag)
    for choose in (lambda n: n.tag == "h1" and "ltx_title_document" in n.classes, within("article"), within("main"), lambda n: n.tag == "h1"):
        node = first(nodes, choose)
        if node is not None and text_of(node):
            title = text_of(node)
            break
    if not title:
        head = first(nodes, lambda n: n.tag == "title")
        title = re.sub(r"\s+", " ", "".join(p for p in head.parts if isinstance(p, str))).strip() if head is not None else ""
    child = lambda tag: lambda n: n.tag == "section" and n.parent is not None and n.parent.tag == tag
    found: list[Node] = []
    for choose in (
        lambda n: n.tag == "section" and "ltx_section" in n.classes,
        lambda n: n.tag == "section" and "ltx_appendix" in n.classes,
        child("article"),
        child("main"),
    ):
        found = [n for n in nodes if choose(n)]
        if found:
            break
    sections = []
    for n in found:
        kids = [p for p in n.parts if isinstance(p, Node)]
        head = next((k for k in kids if k.tag in ("h1", "h2", "h3", "h4") or "ltx_title" in k.classes), None)
        text = text_of(n, without_nested=True)
        if len(text) >= least:
            sections.append((text_of(head) if head is not None else "", text, 2))
    main = first(nodes, lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.tag == "body") or tree.root
    return title, text_of(main), sections


@F.pandas_udf(OUT)
def page_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=["title", "text", "sections"])
