"""What depends on a page's structure: read by the standard library's HTML parser, batch by batch over Arrow."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import REQUIREMENT_HEADING

_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ITEM = re.compile("post|item|entry", re.I)
_CONTENT_CLASS = re.compile("entry-content|post-content|article-content|job-content|content-area", re.I)
_CONTENT_ID = re.compile("content|main|article", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.up, self.children = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        """Elements within, in document order, without recursion."""
        stack = [x for x in reversed(self.children) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.children) if isinstance(x, Node)]

    def strings(self, scripts: bool = False) -> Iterator[tuple[str, Node]]:
        """Texts within and their elements, in document order."""
        stack = [(x, self) for x in reversed(self.children)]
        while stack:
            x, owner = stack.pop()
            if isinstance(x, str):
                yield x, owner
            elif scripts or x.tag not in ("script", "style"):
                stack += [(y, x) for y in reversed(x.children)]

    def text(self, between: str = "") -> str:
        return between.join(s for s in (x.strip() for x, _ in self.strings()) if s)

    def link(self) -> Node | None:
        return next((x for x in self.walk() if x.tag == "a" and x.attrs.get("href")), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _EMPTY:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.up
        if node is not self.root:
            self.at = node.up

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def curated_links(root: Node) -> list[tuple[str, str]]:
    """The first anchor of each entry, or of each heading where a page has no entries; absolute addresses only."""
    blocks = [x for x in root.walk() if x.tag in ("article", "div") and _ITEM.search(x.attrs.get("class", ""))] or [x for x in root.walk() if x.tag in ("h2", "h3")]
    found = [a for a in (b.link() for b in blocks) if a]
    return [(a.attrs["href"], a.text()) for a in found if a.attrs["href"].startswith("http")]


def graduate_links(root: Node) -> list[tuple[str, str]]:
    """Anchors of cards, and those whose address has the board's marker."""
    out = []
    for x in root.walk():
        if x.tag == "section" and x.attrs.get("role") == "button":
            a = x.link()
        else:
            a = x if x.tag == "a" and "/jobs-internships/" in x.attrs.get("href", "") else None
        if a:
            out.append((a.attrs["href"], a.text()))
    return out


def content(root: Node) -> Node | None:
    """A page's main part: an article, a main element, or one that is named as content."""
    tests = [lambda x: x.tag == "article", lambda x: x.tag == "main", lambda x: bool(_CONTENT_CLASS.search(x.attrs.get("class", ""))), lambda x: x.tag == "div" and bool(_CONTENT_ID.search(x.attrs.get("id", "")))]
    return next((x for test in tests for x in root.walk() if test(x)), None)


def structure_links(pages: DataFrame, rule: str, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page, pos, job_url, job_title)`` of curated or graduate boards; relative addresses are joined with the page's host."""
    find = {"curated": curated_links, "graduate": graduate_links}[rule]
    kind = dict(pages.dtypes)[page]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, u, *a) for p, u, h in zip(f["page"], f["url"], f["html"]) for i, a in enumerate(find(tree(h)))]
            yield pd.DataFrame(rows, columns=["page", "pos", "url", "href", "title"])

    out = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, f"page {kind}, pos int, url string, href string, title string")
    full = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.array_join(F.slice(F.split("url", "/"), 1, 3), "/"), F.when(F.col("href").startswith("/"), "").otherwise("/"), F.col("href")))
    return out.select(F.col("page").alias(page), "pos", full.alias("job_url"), F.nullif("title", F.lit("")).alias("job_title"))


def page_fields(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """``(page, heading, body, requirements, full_text)``: the first heading, the main part's text, at most 1,000 characters of the element
    whose text is the first that names requirements, and all text. A missing part is null."""
    kind, wanted = dict(pages.dtypes)[page], re.compile(REQUIREMENT_HEADING, re.I)

    def fields(h):
        root = tree(h)
        h1, main = next((x for x in root.walk() if x.tag == "h1"), None), content(root)
        section = next((owner for s, owner in root.strings(scripts=True) if wanted.search(s)), None)
        return h1.text() if h1 else None, main.text(" ") if main else None, section.text()[:1000] if section else None, root.text(" ")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *[x or None for x in fields(h)]) for p, h in zip(f["page"], f["html"])], columns=["page", "heading", "body", "requirements", "full_text"])

    out = pages.select(F.col(page).alias("page"), F.col(html).alias("html")).mapInPandas(run, f"page {kind}, heading string, body string, requirements string, full_text string")
    return out.withColumnRenamed("page", page)
