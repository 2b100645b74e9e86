"""HTML help pages as Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

UNTITLED = "Без названия"
# What is dropped, what holds the content, what HTML never closes.
DROPPED = frozenset(("script", "style", "noscript"))
CHROME = re.compile(r"nav|menu|sidebar|footer|header")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
PARAGRAPHS = frozenset(("p", "div", "section", "article", "main", "body", "table", "ul", "ol", "dl", "blockquote", "form", "header", "footer", "nav", "aside", "pre", "figure"))
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Tree(HTMLParser):
    """Elements as [tag, class, children]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", "", []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closes = CLOSED_BY.get(tag, {"p"} if tag in PARAGRAPHS or re.fullmatch("h[1-6]", tag) else set())
        if self.open[-1][0] in closes:
            self.open.pop()
        node = [tag, dict(attrs).get("class") or "", []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def walk(node: list) -> Iterator[list]:
    """The elements of a tree in document order."""
    stack = [node]
    while stack:
        item = stack.pop()
        yield item
        stack += [c for c in reversed(item[2]) if not isinstance(c, str)]


def dropped(node: list) -> bool:
    return node[0] in DROPPED or any(CHROME.search(c) for c in node[1].split())


def plain(node: list) -> str:
    parts, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item[0] not in DROPPED:
            stack += reversed(item[2])
    return "".join(parts)


def markdown(node: list) -> str:
    """Headings with #, bullets with -, links as their text; at most one blank line in a row."""
    out: list[str] = []
    lists: list[list] = []
    stack: list = [node]
    while stack:
        item = stack.pop()
        if callable(item):
            item()
        elif isinstance(item, str):
            out.append(item if any(x == ["pre"] for x in lists) else re.sub(r"\s+", " ", item))
        elif not dropped(item):
            tag, children = item[0], list(reversed(item[2]))
            before, after = "", ""
            if re.fullmatch("h[1-6]", tag):
                before, after = f"\n\n{'#' * int(tag[1])} ", "\n\n"
            elif tag in ("b", "strong"):
                before = after = "**"
            elif tag in ("i", "em"):
                before = after = "*"
            elif tag == "code":
                before = after = "`"
            elif tag == "br":
                before = "\n"
            elif tag == "hr":
                before = "\n\n---\n\n"
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 0]
                kind[1:] = [kind[1] + 1 if len(kind) > 1 else 1]
                depth = max(0, sum(x[0] in ("ul", "ol") for x in lists) - 1)
                before = "\n" + "  " * depth + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
            elif tag == "tr":
                before, after = "\n|", ""
            elif tag in ("td", "th"):
                before, after = " ", " |"
            elif tag == "pre":
                before, after = "\n\n```\n", "\n```\n\n"
            elif tag in PARAGRAPHS:
                before, after = ("\n" if lists and tag in ("ul", "ol") else "\n\n"), "\n\n" if not lists else ""
            if tag in ("ul", "ol", "pre"):
                lists.append([tag] if tag == "pre" else [tag, 0])
                stack.append(lists.pop)
            out.append(before)
            stack.append(lambda text=after: out.append(text))
            stack += children
    text = "".join(out)
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+(?![-0-9 ])", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def page(source: str) -> tuple[str, str]:
    """Title and Markdown of a page: of main, else article, else body, else all of it."""
    tree = Tree()
    tree.feed(source)
    tree.close()
    nodes = [n for n in walk(tree.root)]
    first = lambda tag: next((n for n in nodes if n[0] == tag), None)
    title = ""
    for tag in ("title", "h1"):
        if not title and (found := first(tag)) is not None:
            title = plain(found).strip()
    body = first("main") or first("article") or first("body") or tree.root
    return title or UNTITLED, markdown(body)


def help_rows(rows: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """keys, title, content of each page."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [page(x or "") for x in frame[html]]
            yield frame[keys].assign(title=[t for t, _ in found], content=[c for _, c in found])

    return rows.select(*keys, html).mapInPandas(run, f"{schema}, title string, content string")
