"""Layout-aware text of HTML pages.

A tree is built with the end tags that HTML implies, that of a head among them; a walk over it then emits all visible text:
blocks on lines of their own, a blank line around paragraphs, headings, lists and tables, list
items with markers and indentation, preformatted text as it is, and table cells in aligned columns.

Defined results: a null or empty html gives an empty text; markup that is cut off counts as text
where it isn't a tag; unmatched end tags are left out; a null page_id is kept; repeated rows are
each rendered. Tables are rendered from the innermost outwards, however deep they stand; cells keep
their column beside others that span several columns or rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_frames, text_of


@dataclass(frozen=True)
class Settings:
    gap: str = "  "


# What HTML says of its elements.
HEAD = frozenset(("base", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
UNSEEN = frozenset(("head", "script", "style", "title", "template", "noscript", "iframe", "noembed", "noframes", "datalist", "object", "audio", "video", "canvas", "meta", "link"))
SPACED = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "menu", "dl", "table", "pre", "blockquote", "figure", "hr"))
BLOCKS = SPACED | frozenset(("html", "body", "div", "section", "article", "aside", "nav", "header", "footer", "main", "address", "form", "fieldset", "legend", "details", "summary", "li", "dt", "dd", "tr", "caption", "figcaption", "center", "dir", "thead", "tbody", "tfoot", "td", "th", "option", "optgroup"))
#: A start tag closes the nearest of the first names, unless one of the second stands in between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
CLOSE_P = (BLOCKS - {"td", "th", "tr", "li", "dt", "dd", "caption", "thead", "tbody", "tfoot", "option", "optgroup", "html", "body", "legend"}) | {"li", "dt", "dd"}
P_SCOPE = frozenset(("td", "th", "table", "caption", "button", "object", "body", "html", "li"))
NOTES = r"<!--(?:>|->|.*?(?:-->|\Z))|<[!?][^>]*+>"
MARKUP = re.compile(NOTES + r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
#: The same where quotes don't count.
UNQUOTED = re.compile(NOTES + r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>()()()", re.S)
BLANKS = re.compile(r"[ \t\n\r\f]+")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    """seen: whether its own text is visible, lines: its rendered lines if it is a table; both known after `tables`."""

    __slots__ = ("attributes", "children", "lines", "seen", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.lines, self.seen = tag, attributes, [], None, True

    def attribute(self, name: str) -> str | None:
        for key, value in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(value.strip("\"'"))
        return None

    def number(self, name: str, most: int) -> int:
        """An attribute that counts from 1."""
        found = self.attribute(name) if name in self.attributes.lower() else None
        return max(1, min(most, int(found))) if found and re.fullmatch(r"[0-9]{1,9}", found.strip()) else 1

    @property
    def shown(self) -> bool:
        if self.tag in UNSEEN:
            return False
        if not self.attributes or not self.attributes.strip(" /"):
            return True
        if "hidden" in self.attributes.lower() and self.attribute("hidden") is not None:
            return False
        return not ("style" in self.attributes.lower() and NOT_SHOWN.search(self.attribute("style") or ""))

    def visibility(self, inherited: bool) -> bool:
        found = VISIBILITY.findall(self.attribute("style") or "") if "visibility" in self.attributes.lower() else []
        return found[-1].lower() == "visible" if found else inherited


class Open:
    """The elements that are open, and where those of each tag stand, so that the nearest of a tag is found at once."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], defaultdict(list)

    @property
    def last(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def nearest(self, names) -> int:
        """The place of the last one opened of these tags; 0 (the root's) if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.at[self.nodes.pop().tag].pop()


def tree(source: str) -> Node:
    """The elements of a page. Strings among the children are text as written, entities and all.

    After a tag whose quotes are never closed they don't count any more, and behind the last `>` only comments
    are looked for: each character is passed a fixed number of times, whatever a page leaves open.
    """
    root = Node("html")
    open_ = Open(root)
    at, last, markup = 0, source.rfind(">") + 1, MARKUP
    while m := markup.search(source, at, last):
        if m.group(5):
            markup = UNQUOTED
        if m.start() > at:
            _text(open_, source[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            if source.startswith("<!--", m.start()) and not source.endswith("-->", m.start(), at):
                at = len(source)  # a comment that nothing closes
            continue
        tag, ends = name.lower(), m.group(1) or m.group(4)
        if ends:
            _end(open_, tag)
            continue
        attributes = m.group(3) if m.group(2) else m.group(6)
        _imply(open_, tag)
        node = Node(tag, attributes)
        open_.last.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            node.children.append(source[at : close.start() if close else len(source)])
            at = close.end() if close else len(source)
        elif tag not in VOID:
            open_.push(node)
    comment = source.find("<!--", at)
    if at < len(source) and comment != at:
        _text(open_, source[at : comment if comment > at else len(source)])
    return root


def _text(open_: Open, text: str) -> None:
    """Adds text where it stands; other than blanks it ends an open head."""
    if open_.last.tag == "head" and text.strip(" \t\n\r\f"):
        open_.cut(len(open_.nodes) - 1)
    open_.last.children.append(text)


def _imply(open_: Open, tag: str) -> None:
    if tag not in HEAD:
        # what a template or noscript in a head holds stays theirs
        _close(open_, {"head"}, {"template", "noscript"})
    if tag in CLOSE_P:
        _close(open_, {"p"}, P_SCOPE)
    if tag in IMPLIED:
        _close(open_, *IMPLIED[tag])


def _close(open_: Open, names: set[str], until: set[str] | frozenset[str]) -> None:
    place = open_.nearest(names)
    if place > open_.nearest(until):
        open_.cut(place)


def _end(open_: Open, tag: str) -> None:
    if tag == "br":
        open_.last.children.append(Node("br"))
        return
    edge = {"td", "th", "table", "caption"} if tag not in {"table", "tr", "thead", "tbody", "tfoot", "body", "html"} else {"table"}
    place = open_.nearest({tag})
    if place and place >= open_.nearest(edge):
        open_.cut(place)


class Page:
    """Lines of text as they are emitted; `fresh` holds words of the line at hand."""

    def __init__(self):
        self.lines: list[str] = []
        self.fresh: list[str] = []
        self.blank = False
        self.indents: list[str] = []
        self.marker = ""

    def words(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if text == " " and not self.fresh:
            return
        self.fresh.append(text)

    def line(self, keep: bool = False) -> None:
        """Ends the line at hand; one without text isn't emitted, unless it is to be kept."""
        text = "".join(self.fresh)
        text = text if keep else BLANKS.sub(" ", text).strip(" ")
        self.fresh = []
        if text or keep:
            self.put(text)

    def put(self, text: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        indent = "".join(self.indents)
        if self.marker:
            indent = indent[: len(indent) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((indent + text).rstrip())

    def space(self) -> None:
        self.line()
        self.blank = True


def rendered(source: str, s: Settings | None = None) -> str:
    s, root = s or Settings(), tree(source)
    for table in reversed(tables(root)):
        table.lines = _table(table, s)
    page = Page()
    _walk(root, page)
    page.line()
    return "\n".join(page.lines)


def tables(root: Node) -> list[Node]:
    """The tables that are shown, outer ones before those in them; notes of each element whether its text is seen."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "table":
            found.append(node)
        for child in node.children:
            if isinstance(child, Node) and child.shown:
                child.seen = child.visibility(node.seen)
                stack.append(child)
    return found


def _walk(root: Node, page: Page) -> None:
    """Emits a subtree. The stack holds what is still to do: strings, nodes, and steps for when a node ends."""
    stack: list = [(root, False)]
    lists: list[list] = []
    while stack:
        item, pre = stack.pop()
        if callable(item):
            item()
        elif isinstance(item, str):
            text = html.unescape(item)
            if pre:
                first, *rest = text.replace("\r\n", "\n").split("\n")
                page.fresh.append(first)
                for x in rest:
                    page.line(keep=True)
                    page.fresh.append(x)
            else:
                page.words(text)
        elif item.shown:
            _enter(item, pre, stack, lists, page)


def _enter(node: Node, pre: bool, stack: list, lists: list[list], page: Page) -> None:
    tag = node.tag
    if tag == "br":
        page.line(keep=bool(page.fresh) or pre)
        return
    if node.lines is not None:
        page.space()
        for line in node.lines:
            page.put(line)
        page.space()
        return
    if tag in SPACED and not (tag in ("ul", "ol", "menu", "dl") and lists):
        page.space()
        stack.append((page.space, False))
    elif tag in BLOCKS:
        page.line()
        stack.append((page.line, False))
    if tag in ("ul", "ol", "menu", "dl"):
        first = node.attribute("start") if tag == "ol" else None
        lists.append([tag, int(first) if first and re.fullmatch(r"-?[0-9]{1,9}", first) else 1])
        stack.append((lists.pop, False))
    if tag == "li":
        kind = lists[-1] if lists else ["ul", 1]
        marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
        kind[1] += 1
        _indent(page, stack, " " * len(marker))
        page.marker = marker
        stack.append((lambda: setattr(page, "marker", ""), False))
        stack.append((page.line, False))
    elif tag in ("dd", "blockquote"):
        _indent(page, stack, "    " if tag == "dd" else "  ")
        stack.append((page.line, False))
    if tag == "pre":
        pre = True
        if node.children and isinstance(node.children[0], str) and node.children[0][:1] == "\n":
            node.children[0] = node.children[0][1:]
        stack.append((lambda: page.line(keep=bool("".join(page.fresh).strip())), False))
    stack += [(c, pre) for c in reversed(node.children) if node.seen or isinstance(c, Node)]


def _indent(page: Page, stack: list, by: str) -> None:
    page.indents.append(by)
    stack.append((page.indents.pop, False))


def _table(table: Node, s: Settings) -> list[str]:
    """Captions and stray text first, then rows, each column as wide as its widest cell."""
    page, rows, stack = Page(), [], [iter([(c, table.seen) for c in table.children])]
    while stack:
        node, seen = next(stack[-1], (None, False))
        if node is None:
            stack.pop()
        elif isinstance(node, str):
            if seen and node.strip():
                page.words(html.unescape(node))
                page.line()
        elif not node.shown:
            continue
        elif node.tag in ("thead", "tbody", "tfoot"):
            stack.append(iter([(c, node.seen) for c in node.children]))
        elif node.tag == "tr":
            rows.append([_cell(c, node.seen) for c in node.children if isinstance(c, Node) and c.shown or isinstance(c, str) and c.strip()])
        elif node.tag in ("td", "th"):
            rows.append([_cell(node, seen)])
        else:
            _walk(node, page)
            page.line()
    _aligned(rows, page, s)
    return page.lines


def _aligned(rows: list[list[tuple[list[str], int, int]]], page: Page, s: Settings) -> None:
    """Puts rows of cells (lines, columns, rows) where their columns begin."""
    widths: dict[int, int] = {}
    taken: list[list[int]] = []  # columns from, to, and the row before which cells of rows above still take them
    placed = []
    for n, row in enumerate(rows):
        taken = [t for t in taken if t[2] > n]
        at, k, here, new = 0, 0, [], []
        for lines, columns, deep in row:
            while k < len(taken) and taken[k][0] <= at:
                at, k = max(at, taken[k][1]), k + 1
            here.append((at, columns, lines))
            if columns == 1:
                widths[at] = max(widths.get(at, 0), *map(_width, lines), 0)
            if deep > 1:
                new.append([at, at + columns, min(n + deep, len(rows))])
            at += columns
        taken = _joined(taken + new)
        placed.append(here)
    known = sorted(widths)
    for here in placed:
        for at, columns, lines in here:
            if columns > 1:
                under = known[bisect_left(known, at) : bisect_left(known, at + columns)]
                short = max(map(_width, lines), default=0) - sum(widths[c] for c in under) - len(s.gap) * max(0, len(under) - 1)
                if short > 0:
                    if not under:
                        insort(known, at)
                        widths[at] = 0
                    widths[under[-1] if under else at] += short
    starts, total = {}, 0
    for c in sorted(widths):
        starts[c] = total
        total += widths[c] + len(s.gap)
    order = sorted(starts)
    begin = lambda c: starts[order[k]] if (k := bisect_left(order, c)) < len(order) else total
    for here in placed:
        for k in range(max((len(lines) for _, _, lines in here), default=0)):
            line, wide = "", 0
            for at, _, lines in here:
                if k < len(lines):
                    line += " " * (begin(at) - wide) + lines[k]
                    wide = max(wide, begin(at)) + _width(lines[k])
            page.put(line)


def _joined(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order; neighbours that end with the same row are one, so cells that reach the end of a table cost one span."""
    out: list[list[int]] = []
    for low, high, until in sorted(spans):
        if out and out[-1][1] >= low and out[-1][2] == until:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high, until])
    return out


def _cell(node: Node | str, seen: bool) -> tuple[list[str], int, int]:
    """Lines of a cell, and how many columns and rows it takes."""
    inner = Page()
    if isinstance(node, str):
        inner.words(html.unescape(node) if seen else "")
    else:
        _walk(node, inner)
    inner.line()
    spans = isinstance(node, Node) and "span" in node.attributes.lower()
    return inner.lines, node.number("colspan", 1000) if spans else 1, node.number("rowspan", 65534) if spans else 1


def _width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def extract(pages: DataFrame, settings: Settings | None = None) -> DataFrame:
    """page_id, text, n_lines of every page."""
    s = settings or Settings()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [rendered(x, s) for x in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "text": texts, "n_lines": [t.count("\n") + bool(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of("html").alias("html"))
    return in_frames(rows, run, "page_id long, text string, n_lines long", ("page_id",))
