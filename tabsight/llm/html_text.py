"""HTML extraction by layout-aware rendering.

A tree builder reads tags with one scanner, closes what HTML lets authors leave open
(paragraphs, list items, table parts, options, the head) and ignores end tags that
match nothing. A renderer walks the tree and emits all visible text: blocks start on
lines of their own, paragraphs, headings, lists and tables with a blank line around
them, list items with their marker and hanging indent, and table cells padded to
their column's width. Not visible: the head, scripts, styles, templates, noscript,
embedded objects' fallbacks, closed details and dialogs, and elements hidden by the
``hidden`` attribute or an inline ``display: none`` or ``visibility: hidden``.

Defined results: null and empty pages have empty text; unclosed comments, scripts and
styles run to the end; a ``<`` that opens no tag is text; nesting is as deep as the
page has it (no recursion); repeated rows come out alike; an empty table gives an
empty result; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLANK, UNEVEN = re.compile(r"[ \t\n\r\f]+"), re.compile(r"[\t\n\r\f]|  ")


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
IN_HEAD = _set("base link meta noscript script style template title")
UNSEEN = _set("head script style template noscript title iframe object audio video canvas datalist noembed noframes param")
SPACED = _set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset")
BLOCK = SPACED | _set("html body div article aside section nav main header footer address form center details summary dialog li dt dd "
                      "tr td th thead tbody tfoot caption figcaption hr legend option optgroup menu dir search hgroup xmp")
CLOSES_P = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                "header hgroup hr main menu nav ol p pre search section summary table ul li dt dd xmp")
HEADING = _set("h1 h2 h3 h4 h5 h6")
#: Start tag -> (open elements it closes, elements beyond which it does not look).
IMPLIED = {"li": (_set("li"), _set("ul ol menu dir table td th")), "dt": (_set("dt dd"), _set("dl table td th")), "dd": (_set("dt dd"), _set("dl table td th")),
           "option": (_set("option"), _set("select datalist table td th")), "optgroup": (_set("option optgroup"), _set("select table td th")),
           "td": (_set("td th caption"), _set("tr table")), "th": (_set("td th caption"), _set("tr table")), "tr": (_set("tr td th caption"), _set("table")),
           "thead": (_set("thead tbody tfoot tr td th caption"), _set("table")), "tbody": (_set("thead tbody tfoot tr td th caption"), _set("table")),
           "tfoot": (_set("thead tbody tfoot tr td th caption"), _set("table")), "caption": (_set("caption"), _set("table"))}
SCOPE = _set("table td th caption")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attr(self, name: str) -> str | None:
        """An attribute's value, "" if it has none; None where absent."""
        if name in self.attrs.lower():
            for m in ATTR.finditer(self.attrs):
                if m[1].lower() == name:
                    return unescape(m[2] or m[3] or m[4] or "")
        return None


class Stack(list):
    """Open elements, and how many there are of each tag: what is not open need not be looked for."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.tag] += 1

    def cut(self, k: int) -> None:
        """Close the elements from place ``k`` on."""
        for node in self[k:]:
            self.open[node.tag] -= 1
        del self[k:]

    def close(self, tags: frozenset[str], limit: frozenset[str]) -> None:
        """Close up to the outermost open element of ``tags`` above ``limit``."""
        left = sum(self.open[t] for t in tags)
        cut = None
        for k in range(len(self) - 1, 0, -1):
            if not left or self[k].tag in limit:
                break
            if self[k].tag in tags:
                cut = k
                left -= 1
        if cut is not None:
            self.cut(cut)


def parse(html: str) -> Node:
    """The page's tree."""
    root = Node("#root")
    stack, at, opened = Stack(root), 0, {}
    for_p = frozenset(["p"])
    while True:
        m = TOKEN.search(html, at)
        text = html[at:m.start() if m else len(html)]
        if text:
            if stack[-1].tag == "head" and text.strip():
                stack.cut(len(stack) - 1)
            stack[-1].kids.append(unescape(text))
        if not m:
            return root
        at = m.end()
        if m["end"]:
            tag = m["end"].lower()
            if tag == "br":
                stack[-1].kids.append(Node("br"))
                continue
            block = tag in BLOCK
            if not stack.open[tag]:
                if tag == "p" and not any(stack.open[t] for t in SCOPE):
                    stack[-1].kids.append(Node("p"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                open_ = stack[k].tag
                if open_ == tag:
                    stack.cut(k)
                    break
                # an inline end tag stays within its block, others within their table cell
                if open_ in BLOCK and not block or open_ in SCOPE and tag not in SCOPE and tag not in ("tr", "thead", "tbody", "tfoot"):
                    break
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag in ("html", "body") and tag in opened:
                continue
            opened[tag] = True
            if stack[-1].tag == "head" and tag not in IN_HEAD:
                stack.cut(len(stack) - 1)
            if tag in CLOSES_P:
                stack.close(for_p, SCOPE)
            if tag in IMPLIED:
                stack.close(*IMPLIED[tag])
            if tag in HEADING and stack[-1].tag in HEADING:
                stack.cut(len(stack) - 1)
            node = Node(tag, m["attrs"])
            stack[-1].kids.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                body = html[at:end.start() if end else len(html)]
                node.kids.append(unescape(body) if tag in ("textarea", "title") else body)
                at = end.end() if end else len(html)
            elif tag not in VOID and not (m["attrs"].endswith("/") and tag in ("svg", "path", "circle", "rect", "use", "line", "g")):
                stack.push(node)


class Lines:
    """Rendered lines with block gaps, markers and hanging indents."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.space, self.gap, self.indent, self.marker = False, 0, "", ""

    def text(self, s: str) -> None:
        if UNEVEN.search(s):
            s = BLANK.sub(" ", s)
        body = s.strip(" ")
        if s[:1] == " " and self.line:
            self.space = True
        if body:
            if self.space and self.line:
                self.line.append(" ")
            self.line.append(body)
            self.space = s[-1] == " "

    def end_line(self) -> None:
        if self.line:
            self.put("".join(self.line))
        self.line, self.space = [], False

    def put(self, s: str) -> None:
        if self.done:
            self.done += [""] * max(0, self.gap - 1)
        self.gap = 1
        indent = self.indent
        if self.marker:
            indent, self.marker = indent[:len(indent) - len(self.marker)] + self.marker, ""
        self.done.append((indent + s.replace("\xa0", " ")).rstrip())

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def result(self) -> list[str]:
        self.end_line()
        return self.done


def _seen(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether the element is displayed, and whether its own text is visible."""
    if node.tag in UNSEEN or node.tag == "dialog" and node.attr("open") is None:
        return False, False
    if node.attrs:
        if node.attr("hidden") is not None or node.tag == "input" and (node.attr("type") or "").lower() == "hidden":
            return False, False
        style = node.attr("style")
        if style:
            rules = {k.strip().lower(): v.strip().lower() for k, _, v in (r.partition(":") for r in style.replace("!important", "").split(";"))}
            if rules.get("display") == "none":
                return False, False
            if "visibility" in rules:
                visible = rules["visibility"] not in ("hidden", "collapse")
    return True, visible


def _table(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table; a cell over several columns starts in its first and widens none."""
    width: dict[int, int] = {}
    for row in rows:
        k = 0
        for lines, span in row:
            if span == 1:
                width[k] = max(width.get(k, 0), *map(len, lines), 0)
            k += span
    out = []
    for row in rows:
        for n in range(max((len(lines) for lines, _ in row), default=0)):
            k, line = 0, ""
            for lines, span in row:
                full = sum(width.get(c, 0) for c in range(k, k + span)) + 2 * (span - 1)
                line += (lines[n] if n < len(lines) else "").ljust(full) + "  "
                k += span
            out.append(line.rstrip())
    return out


def render(root: Node) -> str:
    """All visible text of a tree."""
    page = Lines()
    out, lists, tables = [page], [], []  # writers, open lists as [kind, next number], open tables as rows
    todo: list[tuple[Node | str | None, Node | None, bool, bool, object]] = [(root, None, True, False, None)]
    while todo:
        node, leave, visible, pre, state = todo.pop()
        w = out[-1]
        if leave is not None:
            tag = leave.tag
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                w.block(2 if not lists else 1)
            elif tag in ("li", "dd", "blockquote"):
                w.end_line()
                w.indent, w.marker = state
                w.block(1 if tag != "blockquote" else 2)
            elif tag in ("td", "th") and state:
                out.pop()
                try:
                    span = max(1, min(1000, int(leave.attr("colspan") or 1)))
                except ValueError:
                    span = 1
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((w.result() or [""], span))
            elif tag == "table":
                rows = tables.pop()
                w.block(2)
                for line in _table(rows):
                    w.put(line)
                w.block(2)
            elif tag == "q":
                w.text("”")
            elif tag in BLOCK:
                w.block(2 if tag in SPACED else 1)
            continue
        if isinstance(node, str):
            if not visible:
                continue
            if pre:
                first, *more = node.replace("\r\n", "\n").split("\n")
                w.line.append(first)
                for s in more:
                    w.put("".join(w.line))
                    w.line = [s]
            else:
                w.text(node)
            continue
        shown, visible = _seen(node, visible)
        if not shown:
            continue
        tag = node.tag
        if tag == "br":
            if w.line:
                w.end_line()
            else:
                w.gap = max(w.gap, 2)
            continue
        if tag == "input" and visible and (node.attr("type") or "").lower() in ("submit", "button", "reset"):
            w.text(node.attr("value") or "")
        kept: object = None
        if tag in ("ul", "ol", "menu", "dir"):
            w.block(2 if not lists else 1)
            try:
                lists.append([tag, int(node.attr("start") or 1)])
            except ValueError:
                lists.append([tag, 1])
        elif tag in ("li", "dd", "blockquote"):
            w.block(1 if tag != "blockquote" else 2)
            kept = (w.indent, "")
            marker = ""
            if tag == "li":
                marker = "- "
                if lists and lists[-1][0] == "ol":
                    marker, lists[-1][1] = f"{lists[-1][1]}. ", lists[-1][1] + 1
            if w.marker:  # an item that starts with a list: its own marker stands alone
                w.put("")
                kept = (w.indent, "")
            w.indent += " " * (len(marker) or 2)
            w.marker = marker if visible else ""
        elif tag == "table":
            w.block(2)
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            out.append(Lines())
            kept = True
        elif tag == "q":
            w.text("“")
        elif tag in BLOCK:
            w.block(2 if tag in SPACED else 1)
        pre = pre or tag in ("pre", "textarea", "xmp")
        kids = node.kids
        if tag == "details" and node.attr("open") is None:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        if tag == "pre" and kids and isinstance(kids[0], str) and kids[0][:1] == "\n":
            kids = [kids[0][1:], *kids[1:]]
        todo.append((None, node, visible, pre, kept))
        todo += [(k, None, visible, pre, None) for k in reversed(kids)]
    lines = page.result()
    return "\n".join(lines).strip("\n")


def html_text(html: str) -> str:
    """The visible text of one page."""
    return render(parse(html))


def extracted(html: str = "html") -> Column:
    """The visible text of a column of pages."""
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([html_text(x) for x in s], dtype=object)
    return extract(F.coalesce(F.col(html).cast("string"), F.lit("")))


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with a column of their visible text."""
    return pages.withColumn(text, extracted(html))
