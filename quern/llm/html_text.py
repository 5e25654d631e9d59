"""HTML to text by layout: a tree with implied tags, then a rendering of what is visible.

The tree builder closes what HTML lets authors leave open (paragraphs, list items, table parts,
options) and puts what stands in a wrong place where it belongs well enough for text.  The renderer
drops what is never shown (scripts, styles, elements hidden by attributes, inline styles or simple
selectors of the page's style sheets; what is visible inside an invisible element stays), collapses white
space as a browser would, starts blocks on lines of their own, leaves an empty line around
paragraphs, headings and lists, numbers or bullets list items by depth, keeps
preformatted text, and pads table cells so that columns line up, cells of several rows and columns too.
Tables are laid out from the inside out, so that no depth of nesting is too deep.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object video audio canvas svg math datalist title meta link base area param source track embed".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu dir".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: What may stand in a head; any other start tag, or text, ends it.
IN_HEAD = frozenset("title meta link base basefont bgsound script style template noscript noframes head html".split())
#: A start tag closes the nearest open element of the first set, up to the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|(!|\?|/(?=[^a-zA-Z>]))[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|/>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_AT_RULE = re.compile(r"/\*.*?(?:\*/|\Z)|@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*(?:\}|\Z))", re.S)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "style", "lines")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.style: str = attributes.get("style", "") if attributes else ""
        self.lines: list[str] = []  # of a table, once it is laid out


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for m in _ATTRIBUTE.finditer(text):
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def build(source: str) -> Node:
    """The tree of a page.  Never fails: stray end tags go, open elements close at the end."""
    root = Node("#root", {})
    stack = [root]
    opened: Counter[str] = Counter()  # by tag: deep pages are not searched for what is not open

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] += 1

    def cut(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def close(tags: set[str], until: set[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                cut(k)
                return
            if stack[k].tag in until:
                return

    def end_head() -> None:
        if opened["head"] and not opened["template"]:
            cut(next(k for k, x in enumerate(stack) if x.tag == "head"))

    def text(data: str) -> None:
        if data:
            if opened["head"] and data.strip(" \t\n\r\f"):
                end_head()
            stack[-1].children.append(html.unescape(data) if "&" in data else data)

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[4] is None:
            continue
        tag = m[4].lower()
        if m[3]:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                        break  # an end tag inside a cell does not close what is around the table
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in ENDS_P:
            close({"p"}, {"td", "th", "table", "button", "li"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("tr", "td", "th", "thead", "tbody", "tfoot"):
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(_child(stack[-1], "tr"))
            if not opened["table"]:
                continue  # parts of tables outside tables are ignored, their text stays
        if tag == "form" and stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr"):
            continue  # its cells belong to the row
        node = Node(tag, _attributes(m[5]))
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            body = source[at : end.start() if end else size]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            shut = source.find(">", end.start()) if end else -1
            at = shut + 1 if shut >= 0 else size
            continue
        push(node)
    return root


def _child(parent: Node, tag: str) -> Node:
    node = Node(tag, {})
    parent.children.append(node)
    return node


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in UNSEEN:
        return False
    if not a:
        return True
    if "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not (node.style and _last(_DISPLAY, node.style) == "none")


def _last(pattern: re.Pattern, style: str) -> str | None:
    found = pattern.findall(style)
    return found[-1].lower() if found else None


def _sheet(sheets: list[str]) -> dict[str, list[tuple[frozenset[str], str]]]:
    """Rules of one element each, by a class, id or tag that they need: (all needs, declarations)."""
    rules: dict[str, list[tuple[frozenset[str], str]]] = {}
    for text in sheets:
        if "none" not in text and "hidden" not in text and "collapse" not in text:
            continue
        for selectors, declarations in _RULE.findall(_AT_RULE.sub("", text)):
            if "display" not in declarations and "visibility" not in declarations:
                continue
            for selector in selectors.split(","):
                m = _SELECTOR.fullmatch(selector.strip())
                if m and m[0]:
                    needs = re.findall(r"[.#][\w-]+", m[2]) + ([m[1].lower()] if m[1] else [])
                    rules.setdefault(needs[0], []).append((frozenset(needs), declarations))
    return rules


def resolve(root: Node) -> list[Node]:
    """Puts style sheets' rules before inline styles, takes invisible text out, and lists all tables, outer ones first."""
    sheets, tables, todo = [], [], [root]
    while todo:
        x = todo.pop()
        if x.tag == "style":
            sheets += [c for c in x.children if isinstance(c, str)]
        elif x.tag == "table":
            tables.append(x)
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    rules = _sheet(sheets)
    hidden: list[tuple[Node, bool]] = [(root, False)]
    while hidden:
        x, unseen = hidden.pop()
        if rules:
            names = [x.tag, "*", *("." + c for c in x.attributes.get("class", "").split()), *(["#" + x.attributes["id"]] if "id" in x.attributes else [])]
            own = [d for n in names for needs, d in rules.get(n, ()) if needs <= set(names)]
            if own:
                x.style = ";".join([*own, x.style])
        if x.style and (how := _last(_VISIBILITY, x.style)) in ("hidden", "collapse", "visible"):
            unseen = how != "visible"
        if unseen:
            x.children = [c for c in x.children if isinstance(c, Node) and (c.tag not in ("img", "input", "textarea", "hr", "br") or "visible" in c.style)]
        hidden += [(c, unseen) for c in x.children if isinstance(c, Node)]
    return tables


class _Lines:
    """Lines under way: collapsed inline text, with pending breaks between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a white space waits for the next word
        self.gap = 0

    def word(self, text: str) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.space = False
        if self.space:
            self.now.append(" ")
        self.now.append(text)
        self.space = False

    def flow(self, text: str) -> None:
        words = _SPACE.split(text)
        for k, w in enumerate(words):
            if k and not (self.now and self.now[-1].endswith(" ")):  # none after a mark
                self.space = True
            if w:
                self.word(w)

    def end(self, gap: int = 1) -> None:
        """Ends the line; at least ``gap - 1`` empty lines come before the next."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def whole(self, lines: list[str]) -> None:
        """Lines that stay as they are."""
        self.end(0)
        if lines:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.lines += lines


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


def render(node: Node) -> list[str]:
    """The lines of a part of the tree whose tables have been laid out."""
    out = _Lines()
    # an explicit stack: pages may be nested deeper than Python calls
    todo: list[tuple] = [("open", node, 0)]
    while todo:
        what, x, depth = todo.pop()
        if what == "gap":
            out.end(x)
        elif what == "mark":
            out.word(x)
        elif what == "item":
            item, mark = x
            if visible(item) and item.children:
                out.end(1)
                out.word("  " * depth + mark)
                todo.append(("gap", 1, depth))
                todo += [("open", c, depth + 1) for c in reversed(item.children)]
        elif isinstance(x, str):
            out.flow(x)
        elif not visible(x):
            continue
        elif x.tag == "br":
            if out.now:
                out.end(1)
            else:
                out.lines.append("") if out.lines and out.gap < 2 else None
                out.gap = max(out.gap, 1)
        elif x.tag == "hr":
            out.end(2)
        elif x.tag == "img":
            if x.attributes.get("alt", "").strip():
                out.flow(x.attributes["alt"])
        elif x.tag == "input":
            if x.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text", "search") and x.attributes.get("value"):
                out.flow(x.attributes["value"])
        elif x.tag == "pre" or x.tag == "textarea":
            out.end(2 if x.tag == "pre" else 1)
            body = _raw_text(x)
            out.whole(body[1:].split("\n") if body.startswith("\n") else body.split("\n"))
            out.end(2 if x.tag == "pre" else 1)
        elif x.tag == "table":
            out.end(2)
            out.whole(x.lines)
            out.end(2)
        elif x.tag in ("ul", "ol", "menu", "dir"):
            gap = 1 if depth else 2
            out.end(gap)
            start = x.attributes.get("start", "1")
            number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            items: list[tuple] = []
            for c in x.children:
                if isinstance(c, Node) and c.tag == "li":
                    value = c.attributes.get("value", "")
                    number = int(value) if x.tag == "ol" and re.fullmatch(r"-?\d{1,9}", value) else number
                    items.append(("item", (c, f"{number}. " if x.tag == "ol" else "- "), depth))
                    number += 1 if visible(c) else 0
                elif isinstance(c, Node) or c.strip():
                    items.append(("open", c, depth + 1))
            todo.append(("gap", gap, depth))
            todo += reversed(items)
        elif x.tag in ("td", "th") or x.tag not in BLOCK:
            todo += [("open", c, depth) for c in reversed(x.children)]
        else:
            gap = 2 if x.tag in SPACED else 1
            out.end(gap)
            todo.append(("gap", gap, depth))
            todo += [("open", c, depth) for c in reversed(x.children)]
            if x.tag == "dd":
                todo.append(("mark", "    ", depth))
    out.end()
    return out.lines


def _raw_text(node: Node) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append("\n")
        elif visible(x):
            todo += reversed(x.children)
    return "".join(parts).replace("\r\n", "\n").replace("\r", "\n").rstrip("\n")


def _rows(table: Node) -> Iterator[list[Node]]:
    for c in table.children:
        if isinstance(c, Node) and visible(c):
            if c.tag == "tr":
                yield [d for d in c.children if isinstance(d, Node) and d.tag in ("td", "th") and visible(d)]
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(c)


def _strays(part: Node) -> Iterator[Node]:
    """What stands in rows and sections outside cells, a block for each of them."""
    for c in part.children:
        if isinstance(c, Node) and visible(c) and c.tag in ("tr", "thead", "tbody", "tfoot"):
            inside = ("td", "th") if c.tag == "tr" else ("tr", "thead", "tbody", "tfoot")
            block = Node("div", {})
            block.children = [d for d in c.children if isinstance(d, str) or d.tag not in inside]
            yield block
            if c.tag != "tr":
                yield from _strays(c)


def _span(cell: Node, name: str = "colspan") -> int:
    value = cell.attributes.get(name, "1")
    return min(max(int(value), 1), 1000) if value.isdecimal() and len(value) < 6 else 1


def _placed(rows: list[list[Node]]) -> list[list[tuple[int, list[str], int]]]:
    """Cells of each row as (column, lines, columns): those of earlier rows that reach down keep their columns."""
    out = []
    busy: dict[int, int] = {}  # column: rows below that are still taken
    for row in rows:
        placed, at, down = [], 0, {}
        for cell in row:
            while busy.get(at):
                at += 1
            span, deep = _span(cell), _span(cell, "rowspan")
            placed.append((at, render(cell) or [""], span))
            if deep > 1:
                down |= dict.fromkeys(range(at, at + span), deep - 1)
            at += span
        busy = {k: n - 1 for k, n in busy.items() if n > 1} | down
        out.append(placed)
    return out


def _table(table: Node) -> list[str]:
    """Captions and what stands outside cells, then rows of cells padded to the columns' widths; cells of several lines stack."""
    out: list[str] = []
    for c in table.children:
        if isinstance(c, str):
            if c.strip():
                out.append(_SPACE.sub(" ", c).strip())
        elif c.tag not in ("tr", "thead", "tbody", "tfoot") and visible(c):
            out += render(c)
    for block in _strays(table):
        out += render(block)
    rows = _placed(list(_rows(table)))
    widths: dict[int, int] = {}
    for row in rows:
        for at, lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), *map(_width, lines))
    for row in rows:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            at, parts = 0, []
            for place, lines, span in row:
                parts += [" " * widths.get(i, 0) for i in range(at, place)]
                room = sum(widths.get(place + i, 0) for i in range(span)) + 3 * (span - 1)
                cell = lines[k] if k < len(lines) else ""
                parts.append(cell + " " * max(0, room - _width(cell)))
                at = place + span
            out.append(" | ".join(parts).rstrip())
    return out


def to_text(source: str | None) -> str | None:
    """The visible text of a page; null stays null, an empty page has an empty text."""
    if source is None:
        return None
    root = build(source)
    for table in reversed(resolve(root)):  # inner ones first
        table.lines = _table(table)
    lines = render(root)
    while lines and not lines[-1].strip():
        lines.pop()
    return "\n".join(lines).lstrip("\n")


def extract_text(pages: DataFrame, *, html_col: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html_col`` in ``to`` (replaced if it is there).

    Null stays null; pages without visible text give an empty text; repeated rows get equal texts;
    an empty table stays empty.  Broken markup never fails."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([to_text(s) for s in sources], dtype=object)

    return pages.withColumn(to, run(F.col(html_col)))
