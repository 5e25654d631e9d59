"""Plain text of wiki markup by one scan with a stack of open brackets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

#: Links to these namespaces show nothing in the running text.
HIDDEN_NAMESPACES = ("file", "image", "category")
_MARK = re.compile(r"<!--|<(?P<tag>/?[A-Za-z][^<>]*)>|\{\{|\}\}|(?m:^)\s*\{\||\|\}|\[\[|\]\]|\[(?=https?://|//)|\]|'{2,}")
_HEADING = re.compile(r"(=+)\s*(.*?)\s*\1\s*")
_LIST = re.compile(r"[*#:;]+\s*")
_OPENS = {"{{": "}}", "{|": "|}", "[[": "]]", "[": "]"}


def plain(text: str | None, hidden: tuple[str, ...] = HIDDEN_NAMESPACES) -> str | None:
    """Templates, tables, comments and references go, nested ones too; a link leaves its last label, an external
    link its label; tags, emphasis, heading and list marks go.  What is opened and never closed stays
    as text; null stays null."""
    if text is None:
        return None
    stack: list[tuple[str, list[str]]] = [("", [])]
    at = 0
    while m := _MARK.search(text, at):
        stack[-1][1].append(text[at : m.start()])
        mark, at = m[0].strip(), m.end()
        if mark == "<!--":
            end = text.find("-->", at)
            at = len(text) if end < 0 else end + 3
        elif m["tag"] is not None:
            name = re.match(r"\w+", m["tag"])
            if name and name[0].lower() == "ref" and not m["tag"].endswith("/"):
                end = re.compile(r"</ref\s*>", re.I).search(text, at)
                at = end.end() if end else at
        elif mark in _OPENS:
            stack.append((mark, []))
        elif mark[0] != "'":
            depth = next((k for k in range(len(stack) - 1, 0, -1) if _OPENS[stack[k][0]] == mark), 0)
            if not depth:
                stack[-1][1].append(mark)
                continue
            while len(stack) > depth + 1:  # opened inside and never closed
                opened, inner = stack.pop()
                stack[-1][1].append(opened + "".join(inner))
            opened, inner = stack.pop()
            stack[-1][1].append(_shown(opened, "".join(inner), hidden))
    stack[-1][1].append(text[at:])
    while len(stack) > 1:
        opened, inner = stack.pop()
        stack[-1][1].append(opened + "".join(inner))
    lines = []
    for line in "".join(stack[0][1]).split("\n"):
        heading = _HEADING.fullmatch(line)
        lines.append(heading[2] if heading else _LIST.sub("", line, count=1) if _LIST.match(line) else line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _shown(opened: str, inner: str, hidden: tuple[str, ...]) -> str:
    if opened == "[[":
        target = inner.split("|", 1)[0]
        if target.split(":", 1)[0].strip().lower() in hidden and ":" in target:
            return ""
        return inner.rsplit("|", 1)[-1].lstrip(":")
    if opened == "[":
        return inner.partition(" ")[2].strip()
    return ""


def plain_udf(hidden: tuple[str, ...] = HIDDEN_NAMESPACES):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([plain(t, hidden) for t in texts], dtype=object)

    return run
