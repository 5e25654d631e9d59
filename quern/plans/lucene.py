"""The query-string language: terms, "phrases", field:, AND OR NOT + -, ( ), ^boost, * ? and ranges.

Words side by side are joined by OR.  Operators are upper-case.  OR binds least, then AND, then NOT.
"""

from __future__ import annotations

import re

from quern.plans.ast import And, Boost, Exists, MatchAll, MatchNone, Node, Not, Or, Phrase, QueryError, Range, Term, Wildcard

DEEPEST = 50
_TOKEN = re.compile(
    r"""\s*(?:
    (?P<phrase>"(?:[^"\\]|\\.)*")
    |(?P<range>[\[{]\s*(?:"[^"]*"|[^\s\]}"]+)\s+TO\s+(?:"[^"]*"|[^\s\]}"]+)\s*[\]}])
    |(?P<boost>\^\s*\d+(?:\.\d+)?)
    |(?P<mark>[()]|[+\-](?=\S)|&&|\|\||!)
    |(?P<field>[A-Za-z_][\w.]*:)(?!\s|$)
    |(?P<word>(?:\\.|[^\s()"^\[\]{}\\:]|:(?!//)|:)+)
    )""",
    re.X | re.S,
)


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"cannot read the query at {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, kind: str, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == kind and (not values or self.tokens[self.at][1] in values)

    def take(self, kind: str, *values: str) -> str | None:
        if self.peek(kind, *values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def any(self, depth: int) -> Node:
        if depth > DEEPEST:
            raise QueryError("the query is nested too deeply")
        parts, required, banned = [], [], []
        while self.at < len(self.tokens) and not self.peek("mark", ")"):
            if self.take("word", "OR") or self.take("mark", "||"):
                continue
            if self.take("mark", "+"):
                required.append(self.all(depth))
            elif self.take("mark", "-"):
                banned.append(self.all(depth))
            else:
                parts.append(self.all(depth))
        if banned or required:
            must = [*required, *(() if required or not parts else [_or(parts)])]
            return And((*(must or [MatchAll()]), *map(Not, banned)))
        if not parts:
            raise QueryError("an empty query or group")
        return _or(parts)

    def all(self, depth: int) -> Node:
        parts = [self.negated(depth)]
        while self.take("word", "AND") or self.take("mark", "&&"):
            parts.append(self.negated(depth))
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negated(self, depth: int) -> Node:
        if self.take("word", "NOT") or self.take("mark", "!") or self.take("mark", "-"):
            if depth > DEEPEST:
                raise QueryError("the query is nested too deeply")
            return Not(self.negated(depth + 1))
        return self.boosted(depth)

    def boosted(self, depth: int) -> Node:
        node = self.primary(depth, None)
        if text := self.take("boost"):
            return Boost(node, float(text[1:]))
        return node

    def primary(self, depth: int, field: str | None) -> Node:
        if self.take("mark", "("):
            node = self.any(depth + 1)
            if not self.take("mark", ")"):
                raise QueryError("a ( is not closed")
            return _within(node, field) if field else node
        if (name := self.take("field")) and field is None:
            return self.primary(depth, name[:-1])
        if text := self.take("phrase"):
            return Phrase(re.sub(r"\\(.)", r"\1", text[1:-1]), field)
        if text := self.take("range"):
            if field is None:
                raise QueryError("a range needs a field")
            low, high = (x.strip().strip('"') for x in re.split(r"\s+TO\s+", text[1:-1].strip()))
            return Range(field, None if low == "*" else low, None if high == "*" else high, text[0] == "[", text[-1] == "]")
        text = self.take("word")
        if text is None or text in ("AND", "OR", "NOT"):
            raise QueryError("an operator lacks an operand")
        if text == "*":
            return Exists(field) if field else MatchAll()
        if re.search(r"(?<!\\)[*?]", text):
            return Wildcard(text, field)
        return Term(re.sub(r"\\(.)", r"\1", text), field)


def _or(parts: list[Node]) -> Node:
    return parts[0] if len(parts) == 1 else Or(tuple(parts))


def _within(node: Node, field: str) -> Node:
    """field:(...) names the field for what is inside."""
    if isinstance(node, (And, Or)):
        return type(node)(tuple(_within(x, field) for x in node.parts))
    if isinstance(node, Not):
        return Not(_within(node.part, field))
    if isinstance(node, Boost):
        return Boost(_within(node.part, field), node.factor)
    if isinstance(node, (Term, Phrase)) and node.field is None:
        return type(node)(node.text, field)
    if isinstance(node, Wildcard) and node.field is None:
        return Wildcard(node.pattern, field)
    return node


def parse(text: str) -> Node:
    """The tree of a query string.  An empty one matches nothing; bad syntax raises QueryError."""
    if not text.strip():
        return MatchNone()
    p = _Parser(text)
    node = p.any(0)
    if p.at != len(p.tokens):
        raise QueryError("a ) closes nothing")
    return node
