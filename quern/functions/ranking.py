"""Decay curves, boosts and the score-function language, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}


def duration(text: str) -> float:
    """Seconds of "7d", "12h", ...; a bare number counts days."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhdw]?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return float(m[1]) * UNITS[m[2] or "d"]


def decay(kind: str, age: Column, scale: float, rate: float = 0.5, offset: float = 0.0) -> Column:
    """Factor from 1 down for an age in seconds.  Future ages and ages up to ``offset`` give 1, and so
    does a scale that is not positive.  Unknown kinds are exponential."""
    if scale <= 0:
        return F.lit(1.0)
    x = (F.greatest(age.cast("double"), F.lit(0.0)) - offset) / scale
    if kind == "linear":
        curve = F.greatest(F.lit(0.0), 1 - x)
    elif kind in ("gauss", "gaussian"):
        curve = F.exp(F.lit(-0.5) * x * x * F.abs(F.log(F.lit(rate))))
    else:
        curve = F.pow(F.lit(rate), x)
    return F.when(x <= 0, 1.0).otherwise(curve)


def request_decay(kind: str, age: Column, scale: float, rate: float = 0.5, offset: float = 86_400.0) -> Column:
    """The other family, applied when a request asks for recency: exp(-rate x), linear, exp(-x^2)."""
    x = (F.greatest(age.cast("double"), F.lit(0.0)) - offset) / scale
    curve = F.greatest(F.lit(0.0), 1 - x) if kind == "linear" else F.exp(-x * x) if kind in ("gauss", "gaussian") else F.exp(F.lit(-rate) * x)
    return F.when(x <= 0, 1.0).otherwise(curve)


def context_boost(context: dict[str, str], boost: float = 1.5) -> Column:
    """``boost`` for each column that equals the request's value, multiplied."""
    out = F.lit(1.0)
    for column, value in context.items():
        out = out * F.when(F.col(column).cast("string") == value, boost).otherwise(1.0)
    return out


class ScoreFunction:
    """expr: term ((+|-) term)*, term: factor ((*|/) factor)*, factor: number, name, log(expr), (expr).

    ``_score`` is the score; a missing, null or non-numeric field is 0; x / 0 is 0; a result that is not
    finite, or a text that does not parse, leaves the score as it is."""

    _TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|([A-Za-z_][\w.]*)|(.))", re.S)
    DEPTH = 50

    def __init__(self, text: str):
        self.tokens = [m.group(1, 2, 3) for m in self._TOKEN.finditer(text.strip())]

    def column(self, score: Column, fields: dict[str, str]) -> Column:
        """fields: columns by type name."""
        self.at, self.depth = 0, 0
        try:
            value = self._sum(score, fields)
            if self.at != len(self.tokens):
                raise ValueError("more text")
        except (ValueError, IndexError):
            return score
        bad = F.isnan(value) | (F.abs(value) == float("inf")) | value.isNull()
        return F.when(bad, score).otherwise(value)

    def _next(self, *chars: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][2] in chars:
            self.at += 1
            return self.tokens[self.at - 1][2]
        return None

    def _sum(self, score, fields):
        out = self._product(score, fields)
        while op := self._next("+", "-"):
            other = self._product(score, fields)
            out = out + other if op == "+" else out - other
        return out

    def _product(self, score, fields):
        out = self._factor(score, fields)
        while op := self._next("*", "/"):
            other = self._factor(score, fields)
            out = out * other if op == "*" else F.when(other == 0, 0.0).otherwise(out / other)
        return out

    def _factor(self, score, fields):
        self.depth += 1
        if self.depth > self.DEPTH:
            raise ValueError("too deep")
        number, name, _ = self.tokens[self.at]
        if number:
            self.at += 1
            out = F.lit(float(number))
        elif name == "log" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][2] == "(":
            self.at += 2
            inner = self._sum(score, fields)
            if not self._next(")"):
                raise ValueError("no )")
            out = F.when(inner > 0, F.log(inner))
        elif name:
            self.at += 1
            numeric = fields.get(name, "") in ("tinyint", "smallint", "int", "bigint", "float", "double") or fields.get(name, "").startswith("decimal")
            out = score if name == "_score" else F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if numeric else F.lit(0.0)
        elif self._next("("):
            out = self._sum(score, fields)
            if not self._next(")"):
                raise ValueError("no )")
        else:
            raise ValueError("no factor")
        self.depth -= 1
        return out
