"""The JSON query language: queries, and aggregations as specs for ``operators.aggregations``."""

from __future__ import annotations

from quern.plans import lucene
from quern.plans.ast import And, Boost, Exists, MatchAll, MatchNone, Node, Not, Or, Phrase, QueryError, Range, Term, Terms, Wildcard

LONGEST_STRING, LARGEST_PAGE = 10_000, 10_000


def _one(body: dict) -> tuple[str, object]:
    if not isinstance(body, dict) or len(body) != 1:
        raise QueryError("expected one key")
    return next(iter(body.items()))


def _value(x, key: str):
    return (x.get(key, x.get("value")), x.get("boost", 1.0)) if isinstance(x, dict) else (x, 1.0)


def _boosted(node: Node, factor) -> Node:
    return node if factor in (None, 1, 1.0) else Boost(node, float(factor))


def _all(parts: list[Node]) -> Node:
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def query(body: dict | None, strict_reference: bool = False) -> Node:
    """The tree of a query object; none matches all.  ``strict_reference`` reads a match of several words
    as a phrase.  In a bool, ``should`` is needed even beside ``must``."""
    if not body:
        return MatchAll()
    kind, b = _one(body)
    if kind == "match_all":
        return MatchAll()
    if kind == "match_none":
        return MatchNone()
    if kind in ("match", "match_phrase"):
        parts = []
        for field, x in b.items():
            text, boost = _value(x, "query")
            whole = kind == "match_phrase" or strict_reference and len(str(text).split()) > 1
            words = str(text).split()
            operator = str(x.get("operator", "or")).lower() if isinstance(x, dict) else "or"
            if whole:
                node = Phrase(str(text), field)
            elif not words:
                node = MatchNone()
            else:
                terms = tuple(Term(w, field) for w in words)
                node = terms[0] if len(terms) == 1 else And(terms) if operator == "and" else Or(terms)
            parts.append(_boosted(node, boost))
        return _all(parts)
    if kind == "multi_match":
        words, fields = str(b.get("query", "")).split(), b.get("fields") or []
        if not words:
            return MatchNone()
        per = [_boosted(Or(tuple(Term(w, f.split("^")[0]) for w in words)), f.split("^")[1] if "^" in f else 1.0) for f in fields]
        if not per:
            return Or(tuple(Term(w) for w in words))
        return (And if str(b.get("operator", "or")).lower() == "and" else Or)(tuple(per))
    if kind == "term":
        return _all([_boosted(Terms(f, (v,)), w) for f, x in b.items() for v, w in [_value(x, "value")]])
    if kind == "terms":
        return _all([Terms(f, tuple(v)) for f, v in b.items() if f != "boost"])
    if kind == "range":
        parts = []
        for field, x in b.items():
            low, high = x.get("gte", x.get("gt")), x.get("lte", x.get("lt"))
            if low is None and high is None:
                raise QueryError("a range needs a bound")
            parts.append(Range(field, low, high, "gte" in x, "lte" in x))
        return _all(parts)
    if kind == "bool":
        listed = lambda k: [query(x, strict_reference) for x in (b.get(k) if isinstance(b.get(k), list) else [b[k]] if b.get(k) else [])]
        parts = [*listed("must"), *listed("filter")]
        if should := listed("should"):
            parts.append(should[0] if len(should) == 1 else Or(tuple(should)))
        banned = [Not(x) for x in listed("must_not")]
        if not parts:
            parts = [MatchAll()]
        return And((*parts, *banned)) if len(parts) + len(banned) > 1 else parts[0]
    if kind == "exists":
        return Exists(b["field"])
    if kind in ("query_string", "simple_query_string"):
        text = b.get("query", "")
        if len(text) > LONGEST_STRING:
            raise QueryError("the query string is too long")
        return lucene.parse(text)
    if kind in ("wildcard", "prefix"):
        field, x = _one(b)
        text, boost = _value(x, "value")
        return _boosted(Wildcard(str(text) if kind == "wildcard" else f"{text}*", field), boost)
    if kind == "ids":
        return Terms("id", tuple(b.get("values", ())))
    raise QueryError(f"unknown query: {kind}")


def aggregations(body: dict | None) -> dict[str, dict]:
    """Specs by name.  ``cardinality`` counts distinct values; ``value_count`` counts rows with a value."""
    out = {}
    for name, b in (body or {}).items():
        nested = b.get("aggs") or b.get("aggregations") or {}
        kind = next((k for k in b if k not in ("aggs", "aggregations", "meta")), None)
        if kind is None:
            raise QueryError(f"aggregation {name} has no kind")
        spec = {"type": kind, **b[kind]}
        if kind == "date_histogram":
            spec["interval"] = b[kind].get("calendar_interval") or b[kind].get("interval") or b[kind].get("fixed_interval") or "day"
        if kind == "filter":
            spec = {"type": "filter", "query": query(b[kind])}
        if kind == "filters":
            spec = {"type": "filters", "queries": {k: query(q) for k, q in b[kind]["filters"].items()}}
        if nested:
            spec["aggs"] = aggregations(nested)
        out[name] = spec
    return out


def request(body: dict) -> dict:
    """from, size, query, aggregations, highlight, sort and _source of a search request."""
    size = int(body.get("size", 10))
    if size > LARGEST_PAGE:
        raise QueryError("the page is too large")
    return {
        "query": query(body.get("query")), "offset": int(body.get("from", 0)), "limit": size, "aggs": aggregations(body.get("aggs") or body.get("aggregations")),
        "highlight": list((body.get("highlight") or {}).get("fields", {})), "sort": body.get("sort"), "source": body.get("_source"),
    }


def response(hits: list[dict], total: int, took_ms: int = 0) -> dict:
    """The envelope of a result page."""
    return {
        "took": took_ms, "timed_out": False,
        "hits": {"total": {"value": total, "relation": "eq"}, "max_score": max((h["score"] for h in hits), default=None), "hits": [{"_id": h["id"], "_score": h["score"], "_source": {k: v for k, v in h.items() if k not in ("id", "score", "highlight")}} | ({"highlight": h["highlight"]} if h.get("highlight") else {}) for h in hits]},
    }
