"""Search requests in the JSON query language, run end to end, and what a client sees of them."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import highlight
from quern.operators.aggregations import METRICS, aggregate, key_text
from quern.plans import es
from quern.plans.ast import And, Boost, Node, Or, Phrase, QueryError, Term
from quern.plans.search import Collection, matches, search, total
from quern.sources.collection import expand


def words_of(node: Node) -> list[str]:
    """The words of a query's terms and phrases that are wanted, for highlighting."""
    if isinstance(node, (And, Or)):
        return [w for p in node.parts for w in words_of(p)]
    if isinstance(node, Boost):
        return words_of(node.part)
    return node.text.split() if isinstance(node, (Term, Phrase)) else []


def _sort(spec, id_col: str) -> list[tuple[str, bool]] | None:
    """[("name", descending)] of a sort: names, or {name: order} or {name: {"order": order}}."""
    out = []
    for x in spec if isinstance(spec, list) else [spec] if spec else []:
        name, how = (x, "desc" if x == "_score" else "asc") if isinstance(x, str) else next(iter(x.items()))
        how = how.get("order", "asc") if isinstance(how, dict) else how
        out.append(({"_score": "score", "_id": id_col}.get(name, name), how == "desc"))
    return out or None


def _source(spec, columns: list[str]) -> list[str]:
    if spec is False:
        return []
    wanted = [spec] if isinstance(spec, str) else spec if isinstance(spec, list) else (spec or {}).get("includes") or ["*"]
    banned = (spec or {}).get("excludes", []) if isinstance(spec, dict) else []
    some = lambda names: {c for n in names for c in expand(columns, n)}
    return [c for c in columns if c in some(wanted) - some(banned)]


def run(c: Collection, body: dict) -> dict[str, object]:
    """Tables of a request: ``hits`` (id, score, stored columns, highlights as hl_<field>), ``total`` and ``aggs`` by
    name, nested ones as "outer>inner"."""
    asked = es.request(body)
    columns = _source(asked["source"], [x for x in c.df.columns if x not in (c.id_col, "score")])
    extra = [f for f in asked["highlight"] if f in c.types and f not in columns]
    page = search(c, asked["query"], limit=asked["limit"], offset=asked["offset"], columns=[*columns, *extra], sort=_sort(asked["sort"], c.id_col))
    words = words_of(asked["query"])
    for f in asked["highlight"]:
        if f in c.types:
            page = page.withColumn(f"hl_{f}", highlight(F.col(f), words))
    out: dict[str, object] = {"hits": page.drop(*extra), "total": total(c, asked["query"])}
    out["aggs"] = aggregate(c, matches(c, asked["query"]), asked["aggs"]) if asked["aggs"] else {}
    out["specs"] = asked["aggs"]
    return out


def _buckets(specs: dict, tables: dict[str, DataFrame], path: str = "", within: dict | None = None, rows: dict[str, list] | None = None) -> dict:
    """The aggregations part: buckets with their key, text of the key, count, metrics and nested buckets."""
    rows = rows if rows is not None else {p: [r.asDict() for r in t.collect()] for p, t in tables.items()}  # bounded by the buckets asked for
    out = {}
    for name, spec in specs.items():
        here = f"{path}>{name}" if path else name
        if spec["type"] in METRICS:
            out[name] = _metric(name, spec, rows[here][0] if rows.get(here) else {})
            continue
        key = name if path else "key"
        buckets = []
        for r in rows[here]:
            if any(r.get(k) != v for k, v in (within or {}).items()):
                continue
            bucket = {"key": r[key], "key_as_string": key_text(r[key]), "doc_count": r["doc_count"]}
            nested = spec.get("aggs", {})
            bucket |= {n: _metric(n, s, r) for n, s in nested.items() if s["type"] in METRICS}
            inner = {n: s for n, s in nested.items() if s["type"] not in METRICS}
            bucket |= _buckets(inner, tables, here, {**(within or {}), name: r[key]}, rows) if inner else {}
            buckets.append(bucket)
        if spec["type"] in ("filter", "global"):
            out[name] = {k: v for k, v in buckets[0].items() if not k.startswith("key")} if buckets else {"doc_count": 0}
        else:
            out[name] = {"buckets": buckets}
    return out


def _metric(name: str, spec: dict, row: dict) -> dict:
    if spec["type"] == "stats":
        return {k: row.get(f"{name}_{k}") for k in ("count", "min", "max", "avg", "sum")}
    if spec["type"] == "percentiles":
        return {"values": {k[len(name) + 1 :]: v for k, v in row.items() if k.startswith(f"{name}_")}}
    return {"value": row.get(name)}


def respond(c: Collection, body: dict) -> dict:
    """A request's response.  Only the page, the total and the buckets come to the driver."""
    began = time.monotonic()
    found = run(c, body)
    all_ = found["total"].first()
    hits = []
    for r in found["hits"].collect():
        row = r.asDict()
        marks = {k[3:]: [row.pop(k)] for k in list(row) if k.startswith("hl_")}
        hits.append({"id": row.pop(c.id_col), "score": row.pop("score"), **row, "highlight": {k: v for k, v in marks.items() if v[0] is not None}})
    out = es.response(hits, all_["total"], int(1000 * (time.monotonic() - began)))
    out["hits"]["max_score"] = all_["max_score"]
    if found["specs"]:
        out["aggregations"] = _buckets(found["specs"], found["aggs"])
    return out


def msearch(collections: dict[str, Collection], lines: list[str], default: str | None = None) -> list[dict]:
    """Responses of pairs of lines (header, body).  A pair that fails has an ``error`` and does not stop the rest."""
    lines = [x for x in lines if x.strip()]
    out = []
    for header, body in zip(lines[::2], [*lines[1::2], *([None] if len(lines) % 2 else [])]):
        try:
            name = (json.loads(header) or {}).get("index") or default
            names = expand(sorted(collections), name[0] if isinstance(name, list) else name or "")
            if body is None or not names:
                raise QueryError("a header without a body" if body is None else f"no such collection: {name}")
            out.append(respond(collections[names[0]], json.loads(body)) | {"status": 200})
        except (QueryError, ValueError) as e:
            out.append({"error": {"type": type(e).__name__, "reason": str(e)}, "status": 400})
    return out


_KINDS = {"bigint": "long", "int": "integer", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "date", "date": "date", "binary": "binary"}


def mapping(c: Collection) -> dict:
    """Field types as a mapping: analysed strings are text, others keywords, arrays of numbers vectors."""
    kind = lambda n, t: "text" if c.text_fields.get(n, "raw") != "raw" else "keyword" if t == "string" else "dense_vector" if t.startswith("array<") else _KINDS.get(t, "keyword")
    return {"properties": {n: {"type": kind(n, t)} for n, t in c.types.items()}}


def cat_indices(collections: dict[str, Collection]) -> DataFrame:
    """(index, health, docs) of all collections, one count each."""
    spark = next(iter(collections.values())).df.sparkSession
    return spark.createDataFrame([(n, "green", c.df.count()) for n, c in sorted(collections.items())], "index string, health string, docs long")


def health(collections: dict[str, Collection]) -> dict:
    return {"cluster_name": "quern", "status": "green", "number_of_indices": len(collections), "timed_out": False}
