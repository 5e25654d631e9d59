"""Operators on a five-row fixture with known numbers, the parsers, and the driver-side rules."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import ranking
from quern.functions.text import code_tokens, html_strip, wikitext_strip
from quern.operators import graph
from quern.operators.aggregations import aggregate
from quern.operators.vectors import embed_text
from quern.plans import es, lucene
from quern.plans.ast import And, Boost, MatchNone, Not, Or, Phrase, QueryError, Range, Term, Terms, Wildcard
from quern.plans.search import Collection, matches, search
from quern.sources import catalog, collection, pipelines
from quern.sources.schema import Schema


@pytest.fixture(scope="module")
def items(spark):
    day = lambda m, d: datetime(2025, m, d)
    rows = [
        ("1", "Alpha item", "Body one", 10, day(1, 15), "electronics", 99.99), ("2", "Beta item", "Body two", 20, day(1, 16), "electronics", 149.50),
        ("3", "Gamma item", "Body three", 30, day(2, 10), "books", 12.99), ("4", "Delta item", "Body four", 40, day(2, 20), "books", 24.99), ("5", "Epsilon item", "Body five", 50, day(3, 1), "clothing", 59.99),
    ]
    df = spark.createDataFrame(rows, "id string, title string, body string, count bigint, created_at timestamp, category string, price double")
    return Collection(df, "id", {"title": "default", "body": "default", "category": "raw"})


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_metrics(items):
    m = matches(items, Term("item"))
    out = aggregate(items, m, {"c": {"type": "count"}, "s": {"type": "sum", "field": "count"}, "a": {"type": "avg", "field": "count"}, "x": {"type": "stats", "field": "count"}, "p": {"type": "percentiles", "field": "count", "percents": [50, 99]}, "t": {"type": "max", "field": "title"}})
    assert _rows(out["c"]) == [(5,)] and _rows(out["s"]) == [(150.0,)] and _rows(out["a"]) == [(30.0,)]
    assert _rows(out["x"]) == [(5, 10.0, 50.0, 150.0, 30.0)] and _rows(out["t"]) == [(0.0,)]
    assert out["p"].first()[0] == 30.0 and out["p"].first()[1] == pytest.approx(49.6)


def test_buckets(items):
    specs = {
        "cat": {"type": "terms", "field": "category"}, "h": {"type": "histogram", "field": "count", "interval": 20}, "d": {"type": "date_histogram", "field": "created_at", "interval": "month"},
        "r": {"type": "range", "field": "price", "ranges": [{"key": "low", "to": 25}, {"key": "mid", "from": 25, "to": 100}, {"key": "high", "from": 100}]},
        "f": {"type": "filter", "query": Terms("category", ("electronics",))},
    }
    out = aggregate(items, items.df, specs)
    assert _rows(out["cat"]) == [("books", 2), ("electronics", 2), ("clothing", 1)]
    assert dict(_rows(out["h"])) == {0.0: 1, 20.0: 2, 40.0: 2}
    assert sorted(n for _, n in _rows(out["d"])) == [1, 2, 2]
    assert _rows(out["r"]) == [("low", 2), ("mid", 2), ("high", 1)] and _rows(out["f"]) == [("filter", 2)]
    with pytest.raises(QueryError):
        aggregate(items, items.df, {"x": {"type": "sum", "field": "nothing"}})


def test_search(items):
    ids = lambda q: sorted(r["id"] for r in matches(items, lucene.parse(q)).select("id").collect())
    assert ids("item AND alpha") == ["1"] and ids("alpha beta") == ["1", "2"] and ids('"body three"') == ["3"]
    assert ids("count:[20 TO 40]") == ["2", "3", "4"] and ids("count:{20 TO *]") == ["3", "4", "5"] and ids("category:books") == ["3", "4"]
    assert ids("NOT item") == [] and ids("item -alpha -title:beta") == ["3", "4", "5"] and ids("alp*") == ["1"] and ids("") == [] and ids("*") == list("12345")
    assert ids("title:(alpha OR gamma)^2") == ["1", "3"] and ids("price:*") == list("12345") and ids("created_at:[2025-02-01 TO 2025-02-28]") == ["3", "4"]
    with pytest.raises(QueryError):
        matches(items, lucene.parse("nofield:x"))
    page = search(items, lucene.parse("item"), limit=2, offset=1)
    assert [r["id"] for r in page.collect()] == ["2", "3"]
    assert matches(items, Term("item"), ["nothing"]).count() == 0


def test_lucene_trees():
    assert lucene.parse("a b") == Or((Term("a"), Term("b"))) and lucene.parse("a AND b OR c") == Or((And((Term("a"), Term("b"))), Term("c")))
    assert lucene.parse('f:"x y"^2') == Boost(Phrase("x y", "f"), 2.0) and lucene.parse("NOT f:a*") == Not(Wildcard("a*", "f")) and lucene.parse("n:[1 TO 5}") == Range("n", "1", "5", True, False)
    assert lucene.parse(" ") == MatchNone()
    for bad in ("(a", "a)", "AND", "a AND", "[1 TO 2]", "(" * 60 + "a" + ")" * 60):
        with pytest.raises(QueryError):
            lucene.parse(bad)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_parser_never_breaks(text):
    try:
        lucene.parse(text)
    except QueryError:
        pass


def test_es():
    assert es.query({"match": {"t": "a b"}}) == Or((Term("a", "t"), Term("b", "t"))) and es.query({"match": {"t": "a b"}}, True) == Phrase("a b", "t")
    assert es.query({"bool": {"must": [{"term": {"x": 1}}], "must_not": [{"ids": {"values": ["1"]}}]}}) == And((Terms("x", (1,)), Not(Terms("id", ("1",)))))
    for bad in ({"range": {"x": {}}}, {"what": {}}, {"a": 1, "b": 2}):
        with pytest.raises(QueryError):
            es.query(bad)
    assert es.response([{"id": "1", "score": 2.0, "t": "x"}], 7)["hits"]["total"]["value"] == 7


def test_text_functions(spark):
    one = lambda f, text: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(code_tokens, "XMLParser getUser_name2 a-b") == ["xml", "parser", "get", "user", "name", "2", "a", "b"]
    assert one(html_strip, "a<b>c</b>d > e < f") == "acd  e " and one(html_strip, "<<x>y") == "y"
    assert one(wikitext_strip, "== H ==\n'''b''' [[a|c]] {{t|{{u}}}}<ref>r</ref> [http://x y]") == "H\nb c  y"


def test_ranking(spark):
    v = lambda c: spark.range(1).select(c).first()[0]
    assert ranking.duration("2h") == 7200 and ranking.duration("3") == 3 * 86_400
    assert v(ranking.decay("exponential", F.lit(86_400), 86_400, 0.5)) == pytest.approx(0.5) and v(ranking.decay("linear", F.lit(5e9), 86_400)) == 0.0 and v(ranking.decay("gauss", F.lit(-5), 86_400)) == 1.0
    f = lambda text: v(ranking.ScoreFunction(text).column(F.lit(2.0), {"id": "bigint"}))
    assert f("_score * 1.5 + 1") == 4.0 and f("_score / 0") == 0.0 and f("_score * (") == 2.0 and f("nothing + id") == 0.0 and f("log(0)") == 2.0 and f("1 - 2 - 3") == -4.0
    assert sum(x * x for x in embed_text("a b")) == pytest.approx(1.0) and embed_text(None) is None and set(embed_text("")) == {0.0}


def test_writes(spark):
    old = spark.createDataFrame([("1", 1, "a"), ("2", 2, "b")], "id string, seq int, v string")
    new = spark.createDataFrame([("2", 3, "c"), ("2", 4, "d"), ("3", 5, "e")], "id string, seq int, v string")
    assert sorted(_rows(collection.upsert(old, new).select("id", "v"))) == [("1", "a"), ("2", "d"), ("3", "e")]
    assert sorted(_rows(collection.delete(old, new).select("id"))) == [("1",)]
    lines = [(0, '{"index":{"_id":"7"}}'), (1, '{"delete":{"x":1}}'), (2, '{"delete":{"_id":"8"}}'), (3, '{"create":{}}'), (4, "{}"), (5, '{"index":{"_index":"a*"}}'), (6, "{}")]
    got = {r["seq"]: r for r in collection.bulk(spark.createDataFrame(lines, "line long, value string")).collect()}
    assert sorted(got) == [0, 2, 3, 5] and got[0]["id"] == "7" and got[2]["op"] == "delete" and got[3]["id"] == "auto-3" and got[5]["error"] == "wildcard index"
    schema = Schema.parse({"collection": "c", "backends": {"text": {"fields": [{"name": "n", "type": "i64"}, {"name": "u", "type": "u64"}, {"name": "d", "type": "date"}, {"name": "t", "type": "text"}]}}})
    assert schema.lint() == [] and Schema("x", []).lint() == []
    raw = spark.createDataFrame([("1", "x", "-1", "2025-01-02T03:04:05Z", "hi"), ("2", "5", "7", "1000000", None)], "id string, n string, u string, d string, t string")
    assert [(r["n"], r["u"] and int(r["u"]), r["d"]) for r in collection.coerce(raw, schema).orderBy("id").collect()] == [(None, None, datetime(2025, 1, 2, 3, 4, 5)), (5, 7, datetime(1970, 1, 1, 0, 0, 1))]


def test_pipelines(spark):
    df = spark.createDataFrame([("A", "<b>x"), (None, "y")], "t string, h string")
    out = pipelines.run(df, [{"lowercase": {"field": "t"}}, {"html_strip": {"field": "h"}}, {"rename": {"from": "h", "to": "g"}}]).collect()
    assert (out[0]["t"], out[0]["g"], out[0]["_error"]) == ("a", "x", None) and out[1]["_error"].startswith("lowercase")


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "k", 1.0), ("b", "c", "k", 1.0), ("a", "c", "k", 5.0), ("c", "a", "z", 1.0)], "src string, dst string, edge_type string, weight double")
    assert graph.shortest_path(e, "a", "c") == ["a", "b", "c"] and graph.shortest_path(e, "b", "q") is None and graph.shortest_path(e, "a", "a") == ["a"]
    assert sorted(_rows(graph.bfs(e, spark.createDataFrame([("a",)], "id string"), 3, "k"))) == [("b", 1), ("c", 1)]
    with pytest.raises(QueryError):
        graph.add_edges(e, e, ["k"])


def test_catalog():
    assert catalog.rollover_name("logs", "2025.01.02") == "logs-2025.01.02-000001" and catalog.rollover_name("logs-2025.01.02-000009", "2025.01.03") == "logs-2025.01.03-000010"
    assert catalog.rollover_reasons({"max_docs": 5, "max_age": 10}, size=0, documents=5, age=1) == ["max_docs"]
    assert catalog.next_phase({"warm": 1, "cold": 5}, "hot", 6) == "warm" and catalog.next_phase({"warm": 1, "cold": 5}, "warm", 2) is None
    t = [{"name": "a", "patterns": ["logs-*"], "priority": 1}, {"name": "b", "patterns": ["logs-?"], "priority": 5}]
    assert catalog.template_for(t, "logs-1")["name"] == "b" and catalog.template_for(t, "logs-12")["name"] == "a" and catalog.template_for(t, "x") is None
    assert collection.expand(["a1", "a2", "b"], "a*") == ["a1", "a2"]
