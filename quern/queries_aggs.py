"""Registered aggregation queries over the fact tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.aggregations import aggregate, facets
from quern.plans import es
from quern.plans.ast import MatchAll, Range, Term, Terms
from quern.operators import es_search
from quern.plans.search import Collection, matches, search
from quern.queries_search import W1, _sql, docs, read

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, table: str, id_col: str, spec: dict, sql: str, part: str = "a", node=None, columns: dict | None = None) -> None:
    """One aggregation named a over the rows that match."""

    def query(spark, sf_dir: str) -> DataFrame:
        c = Collection(read(spark, sf_dir, table), id_col, {"text": "default"} if table == "documents" else {id_col: "raw"})
        matched = matches(c, node) if node is not None else c.df
        out = aggregate(c, matched, {"a": spec})[part]
        for x, kind in out.dtypes:
            if kind == "double":
                out = out.withColumn(x, F.round(x, 4))
        return out

    QUERIES[name] = query
    SQL[name] = sql


add("agg_count", "lineitem", "l_orderkey", {"type": "count"}, "SELECT count(*) AS a FROM lineitem")
add("agg_value_count", "events", "event_id", {"type": "value_count", "field": "value"}, "SELECT count(value) AS a FROM events")
add("agg_sum", "lineitem", "l_orderkey", {"type": "sum", "field": "l_quantity"}, "SELECT round(coalesce(sum(l_quantity), 0.0), 4) AS a FROM lineitem")
add("agg_avg", "lineitem", "l_orderkey", {"type": "avg", "field": "l_discount"}, "SELECT round(coalesce(avg(l_discount), 0.0), 4) AS a FROM lineitem")
add("agg_min", "lineitem", "l_orderkey", {"type": "min", "field": "l_extendedprice"}, "SELECT round(coalesce(min(l_extendedprice), 0.0), 4) AS a FROM lineitem")
add("agg_max", "lineitem", "l_orderkey", {"type": "max", "field": "l_extendedprice"}, "SELECT round(coalesce(max(l_extendedprice), 0.0), 4) AS a FROM lineitem")
add("agg_sum_empty", "orders", "o_orderkey", {"type": "sum", "field": "o_totalprice"}, "SELECT 0.0::DOUBLE AS a", node=Range("o_orderkey", -5, -4))
add("agg_sum_text", "orders", "o_orderkey", {"type": "sum", "field": "o_orderstatus"}, "SELECT 0.0::DOUBLE AS a")
add("agg_stats", "orders", "o_orderkey", {"type": "stats", "field": "o_totalprice"}, "SELECT count(o_totalprice) AS a_count, round(min(o_totalprice), 4) AS a_min, round(max(o_totalprice), 4) AS a_max, round(sum(o_totalprice), 4) AS a_sum, round(avg(o_totalprice), 4) AS a_avg FROM orders")
add("agg_stats_empty", "orders", "o_orderkey", {"type": "stats", "field": "o_totalprice"}, "SELECT 0 AS a_count, NULL::DOUBLE AS a_min, NULL::DOUBLE AS a_max, 0.0::DOUBLE AS a_sum, NULL::DOUBLE AS a_avg", node=Range("o_orderkey", -5, -4))
_q = ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS \"a_{p}\"" for p in (1, 5, 25, 50, 75, 95, 99))
add("agg_percentiles", "events", "event_id", {"type": "percentiles", "field": "value"}, f"SELECT {_q} FROM events")
add("agg_cardinality", "events", "event_id", {"type": "cardinality", "field": "user_id"}, "SELECT count(DISTINCT user_id) AS a FROM events")
add("agg_terms", "events", "event_id", {"type": "terms", "field": "event_type"}, "SELECT event_type AS key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("agg_terms_size", "lineitem", "l_orderkey", {"type": "terms", "field": "l_suppkey", "size": 7}, "SELECT l_suppkey AS key, count(*) AS doc_count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
add("agg_terms_sub", "lineitem", "l_orderkey", {"type": "terms", "field": "l_returnflag", "aggs": {"q": {"type": "sum", "field": "l_quantity"}, "p": {"type": "avg", "field": "l_extendedprice"}}}, "SELECT l_returnflag AS key, count(*) AS doc_count, round(sum(l_quantity), 4) AS q, round(avg(l_extendedprice), 4) AS p FROM lineitem GROUP BY 1")
add(
    "agg_terms_nested", "lineitem", "l_orderkey", {"type": "terms", "field": "l_suppkey", "size": 5, "aggs": {"flag": {"type": "terms", "field": "l_returnflag", "size": 2, "aggs": {"q": {"type": "max", "field": "l_quantity"}}}}},
    """
WITH top AS (SELECT l_suppkey AS a, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
c AS (SELECT l_suppkey AS a, l_returnflag AS flag, count(*) AS doc_count, round(max(l_quantity), 4) AS q FROM lineitem WHERE l_suppkey IN (SELECT a FROM top) GROUP BY 1, 2)
SELECT a, flag, doc_count, q FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY doc_count DESC, flag) <= 2""", part="a>flag",
)
add("agg_histogram", "orders", "o_orderkey", {"type": "histogram", "field": "o_totalprice", "interval": 50000}, "SELECT floor(o_totalprice / 50000.0) * 50000.0::DOUBLE AS key, count(*) AS doc_count FROM orders GROUP BY 1")
add("agg_histogram_bounds", "lineitem", "l_orderkey", {"type": "histogram", "field": "l_quantity", "interval": 10, "extended_bounds": {"min": -20, "max": 70}}, "SELECT k * 10.0::DOUBLE AS key, count(l_quantity) AS doc_count FROM range(-2, 8) r(k) LEFT JOIN lineitem ON floor(l_quantity / 10.0) = k GROUP BY 1")
add("agg_histogram_min", "events", "event_id", {"type": "histogram", "field": "value", "interval": 25, "min_doc_count": 50}, "SELECT floor(value / 25.0) * 25.0::DOUBLE AS key, count(*) AS doc_count FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 50")
for unit in ("hour", "day", "week", "month", "year"):
    add(f"agg_date_{unit}", "events", "event_id", {"type": "date_histogram", "field": "ts", "interval": unit}, f"SELECT date_trunc('{unit}', ts)::TIMESTAMP AS key, count(*) AS doc_count FROM events GROUP BY 1")
add("agg_date_unknown", "events", "event_id", {"type": "date_histogram", "field": "ts", "interval": "1d"}, SQL["agg_date_day"])
add("agg_date_sub", "events", "event_id", {"type": "date_histogram", "field": "ts", "interval": "week", "aggs": {"v": {"type": "avg", "field": "value"}}}, "SELECT date_trunc('week', ts)::TIMESTAMP AS key, count(*) AS doc_count, round(coalesce(avg(value), 0.0), 4) AS v FROM events GROUP BY 1")
add(
    "agg_range", "lineitem", "l_orderkey", {"type": "range", "field": "l_quantity", "ranges": [{"to": 10}, {"from": 5, "to": 30}, {"from": 30}, {"key": "none", "from": 1000}]},
    """SELECT key, doc_count FROM (VALUES ('*-10', (SELECT count(*) FROM lineitem WHERE l_quantity < 10)), ('5-30', (SELECT count(*) FROM lineitem WHERE l_quantity >= 5 AND l_quantity < 30)),
('30-*', (SELECT count(*) FROM lineitem WHERE l_quantity >= 30)), ('none', 0)) v(key, doc_count)""",
)
add("agg_filter", "documents", "doc_id", {"type": "filter", "query": Terms("lang", ("en",)), "aggs": {"n": {"type": "avg", "field": "n_chars"}}}, "SELECT 'filter' AS key, count(*) AS doc_count, round(avg(n_chars), 4) AS n FROM documents WHERE lang = 'en'")
add("agg_filters", "documents", "doc_id", {"type": "filters", "queries": {"long": Range("n_chars", 3000), "french": Terms("lang", ("fr",)), "term": Term("the", "text")}}, r"""
SELECT key, doc_count FROM (VALUES ('long', (SELECT count(*) FROM documents WHERE n_chars >= 3000)), ('french', (SELECT count(*) FROM documents WHERE lang = 'fr')),
('term', (SELECT count(*) FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'the')))) v(key, doc_count)""")
add("agg_global", "documents", "doc_id", {"type": "global", "aggs": {"n": {"type": "sum", "field": "n_chars"}}}, "SELECT 'global' AS key, count(*) AS doc_count, round(sum(n_chars)::DOUBLE, 4) AS n FROM documents", node=Terms("lang", ("fr",)))
add("agg_over_query", "documents", "doc_id", {"type": "terms", "field": "lang"}, r"SELECT lang AS key, count(*) AS doc_count FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'thing') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", node=Term(W1))
add("agg_range_terms", "orders", "o_orderkey", {"type": "range", "field": "o_totalprice", "ranges": [{"key": "low", "to": 100000}, {"key": "high", "from": 100000}], "aggs": {"s": {"type": "terms", "field": "o_orderstatus"}}}, "SELECT CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'high' END AS a, o_orderstatus AS s, count(*) AS doc_count FROM orders GROUP BY 1, 2", part="a>s")

_ES = {"query": {"range": {"l_quantity": {"gte": 10}}}, "aggs": {"f": {"terms": {"field": "l_returnflag"}, "aggs": {"q": {"sum": {"field": "l_quantity"}}}}}}


def es_request(spark, sf_dir: str) -> DataFrame:
    body = es.request(_ES)
    c = Collection(read(spark, sf_dir, "lineitem"), "l_orderkey", {"l_linestatus": "raw"})
    return aggregate(c, matches(c, body["query"]), body["aggs"])["f"].withColumn("q", F.round("q", 4))


QUERIES["es_aggregation"] = es_request
SQL["es_aggregation"] = "SELECT l_returnflag AS key, count(*) AS doc_count, round(sum(l_quantity), 4) AS q FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"


def _facets(part: str, how: dict):
    def query(spark, sf_dir: str) -> DataFrame:
        c = docs(spark, sf_dir)
        out = facets(c, search(c, MatchAll(), limit=100, columns=["lang", "n_chars"]), {part: how}, ["lang", "n_chars"])[part]
        return out.select(*[F.round(x, 4).alias(x) if kind == "double" else x for x, kind in out.dtypes])

    return query


_hundred = "(SELECT * FROM documents ORDER BY doc_id LIMIT 100)"
QUERIES["facets_page"] = _facets("lang", {})
SQL["facets_page"] = f"SELECT lang AS key, count(*) AS doc_count FROM {_hundred} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
QUERIES["facets_range"] = _facets("n_chars", {"type": "range", "ranges": [{"to": 500}, {"from": 500}]})
SQL["facets_range"] = f"SELECT key, doc_count FROM (VALUES ('*-500', (SELECT count(*) FROM {_hundred} WHERE n_chars < 500)), ('500-*', (SELECT count(*) FROM {_hundred} WHERE n_chars >= 500))) v(key, doc_count)"
QUERIES["facets_stats"] = _facets("n_chars", {"type": "stats"})
SQL["facets_stats"] = f"SELECT count(n_chars) AS n_chars_count, min(n_chars)::DOUBLE AS n_chars_min, max(n_chars)::DOUBLE AS n_chars_max, sum(n_chars)::DOUBLE AS n_chars_sum, round(avg(n_chars), 4) AS n_chars_avg FROM {_hundred}"
add("agg_date_range", "events", "event_id", {"type": "date_range", "field": "ts", "ranges": [{"key": "early", "to": "2024-01-10T00:00:00Z"}, {"key": "late", "from": "2024-01-10T00:00:00Z"}]}, "SELECT CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'early' ELSE 'late' END AS key, count(*) AS doc_count FROM events GROUP BY 1")
add("agg_histogram_nested", "lineitem", "l_orderkey", {"type": "terms", "field": "l_returnflag", "aggs": {"h": {"type": "histogram", "field": "l_quantity", "interval": 10, "min_doc_count": 2000}}}, "SELECT l_returnflag AS a, floor(l_quantity / 10.0) * 10.0::DOUBLE AS h, count(*) AS doc_count FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2000", part="a>h")
add("agg_range_close", "orders", "o_orderkey", {"type": "range", "field": "o_orderkey", "ranges": [{"from": 1234567, "to": 1234568}, {"from": 1234566, "to": 1234567}, {"from": 100, "to": 200}]}, "SELECT key, doc_count FROM (VALUES ('1234567-1234568', (SELECT count(*) FROM orders WHERE o_orderkey = 1234567)), ('1234566-1234567', (SELECT count(*) FROM orders WHERE o_orderkey = 1234566)), ('100-200', (SELECT count(*) FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200))) v(key, doc_count)")
add("agg_terms_order", "events", "event_id", {"type": "terms", "field": "event_type", "order": {"_key": "asc"}, "size": 3, "min_doc_count": 1}, "SELECT event_type AS key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 1 LIMIT 3")
_PAGE = {"query": {"match": {"text": W1}}, "size": 5, "sort": [{"n_chars": "desc"}], "_source": ["lang", "n_chars"]}
QUERIES["es_page"] = lambda s, d: es_search.run(docs(s, d), _PAGE)["hits"].select("doc_id", "lang", "n_chars", F.round("score", 6).alias("score"))
SQL["es_page"] = f"SELECT doc_id, lang, n_chars, round(score, 6) AS score FROM ({_sql([W1], 'tf0 > 0', 'e0', columns='doc_id, lang, n_chars')}) ORDER BY n_chars DESC, doc_id LIMIT 5"


def _cat(spark, sf_dir: str) -> DataFrame:
    return es_search.cat_indices({t: Collection(read(spark, sf_dir, t), i, {i: "raw"}) for t, i in (("documents", "doc_id"), ("pages", "page_id"))}).select("index", "docs")


QUERIES["es_cat_indices"] = _cat
SQL["es_cat_indices"] = "SELECT 'documents' AS index, count(*) AS docs FROM documents UNION ALL SELECT 'pages', count(*) FROM pages"


def _msearch(spark, sf_dir: str) -> DataFrame:
    got = es_search.msearch({"documents": docs(spark, sf_dir)}, ['{"index": "documents"}', '{"query": {"match": {"text": "%s"}}}' % W1, '{"index": "none"}', "{}", '{"index": "doc*"}', '{"query": {"nope": {}}}'])
    return spark.createDataFrame([(i, r["status"], r["hits"]["total"]["value"] if "hits" in r else None) for i, r in enumerate(got)], "i int, status int, total long")


QUERIES["es_msearch"] = _msearch
SQL["es_msearch"] = r"SELECT 0 AS i, 200 AS status, (SELECT count(*) FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'thing')) AS total UNION ALL SELECT 1, 400, NULL UNION ALL SELECT 2, 400, NULL"
