"""Registered vector, fusion, ranking, ingest, graph and catalog queries, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import ranking
from quern.functions.vector import cosine
from quern.operators import fusion, graph, hybrid
from quern.operators import ranking as rank_ops
from quern.operators.vectors import embed, knn, text_search
from quern.plans.ast import Term
from quern.plans.search import Collection, hits, search
from quern.queries_search import W1, W2, _page_node, _round_sql, _sql, _three, benchmark, docs, read, rounded
from quern.sources import catalog, collection, pipelines

QUERIES: dict = {}
SQL: dict = {}
#: The vector that the nearest-neighbour queries look for, by a rule.
PROBE = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
_probe = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _knn(metric: str, k: int = 20):
    return lambda s, d: rounded(_near(s, d, metric, k))


def _near(s, d, metric: str, k: int) -> DataFrame:
    return knn(read(s, d, "embeddings"), PROBE, id_col="vec_id", vector_col="embedding", k=k, metric=metric)


_e = "embedding::DOUBLE[]"
_scores = {"cosine": f"list_cosine_similarity({_e}, {_probe})", "euclidean": f"1 - list_distance({_e}, {_probe})", "dot": f"list_inner_product({_e}, {_probe})"}


def _knn_sql(metric: str, k: int = 20) -> str:
    return f"SELECT vec_id AS id, {_scores[metric]} AS score FROM embeddings ORDER BY score DESC, id LIMIT {k}"


for m in _scores:
    add(f"knn_{m}", _knn(m), _round_sql(_knn_sql(m)))
add("vector_scores", lambda s, d: read(s, d, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), F.array(*[F.lit(x) for x in PROBE])), 6).alias("score")), f"SELECT vec_id, round({_scores['cosine']}, 6) AS score FROM embeddings")
_bytes = "list_transform(range(0, 32), lambda i: ('0x' || sha256(w)[2 * i + 1:2 * i + 2])::INT / 255.0::DOUBLE)"
add("text_to_vector", lambda s, d: embed(read(s, d, "benchmark").select("item_id", F.regexp_extract("text", r"^\S+", 0).alias("text")), "text", "v").select("item_id", F.size("v").alias("dims"), F.array_join(F.transform("v", lambda x: F.format_number(x, 4)), " ").alias("v")), rf"""
SELECT item_id, 32 AS dims, array_to_string(list_transform(v, lambda x: format('{{:.4f}}', x / sqrt(list_sum(list_transform(v, lambda y: y * y))))), ' ') AS v
FROM (SELECT item_id, list_transform(range(0, 32), lambda i: b[i + 1] * (1 + 0.0001::DOUBLE * i)) AS v FROM (SELECT item_id, {_bytes} AS b FROM (SELECT item_id, regexp_extract(text, '^\S+') AS w FROM benchmark)))""")
add("text_vector_search", lambda s, d: text_search(embed(read(s, d, "benchmark"), "text", "v"), read(s, d, "benchmark").where("item_id = 3").first()["text"], id_col="item_id", vector_col="v", k=1).select("id", F.round("score", 6).alias("score")), "SELECT item_id AS id, 1.0::DOUBLE AS score FROM benchmark WHERE item_id = 3")


# the two legs of a hybrid search: a text page and a vector page over one id space
def _hybrid(s, d, limit: int = 100, **how) -> DataFrame:
    return hybrid.hybrid_search(docs(s, d), _page_node, PROBE, vector_col="embedding", vectors=read(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), limit=limit, candidates=100, **how)


_text_sql = f"SELECT doc_id AS id, score FROM ({_three}) ORDER BY score DESC, id LIMIT 100"
_legs = f"t AS ({_text_sql}), v AS ({_knn_sql('cosine', 100)})"
_rank = "SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM "
add("hybrid_rrf", lambda s, d: rounded(_hybrid(s, d), 9), f"WITH {_legs} SELECT id, round(sum(p), 9) AS score FROM ({_rank} t UNION ALL {_rank} v) GROUP BY id ORDER BY sum(p) DESC, id LIMIT 100")
add("hybrid_text_only", lambda s, d: rounded(hybrid.hybrid_search(docs(s, d), _page_node, None, vector_col="embedding", limit=10)), f"SELECT doc_id AS id, round(score, 6) AS score FROM ({_three}) ORDER BY score DESC, doc_id LIMIT 10".replace("ORDER BY score DESC, doc_id LIMIT 10", "ORDER BY score DESC, id LIMIT 10"))
for how in ("none", "max_norm", "metric_aware"):
    t = "score" if how == "none" else "score / (SELECT max(score) FROM t)"
    v = "score" if how in ("none", "metric_aware") else "score / (SELECT max(score) FROM v)"
    add(
        f"hybrid_weighted_{how}", lambda s, d, how=how: rounded(_hybrid(s, d, how="weighted", text_weight=0.7, vector_weight=0.3, normalise=how), 9),
        f"WITH {_legs}, m AS (SELECT id, 0.7::DOUBLE * coalesce(a, 0.0) + 0.3::DOUBLE * coalesce(b, 0.0) AS score FROM (SELECT id, {t} AS a FROM t) FULL JOIN (SELECT id, {v} AS b FROM v) USING (id) ORDER BY score DESC, id LIMIT 100) SELECT id, round(score, 9) AS score FROM m",
    )
add("hybrid_aggregation", lambda s, d: hybrid.hybrid_aggregations(docs(s, d), _hybrid(s, d, 50), {"l": {"type": "terms", "field": "lang"}})["l"], f"WITH {_legs}, m AS (SELECT id FROM ({_rank} t UNION ALL {_rank} v) GROUP BY id ORDER BY sum(p) DESC, id LIMIT 50) SELECT lang AS key, count(*) AS doc_count FROM documents WHERE doc_id IN (SELECT id FROM m) AND lang IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")


def _shards(s, d) -> DataFrame:
    return read(s, d, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("score")).select(F.col("event_type").alias("shard"), F.col("user_id").alias("id"), "score")


_shard_sql = "sh AS (SELECT event_type AS shard, user_id AS id, max(value) AS score FROM events GROUP BY 1, 2)"
add("merge_simple", lambda s, d: rounded(fusion.merge_shards(_shards(s, d))), f"WITH {_shard_sql} SELECT id, round(max(score), 6) AS score FROM sh GROUP BY id")
add("merge_normalized", lambda s, d: rounded(fusion.merge_shards(_shards(s, d), "score_normalized")), f"WITH {_shard_sql}, n AS (SELECT id, score, min(score) OVER w AS lo, max(score) OVER w AS hi FROM sh WINDOW w AS (PARTITION BY shard)) SELECT id, round(max(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END), 6) AS score FROM n GROUP BY id")
add("merge_zscore", lambda s, d: rounded(fusion.merge_shards(_shards(s, d), "zscore")), f"WITH {_shard_sql}, n AS (SELECT id, score, avg(score) OVER w AS m, stddev_pop(score) OVER w AS sd FROM sh WINDOW w AS (PARTITION BY shard)) SELECT id, round(max(CASE WHEN sd > 0 THEN (score - m) / sd ELSE score END), 6) AS score FROM n GROUP BY id")
add("merge_rrf", lambda s, d: rounded(fusion.merge_shards(_shards(s, d), "rrf")), f"WITH {_shard_sql} SELECT id, round(sum(p), 6) AS score FROM (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY shard ORDER BY score DESC, id)) AS p FROM sh) GROUP BY id")


add("merge_weighted", lambda s, d: rounded(fusion.merge_shards(_shards(s, d), "weighted", weights={"click": 2.0, "view": 0.5})), f"WITH {_shard_sql} SELECT id, round(max(score * CASE shard WHEN 'click' THEN 2.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM sh GROUP BY id")


def _multi(s, d) -> DataFrame:
    three = {"documents": docs(s, d), "benchmark": benchmark(s, d), "pages": Collection(read(s, d, "pages"), "page_id", {"html": "default"})}
    return rounded(hybrid.multi_search(three, ["doc*", "bench*"], Term("the"), limit=40)[0], 9)


add("multi_collection_rrf", _multi, "SELECT _collection, id, round(p, 9) AS score FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS _collection, {i}::VARCHAR AS id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, {i})) AS p FROM (SELECT * FROM ({_sql(['the'], 'tf0 > 0', 'e0', table=t, columns=i)}) ORDER BY score DESC, {i} LIMIT 40)" for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))) + ") ORDER BY p DESC, _collection, id LIMIT 40")

# ranking
_NOW = "2024-02-01"


def _decayed(kind: str, family=ranking.decay):
    def query(s, d) -> DataFrame:
        age = F.unix_timestamp(F.lit(_NOW).cast("timestamp")) - F.unix_timestamp("ts")
        return read(s, d, "events").select("event_id", F.round(family(kind, age, ranking.duration("7d"), 0.7, ranking.duration("1d")), 6).alias("factor"))

    return query


_x = f"((epoch(TIMESTAMP '{_NOW}') - floor(epoch(ts)))::DOUBLE - 86400.0) / 604800.0"
for kind, curve in {"exponential": "pow(0.7::DOUBLE, x)", "linear": "greatest(0.0, 1 - x)", "gauss": "exp(-0.5::DOUBLE * x * x * abs(ln(0.7::DOUBLE)))"}.items():
    add(f"decay_{kind}", _decayed(kind), f"SELECT event_id, round(CASE WHEN x <= 0 THEN 1.0 ELSE {curve} END, 6) AS factor FROM (SELECT event_id, {_x} AS x FROM events)")
for kind, curve in {"exponential": "exp(-0.7::DOUBLE * x)", "linear": "greatest(0.0, 1 - x)", "gauss": "exp(-x * x)"}.items():
    add(f"request_decay_{kind}", _decayed(kind, ranking.request_decay), f"SELECT event_id, round(CASE WHEN x <= 0 THEN 1.0 ELSE {curve} END, 6) AS factor FROM (SELECT event_id, {_x} AS x FROM events)")
add("context_boost", lambda s, d: read(s, d, "documents").select("doc_id", F.round(ranking.context_boost({"lang": "fr", "source": "src3"}), 6).alias("factor")), "SELECT doc_id, (CASE WHEN lang = 'fr' THEN 1.5::DOUBLE ELSE 1.0 END) * (CASE WHEN source = 'src3' THEN 1.5::DOUBLE ELSE 1.0 END) AS factor FROM documents")


def _boosted(s, d) -> DataFrame:
    found = hits(docs(s, d), Term(W1), columns=["n_chars"]).join(read(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, 1.2).alias("_boost")), "doc_id", "left")
    return rank_ops.boost(found, signals={"n_chars": 0.0001, "missing": 5.0}, id_col="doc_id").limit(50).select("doc_id", F.round("score", 6).alias("score"))


add("schema_boosting", _boosted, f"SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, score * CASE WHEN quality = 1 THEN 1.2::DOUBLE ELSE 1.0 END + n_chars * 0.0001::DOUBLE AS score FROM ({_sql([W1], 'tf0 > 0', 'e0', columns='doc_id, n_chars')}) LEFT JOIN labels USING (doc_id)) ORDER BY score DESC, doc_id LIMIT 50")


def _recent(s, d) -> DataFrame:
    """Events by value, the older the lower."""
    rows = read(s, d, "events").select("event_id", "ts", F.col("value").alias("score"))
    return rank_ops.boost(rows, now=F.lit(_NOW).cast("timestamp"), recency={"field": "ts", "kind": "exponential", "scale": 604_800.0, "rate": 0.7, "offset": 86_400.0}, id_col="event_id").select("event_id", F.round("score", 6).alias("score"))


add("recency_boosting", _recent, f"SELECT event_id, round(value * CASE WHEN x <= 0 THEN 1.0 ELSE pow(0.7::DOUBLE, x) END, 6) AS score FROM (SELECT event_id, value, {_x} AS x FROM events)")


def _scored(s, d) -> DataFrame:
    found = hits(docs(s, d), Term(W1), columns=["n_chars", "lang"])
    score = ranking.ScoreFunction("_score * 1.5 + log(n_chars + 1) / (missing + 2) - lang / 0").column(F.col("score"), dict(found.dtypes))
    return found.select("doc_id", F.round(score, 6).alias("score"))


add("score_function", _scored, f"SELECT doc_id, round(score * 1.5::DOUBLE + ln(n_chars::DOUBLE + 1.0) / (0.0::DOUBLE + 2.0) - 0.0, 6) AS score FROM ({_sql([W1], 'tf0 > 0', 'e0', columns='doc_id, n_chars')})")


def _reranked(s, d) -> DataFrame:
    config = rank_ops.rerank_config({"candidates": 80}, {"candidates": 50})
    first = lambda n: search(docs(s, d), _page_node, limit=n, columns=["n_chars"])
    return rounded(rank_ops.rerank(first, rank_ops.score_function_reranker("_score / log(n_chars + 10)"), 10, candidates=config["candidates"], id_col="doc_id"))


add("two_phase_rerank", _reranked, f"SELECT doc_id, n_chars, round(score, 6) AS score FROM (SELECT doc_id, n_chars, score / ln(n_chars + 10.0::DOUBLE) AS score FROM (SELECT * FROM ({_sql([W1, W2, 'eau'], 'tf0 > 0 OR tf1 > 0 OR tf2 > 0', '0.0 + e0 + e1 + e2', columns='doc_id, n_chars')}) ORDER BY score DESC, doc_id LIMIT 50)) ORDER BY score DESC, doc_id LIMIT 10")

# ingest
add("pipeline_normalize", lambda s, d: pipelines.run(read(s, d, "documents").select("doc_id", "text", "source", "lang"), [{"lowercase": {"field": "text"}}, {"rename": {"from": "source", "to": "origin"}}, {"remove": {"field": "lang"}}, {"set": {"field": "kind", "value": "prose"}}, {"html_strip": {"field": "origin"}}]), "SELECT doc_id, lower(text) AS text, source AS origin, 'prose' AS kind, NULL::VARCHAR AS _error FROM documents")
add("pipeline_errors", lambda s, d: pipelines.run(read(s, d, "documents").select("doc_id", "n_chars"), [{"lowercase": {"field": "n_chars"}}]).select("doc_id", "_error"), "SELECT doc_id, 'lowercase: n_chars is missing or no string' AS _error FROM documents")


def _orders(s, d) -> tuple[DataFrame, DataFrame]:
    o = read(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    return o.where("seq % 2 = 0").groupBy("id").agg(F.max("seq").alias("seq"), F.max_by("price", "seq").alias("price")), o.where("seq % 2 = 1")


_new = "SELECT o_custkey AS id, max(o_orderkey) AS seq, max_by(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderkey % 2 = {} GROUP BY 1"
add("upsert", lambda s, d: collection.upsert(*_orders(s, d)), f"WITH o AS ({_new.format(0)}), n AS ({_new.format(1)}) SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
add("delete", lambda s, d: collection.delete(read(s, d, "customer"), read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey"), "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
add("delete_by_query", lambda s, d: collection.delete_where(read(s, d, "documents"), hits(docs(s, d), Term("the")), "doc_id").select("doc_id", "lang"), r"SELECT doc_id, lang FROM documents WHERE NOT list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'the')")
add("get_by_id", lambda s, d: collection.get(read(s, d, "documents"), 7, "doc_id"), "SELECT * FROM documents WHERE doc_id = 7")
add("collection_stats", lambda s, d: collection.stats(read(s, d, "documents")).select("documents", (F.col("bytes") > 0).alias("has_bytes")), "SELECT count(*) AS documents, true AS has_bytes FROM documents")


def _bulk(s, d) -> DataFrame:
    c = read(s, d, "region")
    action = F.concat(F.lit('{"index":{"_index":"r","_id":"'), F.col("r_regionkey"), F.lit('"}}'))
    body = F.to_json(F.struct("r_regionkey", "r_name"))
    lines = c.select(F.explode(F.array(F.struct((F.col("r_regionkey") * 2).cast("long").alias("line"), action.alias("value")), F.struct((F.col("r_regionkey") * 2 + 1).cast("long").alias("line"), body.alias("value")))).alias("x")).select("x.*")
    return collection.bulk(lines).select("id", "op", F.get_json_object("source", "$.r_name").alias("name"), "error")


add("bulk", _bulk, "SELECT r_regionkey::VARCHAR AS id, 'index' AS op, r_name AS name, NULL::VARCHAR AS error FROM region")
_DDL = "p_name string, p_brand string, p_size int, p_retailprice double"


def _round_trip(s, d, code=lambda x: x) -> DataFrame:
    table = read(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_brand", "p_size", "p_retailprice")
    return collection.import_lines(code(collection.export_lines(table, {}).select("value")), _DDL)


_part = "SELECT p_partkey::VARCHAR AS id, p_name, p_brand, p_size, p_retailprice FROM part"
add("export_import", _round_trip, _part)
_KEY = bytes(range(32))
add("encrypted_export_import", lambda s, d: _round_trip(s, d, lambda x: collection.decrypt(collection.encrypt(x, _KEY), _KEY)), _part)
add("alias_union", lambda s, d: _catalog(s, d).read("all").groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT 'documents' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark")


def _catalog(s, d) -> catalog.Catalog:
    c = catalog.Catalog({t: read(s, d, t).select(F.lit(t).alias("kind"), "text") for t in ("documents", "benchmark")})
    c.update(add=[("all", "documents"), ("all", "benchmark")])
    return c


_POLICY = {"warm": 5 * 86_400.0, "cold": 12 * 86_400.0, "delete": 25 * 86_400.0}


def _phases(s, d) -> DataFrame:
    age = F.unix_timestamp(F.lit(_NOW).cast("timestamp")) - F.unix_timestamp("ts")
    return read(s, d, "events").select(catalog.phase_column(_POLICY, F.lit("hot"), age).alias("phase")).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


def _rollovers(s, d) -> DataFrame:
    rows = read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("documents"), F.sum("value").alias("size"))
    reasons = catalog.reasons_column({"max_docs": 1990, "max_size": 10_000.0}, size=F.col("size"), documents=F.col("documents"), age=F.lit(0.0))
    return rows.select("event_type", "documents", F.array_join(reasons, ",").alias("reasons"))


_age = f"(epoch(TIMESTAMP '{_NOW}') - floor(epoch(ts)))"
add("phase_transition", _phases, f"SELECT CASE WHEN {_age} >= 432000 THEN 'warm' ELSE NULL END AS phase, count(*) AS n FROM events GROUP BY 1")
add("rollover_check", _rollovers, "SELECT event_type, count(*) AS documents, array_to_string(list_filter([CASE WHEN sum(value) >= 10000 THEN 'max_size' END, CASE WHEN count(*) >= 1990 THEN 'max_docs' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events GROUP BY 1")

# graph: nation -> region, supplier -> nation, customer -> nation, in both directions
def _edges(s, d) -> DataFrame:
    parts = [
        read(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in_region").alias("edge_type"), F.lit(2.0).alias("weight")),
        read(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("in_nation").alias("edge_type"), F.lit(1.0).alias("weight")),
        read(s, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("has_customer").alias("edge_type"), F.lit(1.5).alias("weight")),
    ]
    return reduce(DataFrame.unionByName, parts)


_edge_sql = "e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in_region' AS edge_type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'in_nation' FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'has_customer' FROM customer)"
add("graph_bfs", lambda s, d: graph.bfs(_edges(s, d), s.createDataFrame([("s1",), ("s2",)], "id string"), 3), f"WITH RECURSIVE {_edge_sql}, r(id, depth) AS (SELECT unnest(['s1', 's2']), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0")
add("graph_bfs_typed", lambda s, d: graph.bfs(_edges(s, d), s.createDataFrame([("s1",)], "id string"), 3, "in_nation"), f"WITH {_edge_sql} SELECT DISTINCT dst AS id, 1 AS depth FROM e WHERE src = 's1' AND edge_type = 'in_nation'")
add("graph_out_edges", lambda s, d: graph.out_edges(_edges(s, d), "n3").select("dst", "edge_type"), f"WITH {_edge_sql} SELECT dst, edge_type FROM e WHERE src = 'n3'")
add("graph_degree", lambda s, d: graph.degrees(_edges(s, d)), f"WITH {_edge_sql} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id")


add("graph_stats", lambda s, d: graph.stats(_edges(s, d)), f"WITH {_edge_sql} SELECT edge_type, count(*) AS edges FROM e GROUP BY 1")


def _path(s, d) -> DataFrame:
    path = graph.shortest_path(_edges(s, d), "s1", "r" + str(read(s, d, "supplier").where("s_suppkey = 1").join(read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]))
    return s.createDataFrame([(i, x) for i, x in enumerate(path or [])], "step int, id string")


add("graph_shortest_path", _path, "SELECT unnest([0, 1, 2])::INT AS step, unnest(['s1', 'n' || s_nationkey, 'r' || n_regionkey]) AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1")
