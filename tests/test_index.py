"""The written index against the scan, what a query reads of it, and operators on small tables."""

import datetime

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quern.functions import wikitext
from quern.functions.text import code_tokens
from quern.operators import aggregations as ag
from quern.operators import es_search, graph, hybrid, ranking, suggest
from quern.operators.fusion import merge_shards, rrf
from quern.operators.vectors import AnnIndex, embed_text, knn, shard_of
from quern.plans import lucene
from quern.plans.ast import MatchAll, Not, QueryError, Term
from quern.plans.search import Collection, hits, matches, search
from quern.sources import catalog, collection
from quern.sources import index as index_module
from quern.sources.index import Index, postings_of

ROWS = [
    (1, "The quick brown fox, the fox", "a", 5), (2, "quick fox brown", "b", 3), (3, None, "a", None), (4, "", None, 7), (5, "brown the the quick", "b", 9),
    (6, "getHTTPResponse2 snake_case ÜberÄhnlich", "c", 1), (7, "fox fox fox", "c", 2),
]
QUERIES = [
    "fox", "quick AND fox", "quick OR the", "quick -fox", "NOT fox", '"the fox"', '"quick brown"', '"fox fox"', "br*", "*ow?", "f?x^3 OR the", "kind:a", "fox AND kind:b", "(fox OR kind:a) AND NOT n:[5 TO *]",
    "n:{2 TO 7]", "text:*", "kind:*", "*", "+the fox", "missingword OR n:[9 TO 9]", "", '"fox missingword"', "code:http AND code:response", "code:über", "id:2 OR id:7",
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "id long, text string, kind string, n long").withColumn("code", F.col("text"))
    path = str(tmp_path_factory.mktemp("table") / "t")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    fields = {"text": "default", "code": "code"}
    index = Index.build(df, "id", fields, str(tmp_path_factory.mktemp("index") / "i"))
    return Collection(df, "id", fields), Collection(df, "id", fields, index=index)


def _rows(df):
    return sorted((r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("text", QUERIES)
def test_index_and_scan_agree(both, text):
    scan, indexed = both
    node = lucene.parse(text)
    assert _rows(hits(scan, node)) == _rows(hits(indexed, node))
    assert sorted(r["id"] for r in matches(indexed, node).collect()) == [i for i, _ in _rows(hits(scan, node))]


def test_index_reads_only_the_rows_of_its_words(both):
    plan = hits(both[1], lucene.parse("fox OR quick"))._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [fox,quick])" in plan and "PartitionFilters" in plan and "kind" not in plan


def test_page_with_stored_columns_is_fetched_by_id(both):
    page = search(both[1], lucene.parse("fox"), limit=2, columns=["kind"])
    assert "In(id" in page._jdf.queryExecution().executedPlan().toString() or "EqualTo(id" in page._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in page.collect()] == [r["id"] for r in search(both[0], lucene.parse("fox"), limit=2).collect()]
    assert [r["id"] for r in search(both[1], MatchAll(), limit=3, sort=[("n", True)], columns=["kind"]).collect()] == [5, 4, 1]


def test_index_after_upserts_deletes_and_compaction(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, text string, kind string, n long")
    index = Index.build(df.where("id < 5"), "id", {"text": "default"}, str(tmp_path / "a"))
    index.upsert(df.where("id >= 5").unionByName(df.where("id = 2").withColumn("text", F.lit("wholly new"))), "id")
    index.delete(spark.createDataFrame([(7,), (99,)], "id long"), "id")
    now = df.where("id <> 7").withColumn("text", F.when(F.col("id") == 2, "wholly new").otherwise(F.col("text")))
    packed = index.compact(str(tmp_path / "b"))
    for text in ("fox", "new OR quick", "NOT the", '"wholly new"'):
        want = _rows(hits(Collection(now, "id", {"text": "default"}), lucene.parse(text)))
        assert want == _rows(hits(Collection(now, "id", {"text": "default"}, index=index), lucene.parse(text)))
        assert want == _rows(hits(Collection(now, "id", {"text": "default"}, index=packed), lucene.parse(text)))
    assert {r["term"]: r["doc_freq"] for r in index.vocabulary().collect()}["brown"] == 2


def test_empty_table_has_an_empty_index(spark, tmp_path):
    none = spark.createDataFrame(ROWS, "id long, text string, kind string, n long").limit(0)
    c = Collection(none, "id", {"text": "default"}, index=Index.build(none, "id", {"text": "default"}, str(tmp_path / "e")))
    assert hits(c, Term("fox")).count() == hits(c, Not(Term("fox"))).count() == 0


def test_scores_are_not_rounded(spark):
    lists = [spark.createDataFrame([(i, 1.0 / i) for i in range(1, 1200)], "id long, score double")]
    out = rrf(lists).orderBy(F.desc("score")).collect()
    assert [r["id"] for r in out] == list(range(1, 1200))
    merged = merge_shards(spark.createDataFrame([("a", 1, 0.1234567891)], "shard string, id long, score double")).first()
    assert merged["score"] == 0.1234567891


def test_code_words_of_queries_are_those_of_tables(spark, both):
    text = "getHTTPResponse2 ÜberÄhnlich" + "x" * 60
    row = spark.createDataFrame([(text,)], "t string").select(code_tokens(F.col("t")).alias("t")).first()["t"]
    from quern.plans.search import Compiler

    assert Compiler(both[0]).words("code", text) == row


def test_nested_buckets_have_their_shape(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 30)) for i in range(60)] + [(99, "a", 95.0)], "id long, k string, x double")
    c = Collection(df, "id", {"k": "raw"})
    spec = {"k": ag.terms("k", {"h": ag.histogram("x", interval=10, min_doc_count=5, extended_bounds={"min": -10, "max": 20}), "r": ag.range_("x", ranges=[{"key": "none", "from": 500}, {"to": 10}])})}
    out = ag.aggregate(c, df, spec)
    assert {(r["k"], r["h"]) for r in out["k>h"].collect()} == {(k, h) for k in "ab" for h in (0.0, 10.0, 20.0)}
    assert {(r["k"], r["r"], r["doc_count"]) for r in out["k>r"].collect()} == {("a", "none", 0), ("a", "*-10", 10), ("b", "none", 0), ("b", "*-10", 10)}
    with pytest.raises(QueryError):
        ag.aggregate(c, df, {"k": ag.terms("k", {"g": ag.global_()})})
    close = ag.aggregate(c, df, {"r": ag.range_("x", ranges=[{"from": 1234567, "to": 1234568}, {"from": 1234566, "to": 1234567}])})["r"].collect()
    assert [r["key"] for r in close] == ["1234567-1234568", "1234566-1234567"]
    assert ag.key_text(20.0) == "20" and ag.key_text(True) == "true" and ag.key_text(2.5) == "2.5"


def test_date_histogram_is_in_utc(spark):
    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 2, 2, tzinfo=datetime.UTC))], "id long, t timestamp")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        key = ag.aggregate(Collection(df, "id", {"id": "raw"}), df, {"d": ag.date_histogram("t", interval="day")})["d"].select(F.unix_timestamp("key").alias("s")).first()["s"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert key == datetime.datetime(2024, 1, 2, tzinfo=datetime.UTC).timestamp()


def test_suggest_takes_near_words_only_if_too_few_start_so(spark):
    vocab = spark.createDataFrame([("thing", 9), ("think", 5), ("thick", 3), ("this", 7)], "term string, doc_freq long")
    assert [r["term"] for r in suggest.suggest(vocab, "thi", size=4).collect()] == ["thing", "this", "think", "thick"]
    assert "thing" in [r["term"] for r in suggest.suggest(vocab, "thinq", size=4).collect()]


def test_es_response_from_end_to_end(both):
    _, c = both
    body = {"query": {"match": {"text": "fox"}}, "size": 2, "_source": ["kind"], "highlight": {"fields": {"text": {}}}, "aggs": {"k": {"terms": {"field": "kind"}, "aggs": {"s": {"stats": {"field": "n"}}, "h": {"histogram": {"field": "n", "interval": 5}}}}, "m": {"avg": {"field": "n"}}}}
    out = es_search.respond(c, body)
    assert out["hits"]["total"]["value"] == 3 and len(out["hits"]["hits"]) == 2 and set(out["hits"]["hits"][0]["_source"]) == {"kind"}
    assert "<em>fox</em>" in out["hits"]["hits"][0]["highlight"]["text"][0] and out["hits"]["max_score"] == out["hits"]["hits"][0]["_score"]
    buckets = {b["key"]: b for b in out["aggregations"]["k"]["buckets"]}
    assert buckets["a"]["s"]["max"] == 5.0 and buckets["a"]["h"]["buckets"][0]["key_as_string"] == "5" and out["aggregations"]["m"]["value"] == pytest.approx(10 / 3)
    assert es_search.mapping(c)["properties"]["text"] == {"type": "text"} and es_search.mapping(c)["properties"]["n"] == {"type": "long"}
    got = es_search.msearch({"docs": c}, ['{"index": "docs"}', "{}", '{"index": "docs"}', '{"query": {"bad": 1}}', '{"index": "docs"}'])
    assert [x["status"] for x in got] == [200, 400, 400]


def test_hybrid_legs_and_several_collections(spark, both):
    _, c = both
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (5, [0.0, 1.0])], "id long, v array<double>")
    page = hybrid.hybrid_search(c, Term("fox"), [1.0, 0.0], vector_col="v", vectors=vectors).collect()
    assert page[0]["id"] == 1 and {r["id"] for r in page} == {1, 2, 5, 7}
    assert [r["id"] for r in hybrid.hybrid_search(c, None, [0.0, 1.0], vector_col="v", vectors=vectors, limit=1).collect()] == [5]
    assert hybrid.strategy(None, "weighted") == "weighted" and hybrid.strategy("rrf", "weighted") == hybrid.strategy(None, None) == "rrf"
    with pytest.raises(QueryError):
        hybrid.hybrid_search(c, None, None, vector_col="v")
    other = Collection(c.df.select("id", F.col("text").alias("body")), "id", {"body": "default"})
    found, errors = hybrid.multi_search({"one": c, "two": other}, ["*"], Term("fox", "text"))
    assert set(errors) == {"two"} and {r["_collection"] for r in found.collect()} == {"one"}
    assert hybrid.hybrid_count(c.df, vectors) == 7 and hybrid.hybrid_get(c.df, vectors, 1).first()["v"] == [1.0, 0.0]


def test_ranking_operators(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, "2024-01-01", 3), (2, 1.5, None, None, None), (3, 1.0, 1.0, "2024-01-08", 0)], "id long, score double, _boost double, day string, likes long")
    plain = ranking.boost(rows, skip_ranking=True).collect()
    assert [r["id"] for r in plain] == [2, 1, 3]
    now = F.lit("2024-01-08").cast("timestamp")
    got = {r["id"]: r["score"] for r in ranking.boost(rows, now=now, recency={"field": "day", "kind": "linear", "scale": 14 * 86_400.0}, signals={"likes": 0.5, "none": 2.0}).collect()}
    assert got == {1: 1.0 * 0.5 * 2 + 1.5, 2: 1.5, 3: 1.0}
    assert ranking.rerank_config({"candidates": 50}, {"enabled": False}) is None and ranking.rerank_config({"candidates": 50, "fields": ["a"]}, {"candidates": 7}) == {"candidates": 7, "fields": ["a"]}
    assert ranking.rerank_config(None, {"candidates": 3}) == {"candidates": 3} and ranking.rerank_config(None, None) is None
    first = lambda n: rows.orderBy(F.desc("score"), "id").limit(n)
    assert [r["id"] for r in ranking.rerank(first, ranking.score_function_reranker("likes"), 2).collect()] == [1, 2]
    assert [r["id"] for r in ranking.rerank(first, ranking.model_reranker(None, "q"), 1).collect()] == [2]
    assert rows.select(ranking.rerank_text(rows).alias("t")).first()["t"] == "2024-01-01"


def test_vectors_of_another_length_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="dimensions"):
        knn(rows, [1.0, 0.0], id_col="id", vector_col="v").collect()
    good = rows.where("id < 3")
    assert [r["id"] for r in knn(good, [1.0, 0.0], id_col="id", vector_col="v").collect()] == [1]
    many = spark.createDataFrame([(i, [float(i % 7) + 1, float(i % 5), float(i % 3)]) for i in range(200)], "id long, v array<double>")
    ann = AnnIndex(many, "id", "v")
    want = {r["id"] for r in knn(many, [7.0, 4.0, 2.0], id_col="id", vector_col="v", k=5).collect()}
    assert len(want & {r["id"] for r in ann.search([7.0, 4.0, 2.0], 5).collect()}) >= 1
    less = ann.delete(many.where("id < 100"))
    assert less.deleted_ratio() == 0.5 and len(less.search([7.0, 4.0, 2.0], 5).collect()) == 5 and all(r["id"] >= 100 for r in less.compact().search([7.0, 4.0, 2.0], 5).collect())
    assert {r["s"] for r in many.select(shard_of("id", 4).alias("s")).distinct().collect()} == {0, 1, 2, 3}
    assert sum(x * x for x in embed_text("two words")) == pytest.approx(1) and embed_text("") == [0.0] * 32


def test_wiki_markup_nests():
    text = "== Head ==\n'''Bold''' {{a|{{b|c}}}}[[File:x.png|thumb|of [[y]]]]a [[target|label]], [[Plain]]<ref name=\"r\"/><ref>z</ref> [https://x.org site] <b>t</b>\n* item\n{| table\n|}\n\n\n\nend <!-- no --> [[open"
    assert wikitext.plain(text) == "Head\nBold a label, Plain site t\nitem\n\nend  [[open" and wikitext.plain(None) is None
    assert wikitext.plain("{{" * 5000 + "x" + "}}" * 5000) == ""


def test_catalog_lifecycle(spark):
    t = spark.range(3)
    c = catalog.Catalog({"logs": t})
    c.update(add=[("all", "logs")])
    assert c.transition("logs", {"warm": 10.0, "delete": 100.0}, 5.0) is None and c.transition("logs", {"warm": 10.0, "delete": 100.0}, 20.0) == "warm" and "logs" in c.readonly
    assert c.force_phase("logs", "delete") == "delete" and c.run_deletions() == ["logs"] and not c.aliases and not c.tables
    with pytest.raises(ValueError):
        catalog.check_name("Bad/Name")
    events = spark.createDataFrame([("2024-01-01", "u", "search", "logs", False)], "ts string, user string, action string, collection string, allowed boolean")
    assert catalog.audit(events).first()["outcome"] == "denied"


def test_bulk_limits_and_export_checks(spark, monkeypatch, tmp_path):
    lines = [(i, 1 + i // 4, v) for i, v in enumerate(['{"index":{"_id":"1"}}', '{"a":1}', '{"delete":{"_id":"2"}}', "", '{"index":{"_index":"x*"}}', '{"a":2}'])]
    df = spark.createDataFrame(lines, "line long, file int, value string")
    assert [r["error"] for r in collection.bulk(df, "file").orderBy("seq").collect()] == [None, None, "wildcard index"]
    monkeypatch.setattr(collection, "MOST_BULK_ACTIONS", 2)
    assert {r["error"] for r in collection.bulk(df).collect()} == {"too many actions"}
    table = spark.createDataFrame([("1", "x"), ("2", None)], "id string, v string")
    out = collection.export_lines(table, {}).select("value")
    assert collection.import_lines(out, "v string").count() == 2
    with pytest.raises(QueryError):
        collection.import_lines(out.where(~F.col("value").contains('"2"')), "v string")
    collection.snapshot(table, str(tmp_path / "s"))
    assert collection.restore(spark, str(tmp_path / "s"), str(tmp_path / "t")).count() == 2
    assert collection.files_of(spark.read.parquet(str(tmp_path / "t"))).agg(F.sum("documents")).first()[0] == 2


def test_graph_writes_and_paths(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "n", "A", None)], "id string, node_type string, title string, payload string")
    new = spark.createDataFrame([("a", "n", "old", None, 1), ("a", "n", "new", None, 2)], "id string, node_type string, title string, payload string, seq int")
    assert graph.add_nodes(nodes, new).first()["title"] == "new"
    edges = spark.createDataFrame([("a", "b", "x", 1.0), ("b", "c", "x", 1.0), ("a", "c", "y", 5.0)], "src string, dst string, edge_type string, weight double")
    assert graph.shortest_path(edges, "a", "c") == ["a", "b", "c"] and graph.shortest_path(edges, "a", "c", ["y"]) == ["a", "c"] and graph.shortest_path(edges, "c", "a") is None
    with pytest.raises(QueryError):
        graph.shortest_path(edges.withColumn("weight", F.lit(-1.0)), "a", "c")
    graph.save(nodes, edges, str(tmp_path / "g"))
    assert graph.load(spark, str(tmp_path / "g"))[1].count() == 3


def _text_of_places(spark, tmp_path):
    """A table on disk with null and empty texts, tokens that are dropped and a text longer than a batch of tokens."""
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(i % 40)), "en" if i % 3 else None) for i in range(400)]
    rows += [(400, None, "fr"), (401, "", "fr"), (402, "x" * 40 + " É z é", "de"), (403, "long word " * 3000, "fr"), (None, "lost", "en")]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def _places(rows):
    return {(r["field"], r["term"], r["id"]): (r["tf"], r["dl"], r["places"]) for r in rows}


def _expected(df):
    want = {}
    for r in df.where("id is not null").collect():
        tokens = [w for w in regex.split(r"[^\p{L}\p{N}]+", (r["text"] or "").lower()) if 0 < len(w) <= 39]
        for field, ts in (("text", tokens), ("lang", [r["lang"]] if r["lang"] else [])):
            for p, w in enumerate(ts):
                want.setdefault((field, w, r["id"]), (len(ts), []))[1].append(p)
    return {k: (len(p), dl, p) for k, (dl, p) in want.items()}


def test_postings_are_grouped_without_an_exchange_of_tokens(spark, tmp_path, monkeypatch):
    df = _text_of_places(spark, tmp_path)
    fields = {"text": "default", "lang": "raw"}
    monkeypatch.setattr(index_module, "spread", lambda df: df)
    found = postings_of(df, "id", fields)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    rows = found.collect()
    assert len(rows) == len(_places(rows)) and _places(rows) == _expected(df)


def test_tokens_are_grouped_in_bounded_parts(spark):
    ids, lists = pa.array([7, 8, 9, 10]), pa.array([["b", "a", "b"], [], ["a", None, "c"], ["a"] * 5])
    wanted = [("text", t, i) for t, i in (("a", 7), ("b", 7), ("a", 9), ("c", 9), ("a", 10))]
    before = index_module.TOKENS_AT_ONCE
    try:
        for most in (1, 3, 4, before):
            index_module.TOKENS_AT_ONCE = most
            batches = list(index_module._group(["text"])([pa.RecordBatch.from_arrays([ids, lists], names=["id", "t0"])]))
            rows = [r for b in batches for r in b.to_pylist()]
            assert _places(rows) == dict(zip(wanted, [(1, 3, [1]), (2, 3, [0, 2]), (1, 3, [0]), (1, 3, [2]), (5, 5, [0, 1, 2, 3, 4])], strict=True)), most
    finally:
        index_module.TOKENS_AT_ONCE = before


def test_rows_that_share_an_id_are_one_posting(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a c d"), (2, "a")], "id long, text string")
    rows = postings_of(df, "id", {"text": "default"}).collect()
    assert {(r["term"], r["id"]): (r["tf"], r["places"]) for r in rows} == {("a", 1): (2, [0, 0]), ("b", 1): (1, [1]), ("c", 1): (1, [1]), ("d", 1): (1, [2]), ("a", 2): (1, [0])}


@pytest.mark.parametrize("text", ["", "kind:*", "n:[2 TO 7]", "kind:a", "*", "id:2 OR id:7"])
def test_queries_of_documents_alone_do_not_build_the_index(both, text):
    def build():
        raise AssertionError("built")

    scan, indexed = both
    c = Collection(indexed.df, "id", indexed.text_fields, index=index_module.Deferred(build))
    assert _rows(hits(c, lucene.parse(text))) == _rows(hits(scan, lucene.parse(text)))
    built = Collection(indexed.df, "id", indexed.text_fields, index=index_module.Deferred(lambda: indexed.index))
    assert _rows(hits(built, lucene.parse("fox"))) == _rows(hits(scan, lucene.parse("fox")))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ranges_of_postings_hold_every_posting_in_order(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(index_module, "FEWEST_TOKENS", 8)
    monkeypatch.setattr(index_module, "TOKENS_A_PART", 300)
    monkeypatch.setattr(index_module, "SAMPLE_ROWS", 90)
    df = _text_of_places(spark, tmp_path)
    want = _expected(df.withColumn("id", F.col("id").cast(kind)))
    df = df.withColumn("id", F.col("id").cast(kind))
    index = Index.build(df, "id", {"text": "default", "lang": "raw"}, str(tmp_path / "i"))
    assert _places(index.postings().collect()) == want and index.postings().count() == len(want)
    ordered = index_module.ordered_postings(df, "id", {"text": "default", "lang": "raw"}, index.lengths())
    assert "RangePartitioning" not in ordered._jdf.queryExecution().executedPlan().toString().replace("rangepartitioning", "RangePartitioning")
    rows = [(r["p"], r["field"], r["term"], r["id"]) for r in ordered.select(F.spark_partition_id().alias("p"), *index_module.ORDER).collect()]
    assert [r[1:] for r in sorted(rows)] == sorted(want) and len({r[0] for r in rows}) > 10
    assert len({r[0] for r in rows if r[2] == "w0"}) > 1  # a frequent word is split by id


def test_a_query_of_one_field_builds_that_field_alone(both):
    def build():
        raise AssertionError("built")

    scan, indexed = both
    parts = {"code": index_module.Deferred(lambda: indexed.index), "text": index_module.Deferred(build)}
    c = Collection(indexed.df, "id", indexed.text_fields, index=index_module.Deferred(build, parts))
    assert _rows(hits(c, Term("fox"), ["code"])) == _rows(hits(scan, Term("fox"), ["code"])) != []
    with pytest.raises(AssertionError):
        hits(c, Term("fox"))


@pytest.mark.parametrize("kind", ["long", "smallint", "string", "double"])
@pytest.mark.parametrize("fields", [{"text": "default"}, {"text": "default", "lang": "raw"}])
def test_few_rows_hold_all_postings(spark, tmp_path, kind, fields):
    df = _text_of_places(spark, tmp_path)
    df = df.withColumn("id", F.col("id").cast(kind)).orderBy(F.desc("text"))  # ids do not ascend in a batch
    want = {k: v for k, v in _expected(df).items() if k[0] in fields}
    sizes = {(r["id"], f) for r in df.where("id is not null").collect() for f in fields}
    index = Index.build(df, "id", fields, str(tmp_path / "i"))
    packed = index.compact(str(tmp_path / "c"))
    for x in (index, packed):
        stored = spark.read.parquet(f"{x.path}/postings/seg=0")
        assert 0 < stored.where("term is not null").count() < len(want) / 5
        assert _places(x.postings().collect()) == want and x.postings().count() == len(want)
        assert x.postings(F.col("term") == "w0", places=False).count() == len([k for k in want if k[1] == "w0"])
        lengths = {(r["id"], r["field"]): r["dl"] for r in x.lengths().collect()}
        assert set(lengths) == sizes and all(lengths[i, f] == dl for (f, _, i), (_, dl, _) in want.items())
        assert {(r["field"], r["term"]): (r["df"], r["cf"]) for r in x.terms().collect()} == {k: (sum(1 for q in want if q[:2] == k), sum(v[0] for q, v in want.items() if q[:2] == k)) for k in {q[:2] for q in want}}


def test_blocks_of_parts_that_do_not_ascend_with_the_rows():
    bounds = [("text", "a", 5), ("text", "b", 1)]
    rows = pa.RecordBatch.from_arrays([pa.array([7, 3, 6, 1]), pa.array([["a", "b", "a"], ["a"], ["b", "a"], []], pa.list_(pa.string()))], names=["id", "t0"])
    blocks = pa.Table.from_batches(index_module._block(["text"], bounds)([rows])).to_pylist()
    own = {(b["term"], b["part"]): b for b in blocks if b["term"] is not None}
    assert {k: (b["n"], b["cf"]) for k, b in own.items()} == {("a", 0): (1, 1), ("a", 1): (2, 3), ("b", 2): (2, 2)}
    table = pa.Table.from_pylist([own[k] for k in sorted(own)]).select(["n", "docs", "ids", "places", "term"]).combine_chunks().to_batches()
    schema = pa.schema([("n", pa.int32()), ("docs", pa.binary()), ("ids", pa.binary()), ("places", pa.binary()), ("term", pa.string())])
    out = [r for b in index_module._unpack(1, pa.int64(), True)([t.cast(schema) for t in table]) for r in b.to_pylist()]
    assert sorted(tuple(r.values()) for r in out) == [("a", 3, 1, 1, [0]), ("a", 6, 1, 2, [1]), ("a", 7, 2, 3, [0, 2]), ("b", 6, 1, 2, [0]), ("b", 7, 1, 3, [1])]
    (none,) = [b for b in blocks if b["term"] is None]
    assert none["n"] == 4 and none["cf"] == 0 and 0 <= none["part"] < 3
