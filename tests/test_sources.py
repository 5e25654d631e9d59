"""Sources that stand outside Spark, code tokens and what an index tells of itself."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quern.functions.code import LANGUAGES, syntax_tokens
from quern.functions.text import analyzer, code_language
from quern.operators.aggregations import facets
from quern.plans.ast import QueryError
from quern.plans.search import Collection
from quern.sources import migrate, remote
from quern.sources.index import Index
from quern.sources.schema import Schema

DOCS = {f"d{i}": {"title": f"title {i}", "n": i, "odd": {"a": i}} for i in range(107)}


class Server(BaseHTTPRequestHandler):
    """Answers like a search server; a scroll id is 'slice:slices:from:size'."""

    fail_after = None

    def log_message(self, *args):
        pass

    def answer(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def page(self, k, n, start, size):
        ids = [d for i, d in enumerate(sorted(DOCS)) if i % n == k][start : start + size]
        self.answer(200, {"_scroll_id": f"{k}:{n}:{start + size}:{size}", "hits": {"hits": [{"_id": d, "_source": DOCS[d]} for d in ids]}})

    def do_GET(self):
        if "/secret/" in self.path:
            return self.answer(200 if self.headers.get("Authorization") == "Basic dTpw" else 401, {"count": 1})
        if "/docs/" not in self.path:
            return self.answer(404, {})
        kinds = {"title": {"type": "text"}, "n": {"type": "long"}, "odd": {"type": "object"}}
        self.answer(200, {"count": len(DOCS)} if self.path.endswith("_count") else {"docs": {"mappings": {"properties": kinds}}})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "scroll_id" in body:
            if Server.fail_after is not None:
                return self.answer(500, {})
            return self.page(*map(int, body["scroll_id"].split(":")))
        part = body.get("slice", {"id": 0, "max": 1})
        self.page(part["id"], part["max"], 0, int(self.path.split("size=")[1]))

    def do_DELETE(self):
        self.answer(200, {})


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("slices", [1, 3])
def test_scroll_reads_every_document_once(spark, url, slices):
    rows = remote.import_index(spark, url, "docs", slices=slices, batch=10).collect()
    assert sorted((r["id"], r["title"], r["n"], json.loads(r["odd"])) for r in rows) == sorted((k, v["title"], v["n"], v["odd"]) for k, v in DOCS.items())
    assert remote.count_documents(url, "docs") == len(DOCS)


def test_scroll_fails_aloud(spark, url):
    with pytest.raises(QueryError, match="not found"):
        remote.fetch_schema(url, "missing")
    with pytest.raises(QueryError, match="refused"):
        remote.count_documents(url, "secret")
    assert remote.count_documents(url, "secret", auth="u:p") == 1
    Server.fail_after = 1
    try:
        with pytest.raises(Exception, match="500"):
            remote.import_index(spark, url, "docs", slices=1, batch=10).collect()
    finally:
        Server.fail_after = None


def test_migration_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("a", "one", 1, True, [1.0]), ("b", None, None, False, None)], "id string, t string, n long, ok boolean, v array<float>")
    table.write.parquet(str(tmp_path / "old/things"))
    (tmp_path / "old/empty").mkdir()
    found = migrate.discover(spark, str(tmp_path / "old"))
    assert {k: [(f.name, f.type) for f in s.fields] for k, s in found.items()} == {"things": [("t", "text"), ("n", "i64"), ("ok", "bool"), ("v", "vector")]}
    migrate.export_jsonl(table, str(tmp_path / "lines"))
    back = migrate.import_jsonl(spark, str(tmp_path / "lines"), found["things"])
    assert sorted(back.collect()) == sorted(table.collect())
    (tmp_path / "bad.jsonl").write_text('{"t": "x"}\n\nno json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        migrate.import_jsonl(spark, str(tmp_path / "bad.jsonl"), found["things"]).collect()
    (tmp_path / "good.jsonl").write_text('{"t": "x"}\n \n')
    assert [r["id"] for r in migrate.import_jsonl(spark, str(tmp_path / "good.jsonl"), found["things"]).collect()] == [""]


def test_segments(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"word{i} all") for i in range(10)], "id long, t string")
    index = Index.build(rows, "id", {"t": "default"}, str(tmp_path / "ix"))
    one = index.segment_stats().collect()
    assert [(r["seg"], r["doc_count"], r["deleted_count"], r["delete_ratio"]) for r in one] == [(0, 10, 0, 0.0)] and one[0]["size_bytes"] > 0
    index.upsert(rows.where("id < 2"), "id").delete(rows.where("id = 9"), "id")
    told = {r["seg"]: (r["doc_count"], r["deleted_count"], r["delete_ratio"]) for r in index.segment_stats().collect()}
    assert told == {0: (7, 3, 0.3), 1: (2, 0, 0.0)}


CODE = [
    ("rust", "// Opens theFile\nfn open_file<'a>(p: &'a str) { let x1 = \"not \\\"found\\\"\"; 42 }", "opens the file open file a p a str x 1 not found"),
    ("python", "def getName(x):\n    '''Doc it'''\n    return x + 1  # the end", "get name x doc it x the end"),
    ("sql", "SELECT userId FROM t1 -- all of them\nWHERE a = 'red car'", "user id t 1 all of them a red car"),
    ("html", "<!-- a remark --><p class=\"big\">", "remark p class big"),
    ("erlang", "-module(m). % about it", "module m about it"),
    ("json", '{"keyName": true}', "key name"),
]


def test_syntax_tokens(spark):
    for language, text, want in CODE:
        got = spark.createDataFrame([(text,)], "t string").select(syntax_tokens(F.col("t"), language).alias("x")).first()["x"]
        assert got == want.split(), language
    row = spark.createDataFrame([("x = 'abc' # def",)], "t string")
    bare = row.select(syntax_tokens(F.col("t"), "python", comments=False, strings=False).alias("x")).first()["x"]
    assert bare == ["x"]


def test_odd_code(spark):
    rows = spark.createDataFrame([(None,), ("",), ("/* open",), ('"' + "a\\\"" * 200_000,), ("/*" + "x " * 200_000,), ("'" * 9999,)], "t string")
    for language in LANGUAGES:
        got = [r["x"] for r in rows.select(analyzer(f"code-treesitter-{language}")(F.col("t")).alias("x")).collect()]
        assert got[0] is None and got[1] == [] and "open" in got[2]


def test_code_language(spark):
    cases = [("a.PYI", "", "python"), ("a.hrl", "", "erlang"), (None, "#!/usr/bin/env escript\n", "erlang"), (None, "#!/bin/zsh\n", "bash"), ("x", "defmodule Foo do\nend", "elixir"),
             ("x", "#include \"a.h\"\n", "c"), ("x", "#include <vector>\n", "cpp"), ("x", "const a = 1\n", "javascript"), ("x", '{"a": 1}', "json"), ("x", "[tool.x]\na=1", "toml"), ("x", "plain words", None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, t string, want string")
    for r in rows.select("want", code_language(F.col("p"), F.col("t")).alias("got"), "t").collect():
        assert r["got"] == r["want"], r


def test_facets_of_a_schema(spark):
    config = {"allowed": ["kind", "at"], "default": ["kind"], "configs": [{"field": "kind", "type": "terms", "size": 1}, {"field": "at", "type": "date_histogram", "interval": "month"}]}
    schema = Schema.parse({"collection": "x", "facets": config})
    assert schema.lint() == [] and schema.facet_specs() == {"kind": {"type": "terms", "size": 1}}
    assert schema.facet_specs(["at", "n"]) == {"at": {"type": "date_histogram", "interval": "month"}, "n": {}}
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', timestamp'2024-01-02'), (2, 'a', timestamp'2024-02-02'), (3, 'b', timestamp'2024-02-03') AS t(id, kind, at)")
    c = Collection(rows, "id", {"kind": "raw"})
    assert [(r["key"], r["doc_count"]) for r in facets(c, rows, schema.facet_specs(), config["allowed"])["kind"].collect()] == [("a", 2)]
    assert sorted(r["doc_count"] for r in facets(c, rows, schema.facet_specs(["at"]))["at"].collect()) == [1, 2]
    with pytest.raises(QueryError, match="no facet"):
        facets(c, rows, schema.facet_specs(["n"]), config["allowed"])
    bad = Schema.parse({"facets": {"allowed": ["a"], "default": ["b"], "configs": [{"field": "a", "type": "odd"}]}})
    assert len(bad.lint()) == 2
