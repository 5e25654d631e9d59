"""Registered search queries over ``documents``, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as text_functions
from quern.functions.text import default_tokens, highlight
from quern.operators import suggest as sg
from quern.plans import es, lucene
from quern.plans.ast import MatchAll, Not, Or, Term, Wildcard
from quern.plans.search import Collection, hits, search, simple_search, total
from quern.sources import context, migrate
from quern.sources.index import Deferred, Index, postings_of
from quern.sources.storage import new_path

TOKENS = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: len(x) BETWEEN 1 AND 39)"
#: Words of the invented languages that the queries look for.
W1, W2, W3 = "thing", "nicht", "eau"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_INDEXES: dict[tuple, Deferred] = {}


def indexed(spark, sf_dir: str, table: str, id_col: str, fields: dict[str, str]) -> Deferred:
    """The table's index of these fields, built for the first query of a session that reads it, as a collection has it
    from ingest; a query of one of several fields builds that one."""
    key = (spark.sparkContext.applicationId, sf_dir, table, *sorted(fields.items()))
    if key not in _INDEXES:
        parts = {f: indexed(spark, sf_dir, table, id_col, {f: kind}) for f, kind in fields.items()} if len(fields) > 1 else {}
        _INDEXES[key] = Deferred(lambda: Index.build(read(spark, sf_dir, table), id_col, fields, new_path(spark, f"index-{table}")), parts)
    return _INDEXES[key]


def docs(spark, sf_dir: str, fields: dict | None = None, **how) -> Collection:
    fields = fields or {"text": "default"}
    index = indexed(spark, sf_dir, "documents", "doc_id", fields)
    return Collection(read(spark, sf_dir, "documents"), "doc_id", fields, index=index, **how)


def benchmark(spark, sf_dir: str) -> Collection:
    return Collection(read(spark, sf_dir, "benchmark"), "item_id", {"text": "default"}, index=indexed(spark, sf_dir, "benchmark", "item_id", {"text": "default"}))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Scores as both engines print them."""
    return df.withColumn("score", F.round("score", digits))


def _round_sql(sql: str, digits: int = 6) -> str:
    return f"SELECT * REPLACE (round(score, {digits}) AS score) FROM ({sql})"


def _sql(words: list[str], where: str, score: str, order: str = "", table: str = "documents", columns: str = "doc_id") -> str:
    """A query with the BM25 score of each word i as e{i} and its count as tf{i}."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"sum((tf{i} > 0)::INT)::DOUBLE AS df{i}" for i in range(len(words)))
    e = ", ".join(f"ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5)) AS idf{i}, CASE WHEN tf{i} > 0 THEN ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2::DOUBLE) / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) ELSE 0.0 END AS e{i}" for i in range(len(words)))
    return f"""
WITH t AS (SELECT *, {TOKENS.format(c="text")} AS t FROM {table}),
f AS (SELECT *, len(t)::DOUBLE AS dl{", " + tf if tf else ""} FROM t),
s AS (SELECT count(*)::DOUBLE AS n, sum(dl) / count(*) AS mean{", " + df if df else ""} FROM f),
x AS (SELECT f.*, s.*{", " + e if e else ""} FROM f, s)
SELECT {columns}, {score} AS score FROM x WHERE {where} {order}"""


def _all(node, fields=None):
    return lambda spark, sf_dir: rounded(hits(docs(spark, sf_dir, fields), node))


def _lucene(text: str):
    return _all(lucene.parse(text))


QUERIES: dict = {}
SQL: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = _round_sql(sql) if " AS tf0" in sql and "score" in sql and "round(" not in sql else sql


any_two = ("tf0 > 0 OR tf1 > 0", "0.0 + e0 + e1")
add("match_all", _all(MatchAll()), _sql([], "true", "1.0::DOUBLE"))
add("term", _all(Term(W1)), _sql([W1], "tf0 > 0", "e0"))
add("term_field", _lucene(f"text:{W2.title()}"), _sql([W2], "tf0 > 0", "e0"))
add("keyword_term", _lucene("lang:fr"), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lang = 'fr'")
add("and", _lucene(f"{W1} AND the"), _sql([W1, "the"], "tf0 > 0 AND tf1 > 0", "e0 + e1"))
add("or", _lucene(f"{W1} OR {W2}"), _sql([W1, W2], *any_two))
add("multi_word", _lucene(f"{W1} {W2}"), _sql([W1, W2], *any_two))
add("not", _all(Not(Term(W1))), _sql([W1], "tf0 = 0", "1.0::DOUBLE"))
add("and_not", _lucene(f"the AND NOT {W1}"), _sql(["the", W1], "tf0 > 0 AND tf1 = 0", "e0"))
add("required_banned", _lucene(f"+the -{W1} is"), _sql(["the", W1], "tf0 > 0 AND tf1 = 0", "e0"))
add("boost", _lucene(f"{W1}^2.5 OR {W2}"), _sql([W1, W2], "tf0 > 0 OR tf1 > 0", "0.0 + e0 * 2.5::DOUBLE + e1"))
add("precedence", _lucene(f"{W2} OR {W1} AND the"), _sql([W2, W1, "the"], "tf0 > 0 OR (tf1 > 0 AND tf2 > 0)", "0.0 + e0 + CASE WHEN tf1 > 0 AND tf2 > 0 THEN e1 + e2 ELSE 0.0 END"))
_places = "len(list_filter(range(1, greatest(len(t), 1)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))"
add("phrase", _lucene('"of the"'), _sql(["of", "the"], f"{_places} > 0", f"(idf0 + idf1) * ({_places} * 2.2::DOUBLE) / ({_places} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))"))
add("prefix", _lucene("worth*"), _sql([], "len(list_filter(t, lambda x: starts_with(x, 'worth'))) > 0", "1.0::DOUBLE"))
add("wildcard", _all(Wildcard("w?r*less", "text")), _sql([], "len(list_filter(t, lambda x: regexp_full_match(x, 'w.r.*less'))) > 0", "1.0::DOUBLE"))
add("range", _lucene("n_chars:[100 TO 500}"), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars >= 100 AND n_chars < 500")
add("range_open", _lucene("n_chars:{2000 TO *]"), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars > 2000")
add("exists", _lucene("source:*"), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE source IS NOT NULL")
add("empty_query", _lucene("  "), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE false")


def _es(body: dict, strict: bool = False):
    return lambda spark, sf_dir: rounded(hits(docs(spark, sf_dir), es.query(body, strict)))


add("ids", _es({"ids": {"values": [3, 5, 8]}}), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE doc_id IN (3, 5, 8)")
add("es_match", _es({"match": {"text": f"{W1} {W2}"}}), _sql([W1, W2], *any_two))
add("es_match_strict", _es({"match": {"text": "of the"}}, True), SQL["phrase"])
add("es_match_phrase", _es({"match_phrase": {"text": "of the"}}), SQL["phrase"])
add("es_multi_match", _es({"multi_match": {"query": W1, "fields": ["text^2"]}}), _sql([W1], "tf0 > 0", "e0 * 2.0::DOUBLE"))
add("es_term", _es({"term": {"lang": {"value": "de"}}}), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lang = 'de'")
add("es_terms", _es({"terms": {"lang": ["de", "es"]}}), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lang IN ('de', 'es')")
add("es_range", _es({"range": {"n_chars": {"gt": 100, "lte": 900}}}), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars > 100 AND n_chars <= 900")
add("es_exists", _es({"exists": {"field": "lang"}}), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lang IS NOT NULL")
add("es_prefix", _es({"prefix": {"text": "worth"}}), SQL["prefix"])
add("es_wildcard", _es({"wildcard": {"text": {"value": "w?r*less"}}}), SQL["wildcard"])
add("es_query_string", _es({"query_string": {"query": f"{W1} AND the"}}), SQL["and"])
add(
    "bool_must_should",
    _es({"bool": {"must": [{"match": {"text": "the"}}], "filter": [{"range": {"n_chars": {"gte": 300}}}], "should": [{"term": {"lang": "en"}}, {"match": {"text": W1}}], "must_not": [{"ids": {"values": [1, 2]}}]}}),
    _sql(["the", W1], "tf0 > 0 AND n_chars >= 300 AND (lang = 'en' OR tf1 > 0) AND doc_id NOT IN (1, 2)", "e0 + 1.0 + (CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END + e1)"),
)
_top = "ORDER BY score DESC, doc_id"
_page_node = Or((Term(W1), Term(W2), Term(W3)))
_three = _sql([W1, W2, W3], "tf0 > 0 OR tf1 > 0 OR tf2 > 0", "0.0 + e0 + e1 + e2")
add("bm25_topk", lambda s, d: rounded(search(docs(s, d), _page_node, limit=10)), f"SELECT * FROM ({_three}) {_top} LIMIT 10")
add("offset_page", lambda s, d: rounded(search(docs(s, d), _page_node, limit=10, offset=10)), f"SELECT * FROM ({_three}) {_top} LIMIT 10 OFFSET 10")
add("min_score", lambda s, d: rounded(search(docs(s, d), _page_node, min_score=2.0, limit=1_000_000)), f"SELECT * FROM ({_three}) WHERE score >= 2.0")
add("total_hits", lambda s, d: total(docs(s, d), _page_node).withColumn("max_score", F.round("max_score", 6)), f"SELECT count(*) AS total, round(max(score), 6) AS max_score FROM ({_three})")
add("stored_fields", lambda s, d: rounded(search(docs(s, d), _page_node, limit=10, columns=["lang", "source"])), f"SELECT * FROM ({_sql([W1, W2, W3], 'tf0 > 0 OR tf1 > 0 OR tf2 > 0', '0.0 + e0 + e1 + e2', columns='doc_id, lang, source')}) {_top} LIMIT 10")
add("sort_by_field", lambda s, d: rounded(search(docs(s, d), Term(W1), limit=20, columns=["n_chars"], sort=[("n_chars", True)])), f"SELECT doc_id, n_chars, score FROM ({_sql([W1], 'tf0 > 0', 'e0', columns='doc_id, n_chars')}) ORDER BY n_chars DESC, doc_id LIMIT 20")
add("fields_restrict", lambda s, d: rounded(hits(docs(s, d, {"text": "default", "lang": "raw"}), Term("fr"), ["lang"])), """
WITH s AS (SELECT count(*)::DOUBLE AS n, count(lang)::DOUBLE AS all_len, sum((lang = 'fr')::INT)::DOUBLE AS df FROM documents)
SELECT doc_id, round(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (1.0::DOUBLE * 2.2::DOUBLE) / (1.0::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * 1.0::DOUBLE / (all_len / n))), 6) AS score FROM documents, s WHERE lang = 'fr'""")
add("field_weights", lambda s, d: rounded(hits(docs(s, d, weights={"text": 3.0}), Term(W1))), _sql([W1], "tf0 > 0", "e0 * 3.0::DOUBLE"))
add("simple_search", lambda s, d: rounded(simple_search(docs(s, d), W1, title="source", body="text")), f"SELECT doc_id, source AS title, text[1:100] AS snippet, score FROM ({_sql([W1], 'tf0 > 0', 'e0', columns='doc_id, source, text')}) {_top} LIMIT 10")
_tagged = r"""SELECT doc_id, CASE WHEN pos > 0 THEN regexp_replace(replace(replace(replace(text[greatest(1, pos - 37):greatest(1, pos - 37) + 149], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)\b(idiot|worthless)\b', '<em>\1</em>', 'g') END AS fragment
FROM (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?i)\b(idiot|worthless)\b') THEN length(regexp_extract(text, '(?is)^(.*?)\b(?:idiot|worthless)\b', 1)) + 1 ELSE 0 END AS pos FROM documents) WHERE pos > 0"""
add("highlight", lambda s, d: read(s, d, "documents").select("doc_id", highlight(F.col("text"), ["worthless", "idiot"]).alias("fragment")).where("fragment IS NOT NULL"), _tagged)
add("scan_term", lambda s, d: rounded(hits(Collection(read(s, d, "documents"), "doc_id", {"text": "default"}), Term(W1))), _sql([W1], "tf0 > 0", "e0"))
add("context_assembly", lambda s, d: rounded(context.assemble({"documents": docs(s, d), "benchmark": benchmark(s, d)}, Term(W1), limit=8)), _round_sql(" UNION ALL ".join(f"SELECT '{t}' AS collection, {i}::VARCHAR AS id, score, text FROM (SELECT * FROM ({_sql([W1], 'tf0 > 0', 'e0', table=t, columns=f'{i}, text')}) ORDER BY score DESC, {i} LIMIT 8)" for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))))
_places = TOKENS.format(c="text")
add("index_postings", lambda s, d: postings_of(read(s, d, "documents"), "doc_id", {"text": "default"}).select("term", F.col("id").alias("doc_id"), "tf", "dl", F.array_join(F.col("places").cast("array<string>"), " ").alias("places")), f"""
SELECT term, doc_id, count(*)::INT AS tf, any_value(dl)::INT AS dl, string_agg(i - 1, ' ' ORDER BY i) AS places
FROM (SELECT doc_id, dl, unnest(t) AS term, unnest(range(1, dl + 1)) AS i FROM (SELECT doc_id, t, len(t) AS dl FROM (SELECT doc_id, {_places} AS t FROM documents WHERE text IS NOT NULL))) GROUP BY term, doc_id""")


def _changed(s, d) -> DataFrame:
    """Half of the documents indexed, then some replaced, the rest added and some deleted."""
    rows = read(s, d, "documents").select("doc_id", "text")
    index = Index.build(rows.where("doc_id % 2 = 0"), "doc_id", {"text": "default"}, new_path(s, "index-changed"))
    index.upsert(rows.where("doc_id % 2 = 1 or doc_id % 10 = 0").withColumn("text", F.when(F.expr("doc_id % 10 = 0"), F.lit("the thing itself")).otherwise(F.col("text"))), "doc_id")
    index.delete(rows.where("doc_id % 7 = 0"), "doc_id")
    return rounded(hits(Collection(rows, "doc_id", {"text": "default"}, index=index), Term(W1)))


add("index_upsert_delete", _changed, f"WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'the thing itself' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0) SELECT * REPLACE (round(score, 6) AS score) FROM ({_sql([W1], 'tf0 > 0', 'e0', table='changed')})")

def _segments(s, d) -> DataFrame:
    rows = read(s, d, "documents")
    index = Index.build(rows, "doc_id", {"text": "default"}, new_path(s, "index-segments"))
    index.upsert(rows.where("doc_id % 5 = 0"), "doc_id").delete(rows.where("doc_id % 7 = 0"), "doc_id")
    return index.segment_stats().select("seg", "doc_count", "deleted_count", F.round("delete_ratio", 6).alias("delete_ratio"))


add("segment_stats", _segments, """
SELECT seg, count(*) FILTER (live) AS doc_count, count(*) FILTER (NOT live) AS deleted_count, round(count(*) FILTER (NOT live) / count(*)::DOUBLE, 6) AS delete_ratio
FROM (SELECT 0 AS seg, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS live FROM documents UNION ALL SELECT 1, doc_id % 7 <> 0 FROM documents WHERE doc_id % 5 = 0) GROUP BY seg""")


def _migrated(s, d) -> DataFrame:
    old = read(s, d, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    path = new_path(s, "lines")
    migrate.export_jsonl(old, path)
    return migrate.import_jsonl(s, path, migrate.schema_of("documents", old, "doc_id"), "doc_id").select("doc_id", F.md5("text").alias("text"), "lang", "source", "n_chars")


add("migrate_jsonl", _migrated, "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text, lang, source, n_chars FROM documents")

# tokenizers
add("default_tokens", lambda s, d: read(s, d, "documents").select("doc_id", F.array_join(default_tokens(F.col("text")), " ").alias("tokens")), f"SELECT doc_id, array_to_string({TOKENS.format(c='text')}, ' ') AS tokens FROM documents")
add("raw_tokens", lambda s, d: read(s, d, "documents").select("doc_id", F.array_join(text_functions.raw_tokens(F.col("source")), " ").alias("tokens")), "SELECT doc_id, source AS tokens FROM documents")
add("code_tokens", lambda s, d: read(s, d, "pages").select("page_id", F.array_join(text_functions.code_tokens(F.col("url")), " ").alias("tokens")), r"""
SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}]+', ' ', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g'), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), ' +'), lambda x: len(x) BETWEEN 1 AND 100), ' ') AS tokens FROM pages""")
add("comment_tokens", lambda s, d: read(s, d, "pages").select("page_id", F.array_join(text_functions.comment_tokens(F.col("url")), " ").alias("tokens")), r"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(url), '[^\p{L}\p{N}_]+'), lambda x: len(x) >= 2), ' ') AS tokens FROM pages")
add("code_language", lambda s, d: read(s, d, "pages").select("page_id", text_functions.code_language(F.col("url"), F.col("html")).alias("language")), "SELECT page_id, CASE WHEN regexp_matches(url, '\\.(html|css|js)$') THEN regexp_extract(url, '\\.([a-z]+)$', 1) WHEN regexp_matches(html, '(?i)<html') THEN 'html' END AS language FROM pages")
add("html_strip", lambda s, d: read(s, d, "pages").select("page_id", text_functions.html_strip(F.col("html")).alias("text")), "SELECT page_id, replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '') AS text FROM pages")
add("wikitext_strip", lambda s, d: read(s, d, "documents").select("doc_id", text_functions.wikitext_strip(F.concat(F.lit("'''"), F.col("source"), F.lit("''' {{box|{{inner|x}}}}[[File:a.png|thumb|of [[b]]]]is a [[link|name]]<ref name=\"r\">x</ref>.\n"), F.regexp_replace("text", r"(\w{4,})", "[[$1]]"))).alias("text")), r"SELECT doc_id, regexp_replace(trim(array_to_string(list_transform(string_split(source || ' is a name.' || chr(10) || text, chr(10)), lambda x: regexp_replace(x, '^[*#:;]+\s*', '')), chr(10)), ' ' || chr(10) || chr(9) || chr(13)), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")

# vocabulary
_vocab = f"SELECT term, count(*) AS doc_freq FROM (SELECT doc_id, unnest(list_distinct({TOKENS.format(c='text')})) AS term FROM documents) GROUP BY term"
def _words(s, d) -> DataFrame:
    return docs(s, d).index.vocabulary(["text"])


add("top_terms", lambda s, d: sg.top_terms(_words(s, d)), f"SELECT * FROM ({_vocab}) ORDER BY doc_freq DESC, term LIMIT 25")
add("vocabulary", _words, _vocab)
add("scan_vocabulary", lambda s, d: sg.vocabulary(read(s, d, "documents"), ["text"]), _vocab)
_by_prefix = f"SELECT term, round(doc_freq / max(doc_freq) OVER (), 6) AS score, doc_freq FROM ({_vocab}) WHERE starts_with(term, '{{}}') ORDER BY score DESC, term LIMIT 5"
_by_distance = f"SELECT term, round((1 - levenshtein(term, 'thnig') / greatest(len(term), 5)::DOUBLE) * 0.8::DOUBLE, 6) AS score, doc_freq FROM ({_vocab}) WHERE levenshtein(term, 'thnig') <= 2 AND NOT starts_with(term, 'thnig') ORDER BY score DESC, doc_freq DESC, term LIMIT 5"
add("suggest_prefix", lambda s, d: rounded(sg.suggest_prefix(_words(s, d), "thin", 5)), _by_prefix.replace("{}", "thin"))
add("suggest_fuzzy", lambda s, d: rounded(sg.suggest_fuzzy(_words(s, d), "thnig", 2, 5)), _by_distance)
add("suggest", lambda s, d: rounded(sg.suggest(_words(s, d), "thnig")), _by_distance)  # no term starts so
add("suggest_enough", lambda s, d: rounded(sg.suggest(_words(s, d), "th")), _by_prefix.replace("{}", "th"))
add("corrections", lambda s, d: rounded(sg.corrections(_words(s, d), s.createDataFrame([("worthles",), ("idiott",), ("pathetik",)], "word string")).select("word", "score")), f"""
SELECT word, max(round(1 - levenshtein(term, word) / greatest(strlen(term), strlen(word))::DOUBLE, 6)) AS score
FROM ({_vocab}), (VALUES ('worthles'), ('idiott'), ('pathetik')) w(word)
WHERE term <> word AND abs(len(term) - len(word)) <= len(word) AND round(1 - levenshtein(term, word) / greatest(strlen(term), strlen(word))::DOUBLE, 6) > 0.7 GROUP BY word""")
_like = "thing thing idiot worthless the the and of"
add("like_terms", lambda s, d: rounded(sg.like_terms(docs(s, d), _like, ["text"])), f"""
SELECT term, round(tf * (ln(n::DOUBLE / (1 + doc_freq)) + 1), 6) AS score
FROM (SELECT w AS term, count(*) AS tf FROM (SELECT unnest(string_split('{_like}', ' ')) AS w) GROUP BY w HAVING count(*) >= 2) JOIN ({_vocab}) USING (term), (SELECT count(*) AS n FROM documents)
WHERE doc_freq >= 5 ORDER BY score DESC, term LIMIT 25""")
add("more_like_this", lambda s, d: rounded(sg.more_like_this(docs(s, d), text="thing thing the the", size=10)), f"SELECT * FROM ({_sql(['thing', 'the'], *any_two)}) {_top} LIMIT 10")
add("reconstruct", lambda s, d: sg.reconstruct(docs(s, d), 3).select("field", F.array_join("terms", " ").alias("terms")), f"SELECT 'text' AS field, array_to_string(list_sort(list_distinct({TOKENS.format(c='text')})), ' ') AS terms FROM documents WHERE doc_id = 3")
add("and_builder", _all(Term(W1) & ~Term(W2)), _sql([W1, W2], "tf0 > 0 AND tf1 = 0", "e0"))
