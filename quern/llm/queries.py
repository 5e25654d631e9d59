"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import pivot_dedup, toxicity
from quern.llm.html_text import extract_text
from quern.llm.langid import predict, train
from quern.llm.line_dedup import drop_boilerplate
from quern.llm.minhash_forest import near_duplicates
from quern.llm.mixing import mix
from quern.llm.projected_search import nearest
from quern.llm.sentencepiece_codec import encode
from quern.llm.shared import fold_of
from quern.llm.token_counts import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer's file, which every executor has at the same place."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    net = toxicity.train(docs.where(~held_out), _read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), net)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    rows = encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(_read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op4_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.9)


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(id, to_id) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id) c ON c.id = e.vec_id
"""


def op5_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"), k=5).select("query_id", "rank", "vec_id", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(_read(spark, sf_dir, "documents"), text_col="text", host_col="source", ratio=0.1, min_pages=5)
    return out.select("doc_id", "source", "lines_all", "lines_dropped", "text")


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, i, l[i] AS line, trim(l[i], ' ' || chr(9) || chr(13)) AS k
  FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
), totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (
  SELECT f.source, f.k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM lines WHERE k <> '' GROUP BY source, k) f
  JOIN totals t ON f.source IS NOT DISTINCT FROM t.source WHERE f.n >= 5 AND f.n > 0.1::DOUBLE * t.pages
), marked AS (
  SELECT l.*, o.k IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.k = o.k
), agg AS (
  SELECT doc_id, count(*) AS lines_all, count(*) FILTER (WHERE gone) AS lines_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, d.source, coalesce(a.lines_all, 0) AS lines_all, coalesce(a.lines_dropped, 0) AS lines_dropped, a.text
FROM documents d LEFT JOIN agg a USING (doc_id)
"""


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op8_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    filters = train(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), filters).select("doc_id", "held_out", "lang_pred", "score")


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), width=5, percent=85)


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x.a, x.b FROM both_ x JOIN sizes p ON x.a = p.doc_id JOIN sizes q ON x.b = q.doc_id WHERE 100 * x.n >= 85 * (p.n + q.n - x.n)
), reach(id, to_id) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a
), comp AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d JOIN comp c ON c.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).select("doc_id", "n_tokens")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_mix_sources": op3_mix_sources,
    "op4_pivot_dedup": op4_pivot_dedup,
    "op5_projected_search": op5_projected_search,
    "op6_line_dedup": op6_line_dedup,
    "op7_html_text": op7_html_text,
    "op8_language_filters": op8_language_filters,
    "op9_minhash_forest": op9_minhash_forest,
    "op10_token_counts": op10_token_counts,
}
SQL: dict[str, str] = {"op4_pivot_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL, "op9_minhash_forest": OP9_SQL}
