"""From raw documents to token ids in five stages, each an operator of the llm subpackage.

Every stage reads all that its predecessor kept, from a written table.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.langid import accepted, predict, train
from quern.llm.line_dedup import drop_boilerplate
from quern.llm.minhash_forest import near_duplicates
from quern.llm.mixing import apply_mix
from quern.llm.queries import tokenizer_path
from quern.llm.sentencepiece_codec import encode
from quern.llm.shared import Workspace, fold_of

#: A document is rejected without a letter, or if no language has this share of its n-grams.
LEAST_LANGUAGE_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the filters recognise; null and empty texts and texts without letters go.

    Labels that are null teach nothing.  Repeated rows fare alike.  Without labelled texts nothing is
    recognised and the result is empty, as it is of an empty table."""
    filters = train(docs.where(F.coalesce(fold_of(F.col("doc_id"), 4) != 2, F.lit(False))))
    if not filters.languages:
        return docs.where(F.lit(False))
    return predict(docs, filters).where(accepted(LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text.

    A null source is a source of its own; null and empty texts stay; a text all of whose lines are
    boilerplate stays as an empty one; a repeated row counts as another page."""
    out = drop_boilerplate(docs, text_col="text", host_col="source")
    changed = F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group whose texts are alike to 80 %.

    Texts without words, rows with a null id and ids with several texts are groups of their own; all rows of a kept
    id stay.  An empty table stays empty."""
    kept = near_duplicates(docs, width=5, percent=80).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null ids, sources and texts are values like others; sources rank by code points, null last."""
    return apply_mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the byte spans of their pieces, and whether decoding gives the text back.

    A null text is empty and has the end id alone.  Repeated rows get equal ids; an empty table stays empty."""
    path = tokenizer_path()
    out = encode(docs.select("doc_id", "lang", "source", "text"), path, round_trip=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends", "round_trip")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece", sentencepiece),
]

#: Language filters, MinHash and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.table(docs, name.replace(" ", "-"))
    return docs
