"""Vocabulary operators: top terms, suggestions, corrections, similar documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import default_tokens
from quern.plans.ast import Or, QueryError, Term
from quern.plans.search import Collection, search

#: So many words of a text are pushed down to the term table; more are joined.
MOST_PUSHED = 1000


def vocabulary(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """(term, doc_freq): documents that hold a term, summed over the fields."""
    parts = None
    for c in text_cols:
        p = df.select(F.explode(F.array_distinct(default_tokens(F.col(c)))).alias("term"))
        parts = p if parts is None else parts.unionAll(p)
    return parts.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))


def top_terms(vocab: DataFrame, limit: int = 25) -> DataFrame:
    return vocab.orderBy(F.desc("doc_freq"), "term").limit(limit)


def suggest_prefix(vocab: DataFrame, prefix: str, size: int = 5) -> DataFrame:
    """(term, score, doc_freq): terms that start so, scored by frequency over the most frequent's."""
    hits = vocab.where(F.col("term").startswith(prefix))
    best = hits.orderBy(F.desc("doc_freq"), "term").limit(size)  # the most frequent of all is its first row
    top = F.max("doc_freq").over(Window.partitionBy(F.lit(0)))
    return best.select("term", (F.col("doc_freq") / top).alias("score"), "doc_freq").orderBy(F.desc("score"), "term")


def suggest_fuzzy(vocab: DataFrame, word: str, distance: int = 2, size: int = 5) -> DataFrame:
    """(term, score, doc_freq): terms within an edit distance, scored (1 - d / longer) * 0.8."""
    d = F.levenshtein(F.col("term"), F.lit(word))
    near = vocab.where(F.abs(F.length("term") - len(word)) <= distance).where((d <= distance) & ~F.col("term").startswith(word))
    longer = F.greatest(F.length("term"), F.lit(len(word))).cast("double")
    scored = near.select("term", ((1 - d / longer) * 0.8).alias("score"), "doc_freq")
    return scored.orderBy(F.desc("score"), F.desc("doc_freq"), "term").limit(size)


def suggest(vocab: DataFrame, word: str, size: int = 5, distance: int = 2) -> DataFrame:
    """Terms that start with the word; if they are fewer than ``size``, near ones fill up."""
    prefix = suggest_prefix(vocab, word, size)
    if prefix.count() >= size:
        return prefix
    both = prefix.unionByName(suggest_fuzzy(vocab, word, distance, size))
    return both.groupBy("term").agg(F.max("score").alias("score"), F.max("doc_freq").alias("doc_freq")).orderBy(F.desc("score"), F.desc("doc_freq"), "term").limit(size)


def corrections(vocab: DataFrame, words: DataFrame, word_col: str = "word", least: float = 0.7) -> DataFrame:
    """(word, correction, score): for each word that is not a term the best term by 1 - distance / longer
    in bytes, if better than ``least``.  The words of a query are few: they are sent to the vocabulary."""
    w = F.broadcast(words.select(F.lower(F.col(word_col)).alias("word")).distinct())
    longer = F.greatest(F.octet_length("term"), F.octet_length("word")).cast("double")
    pairs = vocab.join(w, (F.abs(F.length("term") - F.length("word")) <= F.length("word")) & (F.col("term") != F.col("word")))
    scored = pairs.withColumn("score", 1 - F.levenshtein("term", "word") / longer).where(F.col("score") > least)
    best = scored.groupBy("word").agg(F.max(F.struct("score", "doc_freq", F.expr("transform(split(term, ''), x -> -ascii(x))").alias("o"), "term")).alias("b"))
    return best.select("word", F.col("b.term").alias("correction"), F.col("b.score").alias("score"))


def did_you_mean(vocab: DataFrame, query: str, top: int = 1000) -> str | None:
    """The query with misspelt words replaced, or nothing if no word changes."""
    spark = vocab.sparkSession
    words = query.split()
    if not words:
        return None
    frequent = vocab.orderBy(F.desc("doc_freq"), "term").limit(top)
    fixed = {r["word"]: r["correction"] for r in corrections(frequent, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    known = {r["term"] for r in frequent.where(F.col("term").isin([w.lower() for w in words])).collect()}
    out = [w if w.lower() in known else fixed.get(w.lower(), w) for w in words]
    return " ".join(out) if out != words else None


def like_terms(c: Collection, text: str, fields: list[str], min_tf: int = 2, min_df: int = 5, limit: int = 25) -> DataFrame:
    """(term, score): the text's words by tf * (ln(N / (1 + df)) + 1)."""
    spark = c.df.sparkSession
    words = [w for w in text.lower().split() if len(w.encode()) >= 2]
    tf = spark.createDataFrame([(w,) for w in words], "term string").groupBy("term").agg(F.count(F.lit(1)).alias("tf")).where(F.col("tf") >= min_tf)
    vocab = vocabulary(c.df, fields) if c.index is None else c.index.vocabulary(fields)
    df = vocab.where(F.col("term").isin(list(set(words)))) if len(words) <= MOST_PUSHED else vocab
    n = float(c.df.count() if c.index is None else c.index.n)
    score: Column = F.col("tf") * (F.log(F.lit(n) / (1 + F.col("doc_freq"))) + 1)
    return df.where(F.col("doc_freq") >= min_df).join(F.broadcast(tf), "term").select("term", score.alias("score")).orderBy(F.desc("score"), "term").limit(limit)


def more_like_this(c: Collection, *, doc_id=None, text: str | None = None, fields: list[str] | None = None, size: int = 10, **how) -> DataFrame:
    """A page of documents like a stored one or a text, without the stored one."""
    fields = fields or list(c.text_fields)
    if text is None and doc_id is None:
        raise QueryError("similar to what?")
    if text is None:
        row = c.df.where(F.col(c.id_col) == doc_id).select(*fields).first()
        text = " ".join(x for x in row if x) if row else ""
    terms = [r["term"] for r in like_terms(c, text, fields, **how).collect()] if text else []  # at most ``limit`` terms
    if not terms:
        return search(c, Or(())).limit(0)
    page = search(c, Or(tuple(Term(t) for t in terms)), limit=size + (doc_id is not None), fields=fields)
    return page if doc_id is None else page.where(F.col(c.id_col) != doc_id).limit(size)


def reconstruct(c: Collection, doc_id) -> DataFrame:
    """(field, terms): the distinct terms of one document's fields, sorted."""
    row = c.df.where(F.col(c.id_col) == doc_id)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.array_sort(F.array_distinct(default_tokens(F.col(f)))).alias("terms")) for f in c.text_fields])
    return row.select(F.explode(fields).alias("x")).select("x.field", "x.terms")
