"""Searches of several legs: text with vectors, and several collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.aggregations import aggregate
from quern.operators.fusion import ranked, rrf, weighted
from quern.operators.vectors import knn
from quern.plans.ast import Node, QueryError
from quern.plans.search import Collection, search
from quern.sources.collection import expand

#: A leg gives so many candidates at least.
CANDIDATES = 100


def strategy(asked: str | None, default: str | None) -> str:
    """The request's strategy, else the schema's; what is not "weighted" is rank fusion."""
    return "weighted" if (asked or default) == "weighted" else "rrf"


def hybrid_search(
    c: Collection, node: Node | None, vector: list[float] | None, *, vector_col: str, limit: int = 10, how: str | None = None, default: str | None = None,
    text_weight: float = 0.5, vector_weight: float = 0.5, normalise: str = "max_norm", metric: str = "cosine", candidates: int = CANDIDATES, vectors: DataFrame | None = None,
) -> DataFrame:
    """(id, score) of a page found by text and by vector.  Without a vector it is the text page, without
    a query the vector page.  ``vectors``: a table with the id and vector columns, if not the collection's."""
    most = max(limit, candidates)
    if node is None and vector is None:
        raise QueryError("neither a query nor a vector")
    text = None if node is None else search(c, node, limit=most).select(F.col(c.id_col).alias("id"), "score")
    near = None if vector is None else knn(c.df if vectors is None else vectors, vector, id_col=c.id_col, vector_col=vector_col, k=most, metric=metric)
    if text is None or near is None:
        both = near if text is None else text
    elif strategy(how, default) == "weighted":
        both = weighted(text, near, text_weight, vector_weight, normalise, metric)
    else:
        both = rrf([text, near])
    return both.orderBy(F.desc("score"), "id").limit(limit)


def hybrid_aggregations(c: Collection, page: DataFrame, specs: dict[str, dict]) -> dict[str, DataFrame]:
    """Aggregations over the documents of a hybrid page."""
    return aggregate(c, c.df.join(F.broadcast(page.select(F.col("id").alias(c.id_col))), c.id_col, "left_semi"), specs)  # a page


def hybrid_get(text: DataFrame, vectors: DataFrame, doc_id, id_col: str = "id") -> DataFrame:
    """The text side's row if there is one, with the vector side's other columns."""
    t, v = text.where(F.col(id_col) == doc_id), vectors.where(F.col(id_col) == doc_id)
    return t.join(v.select(id_col, *[c for c in v.columns if c not in t.columns]), id_col, "full")


def hybrid_count(text: DataFrame, vectors: DataFrame) -> int:
    return max(text.count(), vectors.count())


def multi_search(collections: dict[str, Collection], patterns: list[str], node: Node, *, limit: int = 10, offset: int = 0, k: int = 60) -> tuple[DataFrame, dict[str, str]]:
    """(_collection, id, score) of the collections that the patterns name, fused by rank, and the errors of those
    that cannot run the query, which are left out.  An offset counts inside the merged list."""
    names = sorted({n for p in patterns for n in expand(sorted(collections), p)})
    parts, errors = [], {}
    for name in names:
        c = collections[name]
        try:
            page = search(c, node, limit=limit + offset).select(F.col(c.id_col).alias("id"), "score")
            parts.append(ranked(page).select(F.lit(name).alias("_collection"), F.col("id").cast("string").alias("id"), (1.0 / (k + F.col("rank"))).alias("score")))
        except QueryError as e:
            errors[name] = str(e)
    if not parts:
        raise QueryError(f"no collection can run the query: {errors or patterns}")
    merged = reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "_collection", "id")
    return (merged.offset(offset) if offset else merged).limit(limit), errors
