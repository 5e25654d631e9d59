"""Ranking of a matched table: boosts from the schema, and reranking of the best candidates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ranking import ScoreFunction, decay

DEFAULT_CANDIDATES = 100


def recency_age(columns: dict[str, str], field: str | None, now: Column) -> Column | None:
    """Seconds before ``now`` of the configured date column, else of ``_indexed_at``; nothing without either.
    Numbers are microseconds, strings are read as timestamps.  columns: types by name."""
    name = field if field in columns else "_indexed_at" if "_indexed_at" in columns else None
    if name is None:
        return None
    x = F.col(name)
    x = F.timestamp_micros(x.cast("bigint")) if columns[name] in ("bigint", "int") else x.try_cast("timestamp")
    return F.unix_timestamp(now) - F.unix_timestamp(x)


def apply_boosts(score: Column, *factors: Column | float) -> Column:
    """The score times every factor; a factor that is null counts 1."""
    return reduce(lambda s, f: s * (F.coalesce(f, F.lit(1.0)) if isinstance(f, Column) else f), factors, score)


def boost(
    found: DataFrame, *, now: Column | None = None, recency: dict | None = None, boost_col: str = "_boost", signals: dict[str, float] | None = None,
    id_col: str = "id", skip_ranking: bool = False,
) -> DataFrame:
    """score * decay * boost + sum of signal * weight, sorted again, ties to the smaller id.

    recency: field, kind, scale, rate and offset (seconds).  A missing or null boost counts 1, a missing or
    null signal 0.  ``skip_ranking`` leaves the scores as they are."""
    types = dict(found.dtypes)
    score = F.col("score")
    if not skip_ranking:
        if recency and now is not None:
            age = recency_age(types, recency.get("field"), now)
            if age is not None:
                factor = decay(recency.get("kind", "exponential"), age, recency["scale"], recency.get("rate", 0.5), recency.get("offset", 0.0))
                score = apply_boosts(score, factor)
        if boost_col in types:
            score = apply_boosts(score, F.col(boost_col).try_cast("double"))
        for name, weight in (signals or {}).items():
            if name in types:
                score = score + F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) * weight
    return found.withColumn("score", score).orderBy(F.desc("score"), id_col)


def rerank_config(schema: dict | None, request: dict | None) -> dict | None:
    """The request's reranking settings over the schema's; nothing if either lacks or the request turns it off."""
    if request is not None and request.get("enabled") is False:
        return None
    if not schema and not request:
        return None
    merged = {"candidates": DEFAULT_CANDIDATES} | (schema or {}) | {k: v for k, v in (request or {}).items() if v is not None and k != "enabled"}
    return merged


def rerank_text(df: DataFrame, fields: list[str] | None = None) -> Column:
    """What a reranker reads: the fields, or all string columns, joined by a space; nulls are left out."""
    names = fields or [n for n, t in df.dtypes if t == "string"]
    return F.concat_ws(" ", *[F.col(n) for n in names])


def score_function_reranker(text: str) -> Callable[[DataFrame], Column]:
    """A reranker from a score function."""
    return lambda df: ScoreFunction(text).column(F.col("score"), dict(df.dtypes))


def model_reranker(score_pairs, query: str, fields: list[str] | None = None) -> Callable[[DataFrame], Column]:
    """A reranker from a pandas UDF (query, text) -> double; without one the scores pass through."""
    if score_pairs is None:
        return lambda df: F.col("score")
    return lambda df: score_pairs(F.lit(query), rerank_text(df, fields))


def rerank(first: Callable[[int], DataFrame], reranker: Callable[[DataFrame], Column], limit: int, *, candidates: int = DEFAULT_CANDIDATES, id_col: str = "id") -> DataFrame:
    """Two phases: the ``max(candidates, limit)`` best of the first get new scores, are sorted again and cut.
    A score that comes out null stays what it was."""
    found = first(max(candidates, limit))
    return found.withColumn("score", F.coalesce(reranker(found), F.col("score"))).orderBy(F.desc("score"), id_col).limit(limit)
