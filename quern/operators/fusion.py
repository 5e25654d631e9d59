"""Fusion of ranked lists (id, score): reciprocal ranks, weighted scores and merges of shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(page: DataFrame) -> DataFrame:
    """Ranks from 1.  A list is a page, whose length the query sets, so one task holds it."""
    return page.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))


def rrf(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """(id, score): sum of weight / (k + rank) over the lists."""
    weights = weights or [1.0] * len(lists)
    parts = [ranked(df).select("id", (F.lit(w) / (k + F.col("rank"))).alias("part")) for df, w in zip(lists, weights)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("score"))


def _normal(how: str, metric: str | None) -> Column:
    """A page's score after normalisation by its largest."""
    score, top = F.col("score"), F.max("score").over(Window.partitionBy(F.lit(0)))
    if how == "none" or how == "metric_aware" and metric == "cosine":
        return score
    if how == "metric_aware" and metric == "euclidean":
        score = F.greatest(score, F.lit(0.0))
    return F.when((top > 0) & ~F.isnan(top), score / top).otherwise(score)


def weighted(text: DataFrame, vectors: DataFrame, text_weight: float = 0.5, vector_weight: float = 0.5, how: str = "max_norm", metric: str = "cosine") -> DataFrame:
    """(id, score): weighted sum of both pages' scores, each normalised by its largest (``how``: none, max_norm,
    metric_aware)."""
    t = text.select("id", _normal(how, None).alias("t"))
    v = vectors.select("id", _normal(how, metric).alias("v"))
    score = F.lit(text_weight) * F.coalesce("t", F.lit(0.0)) + F.lit(vector_weight) * F.coalesce("v", F.lit(0.0))
    return t.join(v, "id", "full").select("id", score.alias("score"))


def merge_shards(shards: DataFrame, how: str = "simple", k: int = 60, weights: dict | None = None) -> DataFrame:
    """(id, score) of (shard, id, score): the best of each id after ``how``: simple, score_normalized
    (min-max a shard; equal scores give 1), zscore (equal scores stay), weighted (times the shard's weight,
    1 without one) or rrf.  Other names, two_phase among them, are simple.

    A shard's numbers are one row, sent to its rows.  rrf ranks a shard's list in one task: it is
    a page."""
    s = F.col("score")
    if how in ("score_normalized", "normalized", "zscore", "z_score"):
        one = shards.groupBy("shard").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"))
        shards = shards.join(F.broadcast(one), "shard")  # a row a shard
        if how in ("zscore", "z_score"):
            s = F.when(F.col("sd") > 0, (s - F.col("m")) / F.col("sd")).otherwise(s)
        else:
            s = F.when(F.col("hi") > F.col("lo"), (s - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    elif how == "weighted" and weights:
        factor = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        s = s * F.coalesce(F.element_at(factor, F.col("shard")), F.lit(1.0))
    elif how in ("rrf", "reciprocal_rank_fusion"):
        rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("score"), "id"))
        return shards.withColumn("part", 1.0 / (k + rank)).groupBy("id").agg(F.sum("part").alias("score"))
    return shards.withColumn("s", s).groupBy("id").agg(F.max("s").alias("score"))
