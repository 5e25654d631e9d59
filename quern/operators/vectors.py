"""Exact nearest neighbours, and the deterministic text embedder."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vector import METRICS


def knn(df: DataFrame, vector: list[float], *, id_col: str, vector_col: str, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(id, score) of the k rows nearest to one vector: a scan and each task's best k.  Rows without a
    vector are left out; a vector of another length is an error, not a miss."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    v = F.col(vector_col)
    v = F.when(F.size(v) == len(vector), v).otherwise(F.raise_error(F.lit(f"a vector of {vector_col} has not {len(vector)} dimensions")))
    score = METRICS[metric](v, query)
    return df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def text_search(df: DataFrame, text: str, *, id_col: str, vector_col: str, k: int = 10, metric: str = "cosine", embedder: Callable[[str | None], list[float] | None] | None = None) -> DataFrame:
    """The k rows nearest to a text's vector."""
    return knn(df, (embedder or embed_text)(text), id_col=id_col, vector_col=vector_col, k=k, metric=metric)


class AnnIndex:
    """Approximate neighbours by random projections (the ml library's buckets).  Deleted ids are left out before the
    best are taken, so that pages are never short of them; ``compact`` fits again without them."""

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, *, bucket: float = 0.8, tables: int = 12, deleted: DataFrame | None = None):
        from pyspark.ml.feature import BucketedRandomProjectionLSH
        from pyspark.ml.functions import array_to_vector

        self.df, self.id_col, self.vector_col, self.how = df, id_col, vector_col, {"bucket": bucket, "tables": tables}
        norm = F.sqrt(F.aggregate(F.col(vector_col).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
        live = df.where(F.col(vector_col).isNotNull() & (norm > 0))
        self.deleted = deleted
        if deleted is not None:
            live = live.join(deleted.select(id_col), id_col, "left_anti")
        rows = live.select(F.col(id_col).alias("id"), array_to_vector(F.transform(F.col(vector_col).cast("array<double>"), lambda x: x / norm)).alias("unit"))
        self.model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(rows)
        self.rows = self.model.transform(rows)

    def delete(self, ids: DataFrame) -> AnnIndex:
        gone = ids.select(self.id_col)
        return AnnIndex(self.df, self.id_col, self.vector_col, **self.how, deleted=gone if self.deleted is None else self.deleted.select(self.id_col).union(gone))

    def deleted_ratio(self) -> float:
        n = self.df.count()
        return 0.0 if self.deleted is None or not n else self.df.join(self.deleted, self.id_col, "left_semi").count() / n

    def compact(self) -> AnnIndex:
        left = self.df if self.deleted is None else self.df.join(self.deleted, self.id_col, "left_anti")
        return AnnIndex(left, self.id_col, self.vector_col, **self.how)

    def search(self, vector: list[float], k: int = 10) -> DataFrame:
        """(id, score) by cosine: of unit vectors at distance d it is 1 - d^2 / 2."""
        from pyspark.ml.linalg import Vectors

        n = math.sqrt(sum(x * x for x in vector)) or 1.0
        near = self.model.approxNearestNeighbors(self.rows, Vectors.dense([x / n for x in vector]), k, distCol="d")
        return near.select("id", (1 - F.col("d") * F.col("d") / 2).alias("score")).orderBy(F.desc("score"), "id")


def shard_of(id_col: str, n: int) -> Column:
    """The shard of an id, from 0."""
    return F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")


def embed_text(text: str | None, dims: int = 32) -> list[float] | None:
    """The deterministic test embedder, plain Python a text.
    Sums, over the words, the bytes of each word's SHA-256 as parts of 255, the i-th component scaled by
    1 + 0.0001 i; then takes the sum to length 1.  A text without words is a zero vector."""
    if text is None:
        return None
    out = [0.0] * dims
    for word in text.split():
        digest = hashlib.sha256(word.encode()).digest()
        for i in range(dims):
            out[i] = (out[i] + digest[i % 32] / 255.0) * (1.0 + 0.0001 * i)
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def embed(df: DataFrame, text_col: str, to: str, embedder: Callable[[str | None], list[float] | None] = embed_text) -> DataFrame:
    """``df`` with a vector of ``text_col`` in ``to`` where that is missing or null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([embedder(t) for t in texts], dtype=object)

    new = run(F.col(text_col))
    return df.withColumn(to, F.coalesce(F.col(to).cast("array<double>"), new) if to in df.columns else new)


def embed_cached(df: DataFrame, cache: DataFrame, text_col: str, to: str, model: str = "default", embedder=embed_text) -> tuple[DataFrame, DataFrame]:
    """(df with vectors, new rows of the cache (key, vector)): texts in the cache are not embedded again."""
    key: Column = F.sha2(F.concat_ws(":", F.lit(model), F.col(text_col)), 256)
    keyed = df.withColumn("__key", key)
    missing = keyed.where(F.col(text_col).isNotNull()).select("__key", text_col).dropDuplicates(["__key"]).join(cache.select(F.col("key").alias("__key")), "__key", "left_anti")
    new = embed(missing, text_col, "vector", embedder).select(F.col("__key").alias("key"), "vector")
    all_ = cache.select("key", "vector").unionByName(new)
    return keyed.join(all_.select(F.col("key").alias("__key"), F.col("vector").alias(to)), "__key", "left").drop("__key"), new
