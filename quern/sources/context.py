"""Passages of several collections for one question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.ast import Node
from quern.plans.search import Collection, search


def assemble(collections: dict[str, Collection], node: Node, *, limit: int = 8, text_col: str = "text") -> DataFrame:
    """(collection, id, score, text): the best ``limit`` of each collection with their texts."""
    parts = [search(c, node, limit=limit, columns=[text_col]).select(F.lit(name).alias("collection"), F.col(c.id_col).cast("string").alias("id"), "score", F.col(text_col).alias("text")) for name, c in collections.items()]
    return reduce(DataFrame.unionByName, parts)
