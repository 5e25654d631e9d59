"""A property graph as two tables: nodes (id, node_type, title, payload), edges (src, dst, edge_type, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.ast import QueryError
from quern.sources.storage import written


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """The last write of an id wins.  Among new rows of one id that is the one of the largest ``seq``, if
    there is that column, else the greatest row."""
    rest = [c for c in nodes.columns if c != "id"]
    order = F.struct(*(["seq"] if "seq" in new.columns else []), *rest)
    last = new.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(last)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes and the edges that touch them."""
    gone = ids.select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def add_edges(edges: DataFrame, new: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Parallel edges stay; with configured types others are an error."""
    if types and not new.where(~F.col("edge_type").isin(types)).isEmpty():
        raise QueryError("an edge has a type that is not configured")
    return edges.unionByName(new)


def remove_edges(edges: DataFrame, src, dst, edge_type: str | None = None) -> DataFrame:
    hit = (F.col("src") == src) & (F.col("dst") == dst)
    return edges.where(~(hit & (F.col("edge_type") == edge_type) if edge_type else hit))


def out_edges(edges: DataFrame, src, edge_type: str | None = None) -> DataFrame:
    out = edges.where(F.col("src") == src)
    return out.where(F.col("edge_type") == edge_type) if edge_type else out


def bfs(edges: DataFrame, start: DataFrame, depth: int = 3, edge_type: str | None = None) -> DataFrame:
    """(id, depth): what is reached from ``start`` (a table with ``id``) along edges of a type, without the
    start.  Each level is a join of the frontier; lineage is cut at each level."""
    e = (edges.where(F.col("edge_type") == edge_type) if edge_type else edges).select("src", "dst").distinct()
    seen = start.select(F.col("id"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        nxt = e.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = _cut(nxt.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, start, target, types: list[str] | None = None) -> list | None:
    """The ids of the cheapest path, or nothing.  Distances are relaxed until none falls; weights are not
    negative, so that comes to an end."""
    if not edges.where("weight < 0").isEmpty():
        raise QueryError("an edge has a negative weight")
    if start == target:
        return [start]
    e = (edges.where(F.col("edge_type").isin(types)) if types else edges).groupBy("src", "dst").agg(F.min("weight").cast("double").alias("w"))
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    best = spark.createDataFrame([(start, 0.0, None)], f"id {kind}, cost double, prior {kind}")
    frontier = best
    while True:
        step = e.join(frontier.select(F.col("id").alias("src"), "cost"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("prior"))).alias("m")).select("id", "m.cost", "m.prior")
        old = best.select(F.col("id").alias("o"), F.col("cost").alias("oc"))
        frontier = _cut(step.join(old, step["id"] == old["o"], "left").where(F.col("oc").isNull() | (F.col("cost") < F.col("oc"))).select("id", "cost", "prior"))
        if frontier.isEmpty():
            break
        best = _cut(best.join(frontier.select("id"), "id", "left_anti").unionByName(frontier))
    path, at = [target], target
    while at != start:
        row = best.where(F.col("id") == at).first()
        if row is None:
            return None
        at = row["prior"]
        path.append(at)
    return path[::-1]


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def stats(edges: DataFrame) -> DataFrame:
    """(edge_type, edges)."""
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"))


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables in one folder; edges by type, so that a walk along one type reads only that."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def _cut(df: DataFrame) -> DataFrame:
    """A written table, so that levels do not pile up lineage."""
    return written(df, "graph")
