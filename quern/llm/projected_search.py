"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Unit vectors are projected on a few Gaussian directions.  The squared projected distance of two
vectors at distance d is d^2 times a chi-square variable, so once the projected
neighbours of a query have been verified up to projected distance r, a vector nearer than the
k-th found (at distance d_k) is still unseen with a probability below 1 - F(r^2 / d_k^2).
The search stops when F passes ``confidence``.

The kd-tree has two levels: splits fitted on a bounded sample deal all rows to cells, and
each cell splits its own rows into leaves.  A query first searches its home cell; the d_k found
there decides which other cells lie before its stopping point.  Those are searched leaf by
leaf, nearest projected box first.

A cell that many queries need meets them in several tasks, and a cell of many rows is dealt to several
tasks: rows move only to cells that a query needs, as often as QUERIES fit into those queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import Workspace
from quern.llm.vectors import common_length, stack, unit, usable

DIMS, CONFIDENCE = 8, 0.98
#: Rows of a cell and a leaf, on average; rows that the splits are fitted on; bound of the cells.
CELL, LEAF, SAMPLE, MOST_CELLS = 4096, 64, 20_000, 4096
#: Queries, and rows of a cell, that meet in a task.
QUERIES, CELL_ROWS = 2048, 16_384


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.maximum(x, 0) / 2, 700)
    term = total = np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def directions(width: int, dims: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


class Splits:
    """A kd-tree as arrays: the widest dimension is cut at the median, level by level."""

    def __init__(self, points: np.ndarray, cells: int):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.dim, self.at = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        self._split(points, 1, self.depth)

    def _split(self, points: np.ndarray, node: int, left: int) -> None:
        if not left:
            return
        if len(points):
            self.dim[node] = int(np.argmax(points.max(0) - points.min(0)))
            self.at[node] = np.median(points[:, self.dim[node]])
        low = points[:, self.dim[node]] <= self.at[node]
        self._split(points[low], 2 * node, left - 1)
        self._split(points[~low], 2 * node + 1, left - 1)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[rows, self.dim[node]] > self.at[node])
        return node - (1 << self.depth)


def _leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        p = points[rows]
        order = np.argpartition(p[:, int(np.argmax(p.max(0) - p.min(0)))], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0) ** 2
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed in order of the components."""
    dot, aa, bb = (np.cumsum(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    return dot / np.sqrt(aa * bb)


def search_cell(q: np.ndarray, q_ids: np.ndarray, q_far: np.ndarray, v: np.ndarray, ids: list[np.ndarray], g: np.ndarray, k: int, confidence: float):
    """(query row, id, score) of the k best of a cell for each query; ``q_far``: the squared distance of
    its k-th so far, infinite if there are fewer.  ids: of each row, the equal vectors'."""
    qu, vu = unit(q), unit(v)
    qp, vp = qu @ g, vu @ g
    leaves = _leaves(vp, LEAF)
    low, high = np.array([vp[r].min(0) for r in leaves]), np.array([vp[r].max(0) for r in leaves])
    bound = box_distance(qp, low, high)
    order = np.argsort(bound, axis=1, kind="stable")
    many = np.array([len(x) for x in ids])
    best = np.full((len(q), k), -np.inf)  # similarities, with equal vectors counted up to k times
    got: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(q))]
    active = np.arange(len(q))
    for turn in range(len(leaves)):
        far = np.minimum(q_far[active], 2 - 2 * best[active, k - 1])
        r2 = bound[active, order[active, turn]]
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = chi_square(np.where(far > 0, r2 / far, np.where(r2 > 0, np.inf, 0)), g.shape[1])
        active = active[~(seen >= confidence)]
        if not active.size:
            break
        leaf = order[active, turn]
        by = np.argsort(leaf, kind="stable")
        for rows in np.split(active[by], np.flatnonzero(np.diff(leaf[by])) + 1):
            members = leaves[order[rows[0], turn]]
            s = qu[rows] @ vu[members].T
            worth = s >= best[rows, k - 1][:, None] - 1e-9
            for n, row in enumerate(rows):
                m = members[worth[n]]
                if m.size:
                    got[row].append((m, s[n][worth[n]]))
                    others = many[m] - np.array([q_ids[row] in ids[x] for x in m])
                    best[row] = np.sort(np.concatenate((best[row], np.repeat(s[n][worth[n]], np.minimum(others, k)))))[::-1][:k]
    out_q, out_id, out_v = [], [], []
    for row, parts in enumerate(got):
        if parts:
            m, s = (np.concatenate(x) for x in zip(*parts))
            for x in m[s >= best[row, k - 1] - 1e-9]:
                for i in ids[x]:
                    if i != q_ids[row]:
                        out_q.append(row)
                        out_id.append(i)
                        out_v.append(x)
    out_q, out_id, out_v = np.array(out_q, np.int64), np.array(out_id, np.int64), np.array(out_v, np.int64)
    score = cosine(q[out_q], v[out_v]) if out_q.size else np.empty(0)
    first = np.lexsort((out_id, -score, out_q))
    out_q, out_id, score = out_q[first], out_id[first], score[first]
    rank = np.arange(out_q.size) - np.searchsorted(out_q, out_q)
    return out_q[rank < k], out_id[rank < k], score[rank < k]


def nearest(
    rows: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
    dims: int = DIMS, confidence: float = CONFIDENCE, workspace: Workspace | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` its k nearest of ``rows`` by cosine, without
    its own id, nearest first, ties to the smaller id; all candidates if there are fewer.

    Vectors that are null, zero or hold null or non-finite components, vectors of another length than
    most of ``rows``, and rows with a null id, take no part on either side.  Of equal vectors only the k + 1
    smallest ids can be among the nearest, so no more are kept.  A repeated row counts once; a
    query id with several vectors is asked with one of them, the smallest.  Without usable
    rows or queries the result is empty.  Other columns are not read."""
    ws = workspace or Workspace(rows.sparkSession, "search")
    good = usable(rows, id_col, vector_col).distinct()
    width = common_length(good)
    good = good.where(F.size("v") == width)
    same = Window.partitionBy("v").orderBy("id")
    classes = good.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = ws.table(classes.select("ids", "v"), "classes")
    n = classes.count()
    asked = usable(queries, id_col, vector_col).where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"))
    if n == 0:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).where(F.lit(False))
    kind = classes.schema["v"].dataType.simpleString()

    # a bounded sample, the same in every run
    sample = unit(np.array(classes.orderBy(F.xxhash64(F.element_at("ids", 1), F.lit(3))).limit(SAMPLE).select("v").toPandas()["v"].tolist(), np.float64))
    g = directions(sample.shape[1], dims)
    splits = Splits(sample @ g, min(MOST_CELLS, math.ceil(n / CELL)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = unit(stack(batch.column(1))) @ g
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(splits.cell(p), pa.int64()), *[pa.array(p[:, d]) for d in range(dims)]], names=["id", "v", "cell", *[f"p{d}" for d in range(dims)]])

    coords = ", ".join(f"p{d} double" for d in range(dims))
    cells = ws.table(classes.select(F.col("ids").alias("id"), "v").mapInArrow(place, f"id array<long>, v {kind}, cell long, {coords}"), "cells")
    bounds = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), *[f(f"p{d}").alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(dims)]).toPandas()  # a row a cell
    home = asked.mapInArrow(place, f"id long, v {kind}, cell long, {coords}").select("id", "v", "cell")
    home = home.withColumn("far", F.lit(float("inf")))
    home = ws.table(home, "queries")
    low, high = (bounds[[f"{f}{d}" for d in range(dims)]].to_numpy() for f in ("min", "max"))
    names = bounds["cell"].to_numpy()

    def meet(key, asked_rows, cell_rows):
        got = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not asked_rows.num_rows or not cell_rows.num_rows:
            return got.empty_table()
        q, v = stack(asked_rows["v"].combine_chunks()), stack(cell_rows["v"].combine_chunks())
        q_ids, far = asked_rows["id"].to_numpy(), asked_rows["far"].to_numpy()
        ids = [np.array(x) for x in cell_rows["id"].to_pylist()]
        at, i, s = search_cell(q, q_ids, far, v, ids, g, k, confidence)
        return pa.table([pa.array(q_ids[at]), pa.array(i), pa.array(s)], schema=got)

    row_parts = rows.sparkSession.createDataFrame([(int(c), max(1, math.ceil(m / CELL_ROWS))) for c, m in zip(bounds["cell"], bounds["rows"])], "cell long, rp int")  # a row a cell

    def run(asked_rows: DataFrame) -> DataFrame:
        asked_rows = ws.table(asked_rows, "asked")
        wanted = asked_rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qp")).join(row_parts, "cell")
        wanted = F.broadcast(ws.table(wanted, "wanted"))  # at most MOST_CELLS rows
        some = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
        dealt = cells.select("id", "v", "cell").join(wanted, "cell").select("id", "v", "cell", one("id", "rp").alias("r"), some("qp").alias("q"))
        asked_rows = asked_rows.select("id", "v", "far", "cell").join(wanted, "cell").select("id", "v", "far", "cell", some("rp").alias("r"), one("id", "qp").alias("q"))
        return asked_rows.groupBy("cell", "r", "q").cogroup(dealt.groupBy("cell", "r", "q")).applyInArrow(meet, "query long, id long, score double")

    first = ws.table(run(home), "home")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    kth = first.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("query", (2 - 2 * F.col("score")).alias("d2"))
    known = home.join(kth, home["id"] == kth["query"], "left").select("id", "v", "cell", F.coalesce("d2", F.lit(float("inf"))).alias("far"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                r2 = box_distance(unit(stack(part.column(1))) @ g, low, high)
                far = np.maximum(part.column(3).to_numpy(), 1e-300)[:, None]
                go = (chi_square(r2 / far, dims) < confidence) & (names[None, :] != part.column(2).to_numpy()[:, None])
                i, c = np.nonzero(go)
                take = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), take.column(3), pa.array(names[c], pa.int64())], names=["id", "v", "far", "cell"])

    further = known.mapInArrow(others, f"id long, v {kind}, far double, cell long")
    rest = run(further)
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
