"""Embedding near-dedup with a pivot-permutation index.

Pivots are reference vectors drawn from the data, as far from each other as a sample allows, so that a
dense group does not draw more of them than its spread.  Their number is fixed for large tables: a link
is found by its place among the pivots alone, so recall stays level as rows grow.  A vector is
described by its ``order`` nearest pivots, nearest first.  Two vectors are candidates if their
descriptions share at least ``share`` pivots, and candidates are verified by the cosine in double
precision.

The inverted list of a pivot holds the vectors that have it in their description.  A list of more than
LONG vectors is divided by a second pivot, and by a third, up to ``share`` of them, which loses
no candidate: two vectors that share three pivots meet in the list of all three.  So lists
stay short while rows grow; only vectors that agree in ``share`` pivots meet in a list longer than that.

Equal vectors are one class and are counted, not paired.  A list is read in blocks against
blocks, so no task holds more than two blocks, however long the list; a pair that meets in
several lists is counted in the first alone.  Only counts and one hook a vector leave the
blocks, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import merge
from quern.llm.shared import Workspace, join_hot
from quern.llm.vectors import common_length, stack, unit, usable

#: So many pivots at most, chosen from so many vectors; one for so many vectors in small tables.
PIVOTS, PIVOT_SAMPLE, VECTORS_PER_PIVOT, FEWEST_PIVOTS = 256, 4096, 64, 16
#: Length of a description, pivots that candidates share, longest list that is not divided, block.
ORDER, SHARE, LONG, BLOCK = 10, 3, 4096, 4096
#: Blocks are compared in pieces of so many vectors, which bounds the pairs held at once.
PIECE = 1024
#: A vector with so many copies is a hot key of the last join.
HOT_COPIES = 100_000


def _spread(sample: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` of the unit vectors, each the farthest from those before it."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(m, len(sample)):
        near[chosen[-1]] = np.inf
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def _describe(pivots: np.ndarray, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(stack(batch.column(1)))
            k = min(order, len(pivots))
            near = np.empty((len(x), k), np.int32)
            for at in range(0, len(x), 2048):
                s = x[at : at + 2048] @ pivots.T
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                near[at : at + 2048] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
            ends = np.arange(len(x) + 1, dtype=np.int32) * k
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))], names=["id", "v", "copies", "near"])

    return run


def _pairs(a: dict, b: dict, same: bool, own: np.ndarray, threshold: float, share: int):
    """Verified pairs (i, j) of two blocks of a list: shared pivots first, then the cosine."""
    flat = np.concatenate([a["near"].ravel(), b["near"].ravel()])
    pivots, code = np.unique(flat, return_inverse=True)
    na = a["near"].size
    width = a["near"].shape[1]
    ma, mb = np.zeros((len(a["id"]), pivots.size), np.float32), np.zeros((len(b["id"]), pivots.size), np.float32)
    np.put_along_axis(ma, code[:na].reshape(-1, width), 1, 1)
    np.put_along_axis(mb, code[na:].reshape(-1, width), 1, 1)
    found = ma @ mb.T >= share
    if same:
        found &= np.tri(len(a["id"]), k=-1, dtype=bool)
    # the pair is counted in the list of the first pivots they share
    before = np.searchsorted(pivots, own[-1])
    found &= ma[:, :before] @ mb[:, :before].T == own.size - 1
    i, j = np.nonzero(found)
    keep = np.zeros(i.size, bool)
    for at in range(0, i.size, 1 << 18):
        p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        keep[at : at + (1 << 18)] = np.einsum("ij,ij->i", a["v"][p], b["v"][q]) >= threshold
    return i[keep], j[keep]


def _verify(threshold: float, share: int):
    """A group: two blocks (or one) of a list.  Out: (id, links, hook): links found here, and the smallest
    id linked here."""

    def run(key, table):
        *own, left, right = (k.as_py() for k in key)
        own = np.array([x for x in own if x >= 0])
        part = table["part"].to_numpy()
        sides = {}
        for p in {left, right}:
            t = table.filter(pa.array(part == p)).combine_chunks()
            near = stack(t["near"].combine_chunks()).astype(np.int32)
            sides[p] = {"id": t["id"].to_numpy(), "copies": t["copies"].to_numpy(), "v": unit(stack(t["v"].combine_chunks())), "near": near}
        a, b = sides[left], sides[right]
        out = [pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "hook": pa.array([], pa.int64())})]
        for p in range(0, len(a["id"]), PIECE):
            for q in range(0, p + 1 if left == right else len(b["id"]), PIECE):
                out += _piece({k: v[p : p + PIECE] for k, v in a.items()}, {k: v[q : q + PIECE] for k, v in b.items()}, left == right and p == q, own)
        return pa.concat_tables(out)

    def _piece(a: dict, b: dict, same: bool, own: np.ndarray):
        i, j = _pairs(a, b, same, own, threshold, share)
        if not i.size:
            return
        ids = np.concatenate([a["id"][i], b["id"][j]])
        other = np.concatenate([b["id"][j], a["id"][i]])
        copies = np.concatenate([b["copies"][j], a["copies"][i]])
        u, at = np.unique(ids, return_inverse=True)
        links = np.bincount(at, weights=copies).astype(np.int64)
        # every vector's smallest neighbour keeps each block's components whole only if chains meet: join them here
        yield pa.table({"id": u, "links": links, "hook": _local_roots(u, ids, other)})

    return run


def _local_roots(u: np.ndarray, ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The smallest id of each vector's component within the block's links."""
    a, b = np.searchsorted(u, ids), np.searchsorted(u, other)
    label = np.arange(u.size)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if (low == label).all():
            return u[label]
        label = low


def _lists(ws: Workspace, described: DataFrame, order: int, share: int, long: int) -> DataFrame:
    """Rows (l1, l2, l3, n, id, copies, v, near): every vector in its lists, those longer than ``long`` divided.

    A list's pivots are the first of those that its pairs share, so ``share - 1`` later ones must follow.
    Sizes of lists are at most one row for three pivots."""
    rows = described.withColumn("s", F.array_sort("near")).withColumn("at", F.lit(0)).select("id", "copies", "v", "near", "s", "at")
    none = F.lit(-1)
    out, names = [], []
    for level in range(1, share + 1):
        name = f"l{level}"
        names.append(name)
        picks = F.transform(F.sequence(F.col("at") + 1, F.lit(order - share + level)), lambda i: F.struct(F.element_at("s", i).alias(name), i.alias("at")))
        rows = rows.withColumn("pick", F.explode(picks)).select("id", "copies", "v", "near", "s", *names[:-1], F.col(f"pick.{name}").alias(name), "pick.at")
        sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = ws.table(sizes, "sizes")
        rows = rows.join(F.broadcast(sizes), names)  # at most 256 ** 3 / 6 rows, and only lists of two vectors or more
        whole = rows if level == share else rows.where(F.col("n") <= long)
        out.append(whole.select(*names, *[none.alias(f"l{k}") for k in range(level + 1, 4)], "n", "id", "copies", "v", "near"))
        if level == share or sizes.where(F.col("n") > long).isEmpty():
            break
        rows = rows.where(F.col("n") > long).drop("n")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def near_duplicates(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
    order: int = ORDER, share: int = SHARE, long: int = LONG, block: int = BLOCK, workspace: Workspace | None = None,
) -> DataFrame:
    """One row for each row of ``rows``: (vec_id, n_links, component_id, kept).

    Links join vectors of cosine >= ``threshold``.  n_links counts other rows linked directly, equal
    vectors among them; component_id is the smallest id reachable.  Vectors that are null, zero, or
    hold null or non-finite components, vectors of another length than most, and rows with a null id,
    link with nothing and are kept.  Rows that repeat an id count each; the id's row has the larger
    number of links and the smaller component.  An empty table gives an empty result.  Other
    columns are not read."""
    ws = workspace or Workspace(rows.sparkSession, "pivots")
    good = ws.table(usable(rows, id_col, vector_col), "usable")
    good = good.where(F.size("v") == common_length(good))
    classes = ws.table(good.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "v", "copies"), "classes")
    ids = rows.select(F.col(id_col).cast("long").alias("id"))
    n = classes.count()
    if not n:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    # a bounded sample, the same in every run; only usable vectors are pivots
    sample = classes.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(PIVOT_SAMPLE).select("v").toPandas()["v"]
    pivots = _spread(unit(np.array(sample.tolist(), np.float64)), min(PIVOTS, max(FEWEST_PIVOTS, n // VECTORS_PER_PIVOT)))
    order, share = min(order, len(pivots)), min(share, len(pivots))

    schema = f"id long, v {classes.schema['v'].dataType.simpleString()}, copies long, near array<int>"
    described = ws.table(classes.mapInArrow(_describe(pivots, order), schema), "described")
    # each list dealt into blocks by hash, each block met with itself and those after it
    dealt = _lists(ws, described, order, share, long).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    left = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("part")).alias("l"), F.greatest(x, F.col("part")).alias("r")))
    met = dealt.withColumn("meet", F.explode(left)).select("l1", "l2", "l3", "meet.l", "meet.r", "part", "id", "copies", "v", "near")
    found = met.groupBy("l1", "l2", "l3", "l", "r").applyInArrow(_verify(threshold, share), "id long, links long, hook long")
    found = ws.table(found.groupBy("id", "hook").agg(F.sum("links").alias("links")), "found")

    comps = merge(ws, found.select(F.col("id").alias("a"), F.col("hook").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # a vector without copies or links needs no row here
    reps = classes.join(links, "id", "left").join(comps, "id", "left").where("copies > 1 or links is not null")
    reps = ws.table(reps.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "id").alias("comp"), "copies"), "reps")
    of = join_hot(good, reps.select("v", "n", "comp"), "v", reps.where(F.col("copies") >= HOT_COPIES).select("v", "n", "comp"))
    of = of.where("n is not null").groupBy("id").agg(F.max("n").alias("n"), F.min("comp").alias("comp"))
    comp = F.coalesce("comp", "id")
    out = ids.join(of, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))
