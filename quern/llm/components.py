"""Connected components by contraction, in DataFrame operations.

In each round every component hooks onto its smallest linked neighbour, chains of hooks are
shortened by pointer doubling, and links inside a component disappear.  The number of components
that still have links falls at least by half, so rounds grow as log(n).  Links are
never collected; a component may hold most of the rows, since its size shows only as a
key of joins whose other side has one row for it, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import Workspace


def _roots(ws: Workspace, hooks: DataFrame) -> DataFrame:
    """(c, p) with p < c: p becomes the end of its chain of hooks."""
    while True:
        up = hooks.select(F.col("c").alias("c2"), F.col("p").alias("p2"))
        nxt = hooks.join(up, hooks["p"] == up["c2"], "left").select("c", F.coalesce("p2", "p").alias("p"), F.col("p2").isNotNull().alias("moved"))
        nxt = ws.table(nxt, "hooks")
        hooks = nxt.select("c", "p")
        if nxt.where("moved").isEmpty():
            return hooks


def merge(ws: Workspace, links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """labels (id, comp) after the links (a, b) between components; ids without a row are
    components of their own, and so is every id that is not in a row of the result.

    comp is the smallest id of its component, given that this held for ``labels``."""
    links = ws.table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not links.isEmpty():
        hooks = _roots(ws, ws.table(links.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("p")), "hooks"))
        if labels is None:
            labels = hooks.select(F.col("c").alias("id"), F.col("p").alias("comp"))
        else:
            moved = labels.join(hooks, labels["comp"] == hooks["c"], "left").select("id", F.coalesce("p", "comp").alias("comp"))
            new = hooks.join(labels.select(F.col("id").alias("c")), "c", "left_anti").select(F.col("c").alias("id"), F.col("p").alias("comp"))
            labels = moved.unionByName(new)
        labels = ws.table(labels, "labels")
        links = ws.table(relabel(links, hooks), "links")
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return labels


def relabel(links: DataFrame, hooks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Links between the components that their ends now belong to; those inside one go.
    hooks: (c, p); carry: columns that are kept beside a and b, else links are distinct."""
    h1, h2 = hooks.select(F.col("c").alias("c1"), F.col("p").alias("p1")), hooks.select(F.col("c").alias("c2"), F.col("p").alias("p2"))
    out = links.join(h1, F.col("a") == F.col("c1"), "left").join(h2, F.col("b") == F.col("c2"), "left")
    out = out.select(F.coalesce("p1", "a").alias("x"), F.coalesce("p2", "b").alias("y"), *carry).where("x <> y")
    out = out.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), *carry)
    return out if carry else out.distinct()
