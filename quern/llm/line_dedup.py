"""Line dedup by site-relative frequency, in DataFrame operations.

A line is boilerplate of a host if at least ``min_pages`` pages of the host and more than
``ratio`` of them contain it.  Lines are compared without spaces, tabs and carriage returns
at their ends, by MD5; blank lines are never boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import Workspace

RATIO, MIN_PAGES = 0.1, 5
#: The boilerplate lists of all hosts are broadcast if they hold so many lines in all, 16 bytes
#: each; above it they are joined to salted pages.
BROADCAST_LINES = 200_000
SALTS = 64
_ENDS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(_ENDS)).cast("binary")))


def boilerplate(pages: DataFrame, *, text_col: str, host_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): for each host that has any, the keys of its boilerplate lines.

    Fewer than (lines of a page on average) / ratio keys a host.  Counts are summed
    before the shuffle, so a line or host of many pages costs each task one row."""
    blank = F.unhex(F.md5(F.lit("").cast("binary")))
    keys = F.array_distinct(F.transform(_lines(F.col("text")), _key))
    rows = pages.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    found = rows.select("host", F.explode(keys).alias("key")).where(F.col("key") != blank)
    found = found.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("host", "h")
    often = found.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("key").alias("lines"))


def drop_boilerplate(
    pages: DataFrame, *, text_col: str = "text", host_col: str = "source",
    ratio: float = RATIO, min_pages: int = MIN_PAGES, workspace: Workspace | None = None,
) -> DataFrame:
    """``pages`` with the boilerplate lines cut from ``text_col``, and two more columns:
    ``lines_all`` and ``lines_dropped`` (a clashing name is replaced).

    A null text stays null and has no lines; an empty text is one blank line and stays.  A null
    host is a host of its own.  A repeated row counts as another page.  A page all of whose lines
    are boilerplate keeps an empty text.  An empty table gives an empty result."""
    ws = workspace or Workspace(pages.sparkSession, "line-dedup")
    lists = ws.table(boilerplate(pages, text_col=text_col, host_col=host_col, ratio=ratio, min_pages=min_pages), "boilerplate")
    lists = lists.select(F.col("host").alias("__ld_host"), F.col("lines").alias("__ld_drop"))
    n = lists.agg(F.coalesce(F.sum(F.size("__ld_drop")), F.lit(0))).first()[0]
    host = F.col(host_col).cast("string")
    columns = [c for c in pages.columns if c not in ("lines_all", "lines_dropped")]
    rows = pages.select(*[F.col(f"`{c}`") for c in columns])
    if n <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(lists), host.eqNullSafe(F.col("__ld_host")), "left")
    else:  # a host of many pages is dealt over SALTS tasks
        lists = lists.withColumn("__ld_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("__ld_page", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = salted.join(lists, host.eqNullSafe(F.col("__ld_host")) & (F.col("__ld_page") == F.col("__ld_salt")), "left")
    lines = _lines(F.col(text_col))
    kept = F.when(F.col("__ld_drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("__ld_drop"), _key(x))))
    joined = joined.withColumn("__ld_kept", kept)
    total = F.coalesce(F.size(lines), F.lit(0))
    out = {c: F.col(f"`{c}`") for c in columns} | {text_col: F.array_join("__ld_kept", "\n")}
    return joined.select(
        *[x.alias(c) for c, x in out.items()],
        F.when(F.col(text_col).isNull(), 0).otherwise(total).cast("long").alias("lines_all"),
        F.when(F.col(text_col).isNull(), 0).otherwise(total - F.size("__ld_kept")).cast("long").alias("lines_dropped"),
    )
