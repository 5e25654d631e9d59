"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations.

Each row of a source should be taken ``target / source size`` times.  The whole part of that
rate is certain.  The fractional parts of a source are rounded dependently: two rows meet, word
mass passes at random from one to the other until one of the two is wholly in or out, and
the other goes on with the rest.  A pass keeps the expected number of words, exactly, so what
a source loses or gains in all is less than its last row.

Rows meet in blocks of about ``block``; what each block leaves over (one row) meets
in the blocks of the next level, a tree of ``log(n) / log(block)`` levels.  No task holds
more than a block of a source, whatever the source's share of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import BROADCAST_ROWS, Workspace, n_words, small

BLOCK = 64
#: Repeats of a row come in runs of so many.
REPEATS = 10_000


def source_targets(units: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """(source, source_size, n, base, part, target) from (source, mass, size, mult) rows.

    Sources in order of code points, null last, take the weights in turn.  A target that would
    pass ``cap`` times its source's size stays there; the rest is shared by weight.  The
    sources that stay are those of smallest size for their weight, so one pass in that order
    finds them.  The window has one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    # only rows of some words meet in blocks
    s = units.groupBy("source").agg(F.sum("mass").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("most", F.col("source_size") * cap).withColumn("room", F.col("most") / F.col("weight"))
    s = s.withColumns({
        "total": F.sum("source_size").over(every) * share,
        "all_w": F.sum("weight").over(every),
        "used": F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "used_w": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    s = s.withColumn("level", (F.col("total") - F.col("used")) / (F.col("all_w") - F.col("used_w")))
    s = s.withColumn("full", F.col("level") >= F.col("room"))
    # the level at the first source that does not stay at its most
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.struct("room", "level"))).over(every)["level"])
    s = s.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("most"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "n", F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("part"), "target")


def _uniform(*cols) -> Column:
    """In [0, 1), from the values alone: reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _take(acc: Column, b: Column, seed: int) -> Column:
    """The state (settled, rest) of a block after its rest has met the unit ``b``.

    The rest a gains ``up`` words from b with chance down / (up + down), else loses ``down`` to
    it: words in expectation stay, and one of the two gets whole or empty."""
    a = acc["rest"]
    a_in, a_room, b_in, b_room = a["p"] * a["mass"], (1 - a["p"]) * a["mass"], b["p"] * b["mass"], (1 - b["p"]) * b["mass"]
    up, down = F.least(a_room, b_in), F.least(a_in, b_room)
    gains = _uniform(a["id"], a["size"], b["id"], b["size"], F.lit(seed)) * (up + down) < down
    moved = F.struct(
        F.when(gains, up).otherwise(-down).alias("words"),
        F.when(gains, a_room <= b_in).otherwise(a_in <= b_room).alias("a_settles"),
    )

    def after(m: Column) -> Column:
        pair = F.array(_unit(a, a["p"] + m["words"] / a["mass"]), _unit(b, b["p"] - m["words"] / b["mass"]))
        first = F.when(m["a_settles"], 0).otherwise(1)
        return F.struct(F.concat(acc["settled"], F.array(pair[first])).alias("settled"), pair[1 - first].alias("rest"))

    return F.transform(F.array(moved), after)[0]  # the array binds what has moved once


def _unit(x: Column, p: Column) -> Column:
    return F.struct(x["id"].alias("id"), x["size"].alias("size"), x["mult"].alias("mult"), x["mass"].alias("mass"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))


def _blocks(rows: DataFrame, level: int, block: int, seed: int) -> DataFrame:
    """One row a block: what it settled, and its rest.  rows: (source, n, unit)."""
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(block**level))))
    unit = F.col("unit")
    met = rows.groupBy(
        "source", "n", F.pmod(F.xxhash64(unit["id"], unit["size"], F.lit(seed + level)), count).alias("block")
    ).agg(F.sort_array(F.collect_list("unit")).alias("units"))

    first = F.col("units")[0]
    none = F.filter(F.col("units"), lambda x: F.lit(False))
    folded = F.aggregate(F.slice("units", 2, F.size("units")), F.struct(none.alias("settled"), first.alias("rest")), lambda acc, x: _take(acc, x, seed + level))
    return met.select("source", "n", folded.alias("f")).select("source", "n", "f.settled", "f.rest")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, seed: int = 20_011, workspace: Workspace | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, source, size, source_size, target, copies, taken).

    size: words of the text (null: 0).  copies: how often the mix takes the row, ``cap`` at
    most, rounded up from it.  taken: copies * size.

    Rows that agree in id, source and size are one unit of their joint mass and share one
    decision.  A null id or source is a value like any other; null sources rank last.
    Rows without words add no mass; they are taken as often as the whole part of their
    source's rate says, once more with the chance of its fraction.  An empty table gives
    an empty result.  Other columns, whatever their names, are not read."""
    ws = workspace or Workspace(docs.sparkSession, "mix")
    units = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    units = units.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("mult"))
    units = ws.table(units.withColumn("mass", F.col("size") * F.col("mult")), "units")
    targets = ws.table(source_targets(units, weights, share, cap), "targets")
    most, n_sources = targets.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    targets = small(targets, n_sources)

    joined = units.join(targets.withColumnRenamed("source", "s"), units["source"].eqNullSafe(F.col("s")))
    unit = F.struct("id", "size", "mult", F.col("mass").cast("double").alias("mass"), F.col("part").alias("p"))
    sized = joined.where("size > 0").select("source", "n", unit.alias("unit"))
    empty = joined.where("size = 0").select("source", "id", "size", "mult", (_uniform("id", F.lit(seed)) < F.col("part")).cast("int").alias("up"))

    levels = max(1, math.ceil(math.log(max(2, most)) / math.log(block)))
    settled = []
    rows = sized
    for level in range(1, levels + 1):
        done = ws.table(_blocks(rows, level, block, seed), f"level{level}")
        settled.append(done.select("source", F.explode("settled").alias("x")).select("source", "x.id", "x.size", "x.mult", F.round("x.p").cast("int").alias("up")))
        rows = done.select("source", "n", F.col("rest").alias("unit"))
    last = rows.select("source", "unit.id", "unit.size", "unit.mult", (_uniform("unit.id", "unit.size", F.lit(seed + 99)) < F.col("unit.p")).cast("int").alias("up"))
    decided = empty
    for part in [*settled, last]:
        decided = decided.unionByName(part)
    out = decided.join(targets.select(F.col("source").alias("s"), "source_size", "target", "base"), F.col("source").eqNullSafe(F.col("s")))
    # a row for each repeat, in runs, so that no array follows a unit's repeats
    out = out.withColumn("copies", F.col("base") + F.col("up")).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("mult") - 1) / REPEATS))))
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.col("mult") - F.col("run") * REPEATS).cast("int"))))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus: each row of ``docs``, all its columns, as often as it is taken.

    Rows that agree in id, source and size are taken equally often, whatever their other columns.  Null ids,
    sources and texts are values as in ``mix``; a text without words is taken as its source's rate
    says.  The columns of the mix do not clash with those of ``docs``.  An empty table stays empty."""
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    plan = plan.select(F.col(id_col).alias("__mix_id"), F.col(source_col).alias("__mix_source"), F.col("size").alias("__mix_size"), F.col("copies").alias("__mix_copies")).where("__mix_copies > 0").distinct()
    sized = docs.withColumn("__mix_n", n_words(F.col(text_col)))
    same = sized[id_col].eqNullSafe(F.col("__mix_id")) & sized[source_col].cast("string").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_n") == F.col("__mix_size"))
    copies = F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))
    return sized.join(plan, same).withColumn("__mix_again", copies).select(*[F.col(f"`{c}`") for c in docs.columns])


__all__ = ["BLOCK", "BROADCAST_ROWS", "apply_mix", "mix", "source_targets"]
