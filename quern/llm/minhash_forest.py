"""MinHash near-dedup with an LSH forest.

Each distinct set of word shingles gets ``trees * depth`` MinHash values.  Each tree is an order
of the sets by its ``depth`` values; the tree is not stored, it is a range-partitioned sort.

First, near neighbours: candidates of a set are the ``window`` sets that follow it in each order,
those with the longest common prefix.  They join copies with few edits cheaply.

Then, whole regions: a run is all sets of a tree with an equal prefix.  Its depth adapts to the
region: ``least_prefix`` values where that run has at most CROWD sets, else the deepest prefix at
which a link is still missed in all trees with a probability of at most MISS.  In a run all
sets of different components are compared by one byte of each MinHash value; those that may link are
compared on their full sets.  A crowded run is first compared with its centre, the set most
like the run's most frequent values, which joins a star in linear work; what remains is read block
against block, and pairs inside the largest component are left out.  No list, window or group is
cut short.

Copies (equal sets) are one class from the start, and links are confirmed on the full sets.
A link inside a component changes nothing and is not looked up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import merge, relabel
from quern.llm.shared import BROADCAST_ROWS, Workspace, join_hot, shingle_sets, text_bytes

TREES, DEPTH, WINDOW, LEAST_PREFIX = 16, 8, 2, 2
_VALUE = 4  # bytes
#: So many ids, 8 bytes each, are sent to the texts at most.
BROADCAST_IDS = 1_000_000
#: A run of so many sets is compared at the least prefix; above it the region goes deeper.
CROWD = 64
#: Chance that two sets at the threshold share no run, and that their bytes hide a link: so many deviations.
MISS, DEVIATIONS = 2e-5, 4.5
#: Sets, and shingles, of a block; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: A class of so many copies is a hot key of the last join.
HOT_COPIES = 100_000


def _multipliers(k: int, seed: int = 71) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def minhash(shingles: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function; the set is read in blocks."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(a.size, 0xFFFFFFFF, np.uint32)
    for at in range(0, shingles.size, 256):
        h = low[at : at + 256, None] * a
        h += high[at : at + 256, None]
        np.minimum(out, h.min(axis=0), out=out)
    return out


def _signatures(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _multipliers(k)
        for batch in batches:
            sizes, classes, marks, briefs = [], [], [], []
            for s in shingle_sets(text_bytes(batch.column(1)), width):
                sizes.append(s.size)
                m = minhash(s, a) if s.size else None
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None)
                marks.append(m.astype(">u4").tobytes() if s.size else None)
                briefs.append(m.astype(np.uint8).tobytes() if s.size else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (classes, marks, briefs)]], names=["id", "n", "class", "marks", "brief"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(text_bytes(batch.column(1)), width)]
            ends = np.cumsum([0, *(s.size for s in sets)])
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "hashes"])

    return run


def _neighbours(window: int, least: int, ratio: float):
    """From rows (tree, mark, id, n) in order: pairs of rows up to ``window`` apart that share a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([tail, rows]) if tail is not None else rows
            yield from _pairs(rows, tail.num_rows if tail is not None else 0)
            tail = rows.slice(max(0, rows.num_rows - window))

    def _pairs(rows: pa.Table, seen: int):
        m = rows.num_rows
        if m < 2:
            return
        tree, ids, n = (rows[c].to_numpy() for c in ("tree", "id", "n"))
        marks = np.frombuffer(b"".join(rows["mark"].to_pylist()), np.uint8).reshape(m, -1)
        prefix = marks[:, : least * _VALUE]
        out_a, out_b = [], []
        for gap in range(1, min(window, m - 1) + 1):
            i = np.arange(m - gap)
            i = i[i + gap >= seen]  # a pair of two carried rows has been given already
            j = i + gap
            ok = (tree[i] == tree[j]) & (prefix[i] == prefix[j]).all(axis=1) & _comparable(n[i], n[j], ratio)
            out_a.append(np.maximum(ids[i], ids[j])[ok])
            out_b.append(np.minimum(ids[i], ids[j])[ok])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        if a.size:
            pairs = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])

    return run


def _comparable(n: np.ndarray, m: np.ndarray, ratio: float) -> np.ndarray:
    """Whether sets of these sizes can be as alike as the ratio."""
    return np.minimum(n, m) >= ratio * np.maximum(n, m) - 1e-9


def candidates(ws: Workspace, classes: DataFrame, *, trees: int, depth: int, window: int, least_prefix: int, ratio: float) -> DataFrame:
    """Distinct pairs (a > b) of ids next to each other in some order.  classes: (id, n, marks).  Pairs cut by
    the edge of a partition are left to the runs."""
    mark = F.substring("marks", F.col("tree") * (depth * _VALUE) + 1, depth * _VALUE)
    orders = classes.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)]))).select("tree", mark.alias("mark"), "id", "n")
    near = orders.repartitionByRange("tree", "mark", "id").sortWithinPartitions("tree", "mark", "id").mapInArrow(_neighbours(window, least_prefix, ratio), "a long, b long")
    return ws.table(near.distinct(), "pairs")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, hubs: DataFrame | None = None) -> DataFrame:
    """The written pairs (a, b, ..., ea, eb) whose sets ea and eb have 100 * intersection >= percent * union.

    Few pairs (counted) are sent to the sets, which then move only if a pair needs them.  hubs: the sets of
    all eb, if they are of a checked size."""
    n = pairs.count()
    of_b = sets if hubs is None else F.broadcast(hubs)
    if n <= BROADCAST_ROWS:
        needed = F.broadcast(pairs.select(F.col("ea").alias("id")).union(pairs.select("eb")).distinct())
        sets, pairs = sets.join(needed, "id", "left_semi"), F.broadcast(pairs)
        of_b = sets if hubs is None else of_b
    sa, sb = sets.select(F.col("id").alias("ida"), F.col("hashes").alias("ha")), of_b.select(F.col("id").alias("idb"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    either = F.size("ha") + F.size("hb") - both
    out = pairs.join(sa, pairs["ea"] == F.col("ida")).join(sb, F.col("eb") == F.col("idb"))
    return out.where(100 * both >= percent * either).select(*pairs.columns)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups, with the first row of each group."""
    tail: pa.Table | None = None

    def starts_of(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in names:
            x = rows[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    parts: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        starts = starts_of(pa.concat_tables([parts[-1].slice(parts[-1].num_rows - 1), rows]) if parts else rows)
        starts = starts[1:] - 1 if parts else starts[1:]
        if starts.size:  # a group begins here: all before the last such row is whole
            whole = pa.concat_tables([*parts, rows.slice(0, starts[-1])]).combine_chunks()
            yield whole, starts_of(whole)
            parts = [rows.slice(starts[-1])]
        else:
            parts.append(rows)
    if parts:
        whole = pa.concat_tables(parts).combine_chunks()
        yield whole, starts_of(whole)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _hopeful(percent: int, k: int):
    """Blocks of runs, rows (run, l, r, part, tree, id, n, comp, deep, brief) in order of (run, l, r): the rows that
    may link with a row of another component, as far as one byte of each MinHash value tells.

    A pair is looked at in the first tree whose deep prefixes agree, and in those before it where a
    shallow run holds both."""
    ratio = percent / 100
    cut = ratio - DEVIATIONS * math.sqrt(ratio * (1 - ratio) / k)
    least = k * (cut + (1 - cut) / 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches, ["run", "l", "r"]):
            tree, part, n, comp, left, right = (rows[c].to_numpy() for c in ("tree", "part", "n", "comp", "l", "r"))
            brief = _bytes(rows["brief"])
            deep = rows["deep"].combine_chunks().flatten().to_numpy().reshape(len(brief), -1)
            mark = np.zeros(len(brief), bool)
            size = np.diff(np.append(starts, len(brief)))

            def look(i: np.ndarray, j: np.ndarray, near: bool) -> None:
                ok = (comp[i] != comp[j]) & _comparable(n[i], n[j], ratio) & ((left[i] == right[i]) | (part[i] != part[j]))
                i, j = i[ok], j[ok]
                for at in range(0, i.size, 1 << 16):
                    p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    if not near:
                        ok = np.count_nonzero(brief[p] == brief[q], axis=1) >= least
                        p, q = p[ok], q[ok]
                    same = deep[p] == deep[q]
                    ok = ~(same & (np.arange(same.shape[1]) < tree[p][:, None])).any(axis=1)
                    mark[p[ok]] = True
                    mark[q[ok]] = True

            small = size <= CROWD
            first, many = starts[small], size[small]
            for gap in range(1, int(many.max()) if many.size else 0):
                wide = many > gap
                first, many = first[wide], many[wide]
                runs = many - gap
                i = np.repeat(first, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                look(i, i + gap, False)
            for s, m in zip(starts[~small], size[~small]):
                for p in range(s, s + m, 256):
                    x = brief[p : min(p + 256, s + m)]
                    for q in range(s, p + 1, 256):
                        y = brief[q : min(q + 256, s + m)]
                        if comp[p] == comp[p + len(x) - 1] == comp[q] == comp[q + len(y) - 1]:
                            continue  # in order of components: all one
                        near = np.zeros((len(x), len(y)), np.int16)
                        for c in range(x.shape[1]):
                            near += x[:, c, None] == y[None, :, c]
                        i, j = np.nonzero(near >= least)
                        i, j = i + p, j + q
                        look(i[i > j], j[i > j], True)
            yield from rows.select(["run", "l", "r", "id", "comp"]).filter(pa.array(mark)).to_batches()

    return run


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of crowded runs, rows (run, part, id, brief) in order: of each block the set most like its most
    frequent bytes, with the number of bytes that agree."""
    for rows, starts in _groups(batches, ["run", "part"]):
        brief, ids, runs = _bytes(rows["brief"]), rows["id"].to_numpy(), rows["run"].to_numpy()
        out = []
        for s, e in zip(starts, np.append(starts[1:], len(brief))):
            x = brief[s:e]
            usual = np.array([np.bincount(x[:, c], minlength=256).argmax() for c in range(x.shape[1])], np.uint8)
            near = np.count_nonzero(x == usual, axis=1)
            out.append((runs[s], ids[s + np.lexsort((ids[s:e], -near))[0]], near.max()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["run", "id", "agree"])


def _search(percent: int):
    """A part of a list, rows (comp, id, hashes): links that join all sets of the part that belong together."""

    def run(table: pa.Table) -> pa.Table:
        ids, comps = table["id"].to_numpy(), table["comp"].to_numpy()
        hashes = table["hashes"].combine_chunks()
        sizes = np.diff(hashes.offsets.to_numpy())
        values, flat = np.unique(hashes.flatten().to_numpy(), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        seen = np.zeros(values.size, np.int32)
        _, label = np.unique(comps, return_inverse=True)
        a, b = [], []
        done = np.zeros(ids.size, bool)
        rest = np.arange(ids.size)  # sets not yet compared with all others; their shingles in order
        part, begins = flat, starts
        queue: list[int] = []
        while True:
            while queue and done[queue[-1]]:
                queue.pop()
            if queue:
                x = queue.pop()
            else:
                left = rest[~done[rest]]
                if left.size < 2:
                    break
                x = int(left[0])
            done[x] = True
            mine = flat[starts[x] : starts[x] + sizes[x]]
            seen[mine] = 1
            both = np.add.reduceat(seen[part], begins)
            seen[mine] = 0
            linked = rest[(100 * both >= percent * (sizes[rest] + sizes[x] - both)) & (label[rest] != label[x])]
            for y in linked.tolist():
                if label[y] != label[x]:
                    a.append(ids[x])
                    b.append(ids[y])
                    label[label == label[y]] = label[x]
            queue += linked[np.argsort(both[np.searchsorted(rest, linked)], kind="stable")].tolist()  # the most alike next
            open_ = ~done[rest]
            if (label[rest[open_]] == label[x]).all() and (label[rest] == label[x]).all():
                break
            if 2 * open_.sum() <= rest.size:  # pairs with a done set have been compared
                rest = rest[open_]
                if rest.size < 2:
                    break
                part = np.concatenate([flat[starts[y] : starts[y] + sizes[y]] for y in rest])
                begins = np.cumsum(sizes[rest]) - sizes[rest]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _linker(percent: int):
    search = _search(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches, ["run", "l", "r"]):
            out = [search(rows.slice(s, e - s)) for s, e in zip(starts, np.append(starts[1:], rows.num_rows)) if e - s > 1]
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


def _deepest(ratio: float, trees: int, depth: int) -> int:
    return max([d for d in range(1, depth + 1) if (1 - ratio**d) ** trees <= MISS], default=1)


class _Runs:
    """The runs of all trees that hold more than one component."""

    def __init__(self, ws: Workspace, rows: DataFrame, classes: DataFrame, *, trees: int, depth: int, least_prefix: int, percent: int, width: int):
        self.ws, self.rows, self.classes, self.percent, self.width, self.k = ws, rows, classes, percent, width, trees * depth
        deepest = _deepest(percent / 100, trees, depth)
        prefix = lambda t, d: F.xxhash64(F.lit(t), F.substring("marks", t * depth * _VALUE + 1, d * _VALUE))
        self.deep = F.array(*[prefix(t, deepest) for t in range(trees)])
        self.shallow = F.array(*[prefix(t, min(least_prefix, deepest)) for t in range(trees)])

    def _with_comp(self, rows: DataFrame, comps: DataFrame) -> DataFrame:
        """comps: ids that have been joined to others; few are sent to the rows."""
        of = comps.select(F.col("id").alias("__id"), F.col("comp").alias("__comp"))
        of = F.broadcast(of) if of.count() <= BROADCAST_IDS else of
        return rows.join(of, F.col("id") == F.col("__id"), "left").select(*rows.columns, F.coalesce("__comp", "id").alias("comp"))

    def open(self, comps: DataFrame) -> DataFrame:
        """(run, tree, id, n, comp, m, all_n) of open runs."""
        ws = self.ws
        one = F.arrays_zip(self.shallow.alias("shallow"), self.deep.alias("deep"))
        rows = self._with_comp(self.classes.select("id", F.col("n").cast("int").alias("n"), one.alias("keys")), comps)
        rows = rows.select("id", "n", "comp", F.posexplode("keys").alias("tree", "key")).select("id", "n", "comp", "tree", "key.shallow", "key.deep")
        runs = rows.groupBy("shallow").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        runs = ws.table(runs.select("shallow", "m"), "shallow")
        runs = F.broadcast(runs) if runs.count() <= BROADCAST_IDS else runs
        run = F.when(F.col("m") <= CROWD, F.col("shallow")).otherwise(F.col("deep"))
        rows = ws.table(rows.join(runs, "shallow").select(run.alias("run"), "tree", "id", "n", "comp"), "members")
        return self._sized(rows)

    def _sized(self, rows: DataFrame) -> DataFrame:
        runs = rows.groupBy("run").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all_n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        runs = self.ws.table(runs.select("run", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("all_n") / BLOCK_SHINGLES)).cast("int").alias("parts"), "m"), "runs")
        runs = F.broadcast(runs) if runs.count() <= BROADCAST_IDS else runs
        return self.ws.table(rows.join(runs, "run"), "open")

    def _marked(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the sets' bytes and deep prefixes."""
        ids = self.ws.table(rows.select("id").distinct(), "open-ids")
        few = ids.count() <= BROADCAST_IDS
        marks = self.classes.select(F.col("id").alias("__id"), self.deep.alias("deep"), "brief").join(F.broadcast(ids) if few else ids, F.col("__id") == F.col("id"), "left_semi")
        return rows.join(marks, F.col("id") == F.col("__id")).drop("__id")

    def sets(self, ids: DataFrame) -> DataFrame:
        ids = self.ws.table(ids.distinct(), "ids")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return self.ws.table(self.rows.join(ids, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(self.width), "id long, hashes array<long>"), "sets")

    def join_centres(self, open_: DataFrame, comps: DataFrame) -> DataFrame:
        """``comps`` after every set of a crowded run has been compared with the run's centre."""
        crowded = open_.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("id", F.lit(19)), F.col("parts")).cast("int"))
        rows = self._marked(crowded.select("run", "part", "id")).repartition("run", "part").sortWithinPartitions("run", "part")
        best = rows.select("run", "part", "id", "brief").mapInArrow(_centres, "run long, id long, agree long")
        best = best.groupBy("run").agg(F.max(F.struct("agree", (-F.col("id")).alias("x"))).alias("m")).select("run", (-F.col("m.x")).alias("eb"))
        best = self.ws.table(best, "centres")
        pairs = crowded.select("run", "id").join(F.broadcast(best) if best.count() <= BROADCAST_ROWS else best, "run").where("id <> eb")
        pairs = self.ws.table(pairs.select(F.col("id").alias("ea"), "eb").distinct(), "with-centre")
        sets = self.sets(pairs.select(F.col("ea").alias("id")).union(pairs.select("eb")))
        hubs = sets.join(F.broadcast(best.select(F.col("eb").alias("id")).distinct()), "id", "left_semi")
        size = hubs.agg(F.sum(F.size("hashes"))).first()[0] or 0
        return self._merged(_confirm(pairs, sets, self.percent, hubs if size <= BLOCK_SHINGLES else None), comps)

    def _merged(self, links: DataFrame, comps: DataFrame) -> DataFrame:
        links = self.ws.table(links.toDF("a", "b"), "run-links")
        return comps if links.isEmpty() else merge(self.ws, relabel(links, comps.select(F.col("id").alias("c"), F.col("comp").alias("p"))), comps)

    def complete(self, comps: DataFrame) -> DataFrame:
        """``comps`` after all links between components."""
        open_ = self.open(comps)
        if not open_.where("parts > 1").isEmpty():
            comps = self.join_centres(open_, comps)
            open_ = self._sized(self._with_comp(open_.select("run", "tree", "id", "n"), comps))
        # the largest component of a run of several blocks has blocks of its own, which need not meet each other
        large = open_.where("parts > 1").groupBy("run", "comp").agg(F.count(F.lit(1)).alias("c"))
        large = self.ws.table(large.groupBy("run").agg(F.max(F.struct("c", "comp")).alias("x")).select("run", "x.c", F.col("x.comp").alias("big")), "large")
        rows = open_.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "run", "left")
        own = F.when(F.col("big").isNull(), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("parts") * F.col("c") / F.col("m"))).cast("int"))
        rows = rows.withColumn("own", own).withColumn("rest", F.greatest(F.lit(1), F.col("parts") - F.col("own")))
        part = F.when(F.col("comp") == F.col("big"), F.pmod(F.xxhash64("id", F.lit(19)), "own")).otherwise(F.col("own") + F.pmod(F.xxhash64("id", F.lit(19)), "rest"))
        rows = rows.withColumn("part", part.cast("int"))
        met = F.filter(F.sequence(F.lit(0), F.col("own") + F.col("rest") - 1), lambda x: F.greatest(x, F.col("part")) >= F.col("own"))
        rows = self._marked(rows).withColumn("x", F.explode(met)).select("run", F.least("x", "part").alias("l"), F.greatest("x", "part").alias("r"), "part", "tree", "id", "n", "comp", "deep", "brief")
        rows = rows.repartition("run", "l", "r").sortWithinPartitions("run", "l", "r", "comp")
        found = self.ws.table(rows.mapInArrow(_hopeful(self.percent, self.k), "run long, l int, r int, id long, comp long"), "hopeful")
        if found.isEmpty():
            return comps
        whole = found.join(self.sets(found.select("id")), "id").repartition("run", "l", "r").sortWithinPartitions("run", "l", "r")
        return self._merged(whole.mapInArrow(_linker(self.percent), "a long, b long"), comps)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    trees: int = TREES, depth: int = DEPTH, window: int = WINDOW, least_prefix: int = LEAST_PREFIX, workspace: Workspace | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_shingles, component_id, kept).

    A document's set: the distinct shingles of ``width`` words (runs of other than ASCII white
    space, A-Z lower-cased); a shorter text is one shingle; a text without words, empty or
    null, has none and links with nothing.  Documents link if 100 * intersection >=
    percent * union.  component_id is the smallest id reachable by links; kept marks that id.

    Ids are integers.  Rows that repeat an id with the same set are copies; all of them are kept if
    one is.  Rows that repeat an id with different sets link with nothing: nothing tells which
    of them the id means.  A row with a null id links with nothing, has a null component and is kept.
    An empty table gives an empty result.  Other columns are not read."""
    ws = workspace or Workspace(docs.sparkSession, "minhash")
    ratio = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = ws.table(rows.mapInArrow(_signatures(width, trees * depth), "id long, n long, class binary, marks binary, brief binary"), "marks")
    linked = marked.where("id is not null and class is not null")
    unclear = ws.table(marked.where("id is not null").groupBy("id").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("class").alias("k"), F.count(F.lit(1)).alias("all")).where("lo <> hi or k between 1 and all - 1").select("id"), "unclear")
    if not unclear.isEmpty():
        linked = linked.join(unclear, "id", "left_anti")
        marked = marked.join(unclear.withColumn("__u", F.lit(True)), "id", "left").withColumn("class", F.when(F.col("__u").isNull(), F.col("class"))).drop("__u")
    classes = ws.table(linked.groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("marks").alias("marks"), F.first("brief").alias("brief"), F.count(F.lit(1)).alias("copies")), "classes")
    pairs = candidates(ws, classes.select("id", "n", "marks"), trees=trees, depth=depth, window=window, least_prefix=least_prefix, ratio=ratio)

    near = ws.table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-ids")
    near = F.broadcast(near) if near.count() <= BROADCAST_IDS else near  # above it the texts are shuffled once
    sets = ws.table(rows.join(near, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(width), "id long, hashes array<long>"), "sets")

    # each pair once with the ends' components (a > b) and the sets to compare (ea, eb)
    open_ = pairs.select("a", "b", F.col("a").alias("ea"), F.col("b").alias("eb"))
    comps = None
    for turn in range(3):
        if turn < 2:
            least = F.min(F.struct("b", "ea", "eb")).alias("m")
            picked = open_.groupBy("a").agg(least).select("a", "m.b", "m.ea", "m.eb")
        else:
            picked = open_
        picked = ws.table(picked, "picked")
        links = ws.table(_confirm(picked, sets, percent).select("a", "b"), "confirmed")
        if turn < 2:
            before = comps
            comps = merge(ws, links, comps)
            if before is None:
                hooks = comps.select(F.col("id").alias("c"), F.col("comp").alias("p"))
            else:
                hooks = merge(ws, links).select(F.col("id").alias("c"), F.col("comp").alias("p"))
            rest = open_.join(picked.select("ea", "eb"), ["ea", "eb"], "left_anti")
            open_ = ws.table(relabel(rest, hooks, ("ea", "eb")), "open")
            if open_.isEmpty():
                break
        else:
            comps = merge(ws, links, comps)
    comps = _Runs(ws, rows, classes, trees=trees, depth=depth, least_prefix=least_prefix, percent=percent, width=width).complete(comps)

    # a set without copies or links is its own component and needs no row here
    reps = classes.select("class", F.col("id").alias("rep"), "copies").join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    reps = ws.table(reps.where("copies > 1 or comp is not null").select("class", F.coalesce("comp", "rep").alias("comp"), "copies"), "reps")
    out = join_hot(marked.select("id", "n", "class"), reps.select("class", "comp"), "class", reps.where(F.col("copies") >= HOT_COPIES).select("class", "comp"))
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))
