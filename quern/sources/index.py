"""A written inverted index: postings sorted by term, so that a query reads the row groups of its words.

Folder: ``postings/seg=N/field=F`` (term, ids, docs, places, n, cf), sorted by term: a row is a block, the postings
of a word in the rows that one batch held, as bytes, so that few and plain rows are shuffled, sorted and written.  It
has its n ids (as integers of 64 bits, others as a list), in ``docs`` of each the length and where its places end, and
the places (32 bits each, little endian).  A block without a term has the lengths of its batch.  ``terms/seg=N``
(field, term, df, cf), sorted; ``lengths/seg=N`` (id, field, dl); ``dead/seg=N`` (id, upto): what the
segments up to ``upto`` hold of an id is replaced or deleted.  A write adds a segment; ``compact``
merges all into one.  A segment is listed in ``log`` when all its files are written, so a reader
never sees half of one, and a writer that failed can run again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import analyzer

#: Row groups are small, for a query wants a few words of many.
ROW_GROUP = 4 << 20
#: Order of the postings; a word that most documents hold is split among files by id.
ORDER = ("field", "term", "id")
#: So many ids are sent to the postings at most.
BROADCAST_IDS = 1_000_000
#: So many tokens are grouped at once (a longer text on its own).
TOKENS_AT_ONCE = 2 << 20
#: A range of postings has about so many tokens; of small tables fewer, but no fewer than FEWEST_TOKENS.
TOKENS_A_PART, FEWEST_TOKENS = 4 << 20, 1 << 18
#: The bounds of the ranges are chosen among at most SAMPLE_KEYS postings of about SAMPLE_ROWS rows; all rows are indexed.
SAMPLE_ROWS, SAMPLE_KEYS = 4000, 20_000


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than there are cores, dealt to all of them; a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _sorted(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of some rows' tokens, in order of term and row: the terms, each posting's term and row, where its places
    begin (and where the last end), the places, and the rows' lengths."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    tokens = lists.flatten()
    if tokens.null_count:
        held = tokens.is_valid()
        keep = held.to_numpy(zero_copy_only=False)
        tokens, row, place = tokens.filter(held), row[keep], place[keep]
    words = tokens.dictionary_encode()
    ordered = pc.sort_indices(words.dictionary)
    terms = words.dictionary.take(ordered)
    rank = np.empty(len(terms), np.uint16 if len(terms) < 1 << 16 else np.int32)  # small integers are sorted by radix
    rank[ordered.to_numpy()] = np.arange(len(terms))
    code = rank[words.indices.to_numpy()]
    order = np.argsort(code, kind="stable")  # rows and places ascend within a term
    code, row, place = code[order].astype(np.int32), row[order], place[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(code), 1), bool), (code[1:] != code[:-1]) | (row[1:] != row[:-1]))))
    bounds = np.append(first, len(code)).astype(np.int32)
    return terms, code[first], row[first], bounds, place, sizes


def _grouped(ids: pa.Array, lists: pa.Array) -> pa.RecordBatch:
    """Postings of some rows' tokens, in order of term and row."""
    terms, code, of, bounds, place, sizes = _sorted(lists)
    places = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place))
    return pa.RecordBatch.from_arrays([terms.take(pa.array(code)), ids.take(pa.array(of)), pa.array(np.diff(bounds)), pa.array(sizes[of]), places], names=["term", "id", "tf", "dl", "places"])


def _part(terms: pa.Array, code: np.ndarray, ids: pa.Array, bounds: list[tuple]) -> np.ndarray:
    """How many bounds (term, id), which ascend, are not above each posting; the postings are in order of term."""
    n = len(code)
    part, step = np.zeros(n, np.int32), np.zeros(n + 1, np.int32)
    term_at = lambda i: terms[int(code[i])].as_py()
    lo = 0
    for term, some in groupby(bounds, key=lambda b: b[0]):
        limits = [i for _, i in some]
        lo = bisect_left(range(n), term, lo=lo, key=term_at)
        hi = bisect_right(range(n), term, lo=lo, key=term_at)
        if hi > lo:
            own = ids.slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            part[lo:hi] += np.searchsorted(np.array(limits, own.dtype), own, "right").astype(np.int32)
        step[hi] += len(limits)
    return part + np.cumsum(step[:n], dtype=np.int32)


def _blocks(terms: pa.Array, code: np.ndarray, ids: pa.Array, bounds: np.ndarray, place: np.ndarray, dl: np.ndarray, part: np.ndarray) -> dict[str, pa.Array]:
    """Postings in order of term, packed into a row for each term and part."""
    tf = np.diff(bounds)
    key = code.astype(np.int64) << 32 | part
    if (key[1:] < key[:-1]).any():  # the parts of a term do not ascend with its rows
        order = np.argsort(key, kind="stable")
        code, dl, part, tf, ids = code[order], dl[order], part[order], tf[order], ids.take(pa.array(order))
        starts, bounds = bounds[:-1][order], np.concatenate(([0], np.cumsum(tf))).astype(np.int32)
        place, key = place[np.repeat(starts - bounds[:-1], tf) + np.arange(len(place), dtype=np.int32)], key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    at = np.append(first, len(key)).astype(np.int32)
    ends = bounds[1:] - np.repeat(bounds[first], np.diff(at))
    docs = np.stack((dl, ends), 1).astype("<i4")
    held = _bytes(at, ids.cast(pa.int64()).to_numpy().astype("<i8")) if pa.types.is_integer(ids.type) else pa.ListArray.from_arrays(pa.array(at), ids)
    return {
        "term": terms.take(pa.array(code[first])), "ids": held, "docs": _bytes(at, docs), "places": _bytes(bounds[at], place.astype("<i4")),
        "n": pa.array(np.diff(at)), "cf": pa.array(np.diff(bounds[at])), "part": pa.array(part[first]),
    }


def _bytes(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    """The rows of ``values`` between the cuts, as binary values."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(values)])


def _values(column: pa.Array, dtype: str) -> np.ndarray:
    """What ``_bytes`` packed, of all rows."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype) if data is not None and len(column) else np.empty(0, dtype)


def _of_field(f: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_pydict({"field": pa.array([f], pa.string()).take(pa.array(np.zeros(rows, np.int32))), **columns})


def _pieces(fields: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, pa.Array]]:
    """(field, ids, token lists) of batches (id, tokens of each field), a bounded number of tokens at a time."""
    for batch in batches:
        ids = batch.column(0)
        for f, lists in zip(fields, batch.columns[1:], strict=True):
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS_AT_ONCE, "right")))
                yield f, ids.slice(at, to - at), lists.slice(at, to - at)
                at = to


def _group(fields: list[str]):
    """Batches (id, tokens of each field) to postings, a bounded number of tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, ids, lists in _pieces(fields, batches):
            out = _grouped(ids, lists)
            yield _of_field(f, dict(zip(out.schema.names, out.columns, strict=True)))

    return run


def _block(fields: list[str], bounds: list[tuple]):
    """Batches (id, tokens of each field) to blocks and the number of their part between the bounds (field, term, id),
    which ascend; the lengths of a piece are a block without a term, dealt by its first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, ids, lists in _pieces(fields, batches):
            terms, code, of, cuts, place, sizes = _sorted(lists)
            held, own, before = ids.take(pa.array(of)), [b[1:] for b in bounds if b[0] == f], sum(b[0] < f for b in bounds)
            yield _of_field(f, _blocks(terms, code, held, cuts, place, sizes[of], _part(terms, code, held, own) + np.int32(before)))
            none = np.zeros(len(ids) + 1, np.int32)
            part = np.full(len(ids), crc32(str(ids[0]).encode()) % (len(bounds) + 1), np.int32)
            yield _of_field(f, _blocks(pa.nulls(1, pa.string()), none[1:], ids, none, none[:0], sizes, part))

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (field, term, id, tf, dl, places) in order of field and term to blocks."""
    for batch in batches:
        fields = batch.column(0).dictionary_encode()
        for k, f in enumerate(fields.dictionary.to_pylist()):
            some = batch.filter(pc.equal(fields.indices, k))
            words, places = some.column(1).dictionary_encode(), some.column(5)
            cuts = np.concatenate(([0], np.cumsum(places.value_lengths().to_numpy()))).astype(np.int32)
            code = words.indices.to_numpy()
            out = _blocks(words.dictionary, code, some.column(2), cuts, places.flatten().to_numpy(), some.column(4).to_numpy(), np.zeros(len(code), np.int32))
            del out["part"]
            yield _of_field(f, out)


def _unpack(keep: int, kind: pa.DataType, places: bool):
    """Batches (n, docs, ids, places if wanted, ``keep`` columns) of blocks to a row for each posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes, start = whole.column(0).to_numpy(), 0
            tokens = np.cumsum(sizes, dtype=np.int64)
            while start < len(sizes):  # a bounded number of postings at a time
                stop = max(start + 1, int(np.searchsorted(tokens, (tokens[start - 1] if start else 0) + TOKENS_AT_ONCE, "right")))
                batch, n = whole.slice(start, stop - start), sizes[start:stop]
                start = stop
                docs = _values(batch.column(1), "<i4").reshape(-1, 2)
                of = np.repeat(np.arange(len(n)), n)
                first = np.zeros(len(docs), bool)
                first[(np.cumsum(n) - n)[n > 0]] = True
                tf = np.where(first, docs[:, 1], np.diff(docs[:, 1], prepend=np.int32(0))).astype(np.int32)
                ids = batch.column(2)
                ids = ids.flatten() if pa.types.is_list(ids.type) else pa.array(_values(ids, "<i8")).cast(kind)
                out = [c.take(pa.array(of)) for c in batch.columns[len(batch.columns) - keep :]]
                out += [ids, pa.array(tf), pa.array(docs[:, 0].copy())]
                if places:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(tf))).astype(np.int32)), pa.array(_values(batch.column(3), "<i4"))))
                yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])

    return run


#: Ids of these types are packed as bytes.
INTEGERS = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}


def block_schema(kind: str) -> str:
    return f"term string, ids {'binary' if kind in INTEGERS else f'array<{kind}>'}, docs binary, places binary, n int, cf int"


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of postings (field, term, id, tf, dl, places), which are in order of field and term."""
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select(*ORDER, "tf", "dl", "places").mapInArrow(_pack, f"field string, {block_schema(kind)}")


def unpacked(blocks: DataFrame, kind: str, keep: tuple[str, ...] = ("field", "term"), places: bool = True) -> DataFrame:
    """The columns to keep and (id, tf, dl, places) of each posting of blocks with ids of a type."""
    wanted = [*[(c, blocks.schema[c].dataType.simpleString()) for c in keep], ("id", kind), ("tf", "int"), ("dl", "int"), *([("places", "array<int>")] if places else [])]
    rows = blocks.select("n", "docs", "ids", *(["places"] if places else []), *keep)
    out = rows.mapInArrow(_unpack(len(keep), INTEGERS.get(kind), places), ", ".join(f"c{i} {k}" for i, (_, k) in enumerate(wanted)))
    return out.select(*[F.col(f"c{i}").alias(c) for i, (c, _) in enumerate(wanted)])


def _tokens(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(id, tokens of each field in order of name) of each row with an id."""
    names = sorted(fields)
    none = F.array().cast("array<string>")
    tokens = [F.coalesce(analyzer(fields[f])(F.col(f"`{f}`")), none).alias(f"t{i}") for i, f in enumerate(names)]
    return spread(df.where(F.col(id_col).isNotNull()).select(id_col, *names)).select(F.col(id_col).alias("id"), *tokens)


def _postings(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(field, term, id, tf, dl, places) of each row, in no order.  No token is shuffled."""
    wide = _tokens(df, id_col, fields)
    kind = wide.schema["id"].dataType.simpleString()
    return wide.mapInArrow(_group(sorted(fields)), f"field string, term string, id {kind}, tf int, dl int, places array<int>")


def postings_of(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(field, term, id, tf, dl, places), in no order.

    A row's tokens are grouped where the row is read: no token is shuffled.  Only rows that share an id (a
    collection has none) meet in an exchange, which merges them."""
    out = _postings(df, id_col, fields)
    if df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return out
    merged = out.groupBy(*ORDER).agg(F.sum("tf").cast("int").alias("tf"), F.first("dl").alias("dl"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    return merged.select(*out.columns)


def sole(fields: dict[str, str]) -> str | None:
    """The name of the only field, if it can name a folder as it is."""
    name = min(fields)
    return name if len(fields) == 1 and re.fullmatch(r"\w+", name, re.ASCII) else None


def ordered_blocks(df: DataFrame, id_col: str, fields: dict[str, str], ids: DataFrame) -> DataFrame | None:
    """Blocks by ranges of field, term and id, in order of field and term, with the lengths among them; a word that most
    documents hold is split by id.  ids: those of the rows.  None if rows share an id, and for ids of other types.

    The bounds of the ranges come from the postings of about SAMPLE_ROWS rows, for a range exchange would group all rows
    a second time to find them.  The same pass counts their tokens, which tell how many ranges there are."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = ids.groupBy(*ids.columns).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.max("count").alias("most")).first()
    if kind not in ("string", *INTEGERS) or (rows["most"] or 0) > 1:
        return None
    share = max(1, rows["n"] // SAMPLE_ROWS)
    seen = Observation()
    some = _postings(df.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(share)) == 0), id_col, fields).observe(seen, F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    keys = sorted(tuple(r) for r in some.select(*ORDER).orderBy(F.xxhash64(*ORDER)).limit(SAMPLE_KEYS).collect())
    tokens = seen.get["tokens"] * share
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-tokens // TOKENS_A_PART), min(cores, -(-tokens // FEWEST_TOKENS)), 1)
    bounds = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    blocks = _tokens(df, id_col, fields).mapInArrow(_block(sorted(fields), bounds), f"field string, {block_schema(kind)}, part int")
    return blocks.repartitionById(len(bounds) + 1, F.col("part")).drop("part").sortWithinPartitions(*([] if sole(fields) else ["field"]), "term")  # the first column's beginning is compared first


def ordered_postings(df: DataFrame, id_col: str, fields: dict[str, str], lengths: DataFrame) -> DataFrame:
    """``postings_of`` by the ranges of ``ordered_blocks``; rows that share an id and ids of other types take a range exchange."""
    blocks = ordered_blocks(df, id_col, fields, lengths.where(F.col("field") == min(fields)).select("id"))
    if blocks is None:
        return postings_of(df, id_col, fields).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return unpacked(blocks.where("term is not null"), df.schema[id_col].dataType.simpleString())


@dataclass
class Index:
    """An index at ``path`` of the fields (name -> analyzer) of a collection with one row an id."""

    spark: SparkSession
    path: str
    fields: dict[str, str]
    n: int = 0
    total: dict[str, int] | None = None
    segments: tuple[int, ...] = ()

    def __post_init__(self):
        self._tables: dict[tuple, DataFrame] = {}

    # --- writing

    @classmethod
    def build(cls, df: DataFrame, id_col: str, fields: dict[str, str], path: str) -> Index:
        index = cls(df.sparkSession, path, dict(fields))
        index._segment(0, df, id_col)
        return index.refresh()

    def upsert(self, rows: DataFrame, id_col: str) -> Index:
        """Rows added, or put in the place of those with the same id."""
        number = max(self.segments) + 1
        self._write(rows.select(F.col(id_col).alias("id"), F.lit(number - 1).alias("upto")).distinct(), "dead", number)
        self._segment(number, rows, id_col)
        return self.refresh()

    def delete(self, ids: DataFrame, id_col: str) -> Index:
        number = max(self.segments) + 1
        self._write(ids.select(F.col(id_col).alias("id"), F.lit(number - 1).alias("upto")).distinct(), "dead", number)
        self._log(number, [])
        return self.refresh()

    def compact(self, path: str) -> Index:
        """All live postings as one segment at another path."""
        new = Index(self.spark, path, self.fields)
        new._write(self.lengths(), "lengths", 0)
        new._write(packed(self.postings().repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)), "postings", 0)
        new._finish(0)
        return new.refresh()

    def _segment(self, number: int, rows: DataFrame, id_col: str) -> None:
        blocks = ordered_blocks(rows, id_col, self.fields, rows.where(F.col(id_col).isNotNull()).select(id_col))
        if blocks is not None:  # one pass over the texts gives both
            self._write(blocks, "postings", number)
            kind = rows.schema[id_col].dataType.simpleString()
            sizes = unpacked(self._stored(kind, [number]).where(F.col("term").isNull()), kind, ("field",), places=False)
            self._write(sizes.select("id", "field", "dl"), "lengths", number)
        else:
            none = F.array().cast("array<string>")
            sizes = [F.struct(F.lit(f).alias("field"), F.size(F.coalesce(analyzer(k)(F.col(f"`{f}`")), none)).alias("dl")) for f, k in sorted(self.fields.items())]
            lengths = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(*sizes)).alias("x")).select("id", "x.field", "x.dl")
            self._write(lengths, "lengths", number)
            self._write(packed(postings_of(rows, id_col, self.fields).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)), "postings", number)
        self._finish(number)

    def _finish(self, number: int) -> None:
        terms = self._read("postings", [number]).where(F.col("term").isNotNull()).groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
        self._write(terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term"), "terms", number)
        self._log(number, list(self.fields))

    def _write(self, df: DataFrame, kind: str, number: int) -> None:
        path, partitioned = f"{self.path}/{kind}/seg={number}", kind == "postings"
        if partitioned and (only := sole(self.fields)):
            df, path, partitioned = df.drop("field"), f"{path}/field={only}", False
        writer = df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP)
        if kind == "postings":
            for c in ("ids", "docs", "places"):  # hardly any value comes twice
                writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
        writer = writer.partitionBy("field") if partitioned else writer
        writer.parquet(path)

    def _log(self, number: int, fields: list[str]) -> None:
        self.spark.createDataFrame([(number, bool(fields))], "seg int, rows boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/seg={number}")

    # --- reading

    def refresh(self) -> Index:
        """This index as it now is on storage."""
        self._tables = {}
        log = self.spark.read.option("basePath", f"{self.path}/log").parquet(f"{self.path}/log").orderBy("seg").collect()  # a row a segment
        self.segments = tuple(r["seg"] for r in log)
        self._full = [r["seg"] for r in log if r["rows"]]
        self._dead = None
        if len(self.segments) > 1:
            self._dead = self._read("dead", list(self.segments[1:])).groupBy("id").agg(F.max("upto").alias("upto"))
            self._dead_small = self._dead.count() <= BROADCAST_IDS
        rows = self.lengths().groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total")).collect()  # a row a field
        self.n = max((r["n"] for r in rows), default=0)
        self.total = {r["field"]: r["total"] for r in rows}
        return self

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        key = (kind, *numbers)
        if key in self._tables:  # files are listed once
            return self._tables[key]
        if kind == "postings":
            self._tables[key] = self._stored(self._kind(numbers[0]), numbers)
        else:
            self._tables[key] = self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/seg={k}" for k in numbers])
        return self._tables[key]

    def of_fields(self, names: set[str]) -> Index:
        """What a query of these fields reads."""
        return self

    def _kind(self, number: int) -> str:
        return self._read("lengths", [number]).schema["id"].dataType.simpleString()

    def _stored(self, kind: str, numbers: list[int]) -> DataFrame:
        """Blocks of segments; one without rows has no file to tell the schema."""
        reader = self.spark.read.option("basePath", f"{self.path}/postings").schema(f"{block_schema(kind)}, seg int, field string")
        return reader.parquet(*[f"{self.path}/postings/seg={k}" for k in numbers])

    def _live(self, df: DataFrame) -> DataFrame:
        if self._dead is None:
            return df
        dead = F.broadcast(self._dead) if self._dead_small else self._dead
        return df.alias("p").join(dead.alias("d"), (F.col("p.id") == F.col("d.id")) & (F.col("p.seg") <= F.col("d.upto")), "left_anti")

    def postings(self, where=None, places: bool = True) -> DataFrame:
        """(field, term, id, tf, dl, places) of live documents; ``where`` is applied to the field and term of the stored
        blocks.  Without ``places`` these are not read."""
        rows = self._read("postings", self._full).where(F.col("term").isNotNull() if where is None else where & F.col("term").isNotNull())
        rows = unpacked(rows, self._kind(self._full[0]), ("seg", "field", "term"), places)
        return self._live(rows).select("field", "term", "id", "tf", "dl", *(["places"] if places else []))

    def lengths(self) -> DataFrame:
        return self._live(self._read("lengths", self._full)).select("id", "field", "dl")

    def terms(self, where=None) -> DataFrame:
        """(field, term, df, cf) of live documents."""
        if self._dead is None:
            rows = self._read("terms", self._full).select("field", "term", "df", "cf")
            return rows if where is None else rows.where(where)
        return self.postings(where, places=False).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def vocabulary(self, fields: list[str] | None = None) -> DataFrame:
        """(term, doc_freq): documents that hold a term, summed over the fields."""
        fields = fields or list(self.fields)
        rows = self.terms(F.col("field").isin(fields))
        return rows.select("term", F.col("df").alias("doc_freq")) if len(fields) == 1 else rows.groupBy("term").agg(F.sum("df").alias("doc_freq"))

    def segment_stats(self) -> DataFrame:
        """(seg, doc_count, deleted_count, delete_ratio, size_bytes) of every segment that holds documents; the size is
        that of its files."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        sizes = []
        for k in self._full:  # one look at the folder a segment and kind
            folders = [jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/seg={k}") for kind in ("postings", "terms", "lengths")]
            sizes.append((k, sum(f.getFileSystem(conf).getContentSummary(f).getLength() for f in folders)))
        rows = self._read("lengths", self._full).where(F.col("field") == min(self.fields)).select("seg", "id")  # every document has a row a field
        if self._dead is None:
            rows = rows.withColumn("gone", F.lit(0))
        else:
            dead = F.broadcast(self._dead) if self._dead_small else self._dead
            rows = rows.join(dead, "id", "left").withColumn("gone", F.coalesce((F.col("seg") <= F.col("upto")).cast("int"), F.lit(0)))
        counts = rows.groupBy("seg").agg(F.sum(1 - F.col("gone")).alias("doc_count"), F.sum("gone").alias("deleted_count"))
        table = self.spark.createDataFrame(sizes, "seg int, size_bytes long").join(counts, "seg", "left").na.fill(0, ["doc_count", "deleted_count"])
        ratio = F.coalesce(F.col("deleted_count") / F.nullif(F.col("doc_count") + F.col("deleted_count"), F.lit(0)), F.lit(0.0))
        return table.select("seg", "doc_count", "deleted_count", ratio.alias("delete_ratio"), "size_bytes")


class Deferred:
    """An index that ``build`` makes when something of it is first asked for: queries that read only documents do
    not wait for it.  ``parts`` are indexes of single fields: a query of one field waits for that field alone."""

    def __init__(self, build: Callable[[], Index], parts: dict[str, Deferred] | None = None):
        self._build, self._index, self._parts = build, None, parts or {}

    def of_fields(self, names: set[str]) -> Index | Deferred:
        """What a query of these fields reads: the part of the only one, unless the whole is built."""
        return self._parts.get(min(names), self) if len(names) == 1 and self._index is None else self

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        if self._index is None:
            self._index = self._build()
        return getattr(self._index, name)
