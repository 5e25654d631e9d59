"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of a helper table (sources, hosts, centres) that is broadcast;
#: above it the same join runs as a shuffle join.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` if the
    cluster names one, else (single-machine tests) a folder made for this process."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named
    if not conf.get("spark.master", "local").startswith("local[") and conf.get("spark.master") != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _OWN
    if _OWN is None:
        _OWN = tempfile.TemporaryDirectory(prefix="quern-")
        atexit.register(_OWN.cleanup)
    return "file://" + _OWN.name


_OWN: tempfile.TemporaryDirectory | None = None


class Workspace:
    """Written tables that cut lineage.  A lost executor costs a re-read, not a recompute.

    The folder belongs to one call of an operator.  Its tables back the lazy result, so
    they live until the interpreter ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clear
            pass


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows``, its counted size, is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_hot(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row a key, if a few keys hold most rows.

    hot: the rows of ``table`` whose key has many rows; their number is bounded by the rows over
    that many, and they are sent to the rows.  Rows with a null key match nothing and do not move."""
    names = [c for c in table.columns if c != key]
    nothing = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in names]
    known = rows.where(F.col(key).isNotNull())
    if hot.count():
        head = known.join(F.broadcast(hot), key)
        known = known.join(F.broadcast(hot.select(key)), key, "left_anti")
    else:
        head = None
    out = known.join(small(table, table.count()), key, "left").select(*rows.columns, *names)
    out = out.unionByName(rows.where(F.col(key).isNull()).select(*rows.columns, *nothing))
    return out if head is None else out.unionByName(head.select(*rows.columns, *names))


def trim() -> None:
    """Gives memory that is free in this worker back: workers of all cores share what an executor may take."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def n_words(text: Column) -> Column:
    """Number of runs of bytes other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


# --- hashing of words in numpy ---------------------------------------------------------

#: Texts are hashed in blocks of about so many bytes, cut at white space, so that memory does
#: not follow the longest text.  Short texts share a block.
PIECE = 1 << 16
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit integers (splitmix), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


_UP, _DOWN = _powers(_BASE, 4 * PIECE), _powers(pow(_BASE, -1, 1 << 64), 4 * PIECE)


def _block_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: differences of one running polynomial sum, taken back to
    the power of the word's place."""
    data = np.frombuffer(raw, np.uint8)
    n = data.size
    up, down = (_UP, _DOWN) if n <= _UP.size else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTES[data] * up[:n], out=run[1:])
    return mix64((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def pieces(raw: bytes):
    """A text in pieces that do not cut words."""
    at = 0
    while at < len(raw):
        cut = _SPACES.search(raw, at + PIECE) if at + PIECE < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each UTF-8 text the 64-bit hashes of its words in order, A-Z lower-cased."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            out.append(np.concatenate([_block_hashes(x)[0] for x in pieces(texts[at])]))
            at += 1
            continue
        end, total = at, 0
        while end < len(texts) and total + len(texts[end]) <= PIECE:
            total += len(texts[end]) + 1
            end += 1
        end = max(end, at + 1)
        if total <= end - at:
            out += [np.empty(0, np.uint64)] * (end - at)
        else:
            hashes, starts = _block_hashes(b" ".join(texts[at:end]))
            first = np.cumsum([0, *(len(x) + 1 for x in texts[at:end])])
            out += np.split(hashes, np.searchsorted(starts, first[1:-1]))
        at = end
    return out


_PLACES = np.random.default_rng(4).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles: of its whole sequence of
    words if that is shorter than ``width``, none without words."""
    out = []
    for words in word_hashes(texts):
        if words.size:
            n, w = max(1, words.size - width + 1), min(width, words.size)
            total = words[:n] * _PLACES[0]
            for k in range(1, w):
                total += words[k : k + n] * _PLACES[k]
            total += np.uint64(w)
            mix64(total)
            total.sort()
            words = total[np.concatenate(([True], total[1:] != total[:-1]))]
        out.append(words)
    return out


def text_bytes(column) -> list[bytes]:
    """Each text of a pyarrow string column in UTF-8; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
