"""SentencePiece BPE encoding that keeps source offsets, and decoding.

A text is normalised by longest prefix through the model's character map, which records where
each byte comes from.  No piece of a BPE vocabulary crosses from a character to a following
space mark unless the vocabulary holds such a piece, so the normalised text falls into chunks
that are encoded on their own; chunks that come again are remembered, in a bounded table.
Every piece is projected to its span of bytes of the source text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batch_merge import BatchMerger
from quern.llm.piece_model import BYTE, CONTROL, INVALID, SPACE, UNKNOWN, UNUSED, USER_DEFINED, Normalizer, PieceModel
from quern.llm.shared import trim

#: A worker remembers so many chunks of up to REMEMBERED_LENGTH characters, then starts anew.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 64
#: So many texts and bytes of them are encoded at once (a longer text on its own): arrays are longer than texts.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 200, 1 << 19
_NEVER = float("inf")
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Codec:
    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k not in (CONTROL, UNKNOWN, BYTE)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.unused = {p for p, k in zip(model.pieces, model.kinds) if k == UNUSED}
        self.fixed = sorted((p for p, k in zip(model.pieces, model.kinds) if k == USER_DEFINED), key=len, reverse=True)
        self.normalize = Normalizer(model)
        #: whether the text may be copied as it is, spaces marked
        self.plain = self.normalize.map is None and not self.fixed and model.dummy_prefix and not model.remove_extra_spaces and model.escape_spaces and not model.space_as_suffix
        self.chunked = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._known: dict[str, bytes] = {}
        self._batch: BatchMerger | None = None
        self._cost = {p: -model.scores[i] for p, i in self.ids.items()}
        #: bytes of each piece in the normalised text
        self._sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(model.pieces, model.kinds)], np.int32)
        self._is_byte = np.array([k == BYTE for k in model.kinds])
        raw = [b"" if k == CONTROL else bytes((int(p[3:5], 16),)) if k == BYTE else (model.unk_surface if k == UNKNOWN else p.replace(SPACE, " ")).encode() for p, k in zip(model.pieces, model.kinds)]
        self._raw = raw
        self._leads = [p.startswith(SPACE) and k not in (CONTROL, BYTE, UNKNOWN) for p, k in zip(model.pieces, model.kinds)]
        self._silent = [k == CONTROL for k in model.kinds]

    # -- encoding

    def _symbols(self, chunk: str) -> list[str]:
        if not self.fixed:
            return list(chunk)
        out, at = [], 0
        while at < len(chunk):
            piece = next((p for p in self.fixed if chunk.startswith(p, at)), chunk[at])
            out.append(piece)
            at += len(piece)
        return out

    def merge(self, chunk: str) -> list[str]:
        """Pieces of a chunk: the best-scored neighbours join first, of equal ones the leftmost."""
        if len(chunk) > 100 or self.fixed or self.unused:
            return self._merge_long(chunk)
        cost = self._cost.get
        symbols = list(chunk)
        costs = [cost(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while costs:
            best = min(costs)
            if best == _NEVER:
                break
            k = costs.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del costs[k]
            if k < len(costs):
                costs[k] = cost(symbols[k] + symbols[k + 1], _NEVER)
            if k:
                costs[k - 1] = cost(symbols[k - 1] + symbols[k], _NEVER)
        return symbols

    def _merge_long(self, chunk: str) -> list[str]:
        """The same with a heap, for long chunks and for pieces of the rarer kinds."""
        ids, scores = self.ids, self.model.scores
        symbols = self._symbols(chunk)
        n = len(symbols)
        frozen = [s in self.fixed for s in symbols] if self.fixed else None
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        halves: dict[str, tuple[str, str]] = {}
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left < 0 or right >= n or frozen and (frozen[left] or frozen[right]):
                return
            joined = symbols[left] + symbols[right]
            at = ids.get(joined)
            if at is not None:
                heapq.heappush(heap, (-scores[at], left, right, joined))
                if joined in self.unused:
                    halves[joined] = (symbols[left], symbols[right])

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != joined or after[left] != right:
                continue
            symbols[left], symbols[right] = joined, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        if not self.unused:
            return [s for s in symbols if s]
        out: list[str] = []

        def split(piece: str) -> None:  # unused pieces fall apart again
            if piece in self.unused and piece in halves:
                for half in halves[piece]:
                    split(half)
            else:
                out.append(piece)

        for s in symbols:
            if s:
                split(s)
        return out

    def _encode_chunk(self, chunk: str) -> tuple[list[int], list[int]]:
        """ids, and the bytes of each piece in the normalised text."""
        ids: list[int] = []
        sizes: list[int] = []
        for piece in self.merge(chunk):
            at = self.ids.get(piece)
            if at is None and self.model.byte_fallback:
                data = piece.encode()
                ids += [self.byte_ids[b] for b in data]
                sizes += [1] * len(data)
            else:
                ids.append(self.model.unk_id if at is None else at)
                sizes.append(len(piece.encode()))
        return ids, sizes

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk (int32), remembered if it is short."""
        found = np.array(self._encode_chunk(chunk)[0], np.int32).tobytes()
        if len(chunk) <= REMEMBERED_LENGTH:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[chunk] = found
        return found

    def learn(self, texts: list[str | None]) -> None:
        """Encodes the chunks of these texts that are not known yet, all at once."""
        if not (self.plain and self.chunked and self.model.byte_fallback) or self.unused:
            return
        chunks: set[str] = set()
        for text in texts:
            if text:
                chunks.update(_CHUNK.findall(SPACE + text.replace(" ", SPACE)))
        new = [c for c in chunks if c not in self._known and len(c) <= REMEMBERED_LENGTH]
        if not new:
            return
        if len(self._known) + len(new) > REMEMBERED:
            self._known.clear()
        if self._batch is None:
            self._batch = BatchMerger(self.ids, self._cost, self.byte_ids)
        for chunk, ids in zip(new, self._batch.merge(new)):
            if ids is not None:
                self._known[chunk] = ids

    def encode(self, text: str | None, eos: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends): each piece's span of bytes of the UTF-8 source.

        A null text is empty.  Bytes of a character that the vocabulary lacks share its span; pieces made
        of added marks only have an empty span, as has the end id."""
        if not text:
            ids = np.empty(0, np.int32)
            starts = ends = np.empty(0, np.int64)
            total = 0
        else:
            if self.plain:
                normal = SPACE + text.replace(" ", SPACE)
                places = _plain_places(text)
            else:
                normal, at = self.normalize(text)
                places = np.array(at, np.int64)
            chunks = _CHUNK.findall(normal) if self.chunked else [normal]
            if self.model.byte_fallback:
                known = self._known.get
                ids = np.frombuffer(b"".join([known(c) or self._chunk(c) for c in chunks]), np.int32)
                sizes = self._sizes[ids]
            else:  # the width of an unknown piece is not in its id
                found = [self._encode_chunk(c) for c in chunks]
                ids, sizes = (np.array([x for f in found for x in f[k]], np.int32) for k in (0, 1))
            ends_n = np.cumsum(sizes, dtype=np.int64)
            starts_n = ends_n - sizes
            single = self._is_byte[ids]
            if single.any():  # the bytes of one character all have its span
                starts_n, ends_n = self._whole(normal, single, starts_n, ends_n)
            if not self.model.byte_fallback and ids.size > 1:  # neighbours without a piece are one
                unk = ids == self.model.unk_id
                first = np.concatenate(([True], ~(unk[1:] & unk[:-1])))
                final = np.concatenate((first[1:], [True]))
                ids, starts_n, ends_n = ids[first], starts_n[first], ends_n[final]
            starts, ends = places[starts_n], places[ends_n]
            total = int(places[-1])
        if eos:
            ids = np.append(ids, np.int32(self.model.eos_id))
            starts, ends = np.append(starts, total), np.append(ends, total)
        return ids, starts, ends

    def _whole(self, normal: str, single: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(normal.encode(), np.uint8)
        leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), data.size)  # where characters start
        k = np.searchsorted(leads, starts[single], "right")
        starts, ends = starts.copy(), ends.copy()
        starts[single], ends[single] = leads[k - 1], leads[k]
        return starts, ends

    # -- decoding

    def decode(self, ids) -> str:
        """The text of ids: control ids are silent, the first space mark (the added one) goes (all that
        stand first, if the model removes extra spaces),
        byte ids join to characters, and each byte that makes none becomes U+FFFD."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        skip = 0
        if self.model.dummy_prefix or self.model.remove_extra_spaces:
            for i in ids:
                if not self._silent[i]:
                    skip += self._leads[i]
                    if not self._leads[i] or len(self._raw[i]) > 1 or not self.model.remove_extra_spaces:
                        break
        raw = b"".join(map(self._raw.__getitem__, ids))[skip:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + INVALID)
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One codec for each worker process and model: what it remembers outlives a task."""
    return Codec(PieceModel.read(path))


def _plain_places(text: str) -> np.ndarray:
    """For each byte of the marked text, and its end, the source byte: a space takes three."""
    data = np.frombuffer(text.encode(), np.uint8)
    width = np.where(data == 0x20, 3, 1)
    return np.concatenate(([0, 0, 0], np.repeat(np.arange(data.size), width), [data.size]))


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of these sizes that are encoded at once."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, "right"))
        to = max(at + 1, min(most, at + TEXTS_AT_ONCE))
        yield at, to
        at = to


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", eos: bool = True, decoded: bool = False, round_trip: bool = False) -> DataFrame:
    """``docs`` with ``ids``, ``starts``, ``ends`` (arrays; byte spans of the source text) in place of
    columns so named; with ``decoded`` also the text that the ids decode to, in the same pass, and with ``round_trip``
    whether that is the text, which then doesn't come back (null counts as empty).

    A null or empty text has the end id alone.  Repeated rows get equal results; an empty table gives
    an empty result.  ``model_path`` is a file that every executor has."""

    new = ["ids", "starts", "ends", *(["decoded"] if decoded else []), *(["round_trip"] if round_trip else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for batch in batches:
            texts = batch.column(0)
            for at, to in _cuts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                some = texts.slice(at, to - at).to_pylist()
                codec.learn(some)
                found = [codec.encode(t, eos) for t in some]
                n = pa.array(np.cumsum([0, *(len(x[0]) for x in found)]), pa.int32())
                arrays = [pa.ListArray.from_arrays(n, pa.array(np.concatenate([x[k] for x in found]).astype(np.int32, copy=False), pa.int32())) for k in range(3)]
                back = [codec.decode(x[0]) for x in found] if decoded or round_trip else []
                more = [pa.array(back, pa.string())] if decoded else []
                more += [pa.array([x == (t or "") for x, t in zip(back, some)], pa.bool_())] if round_trip else []
                del found, back
                rest = [c.slice(at, to - at) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, *arrays, *more], names=[*[f"c{i}" for i in range(len(rest))], *new])
                trim()

    kept = [f for f in docs.schema.fields if f.name not in new and not (round_trip and f.name == text_col)]
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])
    schema = ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)], "ids array<int>, starts array<int>, ends array<int>", *(["decoded string"] if decoded else []), *(["round_trip boolean"] if round_trip else [])])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], *new)


def decode(rows: DataFrame, model_path: str, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_col`` in ``to``; null ids give a null text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(model_path)
        for ids in batches:
            yield pd.Series([None if x is None else codec.decode(x) for x in ids], dtype=object)

    return rows.withColumn(to, run(F.col(ids_col)))
