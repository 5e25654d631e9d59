"""Token counts under a unigram vocabulary: a Viterbi search that carries only scores and counts.

An Aho-Corasick automaton names every vocabulary piece that ends at each character.  Dynamic
programming keeps, for each place, the best score of a segmentation that ends there and its
number of pieces.  Ties go as in the tokenizer: of equal scores the piece that starts first,
and a character without a piece is unknown at ten below the least score.

No piece crosses from one chunk (a word with the space marks before it) into the next, so chunks
are searched once and remembered, and their counts add up.  Sums are in double precision: the
tokenizer's single precision can turn a close decision far into a long text, which the
counter does not imitate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.piece_model import NORMAL, SPACE, USER_DEFINED, Normalizer, PieceModel

#: Fixed value of the tokenizer: how far an unknown character lies below the least score.
UNKNOWN_PENALTY = 10.0
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64
_LEAST = float("-inf")
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class TokenCounter:
    def __init__(self, model: PieceModel):
        self.model = model
        normal = [s for s, k in zip(model.scores, model.kinds) if k == NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown = low - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        known = {}
        for p, s, k in zip(model.pieces, model.scores, model.kinds):
            if k == USER_DEFINED:
                known[p] = (len(p), len(p.encode()) * high - 0.1)
            elif k == NORMAL:
                known[p] = (len(p), s)
        for p, value in known.items():
            self.automaton.add_word(p, value)
        if known:
            self.automaton.make_automaton()
        self.known = known
        self.chars = {p for p in known if len(p) == 1}
        self.normalize = Normalizer(model)
        self.plain = self.normalize.map is None and not self.normalize.fixed and model.dummy_prefix and not model.remove_extra_spaces and model.escape_spaces and not model.space_as_suffix
        # "▁" ends a run of unknown characters, so counts of chunks add up
        self.chunked = SPACE in known and not any(SPACE in p.lstrip(SPACE) for p in known)
        self._seen: dict[str, int] = {}

    def _search(self, chunk: str) -> int:
        """Number of pieces on the best path.  Matches come by end, of one end by start."""
        best, counts = [0.0], [0]
        top, pieces, alone = _LEAST, 0, False
        width = self._width

        def close(upto: int) -> None:
            nonlocal top, pieces, alone
            while len(best) <= upto:
                e = len(best)
                if not alone:  # no piece of this character by itself: it may be unknown
                    value = best[e - 1] + self.unknown
                    if value > top:
                        top, pieces = value, counts[e - 1] + width(chunk[e - 1], chunk, e - 1)
                best.append(top)
                counts.append(pieces)
                top, pieces, alone = _LEAST, 0, False

        for last, (size, score) in self.automaton.iter(chunk) if self.known else ():
            if last > len(best) - 1:
                close(last)
            start = last + 1 - size
            value = best[start] + score
            if value > top:
                top, pieces = value, counts[start] + 1
            alone |= size == 1
        close(len(chunk))
        return counts[-1]

    def _width(self, char: str, chunk: str, at: int) -> int:
        """Ids of an unknown character: its bytes, or one that it shares with an unknown before it."""
        if self.model.byte_fallback:
            return len(char.encode())
        return not (at and chunk[at - 1] not in self.chars)

    def _chunk(self, chunk: str) -> int:
        out = self._search(chunk)
        if len(chunk) <= REMEMBERED_LENGTH:
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            self._seen[chunk] = out
        return out

    def count(self, text: str | None) -> int:
        """Number of ids of the text without begin or end ids; null and empty texts have none."""
        if not text:
            return 0
        normal = SPACE + text.replace(" ", SPACE) if self.plain else self.normalize(text)[0]
        if not normal:
            return 0
        chunks = _CHUNK.findall(normal) if self.chunked else [normal]
        seen = self._seen.get
        return sum([seen(c) or self._chunk(c) for c in chunks])


@lru_cache(maxsize=2)
def counter_of(path: str) -> TokenCounter:
    """One counter for each worker process and model."""
    return TokenCounter(PieceModel.read(path))


def count_tokens(docs: DataFrame, model_path: str, *, text_col: str = "text", to: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text in ``to`` (replaced if it is there).

    Null and empty texts count 0.  Repeated rows get equal counts; an empty table stays empty."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(model_path)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return docs.withColumn(to, run(F.col(text_col)))


__all__ = ["TokenCounter", "count_tokens", "counter_of"]
