"""Language identification with language-bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: slot ``s`` of the table holds one bit a language, so
one look-up at each of an n-gram's slots, combined by AND, names every language whose training
texts have the n-gram.  A text's n-grams are counted per language, each count is
corrected for the share that the language's filter lets through by mistake, and the language with the
largest corrected share wins.

N-grams are of 3 and 4 characters of lower-cased words, with one mark for whatever lies
between words; digits, signs and markup do not take part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import mix64, small

ORDERS = (3, 4)
#: Bound of the training sample: so many labelled texts of each language, by hash of the id.
TEXTS_PER_LANGUAGE = 3000
#: So many n-grams of each language enter its filter, the most frequent first.
GRAMS_PER_LANGUAGE = 20_000
#: An n-gram enters a language's filter if it is at least this fraction as frequent there as in
#: the language that has it most.
LEAST_SHARE = 0.2
SLOTS, PROBES = 1 << 19, 3
#: Texts are read in pieces of so many characters, so that memory does not follow the longest.
PIECE = 1 << 18
_MAX_CODE = sys.maxunicode + 1
_STEP = np.uint64(0x110001)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(_MAX_CODE)), bool, _MAX_CODE)


def _codes(piece: str, after_letter: bool) -> tuple[np.ndarray, bool]:
    """Code points of the lower-cased letters, of what lies between words one 0; and whether the
    last character is a letter."""
    raw = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] |= after_letter
    return np.where(letter, raw, np.uint32(0))[keep].astype(np.uint64), bool(letter[-1])


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of a text, repeats included, with a mark at either end."""
    parts = []
    tail, inside = np.zeros(1, np.uint64), False
    for at in range(0, len(text), PIECE):
        codes, inside = _codes(text[at : at + PIECE], inside)
        last = [0] if inside and at + PIECE >= len(text) else []
        codes = np.concatenate((tail, codes, np.array(last, np.uint64)))
        given = tail.size == 3  # its trigram was in the piece before
        tail = codes[-3:]
        if codes.size < 3:
            continue
        inner = codes[1:-1] != 0  # a mark inside an n-gram joins two words
        three = (codes[:-2] * _STEP + codes[1:-1]) * _STEP + codes[2:]
        parts.append(mix64(three[given:][inner[given:]] * np.uint64(8) + np.uint64(3)))
        inner = inner[:-1] & inner[1:]
        parts.append(mix64((three[:-1] * _STEP + codes[3:])[inner] * np.uint64(8) + np.uint64(4)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Filters:
    """languages: in order of code points.  table: SLOTS masks with a bit a
    language, in as many rows as the languages need."""

    languages: list[str]
    table: np.ndarray
    wrong: np.ndarray  # share of unseen n-grams that each language's filter lets through

    @staticmethod
    def build(languages: list[str], grams: dict[str, np.ndarray]) -> Filters:
        few = next((kind for kind, bits in ((np.uint8, 8), (np.uint16, 16)) if len(languages) <= bits), np.uint64)
        width = np.dtype(few).itemsize * 8
        table = np.zeros((max(1, -(-len(languages) // width)), SLOTS), few)
        wrong = np.zeros(len(languages))
        for i, lang in enumerate(languages):
            filled = np.zeros(SLOTS, bool)
            for slot in _slots(grams[lang]):
                filled[slot] = True
            table[i // width, filled] |= few(1 << i % width)
            wrong[i] = filled.mean() ** PROBES
        return Filters(languages, table, wrong)

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, part of all shares in 0..1); ("und", 0.0) for null or a text without letters."""
        return self.measure(text)[:2]

    def measure(self, text: str | None) -> tuple[str, float, float]:
        """(language, part of all shares, corrected share of the text's n-grams)."""
        if not text or not has_letter(text) or not self.languages:
            return "und", 0.0, 0.0
        h = gram_hashes(text)
        share = np.zeros(len(self.languages))
        if h.size:
            first, second, third = _slots(h)
            hits = np.concatenate([_popcounts(row[first] & row[second] & row[third]) for row in self.table])[: share.size]
            share = np.clip((hits / h.size - self.wrong) / (1 - self.wrong), 0, 1)
        best = int(np.argmax(share))  # ties: the first by code points
        total = share.sum()
        return self.languages[best], float(share[best] / total) if total > 0 else 0.0, float(share[best])


def _popcounts(bits: np.ndarray) -> np.ndarray:
    """How many of the masks have each bit."""
    width = bits.dtype.itemsize * 8
    if width <= 16:
        n = np.bincount(bits, minlength=1 << width)
        return np.array([n.reshape(-1, 2, 1 << i)[:, 1].sum() for i in range(width)])
    return np.array([np.count_nonzero(bits & np.uint64(1 << i)) for i in range(width)])


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = np.uint64(SLOTS - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(21) & mask).astype(np.int64), (h >> np.uint64(42) & mask).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums before the shuffle: every 200 texts give each n-gram of a language once."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, []).append(gram_hashes(text or ""))
            for lang, parts in found.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * h.size, pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def train(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts_per_language: int = TEXTS_PER_LANGUAGE, grams_per_language: int = GRAMS_PER_LANGUAGE) -> Filters:
    """Filters from a bounded sample of labelled rows; rows with a null text or label are left out.

    What reaches the driver is ``grams_per_language`` n-grams for each language."""
    labelled = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # ids are chosen without their texts, and cut within each task before the shuffle
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(7)), "id")
    chosen = labelled.select("lang", "id").distinct().withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= texts_per_language).select("lang", "id")
    n_languages = labelled.select("lang").distinct().count()
    chosen = small(chosen, n_languages * texts_per_language)
    sample = labelled.join(chosen, ["lang", "id"], "left_semi")
    # dealt by id: copies of one text do not meet in one task
    grams = sample.repartition(F.xxhash64("id")).select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    every = grams.groupBy("lang").agg(F.sum("n").alias("all"))
    grams = grams.where("n > 1").join(small(every, n_languages), "lang").withColumn("f", F.col("n") / F.col("all"))
    grams = grams.withColumn("top", F.max("f").over(Window.partitionBy("gram"))).where(F.col("f") >= LEAST_SHARE * F.col("top"))  # a row a language
    ranked = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= grams_per_language)
    found = ranked.select("lang", "gram").toPandas()
    groups = {lang: g.to_numpy(np.int64).view(np.uint64) for lang, g in found.groupby("lang")["gram"]}
    languages = sorted(groups)
    return Filters.build(languages, groups)


def predict(docs: DataFrame, filters: Filters, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_share`` in place of columns so named.

    lang_pred is a learned label, or ``und`` with score 0 if the text is null or has no letter.  A text
    none of whose n-grams was learned gets the first label and score 0.  The score is
    the winner's part of the corrected shares of all languages; lang_share is the winner's corrected share of the
    text's n-grams, which doesn't depend on the number of languages.  Ties go to the
    first label by code points.  Repeated rows get equal results; no rows, no result rows."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(filters)  # SLOTS * 8 bytes a 64 languages: a fixed size

    @F.pandas_udf("lang_pred string, score double, lang_share double")
    def run(texts):
        import pandas as pd

        f = model.value
        return pd.DataFrame([f.measure(t) for t in texts], columns=["lang_pred", "score", "lang_share"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_share")]
    out = docs.withColumn("__lang", run(F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__lang.lang_pred").alias("lang_pred"), F.col("__lang.score").alias("score"), F.col("__lang.lang_share").alias("lang_share"))


def accepted(least: float) -> Column:
    """Whether a predicted row is kept: its language has at least this share of its n-grams."""
    return (F.col("lang_pred") != "und") & (F.col("lang_share") >= least)


__all__ = ["Filters", "SparkSession", "accepted", "gram_hashes", "predict", "train"]
