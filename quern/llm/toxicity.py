"""Toxicity by a bidirectional gated recurrent network over characters and words.

A word is the attention-pooled states of a recurrent layer over its characters, beside a hashed
embedding of the word.  A window of words is the attention-pooled states of a second such
layer, and has a logit.  All overlapping windows of a text are scored; the text's logit is
a softmax-weighted mean of theirs, close to the largest.  Training is plain numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.gru import BiGruPool, sigmoid
from quern.llm.shared import _block_hashes

#: Words of a window, and how far the next one starts.
WINDOW, STRIDE = 32, 24
#: Letters of a word; a longer run of letters counts as several words.
LETTERS = 24
CHARS, WORDS = 512, 4096  # rows of the hashed embeddings
CHAR_DIM, CHAR_HIDDEN, WORD_DIM, WORD_HIDDEN = 8, 10, 8, 8
#: Sharpness of the mean over windows.
SHARP = 2.0
#: Bounds of the training sample: texts of each label, by hash of the id, of so many characters at most.
TEXTS_PER_LABEL, LONGEST = (2_000, 6_000), 5_000
#: Of these, so many train the window layer too.
WINDOW_TEXTS = (500, 1_500)
#: Steps of training at least, however few the texts.
LEAST_STEPS = 320
#: A worker remembers so many words, then starts anew.
REMEMBERED = 150_000
_WORD = re.compile(r"[^\W\d_]{1,%d}" % LETTERS)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def windows_of(n: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows over n words; together they hold every word."""
    if n == 0:
        return []
    out = [(s, min(s + WINDOW, n)) for s in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]
    return out


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(time, words) rows of the character table, and the mask."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    width = int(size.max())
    place = (np.cumsum(size) - size)[None, :] + np.arange(width)[:, None]
    mask = np.arange(width)[:, None] < size[None, :]
    codes = flat[np.minimum(place, flat.size - 1)].astype(np.int64)
    return np.where(mask, codes % (CHARS - 1) + 1, 0), mask


def _rows(words: list[str]) -> np.ndarray:
    """Rows of the word table."""
    hashes, _ = _block_hashes(" ".join(words).encode("utf-8", "replace"))
    return (hashes % np.uint64(WORDS)).astype(np.int64)


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.chars = BiGruPool(CHAR_DIM, CHAR_HIDDEN, rng)
        self.words = BiGruPool(2 * CHAR_HIDDEN + WORD_DIM, WORD_HIDDEN, rng)
        self.p = {
            "char": rng.standard_normal((CHARS, CHAR_DIM)).astype(np.float32) * 0.3,
            "word": rng.standard_normal((WORDS, WORD_DIM)).astype(np.float32) * 0.1,
            "out": rng.standard_normal(2 * WORD_HIDDEN).astype(np.float32) * 0.3,
            "bias": np.full(1, -1.0, np.float32),
        }

    # -- scoring

    def word_gates(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of the window layer."""
        out = np.empty((len(words), 6 * WORD_HIDDEN), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(words), 4096):  # alike in length, so that little is padded
            part = order[at : at + 4096]
            some = [words[i] for i in part]
            letters, mask = _letters(some)
            states = self.chars.states(self.chars.gates(self.p["char"][letters]), mask)
            x = np.concatenate((self.chars.pool(states, mask)[0], self.p["word"][_rows(some)]), axis=1)
            out[part] = self.words.gates(x)
        return out

    def logits(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows: (windows, WINDOW) indices of word gates."""
        out = np.empty(len(index), np.float32)
        for at in range(0, len(index), 1024):
            m = mask[at : at + 1024].T
            states = self.words.states(gates[index[at : at + 1024].T], m)
            out[at : at + 1024] = self.words.pool(states, m)[0] @ self.p["out"] + self.p["bias"]
        return out

    def empty(self) -> float:
        return float(self.p["bias"][0])

    # -- training

    def step(self, docs: list[list[str]], labels: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> tuple[float, dict]:
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
        words = list(vocabulary)
        index, mask, owner = _windows([[vocabulary[w] for w in d] for d in docs])
        letters, lmask = _letters(words)
        pooled, char_cache = self.chars.forward(self.p["char"][letters], lmask)
        rows = _rows(words)
        kept = (rng.random(len(words)) > 0.5)[:, None].astype(np.float32)  # so that spelling is learned too
        vectors = np.concatenate((pooled, self.p["word"][rows] * kept), axis=1)
        state, word_cache = self.words.forward(vectors[index.T], mask.T)
        z = state @ self.p["out"] + self.p["bias"]
        doc, share = _mean(z, owner, len(docs))
        prob = sigmoid(doc)
        loss = float(-(weights * (labels * np.log(prob + 1e-7) + (1 - labels) * np.log(1 - prob + 1e-7))).sum() / weights.sum())
        ddoc = (prob - labels) * weights / weights.sum()
        dz = (ddoc[owner] * share * (1 + SHARP * (z - doc[owner]))).astype(np.float32)
        grads = {"out": state.T @ dz, "bias": dz.sum(keepdims=True)}
        dx, g = self.words.backward(dz[:, None] * self.p["out"], word_cache)
        grads |= {f"words.{k}": v for k, v in g.items()}
        dv = _add_rows(index.T[mask.T], dx[mask.T], len(words))
        grads["word"] = _add_rows(rows, dv[:, 2 * CHAR_HIDDEN :] * kept, WORDS)
        dc, g = self.chars.backward(dv[:, : 2 * CHAR_HIDDEN], char_cache)
        grads |= {f"chars.{k}": v for k, v in g.items()}
        grads["char"] = _add_rows(letters[lmask], dc[lmask], CHARS)
        return loss, grads

    def spell(self, words: list[str], labels: np.ndarray, weights: np.ndarray, head: np.ndarray) -> dict:
        """Gradients of the character layer as a judge of single words; ``head``: weights and bias."""
        letters, mask = _letters(words)
        pooled, cache = self.chars.forward(self.p["char"][letters], mask)
        d = ((sigmoid(pooled @ head[:-1] + head[-1]) - labels) * weights / weights.sum()).astype(np.float32)
        dc, g = self.chars.backward(d[:, None] * head[:-1], cache)
        grads = {f"chars.{k}": v for k, v in g.items()} | {"head": np.append(pooled.T @ d, d.sum())}
        grads["char"] = _add_rows(letters[mask], dc[mask], CHARS)
        return grads

    def parameters(self) -> dict[str, np.ndarray]:
        return self.p | {f"words.{k}": v for k, v in self.words.p.items()} | {f"chars.{k}": v for k, v in self.chars.p.items()}


def _add_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that share a place."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    out[places] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _windows(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW) word indices, mask, and the document of each window."""
    spans = [(d, s, e) for d, doc in enumerate(docs) for s, e in windows_of(len(doc))]
    index, mask = np.zeros((len(spans), WINDOW), np.int64), np.zeros((len(spans), WINDOW), bool)
    for k, (d, s, e) in enumerate(spans):
        index[k, : e - s] = docs[d][s:e]
        mask[k, : e - s] = True
    return index, mask, np.array([d for d, _, _ in spans], np.int64)


def _mean(z: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax-weighted mean of each document's window logits, and the windows' weights."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, z)
    w = np.exp(SHARP * (z - top[owner]))
    w /= np.bincount(owner, w, n)[owner]
    return np.bincount(owner, w * z, n), w


def fit(texts: list[str], labels: list[int], *, epochs: int = 2, batch: int = 16, rate: float = 0.006, spelling: int = 1000, seed: int = 5) -> Network:
    """A network from labelled texts; without both labels, one that rates every text alike."""
    net, rng = Network(seed), np.random.default_rng(seed)
    rows = [(w, y) for w, y in ((words_of(t), y) for t, y in zip(texts, labels)) if w]
    positive = sum(y for _, y in rows)
    if not 0 < positive < len(rows):
        net.p["out"][:] = 0
        net.p["bias"][:] = -2.0 if not positive else 2.0
        return net
    _spelling(net, rows, rng, spelling)
    some = {y: [k for k, r in enumerate(rows) if r[1] == y] for y in (0, 1)}
    rows = [rows[k] for k in sorted(some[1][: WINDOW_TEXTS[0]] + some[0][: WINDOW_TEXTS[1]])]
    adam = _Adam(params := net.parameters(), rate, max(LEAST_STEPS, epochs * -(-len(rows) // batch)))  # few texts are read more often
    while adam.left:
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            part = [rows[i] for i in order[at : at + batch]]
            y = np.array([y for _, y in part], np.float64)
            if adam.left:
                adam.step(params, net.step([w for w, _ in part], y, np.ones(len(y)), rng)[1])
    return net


class _Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float, total: int):
        self.first, self.second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
        self.rate, self.total, self.left = rate, total, total

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        self.left -= 1
        n, lr = self.total - self.left, self.rate * (0.1 + 0.9 * self.left / self.total)
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            params[k] -= (lr * (self.first[k] / (1 - 0.9**n)) / (np.sqrt(self.second[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)


def _spelling(net: Network, rows: list[tuple[list[str], int]], rng: np.random.Generator, steps: int) -> None:
    """Starts the character layer: each word of a text is an example of the text's label."""
    counts: dict[str, np.ndarray] = {}
    for words, y in rows:
        for w in set(words):
            counts.setdefault(w, np.zeros(2))[y] += 1
    words = list(counts)
    n = np.array(list(counts.values()))
    labels, size = n[:, 1] / n.sum(1), np.minimum(n.sum(1), 20)
    # and the word table: how much likelier than others a word's texts are toxic, if it is frequent
    base = n[:, 1].sum() / n.sum()
    odds = np.log((n[:, 1] + 4 * base) / (n.sum(1) + 4) / base)
    known = n.sum(1) >= 8
    sums = np.bincount(_rows(words)[known], (odds * n.sum(1))[known], WORDS) / np.maximum(np.bincount(_rows(words)[known], n.sum(1)[known], WORDS), 1)
    net.p["word"][:, 0] = sums.astype(np.float32)
    params = {k: v for k, v in net.parameters().items() if k == "char" or k.startswith("chars.")}
    params["head"] = np.append(rng.standard_normal(2 * CHAR_HIDDEN) * 0.3, 0).astype(np.float32)
    adam = _Adam(params, 0.01, steps)
    chance = size / size.sum()
    for _ in range(steps):
        some = rng.choice(len(words), 512, p=chance)
        adam.step(params, net.spell([words[i] for i in some], labels[some], np.ones(512), params["head"]))
    # the window layer sees the judgement from the start
    scale = float(np.linalg.norm(params["head"][:-1])) or 1.0
    net.words.p["w"][: 2 * CHAR_HIDDEN] += np.outer(params["head"][:-1] / scale, rng.standard_normal(6 * WORD_HIDDEN)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bounds: tuple[int, int] = TEXTS_PER_LABEL, longest: int = LONGEST, **how) -> Network:
    """A network from a bounded sample of the rows that both tables have.

    At most ``bounds[0]`` texts of label 1 and ``bounds[1]`` of label 0, none over ``longest``
    characters, reach the driver, in order of a hash of the id: its front is a fair sample too.  Rows with a null text or label do not count."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    short = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= longest)).select(F.col(id_col).alias("id"))
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(13)), "id")
    # the literal bound lets each task cut its own rows before the shuffle
    chosen = known.join(short, "id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(bounds)).where(F.col("r") <= F.when(F.col("label") == 1, bounds[0]).otherwise(bounds[1]))
    chosen = chosen.select(F.col("id").alias("__id"), "label", "r")  # bounds[0] + bounds[1] rows
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id").orderBy("r", "label", "__id").select("text", "label").toPandas()
    return fit(found["text"].tolist(), found["label"].tolist(), **how)


@dataclass
class Scorer:
    net: Network

    def __post_init__(self):
        self.index: dict[str, int] = {}
        self.gates = np.zeros((1, 6 * WORD_HIDDEN), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), sigmoid(np.float64(self.net.empty())))
        docs = [words_of(t) for t in texts]
        if len(self.index) > REMEMBERED:
            self.index, self.gates = {}, self.gates[:1]
        new = list(dict.fromkeys(w for d in docs for w in d if w not in self.index))
        if new:
            self.index |= {w: len(self.gates) + i for i, w in enumerate(new)}
            self.gates = np.concatenate((self.gates, self.net.word_gates(new)))
        at = self.index.__getitem__
        index, mask, owner = _windows([list(map(at, d)) for d in docs])
        if owner.size:
            doc, _ = _mean(self.net.logits(self.gates, index, mask).astype(np.float64), owner, len(texts))
            some = np.unique(owner)
            out[some] = sigmoid(doc[some])
        return out


def score(docs: DataFrame, net: Network, *, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``to`` (replaced if it is there): the higher, the likelier toxic.

    A text without words, empty or null, gets the score of the bias alone.  Repeated rows get
    equal scores up to single precision; an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size, some 200 kB

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for texts in batches:
            parts = [scorer.scores(texts.iloc[at : at + 200].tolist()) for at in range(0, len(texts), 200)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return docs.withColumn(to, run(F.col(text_col)))
