"""Near-duplicates and neighbours where groups are dense, lists are divided and rows are odd."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import minhash_forest, pivot_dedup, projected_search
from quern.llm.minhash_forest import near_duplicates


def _labels(n, links):
    label = np.arange(n)
    while True:
        low = label.copy()
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if (low == label).all():
            return label
        label = low


def _shingles(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("block", [1024, 100])
def test_minhash_loses_no_link_of_dense_templates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_forest, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(200)]
    texts = []
    for i in range(700):  # most pairs lie under the threshold, hundreds above it
        t = list(base)
        for k in rng.choice(200, int(rng.integers(2, 4)), replace=False):
            t[k] = f"e{i}x{k}"
        texts.append(" ".join(t))
    sets = [_shingles(t) for t in texts]
    vocabulary = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        m[i, [vocabulary[x] for x in s]] = 1
    both, size = m @ m.T, m.sum(1)
    linked = 100 * both >= 85 * (size[:, None] + size[None, :] - both)
    order = rng.permutation(len(texts))
    label = _labels(len(texts), [(order[i], order[j]) for i, j in zip(*np.nonzero(np.tril(linked, -1)))])
    rows = [(int(i), t) for i, t in zip(order, texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == label.tolist()


def test_minhash_id_with_two_texts_links_with_nothing(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f"), (3, "u v w x y z"), (4, "u v w x y z"), (5, None), (5, "a b c d e f")]
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 1): 1, (2, 1): 1, (3, 3): 2, (4, 4): 1, (5, 5): 2}


def _points(n=1500, width=16):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, width))
    x[: n // 3] = x[0] * 0.2 + x[: n // 3] * 0.5 + 3 * x[1]  # a third of the rows lies close together
    return x


def test_pivot_lists_divided_by_deeper_pivots_lose_no_candidate(spark):
    x = _points()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = {r["vec_id"]: tuple(r) for r in pivot_dedup.near_duplicates(df, long=10_000, block=300).collect()}
    divided = {r["vec_id"]: tuple(r) for r in pivot_dedup.near_duplicates(df, long=40, block=64).collect()}
    assert whole == divided
    np.fill_diagonal(s, 0)
    true = (s >= 0.9).sum()
    assert 0.98 * true <= sum(r[1] for r in divided.values()) <= true


def test_vectors_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (4, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "v", "near", "part", "cell", "copies", "score", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    got = collections.defaultdict(list)
    for r in pivot_dedup.near_duplicates(df).collect():
        got[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    assert got == {0: [(3, 0, True)], 1: [(3, 0, False)] * 2, 2: [(0, 2, True)], 3: [(0, 3, True)], None: [(0, None, True)], 4: [(3, 0, False)]}
    near = projected_search.nearest(df, df.where("vec_id in (0, 3)"), k=2)
    assert [tuple(r) for r in near.orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 4, 1.0)]


def test_nearest_with_cells_and_queries_in_parts(spark, monkeypatch):
    monkeypatch.setattr(projected_search, "QUERIES", 8)
    monkeypatch.setattr(projected_search, "CELL", 128)
    monkeypatch.setattr(projected_search, "CELL_ROWS", 100)
    x = _points()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in projected_search.nearest(df, df.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 20):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(got[q]))
    assert len(got) == 75 and all(len(v) == 5 for v in got.values()) and hits >= 0.95 * 5 * 75
