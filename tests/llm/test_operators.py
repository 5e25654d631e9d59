"""Defined results of every operator on nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import pivot_dedup, toxicity
from quern.llm.html_text import extract_text
from quern.llm.langid import Filters, accepted, gram_hashes, predict, train
from quern.llm.line_dedup import drop_boilerplate
from quern.llm.minhash_forest import near_duplicates
from quern.llm.mixing import apply_mix, mix
from quern.llm.projected_search import chi_square, nearest
from quern.llm.queries import tokenizer_path
from quern.llm.sentencepiece_codec import decode, encode
from quern.llm.shared import shingle_sets, word_hashes
from quern.llm.token_counts import count_tokens
from quern.llm.toxicity import Scorer, fit, score, windows_of, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls in every column, empty and long texts, repeated rows and clashing names."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 1), (2, "one two three four five six seven", "en", "a", 1), (2, "one two three four five six seven", "en", "a", 1),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \t\n", "en", None, 3), (6, long, "en", "b", 9), (7, long + " more", None, "b", 9),
        (None, "one two three four five six seven", None, "a", 1), (8, "solo", "de", "c", 4), (9, "solo", "de", "c", 4), (10, "1234 !!!", "de", "c", 4),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "size", "score", "tree", "lines_all", "ids", "component_id", "copies", "unit", "host", "up"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def _by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def test_minhash_odd_rows(odd, none):
    r = _by_id(near_duplicates(odd, percent=85))
    assert sum(map(len, r.values())) == odd.count()
    assert [x["component_id"] for i in (1, 2) for x in r[i]] == [1, 1, 1] and r[1][0]["kept"] and not r[2][0]["kept"] and r[1][0]["n_shingles"] == 3
    assert [(x["n_shingles"], x["component_id"], x["kept"]) for i in (3, 4, 5) for x in r[i]] == [(0, i, True) for i in (3, 4, 5)]
    assert r[7][0]["component_id"] == 6 and r[9][0]["component_id"] == 8 and r[8][0]["n_shingles"] == 1
    assert (r[None][0]["component_id"], r[None][0]["kept"]) == (None, True)
    assert near_duplicates(none).count() == 0


def test_minhash_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(40):
        base = [f"g{g}w{rng.integers(0, 400)}" for _ in range(rng.integers(3, 120))]
        for _ in range(rng.integers(1, 9)):
            t = list(base)
            for _ in range(rng.integers(0, 3)):
                t[rng.integers(0, len(t))] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(t))
    sets = [set(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (t.lower().split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = _by_id(near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i][0]["component_id"] for i in range(len(texts))] == label
    assert [got[i][0]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_minhash_star_links_through_its_centre(spark):
    rng = np.random.default_rng(8)
    centre = [f"c{i}" for i in range(300)]
    texts = [" ".join(centre)]
    for i in range(2000):  # alike to the centre to 0.88, to each other to 0.78
        t = list(centre)
        for k in rng.choice(60, 4, replace=False):
            t[5 * k] = f"e{i}x{k}"
        texts.append(" ".join(t))
    texts += ["lone " + " ".join(f"z{i}" for i in range(40))]
    ids = rng.permutation(len(texts)) + 10  # the centre is not the smallest
    rows = [(int(i), t) for i, t in zip(ids, texts)]
    got = _by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85))
    star = min(i for i, _ in rows[:-1])
    assert all(got[i][0]["component_id"] == star for i, _ in rows[:-1])
    assert got[rows[-1][0]][0]["component_id"] == rows[-1][0]


def test_shingles_are_sets_of_words():
    t = "To to TO of of a b c d e f g  \t h\x0bi é É"
    words = t.encode().lower().split()
    assert word_hashes([t.encode()])[0].size == len(words)
    assert shingle_sets([t.encode()], 5)[0].size == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    long = (" ".join(f"v{i}" for i in range(60_000))).encode()
    a, b = word_hashes([long, b"x", b"", long])[0::3]
    assert (a == b).all() and a.size == 60_000 == np.unique(a).size and word_hashes([b"v7"])[0][0] == a[7]


def test_mix_odd_rows(odd, none):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and mix(none).count() == 0
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert abs(r["target"] - 0) >= 0 and r["target"] <= 2 * r["source_size"] + 1e-9
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"] * 3)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix(odd.repartition(7)).collect()), key=repr)
    assert apply_mix(odd).columns == odd.columns


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Resharing by weight until no target is above its cap."""
    names = sorted(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows, sizes = [], collections.Counter()
    for i in range(3000):
        s = "hot" if rng.random() < 0.4 else f"s{rng.integers(0, 9)}"
        n = int(rng.integers(0, 60))
        rows.append((i, "w " * n, s))
        sizes[s] += n
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8).collect()
    want, taken = _targets(sizes), collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        rate = want[r["source"]] / sizes[r["source"]]
        assert math.floor(rate) <= r["copies"] <= math.ceil(rate)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)  # at most the last row is off


def test_line_dedup(spark, odd, none):
    rows = [(i, f"head \nbody {i}\n\nfoot", "h") for i in range(20)] + [(i, "head\nrare", "other") for i in range(20, 23)] + [(30, None, "h"), (31, "", None), (32, "head\t", "h")]
    got = _by_id(drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[3][0]["text"] == "body 3\n" and got[3][0]["lines_dropped"] == 2 and got[3][0]["lines_all"] == 4
    assert got[21][0]["text"] == "head\nrare" and got[30][0]["text"] is None and got[31][0]["text"] == "" and got[32][0]["text"] == ""
    assert drop_boilerplate(odd).count() == odd.count() and drop_boilerplate(none).count() == 0


def test_language_filters(spark, odd, none):
    rows = [(i, "the cat and the dog with this " * 3, "en") for i in range(5)] + [(i, "der hund und die katze nicht " * 3, "de") for i in range(5, 10)] + [(99, None, "en"), (98, "x", None)]
    f = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert f.languages == ["de", "en"] and f.score("the dog")[0] == "en" and f.score("NICHT die")[0] == "de"
    assert f.score(None) == f.score("12 !") == f.score("") == ("und", 0.0) and f.score("ΩΩΩΩ") == ("de", 0.0)
    out = _by_id(predict(odd, f))
    assert out[3][0]["lang_pred"] == "und" and out[10][0]["lang_pred"] == "und" and predict(none, f).count() == 0
    assert predict(odd, f).where(accepted(0.25)).where("doc_id in (3, 4, 5, 10)").count() == 0
    assert Filters.build([], {}).score("abc") == ("und", 0.0) and train(none).languages == []
    many = [f"l{i:03d}" for i in range(130)]  # more languages than bits of a word
    g = Filters.build(many, {m: gram_hashes(f"{m} {chr(0x4E00 + i) * 5}") for i, m in enumerate(many)})
    assert g.score(chr(0x4E00 + 101) * 5)[0] == "l101"


def test_language_share_decides(spark):
    text = "the cat and the dog with this house over that river"
    related = [f"l{i}" for i in range(10)]  # ten languages that share their n-grams
    clean = Filters.build(related, dict.fromkeys(related, gram_hashes(text)))
    four = Filters.build(["de", "en", "es", "fr"], {"de": gram_hashes("der hund und die katze nicht"), "en": gram_hashes(text), "es": gram_hashes("el perro y los gatos"), "fr": gram_hashes("le chien dans une maison")})
    junk, foreign = "xqzv kjwq zzxv qpwk vbnq the wqjx kzqv", "kissa istuu pöydällä ja katselee ikkunasta pihalle"
    rows = spark.createDataFrame([(0, text), (1, junk), (2, foreign)], "doc_id long, text string")
    assert four.score(junk)[1] >= 0.25  # a part of all shares does not tell
    assert [r["doc_id"] for r in predict(rows, four).where(accepted(0.25)).collect()] == [0]
    assert clean.score(text)[1] < 0.25 and [r["doc_id"] for r in predict(rows, clean).where(accepted(0.25)).collect()] == [0]


def test_tokens(odd, none):
    path = tokenizer_path()
    out = _by_id(decode(encode(odd, path), path))
    assert out[3][0]["ids"] == [2] and out[4][0]["decoded"] == "" and out[6][0]["decoded"] == odd.where("doc_id = 6").first()["text"]
    assert out[6][0]["ends"][-1] == len(out[6][0]["decoded"]) and encode(none, path).count() == 0
    both = _by_id(encode(odd, path, decoded=True))
    assert all(both[i][0]["decoded"] == out[i][0]["decoded"] for i in out)
    counts = _by_id(count_tokens(odd, path))
    assert counts[3][0]["n_tokens"] == 0 and counts[6][0]["n_tokens"] > 60_000 and count_tokens(none, path).count() == 0


def test_html(spark):
    df = spark.createDataFrame([(1, "<p>a<p>b"), (2, None), (3, "")], "page_id long, html string")
    assert [r["text"] for r in extract_text(df).orderBy("page_id").collect()] == ["a\n\nb", None, ""] and extract_text(df.limit(0)).count() == 0


def _vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    x[200:260] = x[:60] + 0.02 * rng.standard_normal((60, 16))
    x[300:340] = x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [float("inf")] * 16), (1004, [None] + [1.0] * 15), (1005, [])]
    return x, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")


def test_pivot_dedup_against_brute_force(spark):
    x, df = _vectors(spark)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(20):
        for i in range(len(x)):
            label[i] = min(label[i], *label[link[i]]) if link[i].any() else label[i]
    got = {r["vec_id"]: r for r in pivot_dedup.near_duplicates(df, block=64).collect()}
    assert len(got) == 406 and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(1000, 1006))
    found, true = sum(got[i]["n_links"] for i in range(len(x))), link.sum()
    assert 0.98 * true <= found <= true and np.mean([got[i]["component_id"] == label[i] for i in range(len(x))]) > 0.98
    assert pivot_dedup.near_duplicates(df.limit(0)).count() == 0 and pivot_dedup.near_duplicates(df.where("vec_id >= 1000")).count() == 6


def test_pivot_dedup_keeps_recall_beside_a_dense_group(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((16_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:5000] = x[0] * 3.2 + x[:5000]  # inner cosines about 0.91
    y = x[15_000:] - (x[15_000:] * x[14_000:15_000]).sum(1)[:, None] * x[14_000:15_000]
    y /= np.linalg.norm(y, axis=1)[:, None]
    x[15_000:] = 0.905 * x[14_000:15_000] + np.sqrt(1 - 0.905**2) * y  # pairs near the threshold
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true = np.array([(u[a : a + 1000] @ u.T >= 0.9).sum(1) - 1 for a in range(0, len(u), 1000)]).ravel()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.zeros(len(u))
    for r in pivot_dedup.near_duplicates(rows).collect():
        got[r["vec_id"]] = r["n_links"]
    print("recall", got[:5000].sum() / true[:5000].sum(), got[14_000:].sum() / true[14_000:].sum())
    assert (got <= true).all() and got[:5000].sum() >= 0.95 * true[:5000].sum() and got[14_000:].sum() >= 0.95 * true[14_000:].sum()


def test_nearest_against_brute_force(spark):
    x, df = _vectors(spark)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = collections.defaultdict(list)
    for r in nearest(df, df.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, ids in got.items():
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:5]
        hits += len(set(best.tolist()) & set(ids))
    assert hits >= 0.95 * 5 * len(got) and got[300] == [5, 301, 302, 303, 304]
    two = df.where("vec_id < 3")
    assert nearest(two, two.where("vec_id = 0")).count() == 2 and nearest(df.limit(0), df).count() == 0 and nearest(two, two.limit(0)).count() == 0
    assert chi_square(np.array([0.0, 7.344, 1e4]), 8) == pytest.approx([0, 0.5, 1], abs=1e-3)


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(4)
    clean = ["the", "that", "house", "garden", "river", "walks", "over", "green", "stone", "light"]
    texts, labels = [], []
    for i in range(160):
        w = [clean[rng.integers(0, 10)] for _ in range(40)]
        if i % 4 == 0:
            w[rng.integers(0, 40)] = f"vile{'abcdefgh'[rng.integers(0, 8)]}"
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    net = fit(texts, labels, spelling=150)
    s = Scorer(net).scores(["the house " * 30 + "vilex river", "green stone light " * 30, None, ""])
    assert s[0] > 0.5 > s[1] and s[2] == s[3] and 0 <= s[3] <= 1
    assert score(none, net).count() == 0 and score(odd, net).where("score between 0 and 1").count() == odd.count()
    one = fit(["a b"], [0])
    assert Scorer(one).scores(["a"])[0] < 0.5
    for n in (0, 1, 32, 33, 57, 500):
        assert {k for a, b in windows_of(n) for k in range(a, b)} == set(range(n))
    assert words_of("Ab1cd É" + "x" * 60) == ["ab", "cd", "é" + "x" * 23, "x" * 24, "x" * 13]


def test_toxicity_layers_learn_from_a_sample_by_hash(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, **how: seen.extend(zip(map(int, texts), labels)))
    docs = spark.createDataFrame([(i, str(i)) for i in range(400)], "doc_id long, text string")
    toxicity.train(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic"))
    assert sorted(i for i, _ in seen) == list(range(400))
    for label in (0, 1):
        front = [i for i, y in seen if y == label][:50]
        assert 120 < np.mean(front) < 280  # the front of the ids would be about 50
