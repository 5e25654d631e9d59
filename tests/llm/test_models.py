"""The network's gradients and layers, and the language filters, against slow plain forms."""

import math

import numpy as np

from quern.llm.gru import BiGruPool
from quern.llm.langid import LEAST_SHARE, Filters, gram_hashes
from quern.llm.toxicity import Network, Scorer, train, windows_of, words_of


def _slow_layer(layer: BiGruPool, x: np.ndarray) -> np.ndarray:
    """One sequence, step by step and number by number."""
    h = layer.h
    sig = lambda v: 1 / (1 + math.exp(-v))
    ways = []
    for way in (0, 1):
        u, s, states = layer.p[f"u{way}"], [0.0] * h, {}
        for k in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
            g = (x[k] @ layer.p["w"] + layer.p["b"])[3 * h * way : 3 * h * (way + 1)]
            su = [sum(s[i] * u[i, j] for i in range(h)) for j in range(3 * h)]
            r = [sig(g[j] + su[j]) for j in range(h)]
            z = [sig(g[h + j] + su[h + j]) for j in range(h)]
            c = [math.tanh(g[2 * h + j] + r[j] * su[2 * h + j]) for j in range(h)]
            s = [(1 - z[j]) * c[j] + z[j] * s[j] for j in range(h)]
            states[k] = s
        ways.append(states)
    out = [np.array(ways[0][k] + ways[1][k]) for k in range(len(x))]
    e = np.array([o @ layer.p["a"] for o in out])
    w = np.exp(e - e.max())
    return sum(wk * o for wk, o in zip(w / w.sum(), out))


def test_layer_equals_a_slow_loop_whatever_the_padding():
    rng = np.random.default_rng(0)
    layer = BiGruPool(3, 4, rng)
    size = [5, 1, 3]
    x = rng.standard_normal((5, 3, 3)).astype(np.float32)
    mask = np.arange(5)[:, None] < np.array(size)[None, :]
    got, _ = layer.forward(x, mask)
    for i, n in enumerate(size):
        assert np.allclose(got[i], _slow_layer(layer, x[:n, i]), atol=1e-5)


def test_gradients_equal_differences():
    docs = [words_of("you are a vile thing " * 9), words_of("a calm day"), words_of("thing")]
    labels, weights = np.array([1.0, 0.0, 1.0]), np.ones(3)
    net = Network(3)
    for layer in (net.chars, net.words):
        layer.p = {k: v.astype(np.float64) for k, v in layer.p.items()}
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: net.step(docs, labels, weights, np.random.default_rng(1))[0]
    grads = net.step(docs, labels, weights, np.random.default_rng(1))[1]
    rng = np.random.default_rng(2)
    for name, p in net.parameters().items():
        busy = np.argwhere(np.abs(grads[name]) > 1e-4)
        for at in map(tuple, busy[rng.permutation(len(busy))[:3]]):
            old, step = p[at], 1e-3
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-2 * max(0.05, abs(grads[name][at])), (name, at)


def test_windows_hold_every_word_and_scores_do_not_depend_on_the_batch():
    for n in (1, 31, 32, 33, 56, 57, 1000):
        spans = windows_of(n)
        assert {i for s, e in spans for i in range(s, e)} == set(range(n)) and all(e - s <= 32 for s, e in spans)
    net = Network(7)
    texts = ["one two three " * 50, "four", "", None, "five six"]
    together = Scorer(net).scores(texts)
    assert np.allclose(together, [Scorer(net).scores([t])[0] for t in texts], atol=1e-6) and together[2] == together[3]


def test_toxicity_training_takes_bounded_rows_by_label(spark):
    docs = spark.createDataFrame([(i, f"word{i} " + ("vile" if i % 3 == 0 else "calm")) for i in range(300)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None)], "doc_id long, toxic int")
    net = train(docs.dropDuplicates(["doc_id"]), labels, bounds=(40, 60), spelling=60)
    bad, good = Scorer(net).scores(["such a vile word", "such a calm word"])
    assert bad > good


def test_filters_equal_plain_sets():
    texts = {"aa": "der die das und nicht ein haus " * 5, "bb": "the house and not one of these " * 5, "cc": "la maison et pas une des autres " * 5}
    grams = {k: np.unique(gram_hashes(t)) for k, t in texts.items()}
    sets = {k: set(map(int, g)) for k, g in grams.items()}
    filters = Filters.build(sorted(texts), grams)
    for text in ("das haus", "the house", "une maison", "house maison haus", "zzzz qqqq", "das haus of the maison"):
        h = [int(x) for x in gram_hashes(text)]
        plain = {k: sum(x in s for x in h) / len(h) for k, s in sets.items()}
        lang, _, share = filters.measure(text)
        assert lang == max(sorted(plain), key=lambda k: plain[k]) and abs(share - plain[lang]) < 0.02
    assert 0 < LEAST_SHARE < 1
