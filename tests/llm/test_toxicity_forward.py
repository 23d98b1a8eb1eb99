"""The network's scores of whole texts against loops over words and units."""

import math

import numpy as np
import pytest

from graphev.llm import toxicity

VOCABULARY = [b"good", b"bad", b"word"]


def gram(a: int, b: int, c: int) -> int:
    n = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
    return (n ^ n >> 15) % toxicity.GRAMS


def word_input(net, word: bytes) -> list[float]:
    marked = b"<" + word + b">"
    grams = [net.p["gram"][gram(*marked[i : i + 3])] for i in range(len(marked) - 2)]
    return [*map(float, net.p["word"][net.vocabulary.get(word, 0)]), *(float(sum(g[k] for g in grams)) / len(grams) for k in range(toxicity.GRAM_DIM))]


def dot(row, matrix, j):
    return sum(x * float(matrix[i, j]) for i, x in enumerate(row))


def window_logit(net, words: list[bytes]) -> float:
    size, attention, value = toxicity.HIDDEN, [0.0] * len(words), [0.0] * len(words)
    logistic = lambda x: 1 / (1 + math.exp(-x))
    for d, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        w, u, c, h = net.p[f"W{d}"], net.p[f"U{d}"], net.p[f"c{d}"], [0.0] * size
        for t in order:
            x = word_input(net, words[t])
            new = []
            for j in range(size):
                z = logistic(dot(x, w, j) + float(c[j]) + dot(h, u, j))
                r = logistic(dot(x, w, size + j) + float(c[size + j]) + dot(h, u, size + j))
                k = math.tanh(dot(x, w, 2 * size + j) + float(c[2 * size + j]) + r * dot(h, u, 2 * size + j))
                new.append(z * h[j] + (1 - z) * k)
            h = new
            attention[t] += sum(a * float(b) for a, b in zip(h, net.p[f"a{d}"]))
            value[t] += sum(a * float(b) for a, b in zip(h, net.p[f"w{d}"]))
    weights = [math.exp(a) for a in attention]
    pooled = sum(a * v for a, v in zip(weights, value)) / sum(weights) if words else 0.0
    return pooled + float(net.p["bias"][0])


def test_scores_are_the_highest_windows_by_plain_loops():
    net = toxicity.Network(VOCABULARY, 3)
    draw = np.random.default_rng(1)
    for name in ("cf", "cb", "bias"):
        net.p[name] = draw.standard_normal(net.p[name].shape).astype(np.float32)
    net.offset = 0.25
    some = [["good", "bad", "Word", "other", "ünï"][i] for i in draw.integers(0, 5, toxicity.WINDOW + 30)]
    texts = ["good bad other", None, "", " \n", " ".join(some), "x", "good bad other"]
    got = toxicity.Scorer(net).scores(texts)
    for text, score in zip(texts, got):
        words = toxicity.words_of(text)
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        top = max(window_logit(net, words[s : s + toxicity.WINDOW]) for s in starts)
        assert score == pytest.approx(1 / (1 + math.exp(-(top + 0.25))), abs=1e-4)
    assert got[1] == got[2] == got[3] and got[0] == got[6]


def test_no_documents(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    out = toxicity.scored(docs, labels)
    assert out.count() == 0 and {"held_out", "score", "predicted"} <= set(out.columns)
