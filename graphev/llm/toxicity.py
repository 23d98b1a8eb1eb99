"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a learnt vector of the word (words of the training sample's vocabulary; others
have none) joined with the mean of learnt vectors of its character trigrams. Two gated recurrent
units read a window of ``WINDOW`` words in both directions, attention weighs their states, and a
logistic unit scores the pooled state. A document is scored by all its overlapping windows
(``STRIDE`` words apart, to its very end); its score is its highest window's.

Training takes a bounded sample of labelled documents: at most ``SAMPLE`` of each label, none
longer than ``SAMPLE_CHARS``, chosen by a hash of their id. One task trains the network on it by
gradient descent; the model (under 5 MB) is broadcast. In a toxic document only the window that
scores highest is learnt from, after the first round, as most of its windows may be harmless. An
offset fitted to documents kept aside makes the scores chances. Everything else covers all documents and whole texts.

Only the text goes into a score. Null and empty texts have one window without words; they get the
score of the network's bias. Words over ``LONGEST`` bytes are read in parts of that length. With
no labelled rows of both kinds all scores are the share of toxic ones (0 without any). Rows whose
toxic label is null are not learnt from; of repeated labels of a doc_id the highest counts. Null
doc_ids are scored like others. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphev.llm.common import table

WINDOW, STRIDE = 64, 48
WORD_DIM, GRAM_DIM, HIDDEN = 16, 16, 16
VOCAB, GRAMS, LONGEST = 20_000, 1 << 15, 40
#: A word is in the vocabulary if at least so many sampled documents, and this share of them, hold it.
WORD_DOCS, WORD_SHARE = 3, 0.003
SAMPLE, SAMPLE_CHARS = {1: 1000, 0: 3000}, 8_000
ROUNDS, BATCH, RATE, SEED = 6, 256, 0.01, 7
#: Small samples take smaller batches, and more rounds until there are so many steps.
SMALL_BATCH, STEPS = 32, 300
DROP, DECAY = 0.3, 0.1
#: Every so-manieth sampled document is kept from training and fits the offset of the scores.
ASIDE = 5
THRESHOLD = 0.7
CACHE_WORDS = 100_000
#: ASCII punctuation and control bytes become blanks; letters of all languages stay.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode().translate(PLAIN).split()
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of '<word>' for all words in a row, and where each word's begin."""
    text = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    grams = (text[:-2] * np.uint32(0x9E3779B1)) ^ (text[1:-1] * np.uint32(0x85EBCA77)) ^ (text[2:] * np.uint32(0xC2B2AE3D))
    inside = np.ones(len(text), bool)
    inside[starts + sizes - 1] = inside[starts + sizes - 2] = False
    firsts = starts - 2 * np.arange(len(words))
    return ((grams ^ (grams >> np.uint32(15))) % np.uint32(GRAMS))[inside[:-2]], firsts


def windows_of(n: int) -> list[int]:
    """First words of the windows over n words; the last one reaches the end."""
    return [*range(0, max(1, n - WINDOW + STRIDE), STRIDE)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, scores and gradients. x: inputs of a batch of windows (n, WINDOW, dim), mask
    (n, WINDOW)."""

    def __init__(self, vocabulary: list[bytes], seed: int):
        draw = np.random.default_rng(seed)
        dim = WORD_DIM + GRAM_DIM
        mat = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.p = {"word": 0.1 * mat(len(vocabulary) + 1, WORD_DIM) * np.sqrt(len(vocabulary) + 1), "gram": draw.standard_normal((GRAMS, GRAM_DIM)).astype(np.float32) * np.float32(0.3)}
        self.p["word"] = self.p["word"].astype(np.float32)
        self.p["word"][0] = 0
        for d in "fb":
            self.p |= {f"W{d}": mat(dim, 3 * HIDDEN), f"U{d}": mat(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
            self.p |= {f"a{d}": mat(HIDDEN) * np.float32(0.3), f"w{d}": mat(HIDDEN)}
        self.p["bias"] = np.full(1, -1, np.float32)
        self.offset = 0.0

    def word_inputs(self, words: list[bytes]) -> np.ndarray:
        known = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        grams, firsts = grams_of(words)
        sums = np.add.reduceat(self.p["gram"][grams], firsts, axis=0)
        counts = np.diff([*firsts, len(grams)])[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][known], sums / counts], axis=1)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def step(self, d: str, g: np.ndarray, h: np.ndarray):
        """One step of a gated unit: update z, reset r, candidate."""
        u = h @ self.p[f"U{d}"]
        zr = sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        return z, r, c, u[:, 2 * HIDDEN :]

    def logits(self, gates: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Scores of windows; at: rows of the gate tables for each word of each window."""
        n = len(at)
        attention, value = np.zeros((2, n, WINDOW), np.float32), np.zeros((2, n, WINDOW), np.float32)
        for k, d in enumerate("fb"):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                z, _, c, _ = self.step(d, gates[d][at[:, t]], h)
                new = z * h + (1 - z) * c
                h = np.where(mask[:, t, None], new, h)
                attention[k, :, t], value[k, :, t] = h @ self.p[f"a{d}"], h @ self.p[f"w{d}"]
        weights = self.softmax(attention.sum(0), mask)
        return (weights * value.sum(0)).sum(1) + self.p["bias"][0]

    @staticmethod
    def softmax(e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        e = np.where(mask, e, -1e9)
        e = np.exp(e - e.max(1, keepdims=True)) * mask
        return e / np.maximum(e.sum(1, keepdims=True), 1e-9)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the mean weighted log loss for the parameters, and for x."""
        n, p, keep = len(x), self.p, {}
        m = mask[:, :, None]
        states = {}
        for d in "fb":
            g = x @ p[f"W{d}"] + p[f"c{d}"]
            h, hs, parts = np.zeros((n, HIDDEN), np.float32), np.zeros((n, WINDOW, HIDDEN), np.float32), {}
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                z, r, c, uc = self.step(d, g[:, t], h)
                parts[t] = (h, z, r, c, uc)
                h = np.where(m[:, t], z * h + (1 - z) * c, h)
                hs[:, t] = h
            states[d], keep[d] = hs, parts
        e = sum(states[d] @ p[f"a{d}"] for d in "fb")
        v = sum(states[d] @ p[f"w{d}"] for d in "fb")
        alpha = self.softmax(e, mask)
        logit = (alpha * v).sum(1) + p["bias"][0]
        err = (sigmoid(logit) - y) * weight / n
        out = {"bias": np.array([err.sum()], np.float32)}
        dv = err[:, None] * alpha
        de = err[:, None] * alpha * (v - (alpha * v).sum(1, keepdims=True))
        dx = np.zeros_like(x)
        for d in "fb":
            hs = states[d]
            out[f"a{d}"], out[f"w{d}"] = np.einsum("nt,nth->h", de, hs), np.einsum("nt,nth->h", dv, hs)
            dh_at = de[:, :, None] * p[f"a{d}"] + dv[:, :, None] * p[f"w{d}"]
            dg = np.zeros((n, WINDOW, 3 * HIDDEN), np.float32)
            dU, dh = np.zeros_like(p[f"U{d}"]), np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1) if d == "f" else range(WINDOW):
                h0, z, r, c, uc = keep[d][t]
                dh = dh + dh_at[:, t]
                live = np.where(m[:, t], dh, 0)
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (h0 - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                dg[:, t] = np.concatenate([dz, dr, dc], axis=1)
                dU += h0.T @ du
                dh = np.where(m[:, t], live * z, dh) + du @ p[f"U{d}"].T
            flat = dg.reshape(-1, 3 * HIDDEN)
            out[f"U{d}"], out[f"W{d}"], out[f"c{d}"] = dU, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
            dx += dg @ p[f"W{d}"].T
        return out, dx


def window_rows(docs_words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all windows (n, WINDOW), their mask, and the document of each."""
    at, mask, of = [], [], []
    steps = np.arange(WINDOW)
    for d, ids in enumerate(docs_words):
        starts = np.array(windows_of(len(ids)))
        where = starts[:, None] + steps
        ok = where < len(ids)
        at.append(np.where(ok, ids[np.minimum(where, len(ids) - 1)], 0) if len(ids) else np.zeros((1, WINDOW), np.int64))
        mask.append(ok)
        of.append(np.full(len(starts), d))
    return np.concatenate(at), np.concatenate(mask), np.concatenate(of)


def train(texts: list[str], labels: list[int], seed: int = SEED) -> Network:
    """The network fitted to most of the texts, its offset to the rest of them."""
    rest = [i for i in range(len(texts)) if i % ASIDE == ASIDE - 1]
    most = [i for i in range(len(texts)) if i % ASIDE != ASIDE - 1]
    net = fitted([texts[i] for i in most], [labels[i] for i in most], seed)
    if len({labels[i] for i in rest}) == 2:
        net.offset = fitted_offset(Scorer(net).logits([texts[i] for i in rest]), np.array([labels[i] for i in rest], float))
    return net


def fitted_offset(logits: np.ndarray, y: np.ndarray) -> float:
    """What to add to logits so that their chances sum to the number of toxic texts."""
    low, high = -30.0, 30.0
    for _ in range(60):
        at = (low + high) / 2
        low, high = (low, at) if sigmoid(logits + at).sum() > y.sum() else (at, high)
    return at


def fitted(texts: list[str], labels: list[int], seed: int) -> Network:
    docs = [words_of(t) for t in texts]
    seen = Counter(w for d in docs for w in set(d))
    vocabulary = [w for w, k in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCAB] if k >= max(WORD_DOCS, WORD_SHARE * len(docs))]
    net, draw = Network(vocabulary, seed), np.random.default_rng(seed)
    number = {w: i for i, w in enumerate(seen)} or {b"": 0}
    every = list(number)
    known = np.array([net.vocabulary.get(w, 0) for w in every])
    grams, firsts = grams_of(every)
    lasts = np.append(firsts[1:], len(grams))
    at, mask, of = window_rows([np.array([number[w] for w in d], np.int64) for d in docs])
    y = np.array(labels, np.float32)[of]
    toxic = max(y.sum(), 1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    steps, batch = 0, int(np.clip(len(at) // 20, SMALL_BATCH, BATCH))
    rounds = max(ROUNDS, -(-STEPS * batch // len(at)))
    for turn in range(rounds):
        use = np.arange(len(at))
        if turn >= rounds // ROUNDS:  # of a toxic document, only the highest window
            score = np.concatenate([net.logits(net.gates(net.word_inputs(every)), at[i : i + 4096], mask[i : i + 4096]) for i in range(0, len(at), 4096)])
            order = np.lexsort((-score, of))
            top = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
            use = np.union1d(np.flatnonzero(y == 0), top)
            toxic = max(y[use].sum(), 1)
        weight = np.where(y == 1, min(4.0, (len(use) - toxic) / toxic), 1).astype(np.float32)
        draw.shuffle(use)
        rate = RATE * (1 - turn / rounds)
        for i in range(0, len(use), batch):
            b = use[i : i + batch]
            words, back = np.unique(at[b], return_inverse=True)
            back = back.reshape(at[b].shape)
            spans = [np.arange(firsts[w], lasts[w]) for w in words]
            counts = np.array([len(s) for s in spans])
            flat = grams[np.concatenate(spans)]
            begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
            x = np.concatenate([net.p["word"][known[words]], np.add.reduceat(net.p["gram"][flat], begin, axis=0) / counts[:, None].astype(np.float32)], axis=1)
            # inputs are dropped for a word's every place in the batch, so that no single one decides
            drop = (draw.random(x.shape) >= DROP).astype(np.float32) / np.float32(1 - DROP)
            grad, dx = net.gradients((x * drop)[back], mask[b], y[b], weight[b])
            per_word = np.zeros_like(x)
            np.add.at(per_word, back.ravel(), dx.reshape(-1, dx.shape[2]) * mask[b].reshape(-1, 1))
            per_word *= drop
            grad["word"], grad["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grad["word"], known[words], per_word[:, :WORD_DIM])
            grad["word"][0] = 0
            np.add.at(grad["gram"], flat, np.repeat(per_word[:, WORD_DIM:] / counts[:, None], counts, axis=0))
            steps += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] *= np.float32(1 - rate * DECAY)
                net.p[k] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return net


class Words(dict):
    """Numbers of words, given out as they come; todo are the words without inputs yet."""

    def __init__(self):
        super().__init__()
        self.todo: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.todo.append(word)
        return n


class Scorer:
    """Scores texts, keeping the gate inputs of words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        self.tables = {d: np.zeros((CACHE_WORDS // 4, 3 * HIDDEN), np.float32) for d in "fb"}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if todo := self.words.todo:
            first, size = len(self.words) - len(todo), len(self.words)
            for d, rows in self.net.gates(self.net.word_inputs(todo)).items():
                if size > len(self.tables[d]):
                    self.tables[d] = np.concatenate([self.tables[d], np.zeros((max(size, 2 * len(self.tables[d])) - len(self.tables[d]), 3 * HIDDEN), np.float32)])
                self.tables[d][first:size] = rows
            self.words.todo = []
        return out

    def scores(self, texts: list) -> np.ndarray:
        return sigmoid(self.logits(texts).astype(np.float64) + self.net.offset)

    def logits(self, texts: list) -> np.ndarray:
        """Each text's highest window."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        docs = [self.numbers(words_of(t)) for t in texts]
        at, mask, of = window_rows(docs)
        top = np.full(len(texts), -np.inf, np.float32)
        for i in range(0, len(at), 4096):
            np.maximum.at(top, of[i : i + 4096], self.net.logits(self.tables, at[i : i + 4096], mask[i : i + 4096]))
        return top


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): at most SAMPLE documents of each label, those with the smallest hashes of
    their ids."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.select("doc_id", "text").filter(F.char_length("text").between(1, SAMPLE_CHARS))
    parts = []
    for label, most in SAMPLE.items():
        # twice as many ids as are wanted, as long texts fall out; a bounded table
        ids = known.filter(F.col("toxic") == label).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(2 * most)
        parts.append(short.join(F.broadcast(ids), "doc_id").orderBy("h", "doc_id", "text").limit(most).select("text", F.lit(label).alias("toxic")))
    return parts[0].unionByName(parts[1])


def trained(sample: DataFrame) -> Network | float:
    """The network, from one task that reads the bounded sample; where the sample has one kind
    only, the share of toxic texts."""

    def run(batches):
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        made = train(texts, marks) if len(set(marks)) == 2 else float(np.mean(marks)) if marks else 0.0
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["model"])

    made = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else 0.0


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted."""
    model = trained(training_sample(docs, labels))
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")])
    if isinstance(model, float):
        out = plain.withColumn("score", F.lit(model))
    else:
        known = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            scorer = Scorer(known.value)
            for batch in batches:
                column, out = batch.column(batch.schema.get_field_index("text")), []
                for i in range(0, len(column), 256):
                    out.append(scorer.scores(column.slice(i, 256).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*batch.schema.names, "score"])

        schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes)
        out = plain.mapInArrow(run, f"{schema}, score double")
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)})


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
