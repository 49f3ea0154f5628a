"""Quality classifier from weak labels.

Labellers vote on each document: good, junk, or nothing (symbols, capitals, bare
punctuation, repetition, sentence ends, shouting, digits, length of words). Expectation
maximisation over the counts of all documents' vote patterns estimates the share of
junk and how each labeller votes on either kind; a pattern's posterior is the label.
Most labellers look for one sort of junk and don't vote where it is absent.
There are at most 3^8 patterns, so the counts that reach the driver are bounded.

A linear scorer is then trained on the posteriors of at most ``TRAIN_ROWS`` documents
(by a hash of id and text): its features are hashed five-grams of
byte classes, as shares of the text, and bins of the labellers' measures. It scores
every whole text.

Defined cases: null, empty and white-space texts are junk (score 0, not kept);
repeated rows get equal results; with no document there is no row; if all patterns
agree on one kind, the posterior itself is the score. Other columns are ignored, or
kept by ``keep_good``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store, vocab

TRAIN_ROWS = 3000
BUCKETS = 4096
ROUNDS = 60
#: The prior on labellers: at most this share of good documents gets a junk vote of any one of them.
FALSE_ALARMS = 0.005

#: Class of each byte: lower, upper, digit, blank, line end, full stop, comma, other closing marks, quotes and brackets, each of some symbols, other, not ASCII.
_CLASS = np.full(256, 14, np.uint64)
for _k, _set in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",", b"!?", b"\"'()-:;", b"|", b"*", b"#", b"&$%@", b"=+/\\<>{}[]_~^"]):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 15
GRAM = 5
#: Measures and their bins: below the first bound, between two, and so on.
BINS = {"symbols": (0.01, 0.03, 0.08), "capitals": (0.05, 0.15, 0.4), "bare": (0.01, 0.05, 0.15), "fresh": (0.4, 0.6, 0.8), "ends": (0.003, 0.02, 0.3), "shout": (0.02, 0.1, 0.3), "digits": (0.02, 0.1, 0.3), "size": (2, 12, 40), "words": (3, 8, 30)}
N_FEATURES = BUCKETS + sum(len(b) + 1 for b in BINS.values())
_BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_END = re.compile(r"\w[.?!](?!\S)")
_SHOUT = re.compile(r"!!|\?\?")


def measures(text: str) -> tuple[float, ...]:
    """symbols, capitals, bare punctuation, share of three-word runs not seen before, sentence ends, shouting, digits, characters a word, words."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    w = text.split()
    n = len(w)
    if not n:
        return (0.0,) * 9
    kind = np.bincount(_CLASS[data].astype(np.int64), minlength=16)
    letters = kind[0] + kind[1]
    runs = max(1, n - 2)
    fresh = len(set(zip(w, w[1:], w[2:], strict=False))) / runs if n > 2 else 1.0
    return (
        float(kind[9:15].sum() / len(data)),
        float(kind[1] / max(1, letters)),
        len(_BARE.findall(text)) / n,
        fresh,
        len(_END.findall(text)) / n,
        len(_SHOUT.findall(text)) / n,
        float(kind[2] / len(data)),
        len(text) / n,
        float(n),
    )


def votes(m: tuple[float, ...]) -> tuple[int, ...]:
    """A vote of each labeller: 1 good, -1 junk, 0 none."""
    symbols, capitals, bare, fresh, ends, shout, digits, size, n = m

    def vote(junk: bool, good: bool = False) -> int:
        return -1 if junk else int(good)

    return (
        vote(symbols >= 0.06),
        vote(capitals >= 0.4),
        vote(bare >= 0.15),
        vote(n >= 8 and fresh <= 0.55),
        vote(n >= 40 and ends <= 0.002, 0.015 <= ends <= 0.5),
        vote(shout >= 0.15),
        vote(digits >= 0.3),
        vote(size >= 40),
    )


def posteriors(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], dict]:
    """Probability of good for each vote pattern, by expectation maximisation; and the fitted shares.

    Starts from the number of junk votes: any of them makes junk likely, as each labeller
    looks for one sort of junk. Two kinds can't hold the many sorts of junk
    apart, so the labellers' precision is a prior: false alarms are rare by FALSE_ALARMS.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, {}
    v = np.array(patterns) + 1
    n = np.array([counts[p] for p in patterns], np.float64)
    up, down = (v == 2).sum(1), (v == 0).sum(1)
    good = np.where(down == 0, 0.95, np.where(down == 1, 0.2, 0.05)) - 0.04 * (up == 0)
    for _ in range(rounds):
        share = float((n * good).sum() / n.sum())
        share = min(max(share, 1e-6), 1 - 1e-6)
        logs = []
        for p, prior in ((good, share), (1 - good, 1 - share)):
            table = np.stack([[(n * p)[v[:, j] == k].sum() + 0.1 for k in range(3)] for j in range(v.shape[1])])
            table /= table.sum(1, keepdims=True)
            if p is good:
                junk = np.minimum(table[:, :1], FALSE_ALARMS)
                table = np.concatenate([junk, table[:, 1:] * ((1 - junk) / table[:, 1:].sum(1, keepdims=True))], 1)
            logs.append(np.log(prior) + sum(np.log(table[j, v[:, j]]) for j in range(v.shape[1])))
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -40, 40)))
    return {p: float(g) for p, g in zip(patterns, good, strict=True)}, {"good": share}


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of each five-gram of byte classes."""
    kind = _CLASS[data]
    if len(kind) < GRAM:
        return np.empty(0, np.int64)
    code = np.zeros(len(kind) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        code = code * np.uint64(16) + kind[i : len(kind) - GRAM + 1 + i]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)


def _bins(m: tuple[float, ...]) -> list[int]:
    at, out = BUCKETS, []
    for value, bounds in zip(m, BINS.values(), strict=True):
        out.append(at + int(np.searchsorted(bounds, value, "right")))
        at += len(bounds) + 1
    return out


def features(text: str) -> np.ndarray:
    """The scorer's features of a text: shares of hashed grams (times ten), and a one for each measure's bin."""
    x = np.zeros(N_FEATURES, np.float32)
    g = _grams(np.frombuffer(text.encode("utf-8"), np.uint8))
    if len(g):
        x[:BUCKETS] = np.bincount(g, minlength=BUCKETS) * (10.0 / len(g))
    x[_bins(measures(text))] = 1
    return x


class Model:
    def __init__(self, weights: np.ndarray, bias: float, posterior: dict):
        self.weights, self.bias, self.posterior = weights, bias, posterior

    def score(self, text: str | None) -> float:
        """Probability of good, 0 to 1."""
        if not text or text.isspace():
            return 0.0
        g = _grams(np.frombuffer(text.encode("utf-8"), np.uint8))
        m = measures(text)
        if self.weights is None:
            return self.posterior.get(votes(m), 0.5)
        value = self.bias + float(self.weights[_bins(m)].sum())
        if len(g):
            value += float(self.weights[g].mean()) * 10
        return float(1 / (1 + np.exp(-min(max(value, -30), 30))))


def _train_linear(x: np.ndarray, y: np.ndarray, ridge: float = 2e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Nesterov's gradient method."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w.copy(), b
    rate = np.float32(4.0 / max(1e-6, float((x * x).sum(1).max()) + 1))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30)))
        d = (p - y).astype(np.float32) / len(y)
        nw, nb = vw - rate * (x.T @ d * np.float32(1) + ridge * vw), vb - float(rate) * float(d.sum())
        step = k / (k + 3)
        vw, vb = nw + np.float32(step) * (nw - w), nb + step * (nb - b)
        w, b = nw, nb
    return w, b


def train(docs: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Counts all documents' vote patterns, fits the weak-label model, and trains the scorer on a bounded sample."""
    vocab.small_batches(docs.sparkSession)

    def count(batches):
        seen: dict = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                p = "".join("-0+"[v + 1] for v in votes(measures(text or "")))
                seen[p] = seen.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    got = docs.select("text").mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    posterior, _ = posteriors({tuple("-0+".index(c) - 1 for c in r[0]): r[1] for r in got})
    sample = store.bounded_sample(docs.where("text is not null").select("doc_id", "text"), sum(r[1] for r in got), limit, "doc_id", "text")
    sample = store.table(sample.select("text"), "quality-train").repartition(16)

    def describe(batches):
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t and not t.isspace()]
            yield pa.RecordBatch.from_arrays([pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary()), pa.array([posterior.get(votes(measures(t)), 0.5) for t in texts], pa.float64())], names=["x", "y"])

    rows = sample.mapInArrow(describe, "x binary, y double").collect()
    y = np.array([r[1] for r in rows])
    if not len(rows) or y.min() > 0.5 or y.max() < 0.5:
        return Model(None, 0.0, posterior)
    x = np.empty((len(rows), N_FEATURES), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r[0], np.float16)
    return Model(*_train_linear(x, y), posterior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), keep (score of at least 0.5) and the weak label's posterior of every whole text."""
    vocab.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("keep", pa.bool_()), ("weak", pa.float64())])

    def run(batches):
        m = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            s = [m.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64()), pa.array([v >= 0.5 for v in s], pa.bool_()), pa.array([m.posterior.get(votes(measures(t or "")), 0.5) if t and not t.isspace() else 0.0 for t in texts], pa.float64())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, keep boolean, weak double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a score of at least the threshold."""
    vocab.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(t) >= threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


