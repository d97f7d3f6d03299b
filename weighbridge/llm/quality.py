"""Operator 9: document quality by positive-unlabelled learning.

Trusted positives are documents with ``quality`` 1; the unlabelled set is drawn
from all documents.  A first classifier of positives against the unlabelled gives
the ratio of their densities, which is 1 / prior where no negatives are, as over
the middle of the positives: the class prior is estimated from there.  A small
network then minimises the non-negative unbiased risk

    prior * R+(P) + max(0, R-(U) - prior * R-(P)).

Its output is calibrated on labelled documents of both kinds, where there are any,
so that a score is the chance of label 1.

Features are of the form of a whole text: pairs of neighbouring character classes,
repetition of words and of five-word runs, word length.  Training draws at most
``positives``, ``unlabelled`` and ``labelled`` documents, none from the held-out
fold.

Cases: a null text counts as the empty text, which has a score like any other;
without positives all scores are 0.5; repeated rows each give a row; of repeated
labels the least counts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .learning import Adam, bounded_sample, held_out, sigmoid, with_ids
from .textbatch import U, shingles, slices, word_hashes

POSITIVES, UNLABELLED, LABELLED, THRESHOLD = 2500, 5000, 4000, 0.3

#: Character classes of bytes.
_CLASSES = 14
_CLASS = np.full(256, 13, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",;:", b"!?", b"#$%&*", b"|", b"@<>{}[]=/\\_~^`+", b"-'\"()")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 12
WIDTH = _CLASSES * _CLASSES + 6


def features(texts: list[str]) -> np.ndarray:
    """One row of WIDTH numbers for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for part in slices(texts):
        own = texts[part]
        raw = [b"\n" + t.encode("utf-8", "replace") + b"\n" for t in own]
        data = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
        size = np.array([len(r) for r in raw])
        doc = np.repeat(np.arange(len(own)), size)
        pair = data[:-1] * _CLASSES + data[1:]
        inside = doc[:-1] == doc[1:]
        count = np.bincount((doc[:-1] * _CLASSES * _CLASSES + pair)[inside], minlength=len(own) * _CLASSES * _CLASSES).reshape(len(own), -1)
        words, first = word_hashes(own)
        n = np.diff(first)
        word_doc = np.repeat(np.arange(len(own)), n)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (word_doc[1:] == word_doc[:-1])
        distinct = lambda h, at: np.bincount((d := np.repeat(np.arange(len(own)), np.diff(at)))[np.unique(h ^ d.astype(U) * U(0x9E3779B97F4A7C15), return_index=True)[1]], minlength=len(own))
        runs, at = shingles(words, first, 5)
        per = lambda x, y: x / np.maximum(y, 1)
        more = (
            np.log1p(n) / 10, per(np.log1p(distinct(words, first)), np.log1p(np.maximum(n, 1))), per(distinct(runs, at), np.diff(at)),
            per(np.bincount(word_doc[same], minlength=len(own)), n), per(size, n) / 20, np.log1p(size) / 12)
        out[part] = np.column_stack((np.sqrt(count / np.maximum(size - 1, 1)[:, None]), *more))
    return out


class Network:
    """One hidden layer; features are scaled by the training set's mean and deviation."""

    def __init__(self, x: np.ndarray, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = x.mean(axis=0), x.std(axis=0) + 0.02
        self.weights = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, 1)) / np.sqrt(hidden), np.zeros(1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.weights[0] + self.weights[1])
        return h, (h @ self.weights[2] + self.weights[3])[:, 0]

    def slopes(self, z: np.ndarray, h: np.ndarray, out: np.ndarray) -> list[np.ndarray]:
        back = out[:, None] * self.weights[2][:, 0] * (1 - h * h)
        return [z.T @ back + 1e-4 * self.weights[0], back.sum(axis=0), h.T @ out[:, None] + 1e-4 * self.weights[2], out.sum(keepdims=True)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.forward(self.scaled(x))[1]


def class_prior(p: np.ndarray, u: np.ndarray, rounds: int = 200) -> float:
    """Share of positives among the unlabelled, from the density ratio over the middle of the positives."""
    net, x = Network(np.concatenate((p, u))), np.concatenate((p, u))
    z, y = net.scaled(x), np.concatenate((np.ones(len(p)), np.zeros(len(u))))
    weight = np.concatenate((np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))))
    adam = Adam([w.shape for w in net.weights], 0.01)
    for _ in range(rounds):
        h, out = net.forward(z)
        adam.step(net.weights, net.slopes(z, h, (sigmoid(out) - y) * weight))
    ratio = np.exp(net(p))
    return float(np.clip(1.0 / np.median(ratio), 0.05, 0.98))


def fit_network(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 400) -> Network:
    """Minimises the non-negative unbiased risk under the sigmoid loss."""
    net = Network(np.concatenate((p, u)))
    zp, zu = net.scaled(p), net.scaled(u)
    z = np.concatenate((zp, zu))
    adam = Adam([w.shape for w in net.weights], 0.01)
    k = len(p)
    for _ in range(rounds):
        h, out = net.forward(z)
        s = sigmoid(out)
        bend = s * (1 - s)
        negative = s[k:].mean() - prior * s[:k].mean()  # loss of calling a text negative is s
        if negative >= 0:
            slope = np.concatenate((-2 * prior * bend[:k] / k, bend[k:] / len(u)))
        else:  # over-fitted: step back on the part that went below zero
            slope = np.concatenate((prior * bend[:k] / k, -bend[k:] / len(u)))
        adam.step(net.weights, net.slopes(z, h, slope))
    return net


def calibrate(margin: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve of labels over margins, lightly held to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - label) * margin).sum() + (a - 1.0), (p - label).sum()])
        hess = np.array([[(w * margin * margin).sum() + 1.0, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        size = np.abs(step).max()
        step = step / max(1.0, size)
        a, b = a - step[0], b - step[1]
    return max(float(a), 1e-3), float(b)


class Model:
    def __init__(self, net: Network | None, slope: float = 1.0, offset: float = 0.0, prior: float = 0.5):
        self.net, self.slope, self.offset, self.prior = net, slope, offset, prior

    def score(self, texts: list[str]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), 0.5)
        return sigmoid(self.slope * self.net(features(texts)) + self.offset)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, labelled: int = LABELLED) -> Model:
    """Learns from documents outside of the held-out fold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out() & F.col("doc_id").isNotNull())
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null")
    marks = docs.select("doc_id").join(marks.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
    good, free = bounded_sample(marks.where("quality = 1"), positives, 1), bounded_sample(docs, unlabelled, 2)
    both = {0: bounded_sample(marks.where("quality = 0"), labelled, 3), 1: bounded_sample(marks.where("quality = 1"), labelled, 4)}
    if not good or not free:
        return Model(None)
    counts = {r["quality"]: r["count"] for r in marks.where("quality in (0, 1)").groupBy("quality").count().collect()}

    def run(frames):
        for frame in frames:
            x = features(frame["text"].fillna("").tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "x": [r.astype("<f4").tobytes() for r in x]})

    wanted = sorted({*good, *free, *both[0], *both[1]})
    rows = with_ids(docs, wanted).mapInPandas(run, "doc_id long, x binary").collect()
    x = {r["doc_id"]: np.frombuffer(bytes(r["x"]), "<f4") for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["x"])))}
    take = lambda ids: np.stack([x[i] for i in ids]).astype(np.float64)
    p, u = take(good), take(free)
    prior = class_prior(p, u)
    net = fit_network(p, u, prior)
    if not both[0]:
        return Model(net, prior=prior)
    margin = np.concatenate((net(take(both[0])), net(take(both[1]))))
    label = np.concatenate((np.zeros(len(both[0])), np.ones(len(both[1]))))
    slope, offset = calibrate(margin, label)
    # the sample's share of positives is not the labels' share
    offset += np.log(counts[1] / counts[0]) - np.log(len(both[1]) / len(both[0]))
    return Model(net, slope, float(offset), prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": shared.value.score(frame["text"].fillna("").tolist())})

    made = docs.select(scratch.id_in("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, score double")
    return made.withColumn("doc_id", scratch.id_out("doc_id")).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text.fillna("").tolist()))

    return docs.where(score(F.col("text").cast("string")) >= THRESHOLD)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
