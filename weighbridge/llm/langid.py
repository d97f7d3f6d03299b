"""Operator 6: language by error-correcting output codes.

Each language has a codeword of +1 and -1.  For each bit a linear classifier over
hashed byte trigrams of the lower-case text, with everything but letters as space,
says which half of the languages a text belongs to.  Decoding is loss-weighted: the
language whose codeword has the least total logistic loss wins; its share of
exp(-loss) is the score, and a text is ambiguous if the runner-up's share comes
within ``margin`` of it.

Training takes at most ``per_language`` whole texts of each language that the table
names, and short pieces of them; those of the held-out fold are never taken.
Prediction reads the whole text and nothing else.

Cases: a null text, or one without a letter, is ``und`` with score 0; without any
labelled text all are ``und``; with one language every text with a letter is that
language with score 1; repeated rows each give a row; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .learning import Adam, bounded_samples, held_out, sigmoid, with_ids
from .textbatch import slices

SLOTS, PER_LANGUAGE, MARGIN = 8192, 300, 0.2
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def codewords(languages: int, seed: int = 3) -> np.ndarray:
    """One row of +1 and -1 for each language: all two-way splits up to 7 languages, else random ones."""
    if languages <= 7:
        bits = (1 << (languages - 1)) - 1
        splits = np.arange(1, bits + 1)
        rows = [np.ones(bits)] + [np.where(splits >> k & 1, -1.0, 1.0) for k in range(languages - 1)]
        return np.stack(rows)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(languages)))
    best = max((rng.choice([-1.0, 1.0], (languages, bits)) for _ in range(50)), key=lambda c: -(c @ c.T - np.eye(languages) * 1e9).max())
    return best


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all byte trigrams, and for each text (and the end) the index of its first; each text has two at least."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    data = _FOLD[np.frombuffer(b"".join(raw) + b"  ", np.uint8)]
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=first[1:])
    h = data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(19)).astype(np.uint16), first


def pieces(text: str) -> list[str]:
    """The text, and up to three short pieces of it."""
    out = [text]
    for k, size in ((1, 24), (2, 60), (3, 150)):
        if len(text) > 2 * size:
            at = (len(text) - size) * k // 4
            out.append(text[at : at + size])
    return out


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages)) if len(languages) > 1 else None
        self.weights, self.bias = weights.astype(np.float32), bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        names, scores, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.languages:
            return names, scores, doubt
        for part in slices(texts):
            own = texts[part]
            letters = np.array([_LETTER.search(t) is not None for t in own])
            if self.code is None:
                share = np.ones((len(own), 1))
            else:
                slots, first = trigrams(own)
                sums = np.add.reduceat(self.weights[slots], first[:-1], axis=0, dtype=np.float64)[: len(own)]
                sign = sums / np.diff(first)[:, None] + self.bias
                loss = np.logaddexp(0.0, -sign[:, None, :] * self.code[None, :, :]).sum(axis=2)
                share = np.exp(loss.min(axis=1, keepdims=True) - loss)
                share /= share.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            top = share[np.arange(len(own)), best]
            rest = np.where(np.arange(share.shape[1]) == best[:, None], 0.0, share).max(axis=1)
            for k in np.flatnonzero(letters):
                names[part.start + k] = self.languages[best[k]]
            scores[part] = np.where(letters, top, 0.0)
            doubt[part] = letters & (top - rest < MARGIN)
        return names, scores, doubt


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 120, most: int = 1 << 18) -> Model:
    """rows: language, slots and their shares of a text; sparse throughout, ``most`` shares at a time."""
    languages = sorted({r[0] for r in rows})
    if len(languages) < 2:
        return Model(languages, np.zeros((SLOTS, 1)), np.zeros(1))
    code = codewords(len(languages))
    scale = 60.0
    place = {name: k for k, name in enumerate(languages)}
    label = np.array([place[r[0]] for r in rows])
    y, weight = code[label], (1.0 / np.bincount(label))[label][:, None] / len(languages)
    slots, share = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]) * np.float32(scale)
    size = np.array([len(r[1]) for r in rows])
    edge = np.concatenate(([0], np.cumsum(size)))
    cuts = np.unique(np.searchsorted(edge, np.arange(0, edge[-1], most)).tolist() + [len(rows)])
    w, b = np.zeros((SLOTS, code.shape[1])), np.zeros(code.shape[1])
    adam = Adam([w.shape, b.shape], 0.05)
    for _ in range(rounds):
        narrow, dw, db = w.astype(np.float32), np.zeros_like(w), np.zeros_like(b)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own, part = slots[edge[lo] : edge[hi]], share[edge[lo] : edge[hi]]
            sums = np.add.reduceat(narrow[own] * part[:, None], edge[lo:hi] - edge[lo], axis=0)
            slope = -y[lo:hi] * sigmoid(-y[lo:hi] * (sums + b)) * weight[lo:hi]
            for k in range(code.shape[1]):
                dw[:, k] += np.bincount(own, part * np.repeat(slope[:, k], size[lo:hi]), SLOTS)
            db += slope.sum(axis=0)
        adam.step([w, b], [dw + 1e-6 * w, db])
    return Model(languages, w * scale, b)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from ``text`` and ``lang`` of documents outside of the held-out fold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = docs.where(F.col("lang").isNotNull() & ~held_out())
    sampled = bounded_samples(known.select("doc_id", "lang"), "lang", per_language)  # the texts are read for the sample alone
    ids = sorted({i for own in sampled.values() for i in own})
    if not ids:
        return fit([])

    def features(frames):
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                if text is not None and _LETTER.search(text):
                    parts = pieces(text)
                    slots, first = trigrams(parts)
                    for a, b in zip(first[:-1], first[1:]):
                        own, n = np.unique(slots[a:b], return_counts=True)
                        yield pd.DataFrame({"lang": [lang], "slots": [own.astype("<u2").tobytes()], "share": [(n / n.sum()).astype("<f4").tobytes()]})

    rows = with_ids(known, ids).select("lang", "text").mapInPandas(features, "lang string, slots binary, share binary").collect()
    rows = sorted((r["lang"], bytes(r["slots"]), bytes(r["share"])) for r in rows)
    return fit([(lang, np.frombuffer(a, "<u2"), np.frombuffer(b, "<f4")) for lang, a, b in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for frame in frames:
            names, scores, doubt = shared.value.predict(frame["text"].fillna("").tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": names, "score": scores, "ambiguous": doubt})

    made = docs.select(scratch.id_in("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return made.withColumn("doc_id", scratch.id_out("doc_id")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, whose language is found and not ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clear(text: pd.Series) -> pd.Series:
        names, _, doubt = shared.value.predict(text.fillna("").tolist())
        return pd.Series([n != "und" and not d for n, d in zip(names, doubt)])

    return docs.where(clear(F.col("text").cast("string")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
