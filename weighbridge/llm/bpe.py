"""Operator 4: byte-level BPE, encoding in two tiers, and decoding.

A text is cut by the pattern into pre-tokens; each is encoded by itself.

Tier 1: a minimal perfect hash over the vocabulary's whole tokens.  A pre-token
that is in the vocabulary is one id; its slot's 64-bit hash and the token's bytes
must agree with it.
Tier 2: any other pre-token starts as its bytes, linked left and right.  A heap
holds the ranks of neighbouring pairs that join to a token; the lowest rank (ties:
the leftmost) is merged, its links and its two new pairs renewed, until no pair is
left.  Stale entries are skipped when they come up.  Results are kept in a bounded
cache, so a piece met again costs a lookup.

Decoding looks the ids' bytes up and joins them.

Cases: a null text counts as the empty text, which has no ids; special tokens'
strings are ordinary text; repeated rows each give a row; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .textbatch import U, PieceCache, mix, piece_hashes, slices


def read_ranks(spark: SparkSession, rank_file: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks; ranks must run from 0 without gaps."""
    import base64

    with open(rank_file, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError("ranks have gaps")
    return tokens


class PerfectHash:
    """Minimal perfect hash of n keys: n slots; each bucket of keys has the first seed that sends all to free slots."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, first = np.unique(keys, return_index=True)
        values, n = values[first], len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        self.seed = np.zeros(self.buckets, U)
        self.keys, self.values = np.zeros(n, U), np.zeros(n, np.int32)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        for b in np.argsort(-np.diff(edges), kind="stable").tolist():
            own = order[edges[b] : edges[b + 1]]
            if not len(own):
                break
            found = self._seed(keys[own], taken, n)
            self.seed[b] = found[0]
            taken[found[1]] = True
            self.keys[found[1]], self.values[found[1]] = keys[own], values[own]

    @staticmethod
    def _seed(keys: np.ndarray, taken: np.ndarray, n: int) -> tuple[int, np.ndarray]:
        begin, step = 0, 64
        while True:
            seeds = np.arange(begin, begin + step, dtype=U)
            slots = (mix(keys[None, :] + seeds[:, None] * U(0x9E3779B97F4A7C15)) % U(n)).astype(np.int64)
            free = ~taken[slots].any(axis=1)
            if len(keys) > 1:
                free &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
            if free.any():
                k = int(free.argmax())
                return begin + k, slots[k]
            begin, step = begin + step, min(2 * step, 1 << 16)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> U(20)) % U(self.buckets)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's value, or -1."""
        slot = (mix(keys + self.seed[self._bucket(keys)] * U(0x9E3779B97F4A7C15)) % U(self.n)).astype(np.int64)
        return np.where(self.keys[slot] == keys, self.values[slot], -1)


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by merges from a heap over linked bytes."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known = rank.get
    heap = []
    for i in range(n - 1):
        r = known(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapify(heap)
    # a part is named by where it begins; after[i] is where it ends, -1 once it is part of the one to its left
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if j < 0 or j >= n or after[j] != end:
            continue
        after[i], after[j] = end, -1
        if end < n:
            before[end] = i
            stop = after[end]
            r = known(piece[i:stop])
            if r is not None:
                heappush(heap, (r, i, stop))
        left = before[i]
        if left >= 0:
            r = known(piece[left:end])
            if r is not None:
                heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : after[i]]])
        i = after[i]
    return out


class Coder:
    """Encoder and decoder over the tokens of a rank file."""

    def __init__(self, tokens: list[bytes], most: int = 1_000_000):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("each single byte must be a token")
        whole = [(i, s) for i, t in enumerate(tokens) if (s := _text(t)) is not None]
        joined = "".join(s for _, s in whole)
        size = np.array([len(s) for _, s in whole], np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32) + np.uint32(1)
        self.first_tier = PerfectHash(piece_hashes(chars, np.cumsum(size) - size, size), np.array([i for i, _ in whole], np.int32))
        self.cache = PieceCache(self._encode_pieces, most)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _encode_pieces(self, pieces: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self.first_tier(keys).tolist()
        out: list[int] = []
        sizes = np.ones(len(pieces), np.int64)
        tokens, rank = self.tokens, self.rank
        for k, i in enumerate(ids):
            raw = pieces[k].encode("utf-8")
            if i >= 0 and tokens[i] == raw:
                out.append(i)
            elif i >= 0 and (whole := rank.get(raw)) is not None:  # another token has its hash
                out.append(whole)
            else:
                found = merge(raw, rank)
                sizes[k] = len(found)
                out += found
        return np.array(out, np.uint16), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin (and the end)."""
        return self.cache(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self.bytes[np.repeat(self.at[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


def _text(token: bytes) -> str | None:
    try:
        return token.decode("utf-8")
    except UnicodeDecodeError:
        return None


_CODERS: dict = {}


def coder(tokens: list[bytes]) -> Coder:
    """One coder in each Python worker, for all its tasks."""
    key = hashlib.sha256(b"\0".join(tokens)).digest()
    if key not in _CODERS:
        if len(tokens) > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        _CODERS[key] = Coder(tokens)
    return _CODERS[key]


def encode_documents(docs: DataFrame, tokens: list[bytes]) -> DataFrame:
    """The operator: doc_id, ids (array) and the bytes that they decode to, for each text."""

    def run(frames):
        own = coder(shared.value)
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            for part in slices(texts, 1 << 20):
                ids, at = own.encode(texts[part])
                cut = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[part], "ids": [c.astype(np.int32) for c in cut], "decoded": [own.decode(c) for c in cut]})

    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    return _texts(docs).mapInPandas(run, "doc_id long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, tokens: list[bytes]) -> DataFrame:
    """As :func:`encode_documents`, with digests in place of ids and bytes, which then need not leave the task."""

    def run(frames):
        own = coder(shared.value)
        names = np.array([str(i) for i in range(len(own.tokens))], dtype=object)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            counts, of_ids, of_bytes = [], [], []
            for part in slices(texts, 1 << 20):
                ids, at = own.encode(texts[part])
                words = names[ids]
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    counts.append(b - a)
                    of_ids.append(sha(" ".join(words[a:b]).encode()))
                    of_bytes.append(sha(own.decode(ids[a:b])))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": np.array(counts, np.int64), "ids_sha256": of_ids, "decoded_sha256": of_bytes})

    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    made = _texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumn("doc_id", scratch.id_out("doc_id"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(scratch.id_in("doc_id"), F.col("text").cast("string").alias("text"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens)
