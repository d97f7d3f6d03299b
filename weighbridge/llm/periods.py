"""Operator 11: periodic runs of words, by tiles of each octave of periods.

A run is a stretch of words with smallest period q, of ``max(LEAST, TIMES * q)`` words
at least, that no neighbouring word extends.

1. Words become numbers, within each text.
2. For the octave of periods from 2**k to below 2**(k+1) the text is cut into
   overlapping tiles: a boundary every 2**(k+1) words, and around it one stride to the
   left and three to the right.  A run of that octave has a boundary with two periods
   after it.  Boundaries at which no period can begin are ruled out by comparing words
   in bulk; at the others the tile's Z-function tells the periods that begin there, which
   of them are primitive, and how far they reach; the words before tell how far back.
   Texts of over ``long`` words are dealt out, octave by octave, in spans of tiles.
3. The fragments are shuffled by text and period and stitched where they touch.
4. The words after a run's first period are dropped.

Cases: a null or empty text has no words and no run; equal rows are texts of their own;
rows without doc_id are kept; of equal exponents the run that starts first comes first,
then the shorter period; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

TIMES, LEAST, LONG = 4, 6, 1 << 16
_CHECKED = 64


def z_function(words: list[int]) -> list[int]:
    """For each place the length of what starts there and is also a prefix; 0 for the first place."""
    n = len(words)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and words[k] == words[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _suspects(words: np.ndarray, octave: int, first: int, last: int) -> np.ndarray:
    """Boundaries in [first, last), multiples of the stride, after which the first words of some period of the octave are repeated."""
    low = 1 << octave
    stride = 2 * low
    tiles = -(-(last - first) // stride)
    reach = first + tiles * stride + stride
    padded = words[first : min(reach, len(words))]
    padded = np.concatenate((padded, -1 - np.arange(reach - first - len(padded) + 4, dtype=words.dtype)))  # no two alike beyond the end
    alike = None
    for j in range(min(low, 3)):
        grid = padded[j : j + tiles * stride].reshape(tiles, stride)
        same = grid[:, low:] == grid[:, :1]
        alike = same if alike is None else alike & same
    tile, period = np.nonzero(alike)
    at, period = first + tile * stride, period + low
    done = min(low, 3)
    n = len(words)
    while len(at) and done < _CHECKED:
        more = np.arange(done, done + 8)
        where = at[:, None] + period[:, None] + more
        same = (words[np.minimum(at[:, None] + more, n - 1)] == words[np.minimum(where, n - 1)]) & (where < n)
        good = (same | (more >= period[:, None])).all(axis=1)
        at, period = at[good], period[good]
        done += 8
    fits = at + 2 * period <= n
    return np.unique(at[fits])


def solve_tiles(words: np.ndarray, octave: int, first: int, last: int, more: tuple[bool, bool] = (False, False), times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) of stretches of the octave's primitive periods, from the boundaries in [first, last).

    A fragment [start, end) holds the places whose word comes again one period later.
    One that the tile shows to be too short for a run is left out.  more: whether the
    text goes on before and after ``words``.
    """
    low = 1 << octave
    stride, out = 2 * low, []
    for at in _suspects(words, octave, first, last).tolist():
        z = z_function(words[at : at + 3 * stride].tolist())
        for q in range(low, min(stride, len(z))):
            if z[q] < q or any(z[q // r] >= q - q // r for r in _primes(q)):
                continue
            back = words[max(0, at - stride) : at]
            differ = np.flatnonzero(back != words[at - len(back) + q : at + q])
            start = at - len(back) + (int(differ[-1]) + 1 if len(differ) else 0)
            # a stretch that ends within the tile on both sides is whole, and a run or none
            cut = start == at - len(back) and (start > 0 or more[0]) or z[q] + q == len(z) and (at + len(z) < len(words) or more[1])
            if cut or at + z[q] + q - start >= max(least, times * q):
                out.append((q, start, at + z[q]))
    return out


def octaves(n: int) -> range:
    """Octaves of the periods that a text of n words has room for."""
    return range((n // TIMES).bit_length())


_DOC = "uid long, doc_id long, n long, plain_sha256 string, words string, q array<long>, lo array<long>, hi array<long>, octave int, at long, until long, offset long, ends boolean, part binary"


def _solve_texts(tail: Callable[[int | None, int], tuple[int, int] | None] | None, long: int):
    """Texts -> a row each, with their fragments; long texts -> spans of tiles besides."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            size = 0
            for uid, doc_id, text in zip(frame["uid"].tolist(), frame["doc_id"].tolist(), frame["text"].tolist()):
                raw = text.encode().split()
                n = len(raw)
                again = tail(None if doc_id == scratch.NO_ID else doc_id, n) if tail and n else None
                if again:
                    a, p = again
                    raw = raw[:a] + (raw[a : a + p] * (-(-(n - a) // p)))[: n - a]
                place: dict[bytes, int] = {}
                words = np.fromiter((place.setdefault(w, len(place)) for w in raw), np.int32, n)
                joined = b" ".join(raw)
                own: list[tuple] = []
                spans: list[tuple] = []
                for k in octaves(n):
                    if n <= long:
                        own += solve_tiles(words, k, 0, n)
                        continue
                    stride = 2 << k
                    step = max(stride, long // stride * stride)
                    for at in range(0, n, step):
                        begin, until = max(0, at - stride), min(n, at + step)
                        spans.append((uid, None, None, None, None, None, None, None, k, at - begin, until - begin, begin, until + 3 * stride >= n, words[begin : until + 3 * stride].tobytes()))
                q, lo, hi = zip(*own) if own else ((), (), ())
                kept = joined.decode() if own or spans else None
                rows.append((uid, doc_id, n, hashlib.sha256(joined).hexdigest(), kept, q, lo, hi, None, None, None, None, None, None))
                for span in spans:
                    rows.append(span)
                    size += len(span[-1])
                    if size > 1 << 25:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=_NAMES)

    return run


_NAMES = [part.split()[0] for part in _DOC.split(", ")]


def _solve_spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = []
        for row in frame.itertuples():
            words = np.frombuffer(row.part, np.int32)
            found += [(row.uid, q, lo + row.offset, hi + row.offset) for q, lo, hi in solve_tiles(words, row.octave, row.at, row.until, (row.offset > 0, not row.ends))]
        yield pd.DataFrame(found, columns=["uid", "q", "lo", "hi"])


def stitched(fragments: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """(uid, q, lo, hi), dealt by text and period -> runs (uid, start, length, period)."""
    by = Window.partitionBy("uid", "q").orderBy("lo", "hi")
    reached = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.distinct().withColumn("new", F.when(F.col("lo") <= reached, 0).otherwise(1))
    groups = marked.withColumn("nth", F.sum("new").over(by)).groupBy("uid", "q", "nth").agg(F.min("lo").alias("start"), (F.max("hi") + F.col("q") - F.min("lo")).alias("length"))
    return groups.where(F.col("length") >= F.greatest(F.lit(least), times * F.col("q"))).select("uid", "start", "length", F.col("q").alias("period"))


_RUNS = "uid long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _collapsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with their runs -> digests, the strongest run, and the words that are left."""
    for frame in frames:
        out = []
        for uid, text, runs in zip(frame["uid"].tolist(), frame["words"].tolist(), frame["runs"].tolist()):
            runs = sorted((int(r["start"]), int(r["length"]), int(r["period"])) for r in runs)
            raw = text.encode().split(b" ")
            gone = np.zeros(len(raw) + 1, np.int32)
            for start, length, q in runs:
                gone[start + q] += 1
                gone[start + length] -= 1
            left = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
            bare = b" ".join([raw[i] for i in left])
            runs.sort(key=lambda r: (r[0], r[2]))
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
            start, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            out.append((uid, len(runs), start, length, q, 1000 * length // q, hashlib.sha256(listed).hexdigest(), hashlib.sha256(bare).hexdigest(), [{"start": s, "length": n, "period": p} for s, n, p in runs], bare.decode()))
        yield pd.DataFrame(out, columns=["uid", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, tail: Callable[[int | None, int], tuple[int, int] | None] | None = None, long: int = LONG, with_texts: bool = True) -> DataFrame:
    """The operator: doc_id, n_words, n_runs, the strongest run and digests; with ``with_texts`` all runs and the collapsed text.

    tail: for a doc_id and its number of words, (a, p) if the words from a on are taken again and again from the p at a.
    A text without a run has no ``collapsed``, as it loses nothing but its white space.
    """
    spark = docs.sparkSession
    own = docs.select(F.monotonically_increasing_id().alias("uid"), scratch.id_in("doc_id"), scratch.text_of())
    solved = scratch.written(own.mapInPandas(_solve_texts(tail, long), _DOC), "tiles")
    texts = solved.where("octave is null")
    fragments = texts.select("uid", F.inline(F.arrays_zip("q", "lo", "hi")))
    spans = solved.where("octave is not null").select("uid", "octave", "at", "until", "offset", "ends", "part")
    if spans.limit(1).count():
        fragments = fragments.unionByName(spans.repartition("uid", "octave", "offset").mapInPandas(_solve_spans, "uid long, q long, lo long, hi long"))
    runs = stitched(fragments).groupBy("uid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    found = texts.where("words is not null").select("uid", "words").join(runs, "uid").mapInPandas(_collapsed, _RUNS)
    if not with_texts:
        found = found.drop("runs", "collapsed")
    out = texts.select("uid", "doc_id", "n", "plain_sha256").join(found, "uid", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        scratch.id_out("doc_id"), F.col("n").alias("n_words"), F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"), "start", "length", "period", "exponent_milli",
        F.coalesce("runs_sha256", F.lit(none)).alias("runs_sha256"), F.coalesce("collapsed_sha256", "plain_sha256").alias("collapsed_sha256"), *(["runs", "collapsed"] if with_texts else []))


def rewritten_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The contract's rule: of one document in ten the words from a on repeat the p at a."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewritten_tail, with_texts=False).drop("n_words")
