"""Operator 1: document fingerprints by SimHash.

Every run of five words, and at half its weight every run of two, is a term.  The
bits of a term's hash vote with their sign, once for each occurrence, so a term's
weight is its weight times its count; the fingerprint holds the signs of the sums.
Words are runs of letters, digits and underscores in lower case.

Fingerprints within a Hamming radius are found through permuted block tables: the
bits are cut into blocks; two fingerprints that differ in at most ``radius`` bits
agree in ``blocks - radius`` whole blocks, so there is one table for each choice of
so many blocks, keyed by their bits.  Each pair of different fingerprints is
verified in the join itself; documents with equal fingerprints form a class and
are never paired.

Cases: a null text counts as the empty text, whose fingerprint is 0; texts of 1 to
4 words have one term of all their words (and those of two); repeated rows each
give a row; other columns of the input are ignored; an empty table gives no rows;
rows without doc_id come last in descending order; rows of one id, or of none, follow
each other by a hash of their texts; class_id is null where no document of the class
has an id.

The radius is small beside what an edit does: one changed word touches five runs of
five.  It finds documents that differ in next to nothing (README has figures); edited
copies are the concern of operator 5.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hot, scratch
from .textbatch import U, mix, shingles, slices, word_hashes

BITS, RADIUS, BLOCKS, MOST_PARTS, PER_PART = 128, 3, 5, 20_000, 20
_LANES = U(0x0101010101010101)


def _votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the number of its hashes with bit k set, k from 0 to 63."""
    texts = len(first) - 1
    out = np.zeros((texts, 64), np.int64)
    count = np.diff(first)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    pieces = -(-count[some] // 255)  # a lane of 8 bits counts to 255
    piece_of = np.repeat(np.arange(len(some)), pieces)
    nth = np.arange(len(piece_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[:-1][some][piece_of] + 255 * nth
    for bit in range(8):
        sums = np.add.reduceat((hashes >> U(bit)) & _LANES, starts)
        lanes = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[some, bit::8] = np.add.reduceat(lanes, np.cumsum(pieces) - pieces, axis=0)
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """Two 64-bit words for each text."""
    words, first = word_hashes(texts)
    total = np.zeros((len(texts), BITS), np.int64)
    for k, weight in ((5, 2), (2, 1)):
        terms, at = shingles(words, first, k)
        n = np.diff(at)[:, None]
        for half in (0, 1):
            h = terms if not half else mix(terms ^ U(0xA0761D6478BD642F))
            total[:, 64 * half : 64 * half + 64] += weight * (2 * _votes(h, at) - n)
    return np.packbits(total > 0, axis=1, bitorder="little").view(U).reshape(len(texts), BITS // 64)


def _fingerprint_all(texts: list[str]) -> np.ndarray:
    parts = [fingerprints(texts[x]) for x in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, BITS // 64), U)


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edited_rows(frames):
    """Rows of some whole parts in order, each part ended by the first row of the part after it."""
    last = None
    for frame in frames:
        if last is not None:
            frame = pd.concat((last, frame), ignore_index=True)
        # the last row may need a row of the batch to come; a part's closing row needs none
        if len(frame):
            last = frame.iloc[-1:]
        texts = frame["text"].tolist()
        closing = frame["closing"].to_numpy()
        prints = _fingerprint_all(texts)
        at = np.flatnonzero(~closing[:-1]) if len(frame) else np.zeros(0, int)
        if not len(at):
            continue
        edited = [_edit(texts[i], texts[i + 1]) for i in at]
        changed = _fingerprint_all(edited)
        yield pd.DataFrame({
            "doc_id": frame["doc_id"].to_numpy()[at],
            "n_chars": np.array([len(texts[i]) for i in at], np.int64),
            "edited_sha": [hashlib.sha256(t.encode("utf-8")).digest() for t in edited],
            "hi": prints[at, 1].view(np.int64), "lo": prints[at, 0].view(np.int64),
            "edited_hi": changed[:, 1].view(np.int64), "edited_lo": changed[:, 0].view(np.int64),
            "near_edited": _likeness(prints[at], changed),
            "near_next": _likeness(prints[at], prints[at + 1]),
        })


_PASS = "doc_id long, n_chars long, edited_sha binary, hi long, lo long, edited_hi long, edited_lo long, near_edited double, near_next double"


def with_edits(docs: DataFrame, rows_per_part: int = 3000) -> DataFrame:
    """Fingerprints of all texts and of their edits, which take words from the next document.

    Documents in descending doc_id are cut into at most MOST_PARTS parts; each part is
    closed by a copy of the first row of the next, so that no part waits for another.
    The cuts come from a sample of the ids alone, and the texts are shuffled once.  Only
    if an id (or none) has more rows than a part are texts hashed for the cuts too.
    """
    spark = docs.sparkSession
    docs = docs.select(scratch.id_in("doc_id"), scratch.text_of())
    # a document's place: descending doc_id, null last, equal ids by their texts' hashes, equal rows in any order
    key = F.when(F.col("doc_id") == scratch.NO_ID, F.lit(2**63 - 1)).otherwise(-F.col("doc_id")).alias("key")
    n, lost = docs.select(key).agg(F.count("*"), F.count(F.when(F.col("key") == 2**63 - 1, 1))).first()
    if not n:
        return spark.createDataFrame([], _PASS)
    parts = max(2, min(MOST_PARTS, max(n // rows_per_part, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    size = max(1, n // parts)
    crowded = lost > size or bool(docs.select(key).groupBy("key").count().where(F.col("count") > size).limit(1).count())
    side = F.xxhash64("text") if crowded else F.lit(0).cast("long")
    places = docs.select(key, side.alias("side"))
    some = F.pmod(F.xxhash64("key", "side", F.lit(1)), F.lit(max(1, -(-n // (PER_PART * parts))))) == 0
    seen = sorted((r["key"], r["side"]) for r in places.where(some).limit(2 * PER_PART * parts).collect())  # a sample for the cuts: 2 * PER_PART * MOST_PARTS rows at most
    cuts = sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []
    cut_keys, cut_sides = np.array([c[0] for c in cuts], np.int64), [c[1] for c in cuts]

    @F.pandas_udf("int")
    def part(keys: pd.Series, sides: pd.Series) -> pd.Series:
        keys = keys.to_numpy(np.int64)
        low, high = np.searchsorted(cut_keys, keys, side="left"), np.searchsorted(cut_keys, keys, side="right")
        for i in np.flatnonzero(low < high):
            low[i] = bisect_right(cut_sides, sides.iat[i], low[i], high[i])
        return pd.Series(low.astype(np.int32))

    placed = docs.withColumns({"key": key, "side": side}).withColumn("part", part("key", "side"))
    heads = places.withColumn("part", part("key", "side")).groupBy("part").agg(F.min(F.struct("key", "side")).alias("head")).collect()  # a row for each part
    order = sorted((r["part"], r["head"]["key"], r["head"]["side"]) for r in heads)
    # the part that a head closes: the one before it; the first closes the last
    ends = spark.createDataFrame([(k, s, order[i - 1][0]) for i, (_, k, s) in enumerate(order)], "key long, side long, closes int")
    closing = placed.drop("part").join(F.broadcast(ends), ["key", "side"]).groupBy("closes", "key", "side").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "doc_id")).alias("row"))
    closing = closing.select("row.doc_id", "row.text", "key", "side", F.col("closes").alias("part"))
    every = placed.withColumn("closing", F.lit(False)).unionByName(closing.withColumn("closing", F.lit(True)))
    dealt = every.repartitionByRange(len(order), "part").sortWithinPartitions("part", "closing", "key", F.xxhash64("text"), "text")
    return dealt.select("doc_id", "text", "closing").mapInPandas(_edited_rows, _PASS)


def block_tables(blocks: int = BLOCKS, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(high, low) masks of the bits that each table's key takes."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [sum(c) for c in combinations(whole, blocks - radius)]
    return [(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in masks]


def neighbours(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (hi, lo, other_hi, other_lo) of different fingerprints at most ``radius`` bits apart, each once."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(h).alias("mh"), F.lit(lo).alias("ml")) for i, (h, lo) in enumerate(block_tables(blocks, radius))])
    rows = prints.select("hi", "lo").distinct().select("hi", "lo", F.inline(tables)).select(
        "t", F.expr("hi & mh").alias("kh"), F.expr("lo & ml").alias("kl"), "hi", "lo")
    crowded = rows.groupBy("t", "kh", "kl").count().where("count > 1").select("t", "kh", "kl")
    keys = ["t", "kh", "kl"]
    rows = scratch.written(rows.join(crowded, keys, "left_semi"), "crowded")
    many = hot.hot_keys(rows, keys)
    a, b = hot.dealt(rows, many, keys, ["hi", "lo"]).alias("a"), hot.repeated(rows, many, keys).alias("b")
    near = F.expr(f"(a.hi < b.hi OR (a.hi = b.hi AND a.lo < b.lo)) AND bit_count(a.hi ^ b.hi) + bit_count(a.lo ^ b.lo) <= {radius}")
    on = F.expr(f"a.t = b.t AND a.kh = b.kh AND a.kl = b.kl AND a.{hot.PART} = b.{hot.PART}")
    pairs = a.join(b, on & near).select(F.col("a.hi").alias("hi"), F.col("a.lo").alias("lo"), F.col("b.hi").alias("other_hi"), F.col("b.lo").alias("other_lo")).distinct()
    return scratch.finished(pairs, "near-prints", rows)


def with_links(rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Adds class_id (smallest doc_id with that fingerprint), class_size, and n_links (other documents within the radius) to a written table."""
    keys = ["hi", "lo"]
    classes = scratch.written(rows.groupBy(*keys).agg(F.min(F.nullif("doc_id", F.lit(scratch.NO_ID))).alias("class_id"), F.count("*").alias("class_size")), "prints")
    pairs = neighbours(classes, radius, blocks)
    both = pairs.unionByName(pairs.select(F.col("other_hi").alias("hi"), F.col("other_lo").alias("lo"), F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo")))
    sizes = classes.select(F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo"), F.col("class_size").alias("others"))
    far = both.join(sizes, ["other_hi", "other_lo"]).groupBy(*keys).agg(F.sum("others").alias("others"))
    known = classes.join(far, keys, "left").select(*keys, "class_id", "class_size", (F.col("class_size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return scratch.finished(hot.join(rows, known, keys, ["doc_id", "edited_sha"]), "fingerprints", rows, classes, pairs)


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """The operator: fingerprints, likeness to the edit and to the next document, class and links."""
    first = scratch.written(with_edits(docs), "simhash")
    text = lambda hi, lo: F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))
    return with_links(first, radius, blocks).select(
        scratch.id_out("doc_id"), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        text("hi", "lo").alias("fingerprint"), text("edited_hi", "edited_lo").alias("edited_fingerprint"),
        "near_edited", "near_next", "class_id", "class_size", "n_links")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
