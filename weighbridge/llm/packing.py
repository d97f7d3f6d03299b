"""Operator 7: packing by optimal length buckets.

All texts are measured in tokens, with one end token each; what is longer than
``longest`` is cut into pieces of that length, none dropped.  Over the histogram of
all lengths a dynamic program chooses the at most ``buckets`` upper bounds that make
the total padding least.  Within a bucket of bound L a batch holds ``budget // L``
sequences (one at least).  Large buckets are dealt into shards by a hash of the
document, so that no task orders a whole bucket; each shard has at most one batch
that is not full.

Cases: a null text counts as the empty text and has the end token alone; rows
without doc_id are packed like others, dealt by their texts; repeated rows are packed
each by itself, in the same shard; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .textbatch import slices
from .token_files import library_cache

LONGEST, BUCKETS, BUDGET, SHARD_ROWS = 4096, 12, 16384, 20_000


def token_lengths(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens (the end token included) and a hash of the text."""

    def run(frames):
        cache = library_cache(tokenizer_file)
        for frame in frames:
            texts = frame["text"].tolist()
            sizes = [np.diff(cache(texts[part])[1]) + 1 for part in slices(texts, 1 << 20)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": np.concatenate(sizes) if sizes else np.zeros(0, np.int64), "spread": frame["spread"]})

    texts = docs.select(scratch.id_in("doc_id"), scratch.text_of()).withColumn("spread", F.xxhash64("text"))
    return texts.mapInPandas(run, "doc_id long, n_tokens long, spread long")


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    lengths: distinct, ascending.  best[j] is the least padded total of the first j
    lengths in the buckets so far; one more bucket that ends at j costs its bound
    times the sequences it takes.
    """
    n = len(lengths)
    if not n:
        return []
    buckets = min(buckets, n)
    before = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    size = lengths.astype(np.float64)
    best = np.concatenate(([0.0], size * before[1:]))
    last = [np.zeros(n + 1, np.int64)]
    for _ in range(1, buckets):
        after, came = best.copy(), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (before[j] - before[:j])
            k = int(cost.argmin())
            after[j], came[j] = cost[k], k
        best = after
        last.append(came)
    out, j = [], n
    for came in reversed(last):
        if j <= 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(came[j])
    return sorted(out)


def pack(rows: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, n_tokens, perhaps spread) -> doc_id, piece, n_tokens, bucket, padded, shard, batch, slot."""
    if "spread" not in rows.columns:
        rows = rows.withColumn("spread", F.lit(0).cast("long"))
    cut = rows.select("doc_id", "spread", F.col("n_tokens").alias("whole"), F.explode(F.expr(f"sequence(0L, greatest(0L, (n_tokens - 1) div {longest}))")).alias("piece"))
    cut = cut.select("doc_id", "spread", "piece", F.least(F.lit(longest).cast("long"), F.col("whole") - F.col("piece") * longest).alias("n_tokens"))
    seen = cut.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # a row for each length up to longest
    lengths, counts = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], np.int64)
    bounds = bucket_bounds(lengths, counts, buckets)
    bucket, padded, shards, per = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("int")
    low = 0
    for k, bound in enumerate(bounds):
        held = int(counts[(lengths > low) & (lengths <= bound)].sum())
        inside, low = (F.col("n_tokens") > low) & (F.col("n_tokens") <= bound), bound
        bucket, padded = F.when(inside, k).otherwise(bucket), F.when(inside, F.lit(bound).cast("long")).otherwise(padded)
        shards, per = F.when(inside, -(-held // shard_rows)).otherwise(shards), F.when(inside, max(1, budget // bound)).otherwise(per)
    dealt = cut.select("doc_id", "piece", "n_tokens", bucket.alias("bucket"), padded.alias("padded"), F.pmod(F.xxhash64("doc_id", "piece", "spread"), shards).cast("int").alias("shard"), per.alias("per"))
    nth = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("n_tokens", "doc_id", "piece")) - 1
    return dealt.withColumn("nth", nth).select(
        scratch.id_out("doc_id"), "piece", "n_tokens", "bucket", "padded", "shard", F.expr("cast(nth div per as long)").alias("batch"), F.expr("cast(nth % per as int)").alias("slot"))


def pack_documents(docs: DataFrame, tokenizer_file: str, **settings) -> DataFrame:
    """The operator."""
    return pack(scratch.written(token_lengths(docs, tokenizer_file), "lengths"), **settings)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
