"""Operator 3: token ids in files of byte-aligned variable-length codes.

Texts are encoded as ``Tokenizer.encode`` does without the post-processor (a text that
holds one of the tokenizer's added tokens by that call itself) and end with an end id.  All ids
of the corpus are counted; an id's rank in the order of falling counts (ties: by
id) is what the files hold, so that frequent tokens take one byte.  A rank takes 1
to 4 bytes; two bits say how many, and those bits stand by themselves: four to a
control byte, before the data bytes.  A reader looks each control byte up in a
table of lengths and shifts, and gathers all data bytes at once with numpy.

A file table has one row for a block of documents: doc_id, start, n_tokens and
n_bytes of each, then ``control`` and ``data``.  Rows are in ascending doc_id order,
file by file; ``read_tokens`` gives the ids back.

Cases: a null text counts as the empty text and has the end id alone; rows without
doc_id come first; repeated rows each have their own ids; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .textbatch import PieceCache, slices

END, IDS = 0, 1 << 16
_CACHES: dict = {}


class TextCache(PieceCache):
    """A piece cache that leaves texts with an added token in them, as '<|endoftext|>', to ``whole``, which encodes entire texts."""

    def __init__(self, encode, added: list[str], whole):
        super().__init__(encode, 1_500_000)
        self.added, self.whole = added, whole

    def __call__(self, texts):
        apart = [k for k, text in enumerate(texts) if any(token in text for token in self.added)]
        if not apart:
            return super().__call__(texts)
        plain = list(texts)
        for k in apart:
            plain[k] = ""
        ids, at = super().__call__(plain)
        parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        for k in apart:
            parts[k] = np.array(self.whole(texts[k]), np.uint16)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def library_cache(tokenizer_file: str) -> PieceCache:
    """A cache over the tokenizers library; one in each Python worker."""
    if tokenizer_file not in _CACHES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        if tokenizer.get_vocab_size() > IDS:
            raise ValueError("ids must fit in 16 bits")

        def encode(pieces, _keys):
            made = tokenizer.encode_batch([pieces], is_pretokenized=True, add_special_tokens=False)[0]
            return np.array(made.ids, np.uint16), np.bincount(np.array(made.word_ids, np.int64), minlength=len(pieces))

        added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        _CACHES[tokenizer_file] = TextCache(encode, added, lambda text: tokenizer.encode(text, add_special_tokens=False).ids)
    return _CACHES[tokenizer_file]


# ---- the code: control bytes apart from data bytes -------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of some unsigned integers below 2**32."""
    values = np.asarray(values, np.uint32)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    four = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = four[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


#: For each control byte the lengths of its four values.
LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.int64)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers that :func:`pack` took."""
    if not n:
        return np.zeros(0, np.uint32)
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        some = np.flatnonzero(sizes > k)
        out[some] |= raw[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# ---- the job ---------------------------------------------------------------------------------------------------


def tokenise(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens and the ids of each text with the end id, compressed."""

    def run(frames):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        cache = library_cache(tokenizer_file)
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            blobs, counts = [], []
            for part in slices(texts, 1 << 20):
                ids, at = cache(texts[part])
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    blobs.append(squeeze.compress(ids[a:b].tobytes() + b"\0\0"))
                    counts.append(b - a + 1)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": np.array(counts, np.int64), "ids": blobs})

    return docs.select(scratch.id_in("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids binary")


def _ids(blobs) -> list[np.ndarray]:
    import zstandard

    open_up = zstandard.ZstdDecompressor()
    return [np.frombuffer(open_up.decompress(b), np.uint16) for b in blobs]


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """Ids in the order of falling counts over all documents: at most 65,536, whatever the corpus."""

    def count(frames):
        total = np.zeros(IDS, np.int64)
        for frame in frames:
            for ids in _ids(frame["ids"]):
                if len(ids) > 4096:
                    total += np.bincount(ids, minlength=IDS)
                else:
                    np.add.at(total, ids, 1)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used.astype(np.int64), "n": total[used]})

    rows = tokens.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint16)


def write_files(tokens: DataFrame, ranked: np.ndarray, path: str, block_tokens: int = 1 << 18) -> None:
    """Writes the file table in ascending doc_id order."""
    rank = np.zeros(IDS, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def run(frames):
        held: list = []

        def block():
            sizes = [len(ids) for _, ids in held]
            values = rank[np.concatenate([ids for _, ids in held])]
            control, data = pack(values)
            return pd.DataFrame({"doc_ids": [[d for d, _ in held]], "sizes": [sizes], "control": [control], "data": [data]})

        size = 0
        for frame in frames:
            for doc, ids in zip(frame["doc_id"].tolist(), _ids(frame["ids"])):
                held.append((doc, ids))
                size += len(ids)
                if size >= block_tokens:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    spark = tokens.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens.rdd.getNumPartitions())
    placed = tokens.repartitionByRange(parts, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    placed.mapInPandas(run, "doc_ids array<long>, sizes array<long>, control binary, data binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, ranked: np.ndarray) -> DataFrame:
    """Each document's place, size and checksum, read from the files alone."""
    blocks = spark.read.schema("doc_ids array<long>, sizes array<long>, control binary, data binary").parquet(path)
    table = ranked.astype("<u4")

    def run(frames):
        for frame in frames:
            for n, (docs, sizes, control, data) in enumerate(zip(frame["doc_ids"], frame["sizes"], frame["control"], frame["data"])):
                sizes = np.asarray(sizes, np.int64)
                ids = table[unpack(control, data, int(sizes.sum()))]
                ends = np.cumsum(sizes)
                yield pd.DataFrame({
                    "file": frame["file"].iloc[n], "block": frame["block"].iloc[n],
                    "nth": np.arange(len(sizes)), "doc_id": np.asarray(docs, np.int64), "n_tokens": sizes, "before": ends - sizes,
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist())],
                })

    # a block's place: its file, then its offset among the file's rows
    placed = blocks.withColumn("file", F.col("_metadata.file_name")).withColumn("block", F.col("_metadata.row_index"))
    return placed.mapInPandas(run, "file string, block long, nth long, doc_id long, n_tokens long, before long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """The operator: writes the files, reads them back, and returns each document's row."""
    spark = docs.sparkSession
    tokens = scratch.written(tokenise(docs, tokenizer_file), "token-ids", codec="none")
    ranked = frequency_ranks(tokens)
    path = path or scratch.new_path(spark, "token-files")
    write_files(tokens, ranked, path)
    scratch.drop(tokens)
    rows = scratch.written(read_tokens(spark, path, ranked), "token-rows")
    # ids before each block: a row for a block, summed within files and then over files, of which each has one row
    sums = rows.groupBy("file", "block").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("in_file", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n"))
    files = sorted(sums.groupBy("file").agg(F.sum("n").alias("n")).collect(), key=lambda r: int(r["file"].split("-")[1]))  # part-<number>-...
    names, total, offset = [], 0, []
    for r in files:
        names.append(r["file"])
        offset.append(total)
        total += r["n"]
    starts = spark.createDataFrame(pd.DataFrame({"file": pd.Series(names, dtype="string"), "base": pd.Series(offset, dtype="int64")}), "file string, base long")
    placed = rows.join(sums.select("file", "block", "in_file"), ["file", "block"]).join(F.broadcast(starts), "file")
    return placed.select(scratch.id_out("doc_id"), (F.col("base") + F.col("in_file") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
