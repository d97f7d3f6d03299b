"""Operator 13: removal of repeated passages by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else,
in another text or in the same one.  Strings are judged on the input.

1. Equal texts are one text with a count, in a table bucketed by the text's digest, so
   that later joins on the digest don't move texts.
2. Each string has an anchor: the leftmost of its runs of ``GRAM`` bytes with the least
   hash.  Equal strings have equal anchors.  The strings of an anchor start in one
   stretch of the text; only anchors that occur more than once go on.
3. A stretch and the ``LENGTH - 1`` bytes after it are a piece.  Pieces are dealt by
   anchor into shards of about ``SHARD`` bytes, whose suffixes are sorted by induction
   (:mod:`suffix_array`).  A string is repeated if the suffix at its start has
   ``LENGTH`` bytes in common with its neighbour, or its piece occurs more than once.
   An anchor with a single piece, however often, needs no sorting.
4. An anchor with over ``most`` places, which no shard could hold, is not sharded: its
   strings are counted by their 128-bit digests instead.
5. Repeated strings become spans of each text, and the rest is kept.

Cases: a null text is empty; a text shorter than ``LENGTH`` loses nothing; texts are
compared as UTF-8 bytes, so that what is kept may begin within a character and is
returned as bytes; repeated rows are copies of each other whatever their ids; rows
without doc_id are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hot, scratch
from .suffix_array import common_prefixes, suffix_array
from .textbatch import U, mix

LENGTH, GRAM, SHARD, MOST, SLICE = 200, 32, 2 << 20, 20_000, 1 << 19
#: A byte that UTF-8 never has stands between pieces.
APART = b"\xff"
_KEY = ["d1", "d2"]
_PLACE = U((1 << 20) - 1)


def digest_columns() -> list:
    """120 bits of the text's SHA-256 as two numbers, and its length in bytes."""
    part = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    return [part(1).alias("d1"), part(16).alias("d2")]


def _with_digest(docs: DataFrame) -> DataFrame:
    own = docs.select(scratch.id_in("doc_id"), scratch.text_of()).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    return own.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), *digest_columns())


class Bucketed:
    """A table of the shared folder, bucketed by the digest."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark = df.sparkSession
        self.name, self.path = f"texts_{uuid.uuid4().hex}", scratch.new_path(self.spark, "texts")
        with scratch.shuffles_removed(self.spark):
            df.write.bucketBy(buckets, *_KEY).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        scratch.delete(self.spark, self.path)


def _parts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of a batch end to end, and where each value begins (and the end)."""
    column = batch.column(name).cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), at


def _byte_numbers(seed: int = 13) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the run of ``gram`` bytes, a power of two, from each place on; those at the end are cut short."""
    h, size, factor = _byte_numbers()[data], 1, 0x9E3779B97F4A7C15
    while size < gram:
        longer = h * U(factor)
        longer[: len(h) - size] += h[size:]
        h, size, factor = longer, 2 * size, factor * factor % 2**64
    return mix(h)


def anchored(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of string starts with one anchor each: the anchor's hash, the first start and how many.

    data: texts end to end, of at most 2**20 bytes; ends: where each text ends.
    """
    n, window = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _gram_hashes(data, gram)
    least = (h & ~_PLACE) | np.arange(n, dtype=U)
    size = 1
    while 2 * size <= window:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < window:
        least = np.minimum(least[: size - window], least[window - size :])
    anchor = (least[: n - length + 1] & _PLACE).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    begins = np.concatenate(([0], ends[:-1]))
    np.add.at(edge, np.maximum(begins, ends - length + 1), 1)
    np.add.at(edge, ends, -1)
    whole = (np.cumsum(edge) == 0)[: len(anchor)]  # starts of strings that lie within their text
    moved = np.ones(len(anchor), bool)
    moved[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(whole & (moved | np.concatenate(([True], ~whole[:-1]))))
    after = np.concatenate((moved[1:] | ~whole[1:], [True]))
    last = np.flatnonzero(whole & after)
    return h[anchor[first]].view(np.int64), first, last - first + 1


def _slices(at: np.ndarray, length: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(first text, one after the last, offset): texts of about ``most`` bytes together, a longer one in pieces that overlap."""
    k, n = 0, len(at) - 1
    while k < n:
        size = at[k + 1] - at[k]
        if size > most:
            for offset in range(0, int(size) - length + 1, most):
                yield k, k + 1, offset
            k += 1
            continue
        last = max(k + 1, int(np.searchsorted(at, at[k] + most, side="right")) - 1)
        yield k, last, 0
        k = last


_ANCHORS = "d1 long, d2 long, h array<long>, lo array<long>, n array<long>"


def _find_anchors(length: int, gram: int, most: int = SLICE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _parts(batch, "text")
            keys = [batch.column(c).to_numpy() for c in _KEY]
            for k, last, offset in _slices(at, length, most):
                begin = at[k] + offset
                end = at[last] if last > k + 1 or not offset and at[last] - begin <= most else min(at[last], begin + most + length - 1)
                ends = np.minimum(at[k + 1 : last + 1], end) - begin
                h, first, n = anchored(data[begin:end], ends, length, gram)
                own = np.searchsorted(ends, first, side="right")
                bounds = pa.array(np.searchsorted(own, np.arange(last - k + 1)).astype(np.int32))
                lo = first - np.concatenate(([0], ends[:-1]))[own] + offset
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (h, lo, n)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][k:last]), pa.array(keys[1][k:last]), *lists], names=["d1", "d2", "h", "lo", "n"])

    return run


_PIECES = "h long, piece binary, d1 long, d2 long, lo long, n long, sure boolean"


def _cut(length: int):
    """Pieces of each text at its anchors; one that the batch has had already goes without its bytes, as surely repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _parts(batch, "text")
            lists = batch.column("found")
            bounds = np.asarray(lists.offsets)
            inner = lists.values if isinstance(lists.values, pa.StructArray) else pa.array(lists.values)
            h, lo, n = (inner.field(c).to_numpy() for c in ("h", "lo", "n"))
            sizes = np.diff(bounds)
            row = np.repeat(np.arange(len(sizes)), sizes)
            h, lo, n = (v[bounds[0] : bounds[-1]] for v in (h, lo, n))
            begin = at[:-1][row] + lo
            whole, seen, pieces = memoryview(data), {}, []
            sure = np.zeros(len(h), bool)
            for i, (a, b) in enumerate(zip(begin.tolist(), (begin + n + length - 1).tolist())):
                piece = bytes(whole[a:b])
                first = seen.setdefault(piece, i)
                if first != i:
                    sure[first] = sure[i] = True
                    piece = None
                pieces.append(piece)
            keys = [batch.column(c).to_numpy()[row] for c in _KEY]
            for k in range(0, len(h), 10_000):
                some = slice(k, k + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(pieces[some], pa.binary()), *(pa.array(v[some]) for v in (*keys, lo, n, sure))], names=["h", "piece", "d1", "d2", "lo", "n", "sure"])

    return run


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some different pieces, which of its strings also start in another of them."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(APART.join(pieces) + APART, np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    room = np.repeat(begin + sizes, sizes + 1) - np.arange(len(text))
    order = suffix_array(text)
    common = common_prefixes(text, order, room)
    own = np.flatnonzero((room >= length)[order])
    marked = np.zeros(len(text), bool)
    if len(own) > 1:
        between = np.minimum.reduceat(common[: own[-1] + 1], own[:-1] + 1) >= length
        marked[order[own[1:][between]]] = marked[order[own[:-1][between]]] = True
    return [marked[b : b + s - length + 1] for b, s in zip(begin.tolist(), sizes.tolist())]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches that are true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


_STARTS = "d1 long, d2 long, start long, n long"


def _shards(length: int, most: int):
    """Rows sorted by anchor -> stretches of repeated starts, shard by shard."""

    def solve(rows: dict[str, np.ndarray], pieces: list) -> Iterator[pa.RecordBatch]:
        nth: dict[bytes, int] = {}
        which = np.array([-1 if p is None else nth.setdefault(p, len(nth)) for p in pieces], np.int64)
        here = which >= 0
        times = np.bincount(which[here], minlength=len(nth))
        np.maximum.at(times, which[here], np.where(rows["sure"][here], 2, 1))
        # different pieces of one anchor
        first = np.zeros(len(nth), np.int64)
        first[which[here][::-1]] = np.flatnonzero(here)[::-1]
        anchor = rows["h"][first] if len(nth) else np.zeros(0, np.int64)
        _, back, many = np.unique(anchor, return_inverse=True, return_counts=True)
        several = np.flatnonzero(many[back] > 1) if len(nth) else []
        texts = list(nth)
        starts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if len(several):
            for k, mask in zip(several.tolist(), repeated_starts([texts[k] for k in several], length)):
                if times[k] < 2 and mask.any():
                    starts[k] = _runs(mask)
        out: list[tuple] = []
        whole = np.where(here, times[which] > 1 if len(nth) else False, True)
        sure = np.flatnonzero(whole)
        out.append((rows["d1"][sure], rows["d2"][sure], rows["lo"][sure], rows["n"][sure]))
        for i in np.flatnonzero(~whole).tolist():
            found = starts.get(int(which[i]))
            if found:
                m = len(found[0])
                out.append((np.repeat(rows["d1"][i], m), np.repeat(rows["d2"][i], m), rows["lo"][i] + found[0], found[1]))
        done = [np.concatenate(v) for v in zip(*out)]
        if len(done[0]):
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in done], names=["d1", "d2", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        pieces: list = []
        size = 0

        def joined() -> dict[str, np.ndarray]:
            return {c: np.concatenate([x[c] for x in held]) for c in held[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "d1", "d2", "lo", "n", "sure")})
            new = batch.column("piece").to_pylist()
            pieces += new
            size += sum(len(p) for p in new if p)
            if size > most:  # all but the last anchor, which may go on
                rows = joined()
                cut = int(np.searchsorted(rows["h"], rows["h"][-1]))
                if cut:
                    yield from solve({c: v[:cut] for c, v in rows.items()}, pieces[:cut])
                    held, pieces = [{c: v[cut:] for c, v in rows.items()}], pieces[cut:]
                    size = sum(len(p) for p in pieces if p)
                else:
                    held = [rows]
        if held:
            yield from solve(joined(), pieces)

    return run


_STRINGS = "string binary, d1 long, d2 long, start long, n long, sure boolean"


def _strings(length: int):
    """The strings of crowded anchors by digest; a piece that the batch has had already goes as a whole, as surely repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _parts(batch, "text")
            text, d1, d2 = memoryview(data), batch.column("d1").to_pylist(), batch.column("d2").to_pylist()
            founds = batch.column("found").to_pylist()
            pieces = [(i, one["lo"], one["n"], bytes(text[int(at[i]) + one["lo"] : int(at[i]) + one["lo"] + one["n"] + length - 1])) for i, found in enumerate(founds) for one in found]
            times = Counter(piece for *_, piece in pieces)
            seen: set[bytes] = set()
            rows: list[tuple] = []
            for i, lo, n, piece in pieces:
                sure = times[piece] > 1
                if piece in seen:
                    rows.append((None, d1[i], d2[i], lo, n, True))
                    continue
                seen.add(piece)
                rows += [(hashlib.blake2b(piece[p : p + length], digest_size=16).digest(), d1[i], d2[i], lo + p, 1, sure) for p in range(n)]
                if len(rows) > 50_000:
                    yield _string_rows(rows)
                    rows = []
            yield _string_rows(rows)

    return run


def _string_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.binary(), "d1": pa.int64(), "d2": pa.int64(), "start": pa.int64(), "n": pa.int64(), "sure": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def _crowded(found: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Starts of repeated strings of anchors that are too frequent for a shard."""
    places = found.groupBy(*_KEY).agg(F.collect_list(F.struct("h", "lo", "n")).alias("found")).hint("shuffle_hash")
    strings = scratch.written(texts.join(places, _KEY).select("text", *_KEY, "found").mapInArrow(_strings(length), _STRINGS), "strings")
    many = strings.where("string is not null").groupBy("string").agg(F.count("*").alias("times"), F.max("sure").alias("once_more")).where("times > 1 or once_more").select("string")
    open_ = scratch.written(strings.where("not sure").select("string", *_KEY, "start", "n"), "open-strings")
    met = hot.join(open_, many, ["string"], [*_KEY, "start"]).select(*_KEY, "start", "n")
    return scratch.finished(met.unionByName(strings.where("sure").select(*_KEY, "start", "n")), "crowded", strings, open_)


def _spans(length: int, with_kept: bool):
    """Merged spans of each text, and what is left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _parts(batch, "text")
            whole = memoryview(data)
            removed, spans, digests, kept, marks = [], [], [], [], []
            copies, founds = batch.column("n_copies").to_pylist(), batch.column("found")
            bounds, inner = np.asarray(founds.offsets), founds.values
            start, n = inner.field("start").to_numpy(), inner.field("n").to_numpy()
            for i in range(batch.num_rows):
                a, b = int(at[i]), int(at[i + 1])
                if copies[i] > 1 and b - a >= length:
                    cuts = [(0, b - a)]
                else:
                    lo, hi = start[bounds[i] : bounds[i + 1]], n[bounds[i] : bounds[i + 1]]
                    cuts = _merged(lo, lo + hi + length - 1)
                left, rest = 0, []
                for x, y in cuts:
                    rest.append(whole[a + left : a + x])
                    left = y
                rest.append(whole[a + left : b])
                bare = b"".join(rest)
                digests.append(hashlib.sha256(bare).hexdigest())
                removed.append(b - a - len(bare))
                spans.append(len(cuts))
                if with_kept:
                    kept.append(bare)
                    marks.append([{"start": x, "end": y} for x, y in cuts])
            out = [batch.column("d1"), batch.column("d2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["d1", "d2", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                out += [pa.array(kept, pa.binary()), pa.array(marks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Unions of intervals, those that touch together."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    return list(zip(lo[new].tolist(), hi[np.append(new[1:], len(hi)) - 1].tolist()))


_SPANS = "d1 long, d2 long, n_removed long, n_spans long, kept_sha256 string"
_KEPT = ", kept binary, spans array<struct<start: long, end: long>>"


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, most: int = MOST, with_kept: bool = True) -> DataFrame:
    """The operator: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_kept`` the bytes that are left and the spans that went."""
    spark = docs.sparkSession
    schema = _SPANS + (_KEPT if with_kept else "")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = _with_digest(docs)
    table = Bucketed(own.groupBy(*_KEY).agg(F.first("text").alias("text"), F.count("*").alias("n_copies")), buckets)
    texts = table.read()
    anchors = scratch.written(texts.where(F.octet_length("text") >= length).select("text", *_KEY).mapInArrow(_find_anchors(length, gram), _ANCHORS), "anchors")
    counts = scratch.written(anchors.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 1"), "anchor-counts")
    dealt = counts.where(F.col("count") > 10 * hot.PER).orderBy(F.desc("count"), "h").limit(hot.MOST_HOT).select("h", F.ceil(F.col("count") / (10 * hot.PER)).cast("int").alias(hot.PARTS))
    every = anchors.select(*_KEY, F.inline(F.arrays_zip("h", "lo", "n")))
    met = hot.dealt(every, dealt, ["h"], [*_KEY, "lo"]).join(hot.repeated(counts, dealt, ["h"]), ["h", hot.PART])
    found = scratch.written(met.select(*_KEY, "h", "lo", "n", (F.col("count") > most).alias("crowded")), "found")
    few = found.where("not crowded").groupBy(*_KEY).agg(F.collect_list(F.struct("h", "lo", "n")).alias("found")).hint("shuffle_hash")
    pieces = texts.join(few, _KEY).select("text", *_KEY, "found").mapInArrow(_cut(length), _PIECES)
    starts = pieces.repartition("h").sortWithinPartitions("h").mapInArrow(_shards(length, shard), _STARTS)
    again: list[DataFrame] = [anchors, counts, found]
    if found.where("crowded").limit(1).count():
        crowded = _crowded(found.where("crowded"), texts, length)
        again.append(crowded)
        starts = starts.unionByName(crowded)
    per_text = starts.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "n")).alias("found")).hint("shuffle_hash")
    none = F.expr("cast(array() as array<struct<start: bigint, n: bigint>>)")
    solved = scratch.finished(texts.join(per_text, _KEY, "left").select("text", *_KEY, "n_copies", F.coalesce("found", none).alias("found")).mapInArrow(_spans(length, with_kept), schema), "spans", *again)
    table.drop()
    rows = scratch.written(own.drop("text"), "digests")
    done = hot.join(rows, solved, _KEY, ["doc_id"])
    return done.select(scratch.id_out("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if with_kept else []))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)
