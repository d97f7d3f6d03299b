"""Numpy work on batches of whole texts: word hashes, shingles, pre-tokens.

A batch of texts is laid end to end in one array and treated at once.  A piece (word,
pre-token) is hashed by a sum of its characters, each times a random number of its
place in the piece, so that no family of strings is known to collide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
_FACTORS = np.zeros(0, U)

#: Words are runs of ASCII letters, digits, underscores and all bytes of non-ASCII characters, in lower case.
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _WORD[_c] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h = h ^ (h >> U(27))
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def _factors(n: int) -> np.ndarray:
    """A random odd number for each place in a piece."""
    global _FACTORS
    if len(_FACTORS) < n:
        _FACTORS = mix(np.arange(1, (1 << max(12, (n - 1).bit_length())) + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    return _FACTORS


def piece_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece; values outside of all pieces must be 0, those inside above 0."""
    if not len(starts):
        return np.zeros(0, U)
    begin = starts - starts[0]
    room = np.diff(starts, append=len(values))  # a piece and what lies between it and the next
    place = np.arange(len(values) - starts[0]) - np.repeat(begin, room)
    sums = np.add.reduceat(values[starts[0] :] * _factors(int(room.max()))[place], begin)
    return mix(sums + lengths.astype(U) * U(0xD6E8FEB86659FD93))


def slices(texts: Sequence[str], most: int = 1 << 18) -> Iterator[slice]:
    """Consecutive slices of about ``most`` characters; a longer text is a slice by itself."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text (and the end) the index of its first word."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    word = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    hashes = piece_hashes((data.astype(np.uint16) + 1) * word, starts, ends - starts)
    return hashes, np.searchsorted(starts, at)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words in each text; a text of 1 to k-1 words has one, of all its words."""
    n = len(words)
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(made, out=out_first[1:])
    if not n:
        return np.zeros(0, U), out_first
    padded = np.concatenate((words, np.zeros(k - 1, U)))
    step = U(0xC2B2AE3D27D4EB4F)
    total, factor = padded[:n].copy(), U(1)
    with np.errstate(over="ignore"):
        factors = [U(1)]
        for _ in range(k - 1):
            factors.append(factors[-1] * step)
    for j in range(1, k):
        total += padded[j : j + n] * factors[j]
    keep = np.repeat(first[:-1] - out_first[:-1], made) + np.arange(out_first[-1])
    for d in np.flatnonzero((count > 0) & (count < k)):
        a, b = first[d], first[d + 1]
        total[a] = np.sum(words[a:b] * np.array(factors[: b - a], U), dtype=U)
    return mix(total[keep]), out_first


_CLASS: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """By code point: 1 letter, 2 number, 3 white space, 0 any other."""
    global _CLASS
    if _CLASS is None:
        import regex

        _CLASS = np.zeros(0x110000, np.uint8)
        kinds = [(kind, regex.compile(pattern)) for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\p{White_Space}"))]
        for lo in range(0, 0x110000, 0x1000):  # in blocks, which leave no large garbage behind
            block = "".join(map(chr, range(lo, lo + 0x1000)))
            for kind, pattern in kinds:
                hits = pattern.findall(block)
                if hits:
                    _CLASS[np.frombuffer("".join(hits).encode("utf-32-le"), np.uint32)] = kind
    return _CLASS


def pretokens(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All matches of the byte-level BPE pattern, found for all texts at once.

    Returns the joined text, starts and lengths of the matches in code points,
    their hashes, and for each text (and the end) the index of its first match.
    """
    joined = "".join(texts)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    n = len(joined)
    if not n:
        return joined, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = char_classes()[chars]
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    run = begins[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    mark = run.copy()
    solid = np.flatnonzero(run & (kind != 3))
    solid = solid[~begins[solid]]
    led = solid[kind[solid - 1] == 3]
    mark[led - 1] = True  # the last white space before a run stands alone or leads the run
    mark[led[chars[led - 1] == 32]] = False
    quotes = np.flatnonzero((chars[:-1] == 39) & run[:-1] & mark[:-1] & (kind[1:] == 1) & ~begins[1:n]) if n > 1 else []
    for p in quotes:  # 's 't 'm 'd 're 've 'll, where a match starts at the apostrophe
        end = at[np.searchsorted(at, p, side="right")]
        two, three = joined[p + 1 : min(p + 2, end)], joined[p + 1 : min(p + 3, end)]
        size = 2 if two in ("s", "t", "m", "d") else 3 if three in ("re", "ve", "ll") else 0
        if size:
            mark[p + 1 : p + size] = False
            if p + size < n:
                mark[p + size] = True
    starts = np.flatnonzero(mark)
    lengths = np.diff(starts, append=n)
    return joined, starts, lengths, piece_hashes(chars + np.uint32(1), starts, lengths), np.searchsorted(starts, at)


class PieceCache:
    """Ids of pre-tokens met so far, as arrays sorted by hash; emptied when it holds ``most`` pieces.

    ``encode`` takes a list of new pieces with their hashes and returns their ids end
    to end and how many each has.  A hash only finds a piece: its characters are
    compared, within a batch and with those kept, before its ids are taken.  A batch in
    which two pieces share a hash is encoded piece by piece.
    """

    def __init__(self, encode, most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U)
        self.at, self.size, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16), 0
        self.from_, self.long, self.chars, self.held = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32), 0

    @staticmethod
    def _put(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if len(store) < used + len(more):
            grown = np.zeros(max(2 * len(store), used + len(more)), store.dtype)
            grown[:used] = store[:used]
            store = grown
        store[used : used + len(more)] = more
        return store

    def _add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.chars = self._put(self.ids, self.used, ids), self._put(self.chars, self.held, chars)
        where = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, where, self.used + np.cumsum(sizes) - sizes)
        self.from_ = np.insert(self.from_, where, self.held + np.cumsum(lengths) - lengths)
        self.keys, self.size, self.long = np.insert(self.keys, where, keys), np.insert(self.size, where, sizes), np.insert(self.long, where, lengths)
        self.used, self.held = self.used + len(ids), self.held + len(chars)

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and for each text (and the end) the index of its first id."""
        joined, starts, lengths, hashes, first = pretokens(texts)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        if len(self.keys) > self.most:
            self.clear()
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        keys, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        shift = (starts[index][inverse] - starts) if (lengths[index][inverse] == lengths).all() else None
        if shift is None or not (chars[np.arange(len(chars)) + np.repeat(shift, lengths)] == chars).all():
            return self._one_by_one(joined, starts, lengths, hashes, first)
        where = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[where] != keys if len(self.keys) else np.ones(len(keys), bool)
        old = np.flatnonzero(~new)
        if len(old):
            here, there, n = index[old], where[old], lengths[index[old]]
            if (self.long[there] != n).any() or (_stretches(chars, starts[here], n) != _stretches(self.chars, self.from_[there], n)).any():
                return self._one_by_one(joined, starts, lengths, hashes, first)
        if new.any():
            pick = index[new]
            pieces = [joined[a : a + k] for a, k in zip(starts[pick].tolist(), lengths[pick].tolist())]
            ids, sizes = self.encode(pieces, keys[new])
            self._add(keys[new], ids, sizes, _stretches(chars, starts[pick], lengths[pick]), lengths[pick])
            where = np.searchsorted(self.keys, keys)
        where = where[inverse]
        sizes = self.size[where].astype(np.int64)
        return _stretches(self.ids, self.at[where], sizes), np.concatenate(([0], np.cumsum(sizes)))[first]

    def _one_by_one(self, joined: str, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place: dict[str, int] = {}
        nth = np.array([place.setdefault(joined[a : a + k], len(place)) for a, k in zip(starts.tolist(), lengths.tolist())])
        _, pick = np.unique(nth, return_index=True)
        ids, sizes = self.encode(list(place), hashes[pick])
        at, sizes = np.cumsum(sizes) - sizes, np.asarray(sizes, np.int64)
        return _stretches(ids, at[nth], sizes[nth]), np.concatenate(([0], np.cumsum(sizes[nth])))[first]


def _stretches(values: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array, end to end."""
    ends = np.cumsum(sizes, dtype=np.int64)
    if not len(ends):
        return values[:0]
    return values[np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1])]
