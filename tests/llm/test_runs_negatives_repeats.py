"""Operators 11, 12 and 13 against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from weighbridge.llm import negatives, periods, repeats
from weighbridge.llm.suffix_array import common_prefixes, suffix_array

RNG = random.Random(31)


# ---- suffix arrays and repeats ---------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_suffix_array_and_common_prefixes():
    for _ in range(400):
        letters = RNG.choice([1, 2, 3, 256])
        s = bytes(RNG.randrange(letters) for _ in range(RNG.randint(1, 70)))
        if RNG.random() < 0.4:
            s = (s * 5)[: RNG.randint(1, 5 * len(s))]
        text = np.frombuffer(s, np.uint8)
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        want = [0] + [_common(s[i:], s[j:]) for i, j in zip(order[:-1].tolist(), order[1:].tolist())]
        assert common_prefixes(text, order, np.arange(len(s), 0, -1)).tolist() == want


def test_suffix_array_of_numbers():
    for _ in range(100):
        v = [RNG.randrange(9) for _ in range(RNG.randint(1, 200))]
        assert suffix_array(np.array(v, np.int32), 9).tolist() == sorted(range(len(v)), key=lambda i: v[i:])


def _removed(texts: list[str | None], length: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(mask) if x and (not i or not mask[i - 1]))
        out.append((len(b), sum(mask), spans, hashlib.sha256(bytes(x for x, y in zip(b, mask) if not y)).hexdigest()))
    return out


def _texts() -> list[str | None]:
    word = lambda: "".join(RNG.choice("abcdeéß") for _ in range(RNG.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, other = prose(30), prose(25)
    texts = [None, "", "short", prose(60), prose(20) + shared + prose(20), prose(15) + " " + shared + " " + other, other + prose(8), shared, "ab" * 300, "x" * 500, shared + prose(3) + shared, prose(3000)]
    return texts + [texts[3], texts[3], texts[1], texts[8][:450] + "c"] + [prose(5) + shared[:120] + prose(5) for _ in range(12)]


@pytest.mark.parametrize("more", [{}, {"shard": 2000, "most": 3}])
def test_repeats_equal_brute_force(spark, more):
    texts = _texts()
    rows = [(i if i != 6 else None, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_removed int")
    got = {r.doc_id: r for r in repeats.without_repeats(docs, length=64, gram=16, **more).collect()}
    assert len(got) == len(texts)
    for (doc_id, text, *_), want in zip(rows, _removed(texts, 64)):
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, doc_id
        raw = (text or "").encode()
        left = b"".join(raw[a:b] for a, b in zip([0, *[s.end for s in r.spans]], [*[s.start for s in r.spans], len(raw)]))
        assert left == bytes(r.kept)


def test_repeats_of_long_texts_in_overlapping_slices():
    text = ("".join(RNG.choice("abc") for _ in range(900))).encode()
    data, ends = np.frombuffer(text, np.uint8), np.array([len(text)])
    whole = repeats.anchored(data, ends, 40, 8)
    parts = [repeats.anchored(data[o : o + 100 + 39], np.array([min(139, 900 - o)]), 40, 8) for o in range(0, 861, 100)]
    starts = sorted((int(o * 100 + lo + k), int(h)) for o, (hs, los, ns) in enumerate(parts) for h, lo, n in zip(hs, los, ns) for k in range(n))
    assert starts == sorted((int(lo + k), int(h)) for h, lo, n in zip(*whole) for k in range(n))


def test_repeats_of_an_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- periodic runs ---------------------------------------------------------------------------------------------


def _runs(w: list) -> list[tuple[int, int, int]]:
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(6, 4 * q) and not any(q % d == 0 and all(w[j] == w[j + d] for j in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _expected(doc_id, text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a, o = g % n, list(w)
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            w[i] = o[a + (i - a) % p]
    runs = _runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *strongest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def _periodic(n: int) -> str:
    out: list[str] = []
    while len(out) < n:
        block = [RNG.choice("abcdefgh") for _ in range(RNG.choice([1, 1, 2, 3, 5, 8, 13]))]
        out += (block * 8)[: RNG.randint(1, 6 * len(block))]
    return RNG.choice([" ", "\t ", "\n"]).join(out)


@pytest.mark.parametrize("long", [1 << 16, 40])
def test_periodic_runs_equal_brute_force(spark, long):
    texts = [None, "", "  \n", "one", "a a a a a a", "a a a a a", "a b " * 9, "x " * 400] + [_periodic(RNG.randint(5, 160)) for _ in range(40)]
    rows = [(i if i != 4 else None, t, "clash", 7) for i, t in enumerate(texts)] + [(8, texts[8], "clash", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    got = periods.periodic_runs(docs, periods.rewritten_tail, long=long).collect()
    assert len(got) == len(rows)
    mine = Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got)
    assert mine == Counter((d, *_expected(d, t)) for d, t, *_ in rows)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_z_function():
    for _ in range(200):
        w = [RNG.randrange(3) for _ in range(RNG.randint(1, 60))]
        want = [0] + [next((k for k in range(len(w) - i) if w[k] != w[i + k]), len(w) - i) for i in range(1, len(w))]
        assert periods.z_function(w) == want


# ---- hard negatives --------------------------------------------------------------------------------------------


def _mined(rows, every, positives, negatives_) -> Counter:
    used = []
    for n, (i, v, label) in enumerate(rows):
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        used.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    last = lambda i: (i is None, i or 0)
    out = []
    for n, i, label, a in used:
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), last(j), j, other) for m, j, other, b in used if m != n and len(b) == len(a)]
        scored.sort()
        for p, _, j, _ in [s for s in scored if s[3] == label][:positives]:
            fit = [s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives_]
            out += [(i, j, k + 1, s[2], -p, -s[0]) for k, s in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_hard_negatives_equal_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) * scale).tolist(), int(rng.integers(3))) for i in range(160)]
    rows += [(3, rows[3][1], 1), (500, rows[5][1], 2), (500, rows[5][1], 2), (None, rows[7][1], 0), (None, rows[9][1], 2)]  # repeated vectors and ids, none
    rows += [(600, None, 1), (700, [1.0] * 8, None), (800, [float("nan")] * 8, 1), (900, [0.0] * 8, 1), (901, [1.0, None] * 4, 1), (902, [], 1), (910, [1.0, 2.0], 1), (911, [1.0, 1.9], 1), (912, [1.1, 0.2], 0), (913, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "vec_id long, embedding array<double>, label int, rank string, score int")
    got = negatives.hard_negatives(df, anchor_every=10, label=negatives.moved_labels(), shelf=40).collect()
    assert Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got) == _mined(rows, 10, 5, 10)
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_angles_bound_scores():
    rng = np.random.default_rng(5)
    refs = negatives.directions({6: rng.standard_normal((50, 6))}, 6)
    a, b = (np.floor(256 * rng.standard_normal((40, 6)) * rng.choice([0.01, 1, 100], (40, 1))) for _ in range(2))
    na, nb = negatives._norms(a), negatives._norms(b)
    ta, tb = negatives._angles(a, refs, na), negatives._angles(b, refs, nb)
    scores = a @ b.T
    for k in range(40):  # a row that scores within the window is never ruled out
        least, most = negatives.windows(ta, na, scores[:, k], scores[:, k], nb[k], nb[k])
        assert negatives.may_meet(ta, least, most, tb[k], tb[k]).all()


# ---- repeated ids in operator 1 --------------------------------------------------------------------------------


def test_rows_of_one_id_have_one_order_in_small_and_large_tables(spark):
    from weighbridge.llm import simhash

    texts = [" ".join(RNG.choice("abcdefghij") * 3 for _ in range(20)) for _ in range(6)]
    rows = [(5, t) for t in texts]

    def seen(others: int) -> dict:
        docs = spark.createDataFrame([(0, "last of all"), *rows, *[(100 + i, f"text number {i}") for i in range(others)]], "doc_id long, text string")
        return {r.fingerprint: (r.edited_sha256, r.near_next) for r in simhash.fingerprint_documents(docs).where("doc_id = 5").collect()}

    assert seen(4) == seen(400) and len(seen(4)) == 6
