"""The operators over small tables with nulls, empty and repeated rows, against brute force."""

import hashlib
import itertools
import random
import re
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from weighbridge.llm import bpe, components, langid, lattice, learning, licenses, order_minhash, packing, pii, quality, simhash, token_files

RNG = random.Random(9)
WORDS = ["w%d" % i for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id string"


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(120)
    rows = [(1, base), (2, base), (3, base.replace(" ", "  ", 1)), (4, None), (5, ""), (6, "one"), (7, "..."), (8, prose(300)), (9, prose(3)), (10, prose(60)), (None, prose(20)), (12, "é" * 50)]
    near = base.split()
    near[60] = "changed"
    rows.append((13, " ".join(near)))
    moved = base.split()
    rows.append((14, " ".join(moved[60:] + moved[:60])))
    rows += [(20, "twice"), (20, "twice")]
    rows.append((21, prose(20000)))
    return spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, empty):
    got = simhash.fingerprint_documents(docs).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert len(got) == len(rows)
    texts = [r.text or "" for r in rows]
    by = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    for k, r in enumerate(rows):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        g = by[r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        a, b, c = (simhash.fingerprints([x])[0] for x in (t, edited, nxt))
        assert g.fingerprint == f"{int(a[1]):016x}{int(a[0]):016x}"
        assert g.near_edited == pytest.approx(1 - sum(bin(int(x ^ y)).count("1") for x, y in zip(a, b)) / 128)
        assert g.near_next == pytest.approx(1 - sum(bin(int(x ^ y)).count("1") for x, y in zip(a, c)) / 128)
    one = {r.doc_id: r for r in got}
    assert one[1].fingerprint == one[2].fingerprint == one[3].fingerprint and one[2].class_id == 1 and one[1].n_links >= 2
    assert simhash.fingerprint_documents(empty).count() == 0


def test_fingerprint_is_the_sign_of_weighted_votes():
    from weighbridge.llm.textbatch import U, mix, shingles, word_hashes

    texts = ["", "one", "one two three", prose(7), prose(40) + " " + prose(3) * 3, prose(700)]
    got = simhash.fingerprints(texts)
    for text, own in zip(texts, got):
        words, first = word_hashes([text])
        total = [0] * 128
        for k, weight in ((5, 2), (2, 1)):
            for term in shingles(words, first, k)[0]:
                for half, h in enumerate((int(term), int(mix(np.array([term ^ U(0xA0761D6478BD642F)]))[0]))):
                    for bit in range(64):
                        total[64 * half + bit] += weight if h >> bit & 1 else -weight
        assert [int(own[b // 64]) >> (b % 64) & 1 for b in range(128)] == [int(t > 0) for t in total]


def test_simhash_over_crowded_ids_and_fingerprints(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "the same text again" if k % 2 else prose(12)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.with_links(simhash.scratch.written(simhash.with_edits(df, rows_per_part=4), "simhash")).collect()
    assert len(got) == 60 and all(r.class_size == 30 and r.n_links == 29 for r in got if r.n_chars == len("the same text again"))
    texts = [r[1] for r in rows]
    nexts = [r.edited_sha for r in got]
    want = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).digest() for a in texts for b in texts}
    assert {bytes(x) for x in nexts} <= want


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = set(base)
    for b in base:
        for r in (1, 2, 3, 4):
            prints.add(b ^ sum(1 << k for k in rng.sample(range(128), r)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints]
    got = {frozenset(((r.hi, r.lo), (r.other_hi, r.other_lo))) for r in simhash.neighbours(spark.createDataFrame(rows, "hi long, lo long")).collect()}
    want = {frozenset((rows[i], rows[j])) for (i, a), (j, b) in itertools.combinations(enumerate(prints), 2) if bin(a ^ b).count("1") <= 3}
    assert got == want and want


def test_lattice_decoding_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)) * 2
    got = lattice.decode(x)
    assert (((2 * got) % 1) == 0).all() and (np.round(got.sum(axis=1)) % 2 == 0).all()
    short = lattice.neighbour_vectors()
    assert short.shape == (240, 8) and np.allclose((short**2).sum(axis=1), 2)
    own = ((x - got) ** 2).sum(axis=1)
    for k in range(300):
        assert (((x[k] - got[k]) - short) ** 2).sum(axis=1).min() >= own[k] - 1e-9


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    rows = [v for v in base]
    rows += [base[0] + rng.standard_normal(64) * 0.1 for _ in range(150)]  # a large group
    rows += [base[1] + rng.standard_normal(64) * 0.45 for _ in range(10)]  # near the threshold
    rows += [base[2], base[2] * 3]
    data = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rows)]
    data += [(900, None, 0), (901, [], 0), (902, [0.0] * 64, 0), (903, [float("nan")] * 64, 0), (904, [None] * 64, 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in lattice.near_vectors(df, big=20).collect()}
    x = np.array([d[1] for d in data[: len(rows)]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.97 * near.sum() <= found <= near.sum()
    assert [got[i].n_links for i in range(60, 210)] == near.sum(axis=1)[60:210].tolist()
    assert got[100].component_id == 0 and got[0].kept and not got[100].kept and got[len(rows) - 1].component_id == 2
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
    assert got[905].n_links == 1 and got[906].component_id == 905
    again = spark.createDataFrame([*data, (None, data[0][1], 0), (None, data[0][1], 0), (0, data[0][1], 0)], "vec_id long, embedding array<float>, label int")
    more = lattice.near_vectors(again, big=20).collect()
    assert len(more) == len(data) + 3 and {r.n_links for r in more if r.vec_id == 0} == {got[0].n_links + 3}
    assert lattice.near_vectors(df.where("vec_id < 0")).count() == 0


def test_recall_by_bands_of_cosine(spark):
    rng = np.random.default_rng(8)
    rows, pairs = [], {}
    for k, cosine in enumerate(np.repeat((0.905, 0.915, 0.93, 0.97), 60)):
        u, v = rng.standard_normal((2, 64))
        u /= np.linalg.norm(u)
        v -= (v @ u) * u
        v /= np.linalg.norm(v)
        rows += [(2 * k, u.tolist()), (2 * k + 1, (cosine * u + np.sqrt(1 - cosine**2) * v).tolist())]
        pairs[2 * k] = cosine
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for cosine in (0.905, 0.915, 0.93, 0.97):
        assert np.mean([got[k] >= 1 for k, c in pairs.items() if c == cosine]) >= 0.97


def test_big_balls_that_meet_are_counted_in_blocks(spark):
    rng = np.random.default_rng(4)
    u, v = np.zeros(64), np.zeros(64)
    u[0], v[0], v[1] = 1.0, 0.92, np.sqrt(1 - 0.92**2)
    rows = [c + rng.standard_normal(64) * 0.02 for c in (u, v) for _ in range(70)] + [0.96 * u + 0.25 * v]
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in lattice.near_vectors(df, big=8).collect()}
    assert [got[k].n_links for k in range(len(rows))] == near.sum(axis=1).tolist() and {r.component_id for r in got.values()} == {0}


@pytest.mark.parametrize("parts", [1, 24])
def test_components(spark, parts):
    """A path, a hub, a cycle, repeated links and links at random, in one partition and in many."""
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    links += [(2000, k) for k in range(1900, 2100)] + [(k, 3000 + (k - 2999) % 50) for k in range(3000, 3050)] + [(-5, 7000), (7000, -5), (7000, -5), (8, 8)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components.components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()
        none = components.components(spark.createDataFrame([], "a long, b long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len({r.node for r in found}) and not none
    assert {r.node: r.component for r in found} == {x: root(x) for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_few_links_need_no_rounds(spark, monkeypatch, few):
    """The same components by rounds and by one task; few links are ended without a round."""
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(500, 501), (501, 500), (9, 9)]
    rounds = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda *a: rounds.append(1) or star(*a))
    monkeypatch.setattr(components, "FEW", few)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    ids = np.array([x for x in links if x[0] != x[1]])
    low, root = components.stars(ids[:, 0], ids[:, 1])
    assert found == dict(zip(low.tolist(), root.tolist())) | {r: r for r in root.tolist()} and bool(rounds) == (few == 0)
    none = components.components(spark.createDataFrame([], "a long, b long"))
    assert none.columns == ["node", "component"] and not none.count()


def test_token_files(docs, empty):
    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = sorted(token_files.token_files(docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d))
    texts = {(r.doc_id): r.text or "" for r in docs.collect()}
    at = 0
    for r in got:
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_files(empty, path).count() == 0


def test_added_tokens_are_those_of_the_library(spark):
    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["a plain text", "one <|endoftext|> two", "<|endoftext|><|endoftext|>", None, "<|endoftext| >", " it's<|endoftext|>'s  \n", "", "plain again"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 50256 in want[1] and 50256 not in want[4]
    at = 0
    for r, ids in zip(sorted(token_files.token_files(df, path).collect(), key=lambda r: r.doc_id), want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        at += len(ids) + 1
    assert {r.doc_id: r.n_tokens for r in packing.pack_documents(df, path).collect()} == {k: len(ids) + 1 for k, ids in enumerate(want)}


def test_bpe_documents(spark, docs, empty):
    tokens = bpe.read_ranks(spark, P.path("byte_bpe_50k.tiktoken"))
    full = bpe.encode_documents(docs, tokens).collect()
    texts = sorted((r.text or "").encode() for r in docs.collect())
    assert sorted(bytes(r.decoded) for r in full) == texts
    got = {r.doc_id: r for r in bpe.digest_documents(docs, tokens).collect()}
    assert got[4].n_tokens == 0 and got[4].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digest_documents(empty, tokens).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    rng = random.Random(0)
    for _ in range(500):
        a = [rng.randint(0, 60) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.05] or [1]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 60))
        m = longest(a, b)
        value = m / (len(a) + len(b) - m)
        assert order_minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64)) == (value if value >= 0.8 else 0.0)


def test_near_documents(spark, docs, empty):
    got = {r.doc_id: r for r in order_minhash.near_documents(docs).collect()}
    assert {i for i in got if got[i].group_id == 1} == {1, 2, 3, 13}
    assert got[14].kept and got[14].group_id == 14  # the same runs in another order
    assert got[4].group_id == got[5].group_id == 4 and got[7].kept
    kept = order_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == sorted((i is not None, i) for i in got if got[i].kept)
    assert order_minhash.near_documents(empty).count() == 0 and order_minhash.one_of_each(empty).count() == 0


def test_near_documents_without_or_with_repeated_ids(spark):
    rng = random.Random(12)
    a, b, c, d, e, f = (prose(60, rng) for _ in range(6))
    near = a.split()
    near[5] = "changed"
    rows = [(None, a), (None, b), (None, c), (None, c), (5, a), (6, b), (7, d), (7, e), (7, e), (8, d), (None, f), (None, None), (9, " ".join(near))]
    df = spark.createDataFrame([(i, t, "x%d" % k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, tag string")
    got = order_minhash.near_documents(df).collect()
    assert len(got) == len(set(rows)) and sum(r.kept for r in got) == 7
    assert {r.doc_id: (r.class_id, r.group_id, r.kept) for r in got if r.doc_id in (5, 6, 8, 9)} == {5: (5, 5, True), 6: (6, 6, True), 8: (7, 7, False), 9: (9, 5, False)}
    kept = order_minhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in [(5, a), (6, b), (None, c), (7, d), (7, e), (None, f), (None, None)])


def test_near_documents_against_all_pairs(spark):
    rng = random.Random(5)
    texts = [prose(rng.randint(20, 200), rng) for _ in range(60)]
    for t in texts[:40]:
        for _ in range(rng.randint(0, 4)):
            w = t.split()
            for _ in range(max(1, int(len(w) * rng.choice((0.005, 0.02, 0.04))))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in order_minhash.near_documents(df).collect()}
    words, at = order_minhash.word_hashes(texts)
    seqs = [words[a:b] for a, b in zip(at[:-1], at[1:])]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if order_minhash.aligned(seqs[i], seqs[j]):
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    assert got == dict(enumerate(group))
    assert {r.doc_id: r.group_id for r in order_minhash.near_documents(df, crowd=1).collect()} == got  # all buckets split


def test_first_occurrences_are_plain_kmers():
    seq = np.array([5, 9, 5, 7], np.uint64)
    own = order_minhash.labelled(seq)
    assert own[[0, 1, 3]].tolist() == [5, 9, 7] and own[2] not in (5, 7, 9)


def test_recall_of_planted_near_copies(spark):
    """One word in 12 to 200 changed, put in or left out: most have fewer than 0.8 of their runs of five in common."""
    rng = random.Random(11)
    texts, pairs = [], []
    for k in range(150):
        w = prose(rng.randint(60, 400), rng).split()
        texts.append(" ".join(w))
        v, step = list(w), rng.choice((12, 25, 50, 200))
        for i in range(rng.randrange(step), len(w), step):
            v[i] = rng.choice(("", "added " + v[i], "changed"))
        pairs.append((len(texts) - 1, len(texts)))
        texts.append(" ".join(v))
        texts.append(prose(30, rng) + " " + " ".join(w[: len(w) // 3]) + " " + prose(len(w) // 2, rng))  # a shared passage
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in order_minhash.near_documents(df).collect()}
    assert np.mean([got[a] == got[b] for a, b in pairs]) >= 0.97
    assert all(got[b + 1] == b + 1 for _, b in pairs)


def test_one_of_each_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 2, "x"), (1, "a b c", 1, 2, "x"), (2, "a b c", 3, 4, "y"), (None, "d", 5, 6, "z")], "doc_id long, text string, out_id int, again_id int, class_id string")
    kept = order_minhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.out_id for r in kept.collect()) == [1, 5]


def test_language(spark, docs, empty):
    rng = random.Random(6)
    tongues = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(i, " ".join("".join(rng.choice(tongues[k]) for _ in range(5)) for _ in range(20)), k) for i in range(240) for k in [rng.choice(list(tongues))]]
    df = spark.createDataFrame([*rows, (998, None, "aa"), (999, "123 !", "bb"), (1000, "zz", None)], "doc_id long, text string, lang string")
    model = langid.train(df, 40)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _, _ in held) and sum(got[i].lang_pred == k for i, _, k in held) >= 0.95 * len(held)
    assert got[998].lang_pred == got[999].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.accepted(df, model).where("doc_id in (998, 999)").count() == 0
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()} == {"en", "und"}
    # the decoding, by plain loops over a text's trigrams
    for i, text, _ in rows[:20]:
        slots, _ = langid.trigrams([text])
        loss = []
        for word in model.code:
            signs = [sum(float(model.weights[s, b]) for s in slots) / len(slots) + model.bias[b] for b in range(len(word))]
            loss.append(sum(np.log1p(np.exp(-c * s)) for c, s in zip(word, signs)))
        share = np.exp(min(loss) - np.array(loss)) / np.exp(min(loss) - np.array(loss)).sum()
        assert got[i].lang_pred == model.languages[int(np.argmin(loss))] and got[i].score == pytest.approx(share.max(), abs=1e-4)


def test_all_languages_of_a_table_are_learnt(spark):
    rng = random.Random(16)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tongues = {f"l{k:02d}": rng.sample(letters, 5) for k in range(40)}
    rows = [(i, " ".join("".join(rng.choice(tongues[k]) for _ in range(4)) for _ in range(40)), k) for i, k in enumerate(sorted(tongues) * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, 5)
    assert model.languages == sorted(tongues)
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in langid.identify(df, model).collect()]) > 0.8


@pytest.mark.parametrize("n", [2, 3, 4, 7, 9, 30])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n and set(np.unique(code)) == {-1.0, 1.0}


def test_quality(spark, docs, empty):
    rng = random.Random(7)
    good = [prose(rng.randint(20, 80), rng).capitalize() + "." for _ in range(400)]
    bad = ["### ".join(prose(30, rng).upper().split()) + "$$$" for _ in range(120)]
    rows = list(enumerate(good + bad))
    df = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows if i % 2], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels, 200, 300, 200)
    got = {r.doc_id: r for r in quality.score_documents(df, model).collect()}
    held = [i for i, _ in rows if got[i].held_out]
    assert sum(got[i].predicted == int(i < 400) for i in held) >= 0.95 * len(held)
    assert 0.5 < model.prior < 0.95 and all(0 <= r.score <= 1 for r in got.values())
    # the score, by plain loops
    w0, b0, w1, b1 = model.net.weights
    for i, text in rows[:5] + rows[-5:]:
        z = model.net.scaled(quality.features([text]))[0]
        h = [np.tanh(sum(z[k] * w0[k, j] for k in range(len(z))) + b0[j]) for j in range(len(b0))]
        out = model.slope * (sum(a * float(b) for a, b in zip(h, w1[:, 0])) + float(b1[0])) + model.offset
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-out)), abs=1e-6)
    twice = labels.unionByName(labels.withColumn("quality", 1 - labels.quality).limit(0)).unionByName(labels)
    assert quality.score_documents(df, quality.train(df, twice, 200, 300, 200)).count() == len(rows) + 2
    none = quality.train(empty, labels)
    assert quality.score_documents(empty, none).count() == 0 and quality.score_documents(docs, none).count() == docs.count()


def test_private_data(spark, docs, empty):
    texts = [
        "write to a.b@x.example.com, or call +1 (017) 555-7713 now", "two cards 4485275742308327 4716258050958645 here", "host 10.0.300.1 and 10.0.0.1", None, "",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "a@b@c.d", "1" * 40, "mail jane_7 [at] host [dot] org today", "not one at the dot here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = spark.createDataFrame([(1000 + k, prose(40)) for k in range(900)], "doc_id long, text string")
    model = pii.train(df.unionByName(more))
    got = {r.doc_id: r for r in pii.find(df, model).collect()}
    assert (got[0].n_email, got[0].n_phone, got[2].n_ip, got[1].n_card) == (1, 1, 1, 0)
    assert got[1].spans == "card:10:26,card:27:43"
    assert got[5].spans == "secret:9:49" and got[3].spans == "" and got[8].spans.startswith("email:") and got[9].spans == ""
    clean = {r.doc_id: r.text for r in pii.redacted(df, model).collect()}
    assert clean[0] == "write to <EMAIL>, or call <PHONE> now" and clean[3] is None and clean[1] == "two cards <CARD> <CARD> here"
    for kind, (n, precision, recall) in model.measured.items():
        assert n > 20 and precision >= 0.98, kind
    assert pii.find(empty, pii.train(empty)).count() == 0
    wide = docs.withColumn("spans", docs.text).withColumn("n_ip", docs.doc_id)  # null ids, repeated rows, clashing names, a long text
    assert sorted(map(str, (r.doc_id for r in pii.find(wide, model).collect()))) == sorted(map(str, (r.doc_id for r in docs.collect())))
    assert pii.redacted(wide, model).columns == wide.columns and pii.redacted(wide, model).count() == docs.count()


def test_base_spans_are_those_of_the_plain_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(3)
    for k in range(5000):
        t = "".join(rng.choice("ab.@-+0123456789 ()" if k % 2 else "a.@1 ") for _ in range(rng.randint(0, 60)))
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        digits = lambda m: "".join(c for c in m.group() if c.isdigit())
        want += [("card", *m.span()) for m in pii._CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [("phone", *m.span()) for m in pii._PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == want


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@.", "a@" * 100_000, "+1 " * 100_000, "'a" * 100_000, "1 " * 50_000])
def test_spans_of_long_texts_take_linear_time(text):
    begin = time.monotonic()
    model = pii.Model(pii.Trees(), dict.fromkeys(pii.KINDS, 0.5))
    model.spans(text)
    assert time.monotonic() - begin < 20


def test_bucket_bounds_are_best():
    rng = random.Random(8)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        for buckets in (1, 2, 3):
            def cost(bounds):
                return sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts))

            best = min(cost((*rest, lengths[-1])) for k in range(buckets) for rest in itertools.combinations(lengths[:-1], min(k, len(lengths) - 1)))
            got = packing.bucket_bounds(np.array(lengths), np.array(counts), buckets)
            assert len(got) <= buckets and cost(got) == best


def test_packing(docs, empty):
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), longest=256, buckets=4, budget=1024, shard_rows=5).collect()
    own = {}
    for r in got:
        own[r.doc_id] = own.get(r.doc_id, 0) + r.n_tokens
    assert own[4] == own[5] == 1 and own[21] > 20000 and all(r.n_tokens <= r.padded <= 256 for r in got)
    batches = {}
    for r in got:
        batches.setdefault((r.bucket, r.shard, r.batch), []).append(r)
    for rows in batches.values():
        assert sum(r.padded for r in rows) <= 1024 and len({r.padded for r in rows}) == 1 and len({r.slot for r in rows}) == len(rows)
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0
    lost = spark_rows(docs, 40)
    assert len({r.shard for r in packing.pack_documents(lost, P.path("byte_bpe_50k.json"), buckets=1, shard_rows=5).collect()}) > 3


def spark_rows(docs, n):
    return docs.sparkSession.createDataFrame([(None, prose(8)) for _ in range(n)], "doc_id long, text string")


def test_licences(spark, docs, empty):
    mit = dict(licenses.KNOWN)["MIT"]
    texts = [mit, "MIT\n" + mit, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ,"), mit[:-10], None, "", "Released under the M.I.T. License", "RELEASED under the MIT licence!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(df, licenses.known_licences(spark)).collect()}
    assert got == {0: "MIT", 1: None, 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "MIT-line"}
    assert licenses.scan(empty, licenses.known_licences(spark)).count() == 0
    wide = docs.withColumn("digest", docs.text).withColumn("license_id", docs.lang)  # null ids, repeated rows, clashing names, a long text
    assert [r.license_id for r in licenses.scan(wide, licenses.known_licences(spark)).collect()] == [None] * docs.count()


def test_licences_with_title_wrapped_and_with_a_notice(spark):
    known = licenses.known_texts()
    assert {"MIT", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {i for i, _ in known}
    rows = []
    for i, text in known:
        wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), 61) for p in re.split(r"\n[ \t]*\n", text))
        rows += [(i, text), (i, "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + text), (i, wrapped)]
    mit = dict(licenses.KNOWN)["MIT"]
    rows += [("MIT", "The MIT License (MIT)\n\nCopyright Jane Doe\n\n" + mit.replace("copyright notice", "\ncopyright notice").replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS"))]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(df, licenses.known_licences(spark)).collect()}
    assert {k: (i, got[k]) for k, (i, _) in enumerate(rows) if got[k] != i} == {}


def test_bounded_sample(spark):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    a, b = learning.bounded_sample(ids, 50, 1), learning.bounded_sample(ids, 50, 1)
    assert a == b and len(set(a)) == 50 and learning.bounded_sample(ids.limit(0), 5, 1) == []
    assert len(learning.bounded_sample(ids, 5000, 1)) == 1000


def test_order_minhash_compares_a_pair_once_in_crowded_buckets(spark, monkeypatch):
    """Texts around one passage share many sketches; neither their rows nor their pairs grow with the pairs of sketches."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{v}" for v in rng.integers(0, 10**6, n)]
    passage = word(90)
    texts = [" ".join(word(7) + passage + word(7)) for _ in range(24)]
    texts.append(texts[0] + " end")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, old = {}, order_minhash.scratch.written
    monkeypatch.setattr(order_minhash.scratch, "written", lambda df, name, *a: seen.setdefault(name, []).append(out := old(df, name, *a)) or out)
    dropped = order_minhash.scratch.drop
    monkeypatch.setattr(order_minhash.scratch, "drop", lambda *frames: None)
    for crowd in (10, 3):  # compared whole, and split
        seen.clear()
        got = {r.doc_id: r.group_id for r in order_minhash.near_documents(df, crowd=crowd).collect()}
        assert got == {k: 0 if k == 24 else k for k in range(25)}
        pairs = seen["alike"][-1]
        assert pairs.count() == pairs.distinct().count() > 100
        if crowd == 10:
            assert 0 < seen["open-signed"][-1].count() <= 25 * order_minhash.SKETCHES
        dropped(*[t for tables in seen.values() for t in tables])
