"""Batch text work against plain loops: pre-tokens, words, BPE, token codes."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from weighbridge.llm import bpe, textbatch, token_files

RNG = random.Random(4)
ODD = ["", " ", "\n", "  a", "it's 's 'S don't I'll''ve", "a  b\n\n c ", "日本語 123４５ ١٢", "é'll'd'dx", "'", "x'", "<|endoftext|> \U0001d4b3", "a b c", "\x1c\x1d \x85"]
ODD += ["".join(RNG.choice(" '\n\tabsltrevmd!.1é日") for _ in range(RNG.randint(0, 40))) for _ in range(500)]


def test_pretokens_are_the_patterns_matches():
    pattern = regex.compile(P.PATTERN)
    joined, starts, lengths, _, first = textbatch.pretokens(ODD)
    for k, text in enumerate(ODD):
        assert [joined[a : a + n] for a, n in zip(starts[first[k] : first[k + 1]], lengths[first[k] : first[k + 1]])] == pattern.findall(text)


def test_equal_words_have_equal_hashes_anywhere():
    texts = ["One two one", "", "two, ONE; straße_1", "!!!"]
    words, first = textbatch.word_hashes(texts)
    assert np.diff(first).tolist() == [3, 0, 3, 0]
    assert words[0] == words[2] == words[4] and words[1] == words[3] and len(set(words.tolist())) == 3


def test_shingles_of_short_texts():
    words, first = textbatch.word_hashes(["a b c d e f", "a b", "", "a b c d e"])
    made, at = textbatch.shingles(words, first, 5)
    assert np.diff(at).tolist() == [2, 1, 0, 1] and made[0] == made[3] and made[2] not in (made[0], made[1])


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(None, P.path("byte_bpe_50k.tiktoken"))


def test_bpe_is_the_librarys(tokens):
    own = bpe.Coder(tokens)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    ids, at = own.encode(ODD)
    for k, text in enumerate(ODD):
        mine = ids[at[k] : at[k + 1]]
        assert mine.tolist() == other.encode_ordinary(text)
        assert own.decode(mine) == text.encode()


def test_first_tier_is_minimal_and_perfect(tokens):
    own = bpe.Coder(tokens).first_tier
    assert len(own.keys) == own.n == len(set(own.keys.tolist()))
    assert (own(own.keys) == own.values).all()
    assert (own(own.keys[:1000] + np.uint64(1)) == -1).all()


def test_merge_of_ties_and_single_bytes():
    rank = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaaa": 257, b"ab": 258}
    assert bpe.merge(b"aaaaa", rank) == [257, 97] and bpe.merge(b"b", rank) == [98] and bpe.merge(b"aab", rank) == [256, 98]


def test_codes_round_trip():
    for n in (0, 1, 3, 4, 5, 1000):
        values = np.array([RNG.choice((0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1)) for _ in range(n)], np.uint32)
        control, data = token_files.pack(values)
        assert len(control) == -(-n // 4)
        assert (token_files.unpack(control, data, n) == values).all()
    assert token_files.pack(np.arange(256))[1] == bytes(range(256))


def test_library_cache_gives_the_librarys_ids():
    cache = token_files.library_cache(P.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids, at = cache(ODD)
    for k, text in enumerate(ODD):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_pieces_of_one_hash_keep_their_own_ids(tokens, monkeypatch):
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    a, b = thue_morse(2048)
    assert len(set(textbatch.word_hashes([a, b])[0].tolist())) == 2
    real = textbatch.piece_hashes
    own, cache = bpe.Coder(tokens), token_files.library_cache(P.path("byte_bpe_50k.json"))
    the = own.first_tier.keys[own.first_tier.values == tokens.index(b" the")]
    assert own._encode_pieces([" the", " of", " ofof"], np.repeat(the, 3))[0].tolist() == [tokens.index(b" the"), tokens.index(b" of"), *other.encode_ordinary(" ofof")]
    monkeypatch.setattr(textbatch, "piece_hashes", lambda v, s, n: real(v, s, n) & np.uint64(31))  # nearly all pieces share a hash
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    cache.clear()
    for texts in (["one"], [a, b, *ODD[:80]], ["a b c", *ODD[80:120]], [b], [a]):
        for got, want in ((own.encode(texts), other.encode_ordinary), (cache(texts), lambda t: plain.encode(t, add_special_tokens=False).ids)):
            ids, at = got
            assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == [want(t) for t in texts]
    cache.clear()
