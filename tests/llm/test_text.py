"""Word hashing and token ids against plain Python and the whole tokeniser."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rasterlake.llm import binary, text, tokens

ODD = [None, "", " ", "  a\tB  ", "x", "a  b", " y ", "z\n q", "\n \n", "a\u3000 b", "\u200b c", "x<|endoftext|> y", "it's a 'tis 12 34!!", "a \x1c b", "\u00e9 \u00c9a", "\U0001f600 x  \U0001f44d\U0001f3fd", "a\xa0 b \xa0c", "日本 語", "it\x85 \x85 x", "w" * 700 + " b", "A b a B " * 90]


@pytest.fixture(params=[1 << 18, 64])
def block(request, monkeypatch):
    monkeypatch.setattr(text, "BLOCK", request.param)
    return request.param


def plain(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_words(block):
    h, first = text.words(pa.array(ODD, pa.string()))
    seen = {}
    for t, a, z in zip(ODD, first[:-1], first[1:]):
        w = plain(t)
        assert len(w) == z - a
        for x, y in zip(w, h[a:z].tolist()):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_shingles():
    sets = text.shingles(pa.array(ODD, pa.string()))
    for t, s in zip(ODD, sets):
        w = plain(t)
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(s) == len(want)
    assert text.shingles(pa.array(["A b c"]))[0].tolist() == text.shingles(pa.array([" a B\nC "]))[0].tolist()


def thue_morse(n, a="a", b="b"):
    """A word on which polynomial hashes modulo powers of two collide with its mirror image."""
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


CRAFTED = [thue_morse(n, *p) for n in (64, 1024, 4096) for p in ("ab", "ba")]
SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z", " <|endoftext|>", "<|endoftext|> ", "<|endoftext|", "é <|endoftext|>é", "a\n<|endoftext|>\n b", "<<|endoftext|>>  c"]


def test_workers_let_go_of_the_tokenizer_when_they_turn_to_words():
    e = tokens.encoder(binary.tokenizer_path())
    ids, _ = e.encode(pa.array(ODD, pa.string()))
    assert tokens.encoder(binary.tokenizer_path()) is e
    text.words(pa.array(ODD, pa.string()))
    assert not text.KEPT
    again = tokens.encoder(binary.tokenizer_path())
    assert again is not e and again.encode(pa.array(ODD, pa.string()))[0].tolist() == ids.tolist()


def test_ids_are_those_of_whole_texts(block):
    e, fresh = tokens.Encoder(binary.tokenizer_path()), Tokenizer.from_file(binary.tokenizer_path())
    r = random.Random(5)
    some_unicode = ["".join(chr(r.choice([r.randrange(32, 127), 32, r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(60)]
    for some in (ODD, ODD[::-1] * 2, SPECIAL, CRAFTED, [" ".join(CRAFTED), *CRAFTED[::-1]], some_unicode):
        ids, first = e.encode(pa.array(some, pa.string()))
        for t, a, z in zip(some, first[:-1], first[1:]):
            assert ids[a:z].tolist() == fresh.encode(t or "", add_special_tokens=False).ids, t


def test_words_with_patterns_do_not_collide(block):
    h, _ = text.words(pa.array(CRAFTED))
    assert len(set(h.tolist())) == len(CRAFTED)
    a, b = text.shingles(pa.array([f"one {CRAFTED[4]} two three four", f"one {CRAFTED[5]} two three four"]))
    assert not set(a.tolist()) & set(b.tolist())


def test_secret_digests():
    data = np.random.default_rng(4).integers(0, 256, 3000).astype(np.uint8)
    starts = np.cumsum(np.arange(65))
    ends = starts + np.arange(65)
    keys = np.random.default_rng(5).integers(0, 2**63, (2, 17)).astype(np.uint64)
    want = []
    for a, z in zip(starts.tolist(), ends.tolist()):
        own = data[a:z].tobytes().ljust(8 * max(1, -(-(z - a) // 8)), b"\0")
        w = [int.from_bytes(own[i : i + 4], "little") for i in range(0, len(own), 4)]
        x, y = (((z - a) * int(k[0]) + sum(v * int(q) for v, q in zip(w, k[1:]))) % 2**64 for k in keys)
        want.append(x >> 32 << 32 | y >> 32)
    assert text.secret_digests(data, starts, ends, keys).tolist() == want


def test_digests_are_siphash_1_3():
    """Against a plain implementation, at all lengths."""

    def sip(data, k0, k1):
        m64 = (1 << 64) - 1
        turn = lambda x, n: (x << n | x >> 64 - n) & m64
        v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

        def mix():
            a, b, c, d = v
            a = (a + b) & m64
            b = turn(b, 13) ^ a
            a = turn(a, 32)
            c = (c + d) & m64
            d = turn(d, 16) ^ c
            a = (a + d) & m64
            d = turn(d, 21) ^ a
            c = (c + b) & m64
            b = turn(b, 17) ^ c
            v[:] = a, b, turn(c, 32), d

        tail = data + b"\0" * (7 - len(data) % 8) + bytes([len(data) & 255])
        for i in range(0, len(tail), 8):
            m = int.from_bytes(tail[i : i + 8], "little")
            v[3] ^= m
            mix()
            v[0] ^= m
        v[2] ^= 255
        for _ in range(3):
            mix()
        return v[0] ^ v[1] ^ v[2] ^ v[3]

    data = np.random.default_rng(3).integers(0, 256, 4000).astype(np.uint8)
    starts = np.cumsum(np.arange(72))
    ends = starts + np.arange(72)
    key = (123, 2**63 + 5)
    assert text.digests(data, starts, ends, key).tolist() == [sip(data[a:z].tobytes(), *key) for a, z in zip(starts, ends)]


def test_memory_is_refilled(monkeypatch):
    e = tokens.Encoder(binary.tokenizer_path())
    monkeypatch.setattr(tokens, "KEPT_PARTS", 3)
    for i in range(4):
        e.filled = tokens.SLOTS if i == 2 else e.filled
        t = [f"word{i} and more, and more{i}."]
        assert e.encode(pa.array(t))[0].tolist() == e.tokenizer.encode(t[0], add_special_tokens=False).ids


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    nulls = np.zeros(len(keys), np.uint8)
    offsets = np.arange(len(keys) + 1)
    payload = np.arange(len(keys), dtype="<u4").tobytes()
    row = binary.make_shard(keys, nulls, payload, offsets)
    index = binary.Index(row)
    assert len(index.slot_doc) == len(keys)  # minimal
    h = binary.key_hash(keys, nulls, np.zeros(len(keys)))
    assert index.find(h).tolist() == list(range(len(keys)))
    other = np.setdiff1d(np.arange(20000), keys)
    assert (index.find(binary.key_hash(other, np.zeros(len(other)), np.zeros(len(other)))) >= 0).sum() <= 2  # fingerprints
    assert bytes(index.ids(7)) == payload[28:32]


def test_pieces():
    for n in (1, 5, 1023, 1024, 1025, 3000):
        p = binary.pieces_of(n)
        assert [s for s, _ in p] == np.append(0, np.cumsum([m for _, m in p]))[:-1].tolist()
        assert sum(m for _, m in p) == n
        assert all(m & (m - 1) == 0 and m <= 1024 for _, m in p)
