"""Periodic runs, token counts and lexical search: whole results against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterlake.llm import binary, lexical, periodic, token_counts
from tests.llm.test_operators import DOCS, make, prose
from tests.llm.test_text import CRAFTED, ODD, SPECIAL

# Periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(12, 2 * q) and not any(w[s : e - p] == w[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 7), st.integers(1, 20), st.integers(1, 3)), max_size=6), min_size=1, max_size=4), st.integers(0, 2**32))
def test_runs_of_several_texts(shape, seed):
    r = random.Random(seed)
    texts = []
    for parts in shape:
        w = []
        for length, times, kinds in parts:
            block = [b"%d" % r.randrange(kinds) for _ in range(length)]
            w += (block * times)[: r.randrange(1, length * times + 1)]
        texts.append(w)
    for w, (s, n, q) in zip(texts, periodic.runs_of(texts)):
        assert list(zip(s.tolist(), n.tolist(), q.tolist())) == brute_runs(w)


def test_runs_in_parts_and_many_symbols(monkeypatch):
    r = random.Random(4)
    texts = [[b"%d" % r.randrange(40) for _ in range(200)] + [b"x", b"y", b"z"] * 30 for _ in range(6)]
    want = [brute_runs(w) for w in texts]
    for together in (1, 700, 1 << 19):
        monkeypatch.setattr(periodic, "_TOGETHER", together)
        assert [list(zip(*(x.tolist() for x in got))) for got in periodic.runs_of(texts)] == want
    assert np.array_equal(periodic._order(np.array([2, 0, 2, 0]), np.array([1, 3, 0, 2]), 1 << 40), [3, 1, 2, 0])


def test_a_leaf_is_tested_logarithmically_often():
    sym = np.append(np.zeros(1 << 12, np.int64), 1)
    levels, base = periodic.ranks(sym)
    assert sum(len(leaf) for leaf, _ in periodic.Tree(levels, base).visits()) <= 12 * len(sym)


def want_runs(doc_id, t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    digest = hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
    return (doc_id, len(runs), *best, milli, digest, hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = [(None, None, "s"), (None, "a b " * 20, "s"), (1, "", "s"), (2, " \n", "s"), (3, "A a " * 9 + "a", "s"), (3, "A a " * 9 + "a", "s"), (4, "one", None), (5, prose(90, 5) + " " + "x y z " * 5 + "é " * 14, "s")]
    out += [(i, prose(r.randrange(1, 120), i), "s") for i in range(10, 130)]  # one in ten is rewritten
    out += [(200 + i, t, "s") for i, t in enumerate([*ODD, *CRAFTED[:2], *SPECIAL])]
    return out


def test_runs_of_the_table(spark, rows, monkeypatch):
    monkeypatch.setattr(periodic.common, "table", lambda *_: make(spark, rows).repartition(3))
    got = periodic.op11_periodic_runs(spark, "")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [want_runs(i, t) for i, t, _ in rows]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert sum(w[1] > 0 for w in want) > 10
    monkeypatch.setattr(periodic.common, "table", lambda *_: spark.createDataFrame([], DOCS))
    assert periodic.op11_periodic_runs(spark, "").collect() == []


def test_collapsed_texts_keep_one_period(spark):
    docs = make(spark, [(7, "start " + "again and " * 8 + "end", "s"), (8, "no run here", "s")])
    got = {r["doc_id"]: r for r in periodic.collapse(docs).collect()}
    assert got[7]["collapsed"] == "start again and end" and [tuple(r) for r in got[7]["runs"]] == [(1, 16, 2)]
    assert got[8]["collapsed"] == "no run here" and got[8]["runs"] == []


# Token counts


@pytest.fixture(scope="module")
def whole():
    return token_counts.whole_tokens(binary.tokenizer_path())


def test_counts_are_those_of_the_library(whole, monkeypatch):
    fresh = Tokenizer.from_file(binary.tokenizer_path())
    count = token_counts.Counter(binary.tokenizer_path(), whole)
    r = random.Random(6)
    marks = ["a", " ", "  ", "\n", "é", "½", "'s", "'S", "\xa0", "\xad", "\x85", "<|endoftext|>", "12", "!!", "\t", "\x1c", "日", "́", " ", "ǅ", "\U0001f600"]
    texts = [*ODD, *CRAFTED, *SPECIAL, "x" * 5000, *("".join(r.choice(marks) for _ in range(30)) for _ in range(2000))]
    texts += ["".join(chr(r.choice([r.randrange(160), 32, r.randrange(160, 0xD000), r.randrange(0xE000, 0x1FFFF)])) for _ in range(50)) for _ in range(300)]
    for size in (1 << 20, 20):
        monkeypatch.setattr(token_counts, "_CHARS", size)
        for t in texts:
            assert count(t) == len(fresh.encode(t or "", add_special_tokens=False).ids), t


def test_whole_tokens_are_not_merged(whole):
    count = token_counts.Counter(binary.tokenizer_path(), whole)
    assert count(" the cat and 12 dogs, the end") == 8 and count.merged == 0
    assert count(" qzxvwk") > 1 and count.merged == 1
    assert count(" qzxvwk qzxvwk") > 2 and count.merged == 1


def test_an_added_token_that_takes_space_is_left_to_the_library(tmp_path, whole):
    t = Tokenizer.from_file(binary.tokenizer_path())
    from tokenizers import AddedToken

    t.add_special_tokens([AddedToken("<x>", lstrip=True), AddedToken("<|endoftext|>y")])
    path = str(tmp_path / "more.json")
    t.save(path)
    count = token_counts.Counter(path, token_counts.whole_tokens(path))
    for s in ("a  <x> b", "<|endoftext|>y", "<x", "a b"):
        assert count(s) == len(t.encode(s, add_special_tokens=False).ids)


def test_counts_of_the_table(spark, rows, monkeypatch):
    rows = [*rows, (900, prose(700, 1), "s"), (901, "a " * 1023 + "a", "s"), (902, "a " * 1024 + "a", "s")]
    monkeypatch.setattr(token_counts.common, "table", lambda *_: make(spark, rows))
    fresh = Tokenizer.from_file(binary.tokenizer_path())
    want = []
    for i, t, _ in rows:
        n = len(fresh.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert Counter(map(tuple, token_counts.op12_token_counts(spark, "").collect())) == Counter(want)
    assert {w[3] for w in want} == {True, False}
    assert token_counts.counted(spark.createDataFrame([], DOCS), binary.tokenizer_path()).collect() == []


# Lexical search

ITEMS = "item_id long, text string, score int, rank int"


def brute_search(docs, items, k=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own = [(i, words(t)) for i, t, _ in docs]
    own = [(i, Counter(w), len(w)) for i, w in own if w]
    total, size = len(own), sum(n for *_, n in own)
    df = Counter(t for _, tf, _ in own for t in tf)
    out = []
    for item, t in items:
        found = []
        for i, tf, n in own:
            m = 100 - 75 + (75 * n * total) // size
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in words(t) if w in tf)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(12)
    docs = [(None, None, "s"), (1, "", "s"), (2, " -- !", "s"), (None, prose(20, 7), "s"), (3, "Été été ÉTÉ x1 X1", "s"), (4, "the " * 3000 + prose(5, 1), "s")]
    docs += [(r.randrange(10, 200), " ".join(["the"] * r.randrange(4) + [prose(r.randrange(1, 60), r.randrange(150))]), "s") for _ in range(400)]
    items = [(i, prose(r.randrange(1, 25), 500 + i) + " the the") for i in range(30)]
    items += [(5, items[5][1]), (None, prose(4, 9)), (77, None), (78, ""), (79, "?!"), (80, "not there at all zzzz"), (81, "été X1"), (82, "the"), (83, prose(1, 3))]
    return docs, items


def answers(spark, docs, items, **more):
    table = spark.createDataFrame([(*x, 1, 2) for x in items], ITEMS)
    return Counter(map(tuple, lexical.search(make(spark, docs).repartition(5), table, **more).collect()))


def test_search_by_brute_force(spark, corpus):
    docs, items = corpus
    assert answers(spark, docs, items) == brute_search(docs, items)
    assert answers(spark, docs, items, k=3) == brute_search(docs, items, 3)


def test_search_in_parts(spark, corpus):
    docs, items = corpus
    assert answers(spark, docs, items, limit=600) == brute_search(docs, items)


def test_search_of_empty_tables(spark, corpus):
    docs, items = corpus
    assert answers(spark, [], items) == answers(spark, docs, []) == answers(spark, docs[:3], items) == Counter()
    assert lexical.search(spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)).columns == ["item_id", "rank", "doc_id", "score"]


def scored(docs, items, k, cells=1 << 22):
    """A search in this process: the state at its end."""
    import pyarrow as pa

    q = lexical.Items([i for i, _ in items], [t for _, t in items])
    h, first = lexical.terms(pa.array([t for _, t, _ in docs], pa.string()))
    size = np.diff(first)
    place = np.minimum(np.searchsorted(q.terms, h), len(q.terms) - 1)
    at = np.flatnonzero(q.terms[place] == h)
    of = np.searchsorted(first, at, "right") - 1
    key, tf = np.unique(of * len(q.terms) + place[at], return_counts=True)
    of, term = key // len(q.terms), key % len(q.terms)
    total = (int((size > 0).sum()), int(size.sum()))
    x = lexical.impact(tf, size[of], total)
    df = np.bincount(term, minlength=len(q.terms))
    weight = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * d + 1))) for d in df.tolist()])
    by_term = [np.sort(x[term == t])[::-1] for t in range(len(q.terms))]
    kth, most = (np.array([v[j] if len(v) > j else 0 for v in by_term]) for j in (k - 1, 0))
    q.prune(weight, weight * kth, weight * most)
    top = lexical.Best(q, k)
    ids = np.array([i or 0 for i, *_ in docs])
    lexical._CELLS, kept = cells, lexical._CELLS
    try:
        top.see(ids, np.array([i is None for i, *_ in docs]), of, term, x)
    finally:
        lexical._CELLS = kept
    return q, top


def test_thresholds_prune_terms_and_documents(corpus):
    docs, items = corpus
    q, top = scored(docs, items, 3)
    want = brute_search(docs, items, 3)
    got = Counter((q.ids[i], None if null else d, s) for i, d, null, s in zip(top.item, top.doc.tolist(), top.null, top.score.tolist()))
    assert got == Counter((i, d, s) for i, _, d, s in want.elements())
    assert len(q.off_term) > 0 and top.scored < len(docs) * len(items) / 3
    kth = np.array([top.score[top.item == i].min() if (top.item == i).sum() == 3 else 0 for i in range(len(q.ids))])
    assert (q.threshold <= kth)[[(top.item == i).sum() == 3 for i in range(len(q.ids))]].all()
    _, small = scored(docs, items, 3, cells=40)
    assert sorted(zip(small.item, small.score)) == sorted(zip(top.item, top.score))
