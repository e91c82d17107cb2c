"""Operators on small tables: against brute force, and on nulls, empties, repeats, ties and clashing columns."""

import functools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterlake.llm import binary, common, decontaminate, jaccard, licenses, lines, passages, quality, text, topk, url_filter
from tests.llm.test_text import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"score": 1, "h": 2, "token": 3, "node": 4, "label": 5, "a": 6, "tk": 7, "gone": 8, "hits": 9, "rule": 10, "q": 11, "low": 12, "sites": 13, "b": 14}
rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def make(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, ties, a long text."""
    long = prose(30000, 1)
    rows = [(1, None, "s1"), (2, "", "s2"), (3, "  \n\t ", None), (4, "one", "s1"), (4, "one", "s1"), (5, "one", "s2"), (None, "null id has text here too", "s3"), (None, None, None), (6, prose(60, 2), "s1"), (7, prose(60, 2), "s2"), (7, prose(60, 3), "s2"), (8, long, "s1"), (9, long, "s4")]
    return make(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, []).where("false") if False else spark.createDataFrame([], DOCS)


def union_find(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# 1 ------------------------------------------------------------------------------------------------
def test_quality_learns_from_text_alone(spark, empty):
    rows = [(i, prose(40, i) if i % 2 else " ".join(w + "$$" for w in prose(40, i).split()), "s") for i in range(200)]
    docs = make(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, epochs=6)
    out = {r["doc_id"]: r for r in quality.scored(docs.drop("score"), model).withColumn("held", quality.held_out()).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in out if out[i]["held"]] == held
    assert sum((out[i]["score"] >= 0.3) == (i % 2 == 1) for i in held) >= 0.95 * len(held)
    shuffled = quality.scored(docs.drop("score").withColumn("doc_id", F.lit(0)).withColumn("source", F.lit("z")), model).collect()
    assert sorted(r["score"] for r in shuffled) == sorted(r["score"] for r in out.values())


def test_quality_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(odd, none)
    got = quality.scored(odd.drop("score"), model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.scored(empty, model).count() == 0


def test_chunks_cover_all_bytes():
    data = np.arange(3000, dtype=np.int64) % 250 + 1
    for n in (0, 1, 447, 448, 449, 512, 513, 960, 961, 2999):
        x, first = quality.chunks(data[:n].astype(np.uint8), np.array([0, n]))
        again = np.concatenate([x[0], *[c[quality.OVERLAP :] for c in x[1:]]])
        assert again[:n].tolist() == data[:n].tolist() and not again[n:].any()


# 2 ------------------------------------------------------------------------------------------------
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
#: Wordings that are not those of the templates: text and family (None: nothing known is granted).
NOTICES = [
    (MIT, "mit"), ("\n".join(f" * {x}" for x in MIT.upper().split("\n")), "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("license = GPL-3.0-or-later", "gpl"), ("MIT-licensed code", "mit"),
    ("This module is released under GPLv3, see COPYING", "gpl"), ("This is free and unencumbered software released into the public domain.", "unlicense"), ("Distributed under the Boost\nSoftware License, Version 1.0.", "boost"), ("Eclipse Public License - v 2.0", "epl"),
    ("code is licensed under the\nApache License,\nVersion 2.0 (the\n\"License\")", "apache"), ("the text is licensed under CC-BY-SA-4.0", "cc-by-sa"), ("Photos here are licensed under CC BY-NC 4.0, thank you", "cc-by-nc"), ("(c) 2021 Some Person. All Rights Reserved.", "proprietary"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation", "lgpl"), ("Licensed under the GNU Affero General Public License, version 3 only", "agpl"), ("* Redistributions of source code must retain the above copyright\n* notice, this list of conditions and the following disclaimer.", "bsd"),
    ("All data is dedicated to the public domain under CC0 1.0 Universal", "cc0"), ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "mpl"), ("Licensed under the ISC license, 2017", "isc"),
    ("My driving license was renewed under the new rules", None), ("the apache tribe lived in the public lands of the commons", None), ("He was granted permission to use the software at MIT", None), ("General public interest in free software is high", None), ("Copies of the book were sold to persons without restriction", None), ("All rooms are reserved", None),
    ("the following conditions are met by all creative people", None), ("Licensed under the Q Public License", None), ("a license plate", None), ("version 2.0 of the program is better than version 1.0", None), ("See the documentation for more details.", None), ("Copyright law is a general matter of the public", None),
]


def test_licences_by_precision_and_recall(spark):
    rows = [(i, f"{prose(30, 100 + i)}\n\n{t}\n\n{prose(25, 200 + i)}", "s") for i, (t, _) in enumerate(NOTICES)]
    rows += [(100 + i, prose(300, 300 + i), "s") for i in range(30)]
    docs = make(spark, rows)
    got = {}
    for r in licenses.scan(docs, licenses.train(docs)).collect():
        if r["confirmed"]:
            got.setdefault(r["doc_id"], set()).add(r["family"])
    want = {i: f for i, (_, f) in enumerate(NOTICES) if f}
    right = sum(want[i] in got.get(i, ()) for i in want)
    said = sum(map(len, got.values()))
    wrong = [(i, f) for i, fs in got.items() for f in fs if want.get(i) != f]
    assert right >= 0.9 * len(want), {i: (NOTICES[i][0], got.get(i)) for i in want if want[i] not in got.get(i, ())}
    assert len(wrong) <= 0.1 * said, wrong


def test_licences_are_seen_whole(spark, odd, empty):
    """Wrapped lines, long blocks without a blank line, long lines, repeats, nulls, no sample."""
    one = " ".join(MIT.split())
    rows = [(1, f"{prose(900, 1)} {one} {prose(900, 2)}", "s"), (2, f"{prose(40, 3)}\n" * 20 + MIT + f"\n{prose(40, 4)}" * 20, "s"), (3, f"a\n\n{MIT}", "s"), (3, f"a\n\n{MIT}", "s"), (4, None, "s"), (5, "", "s"), (None, "Released under the MIT License.", "s")]
    model = licenses.train(make(spark, rows[:0]))
    got = [(r["doc_id"], r["paragraph"], r["lines"], r["family"]) for r in licenses.scan(make(spark, rows), model).collect() if r["confirmed"]]
    assert sorted(got, key=str) == sorted([(1, 0, 1, "mit"), *(x for x in got if x[0] == 2), (3, 2, 6, "mit"), (3, 2, 6, "mit"), (None, 0, 1, "mit")], key=str)
    assert [x for x in got if x[0] == 2 and x[3] == "mit" and x[1] <= 20 and x[1] + x[2] >= 26]
    assert licenses.scan(odd, model).count() == 0 and licenses.scan(empty, model).count() == 0


# 3 and 4 --------------------------------------------------------------------------------------------
@functools.cache
def fresh():
    return Tokenizer.from_file(binary.tokenizer_path())


def whole_ids(t):
    return fresh().encode(t or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing(spark, odd, empty):
    got = binary.pack(odd, binary.tokenizer_path()).collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, s, n, crc(ids[s : s + n]), len(ids)) for r in odd.collect() for ids in [whole_ids(r["text"])] for s, n in binary.pieces_of(len(ids)))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    by = sorted(got, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by] == sorted((r["length"] for r in got), reverse=True)
    assert binary.pack(empty, binary.tokenizer_path()).count() == 0


def test_token_files(spark, odd, empty):
    shards = binary.write_shards(odd, binary.tokenizer_path(), shard_ids=50)
    got = sorted(binary.read_shards(shards).collect(), key=lambda r: r["start"])
    ids = [(r["doc_id"], whole_ids(r["text"])) for r in odd.collect()]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(x), crc(x)) for i, x in ids)
    assert [r["start"] for r in got] == np.append(0, np.cumsum([r["n_tokens"] for r in got]))[:-1].tolist()
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    asked = spark.createDataFrame([(7,), (8,), (4,), (77,), (None,)], "doc_id long")
    found = binary.lookup(shards, asked).collect()
    assert sorted((r["doc_id"], crc(r["ids"])) for r in found) == sorted((i, crc(x)) for i, x in ids if i in (4, 7, 8))
    assert binary.read_shards(binary.write_shards(empty, binary.tokenizer_path())).count() == 0


# 5 ------------------------------------------------------------------------------------------------
def test_lines_against_sql(spark, odd):
    foot = "this is the footer of every page here"
    rows = [(i, f"{prose(20, i)}\n{foot}\n  near threshold line {i % 2} \n{prose(9, i + 1)}", f"s{i % 7}") for i in range(30)]
    rows += [(100 + i, "a copied line that is long\nand another copied line too", f"s{i}") for i in range(8)]
    rows += [(200 + i, f"{foot}\n\n\tMenu\r\nMenu\n{prose(2, i)} {i}\r", f"s{i}") for i in range(9)]  # more boilerplate than text
    docs = make(spark, rows, clash=False)
    got = {(r["doc_id"], r["text"], r["_n"]) for r in lines.dedup(docs, count="_n").collect()}
    c = duckdb.connect()
    c.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.collect()]))
    want = set(map(tuple, c.sql(lines.oracle("documents", "doc_id, text, removed")).fetchall()))
    assert got == want
    assert all(foot not in t for i, t, _ in got if i < 100)
    assert all(t.startswith("a copied") for i, t, _ in got if 100 <= i < 200)  # copies stay whole
    assert {(i, t, n) for i, t, n in got if i >= 200} == {(200 + i, f"\n{prose(2, i)} {i}\r", 3) for i in range(9)}


def test_lines_with_other_settings_and_clashing_names(spark):
    rows = [(i, f"one shared line\nown {i}", f"s{i}") for i in range(7)] + [(50 + i, "one shared line", f"s{i}") for i in range(3)]
    docs = make(spark, rows, clash=False).withColumns({c: F.lit(-1) for c in ("key0", "text_key0", "n0", "chars0", "h", "pos", "line", "rows", "_n")})
    got = {r["doc_id"]: (r["text"], r["n0"], r["gone1"]) for r in lines.dedup(docs, max_share=2, count="gone1").collect()}
    assert got == {**{i: (f"own {i}", -1, 1) for i in range(7)}, **{50 + i: ("", -1, 1) for i in range(3)}}
    assert all(r["text"] == t for r, (_, t, _) in zip(sorted(lines.dedup(docs, min_chars=16).collect(), key=lambda r: r["doc_id"]), rows))


def test_lines_edges(spark, odd, empty):
    got = lines.dedup(odd)
    assert got.columns == odd.columns
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    assert key(got) == key(odd)
    assert lines.dedup(empty).count() == 0


# 6 ------------------------------------------------------------------------------------------------
def test_passages(spark, odd, empty):
    shared = prose(80, 500).split()
    edited = shared[:30] + ["changed"] + shared[31:55] + shared[57:]
    rows = [(i, prose(150, i), "s") for i in range(10)]
    rows += [(20, f"{prose(60, 600)} {' '.join(shared)} {prose(70, 601)}", "s"), (21, f"{prose(90, 602)} {' '.join(edited)} {prose(30, 603)}", "s"), (22, f"{' '.join(shared)} {prose(100, 604)}", "s"), (23, rows[0][1], "s")]
    got = passages.passages(make(spark, rows)).collect()
    met = {frozenset((r["doc_id"], r["other_doc_id"])) for r in got}
    assert {i for p in met for i in p} == {0, 20, 21, 22, 23}
    assert frozenset((0, 23)) in met
    for r in got:
        if 20 <= r["doc_id"] <= 22:
            assert r["end"] - r["start"] >= 76 and r["identity"] >= 0.9
            assert 0 < r["end"] <= len(dict((i, t) for i, t, _ in rows)[r["doc_id"]].split())
    ids = {frozenset((r["doc_id"], r["other_doc_id"])) for r in passages.passages(odd).collect()}
    assert ids == {frozenset((8, 9)), frozenset((6, 7))}
    assert passages.passages(empty).count() == 0


def test_winnowing_and_chains():
    h = np.random.default_rng(0).integers(0, 2**60, 500).astype(np.uint64)
    at = set(passages.winnow(h, 12).tolist())
    assert all(at & set(range(i, i + 12)) for i in range(len(h) - 11))
    brute = {i + int(np.flatnonzero(h[i : i + 12] == h[i : i + 12].min())[0]) for i in range(len(h) - 11)}
    assert at == brute
    segments = np.array([[0, 0, 10], [12, 11, 10], [5, 300, 9], [30, 24, 8]])
    best = passages.chains(segments)[0]
    assert best.tolist() == [[0, 0, 10], [12, 11, 10], [30, 24, 8]]
    assert passages.agreeing(np.array([1, 2, 3, 4]), np.array([2, 9, 3])) == 2


def test_chains_are_the_best_by_brute_force():
    r = np.random.default_rng(4)
    for _ in range(30):
        s = np.stack([r.integers(0, 60, 7), r.integers(0, 60, 7), r.integers(3, 9, 7)], axis=1)
        got = passages.chains(s)[0]

        def value(c):
            return sum(x[2] for x in c) - passages.GAP_COST * sum(max(0, b[0] - a[0] - a[2]) + max(0, b[1] - a[1] - a[2]) for a, b in zip(c, c[1:]))

        def grow(c):
            yield c
            for x in s.tolist():
                if c and x[0] >= c[-1][0] + c[-1][2] and x[1] >= c[-1][1] + c[-1][2] and max(x[0] - c[-1][0] - c[-1][2], x[1] - c[-1][1] - c[-1][2]) <= passages.MAX_GAP:
                    yield from grow([*c, x])

        best = max(value(c) for x in s.tolist() for c in grow([x]))
        assert math.isclose(value(got.tolist()), best)


def test_all_chains_of_long_texts_by_brute_force():
    """Every chain, one after the other, against all predecessors tried one by one."""

    def brute(s):
        s, out = sorted(s.tolist(), key=lambda x: (x[1], x[0])), []
        while s:
            best = []
            for x in s:
                own = (float(x[2]), [x])
                for value, c in best:
                    ga, gb = x[0] - c[-1][0] - c[-1][2], x[1] - c[-1][1] - c[-1][2]
                    if min(ga, gb) >= 0 and max(ga, gb) <= passages.MAX_GAP:
                        own = max(own, (value + x[2] - passages.GAP_COST * (ga + gb), [*c, x]), key=lambda v: round(v[0], 6))
                best.append(own)
            top = max(best, key=lambda v: round(v[0], 6))
            out.append(top)
            s = [x for x in s if x not in top[1]]
        return out

    r = np.random.default_rng(6)
    for _ in range(20):
        # A long exact passage, then short segments on either side, most of them on diagonals near its own.
        b = np.unique(r.integers(0, 3000, 60))
        n = r.integers(8, 24, len(b))
        s = np.stack([np.maximum(0, b + r.integers(-3, 4, len(b)) * r.integers(0, 9, len(b))), b, n], axis=1)
        s = np.concatenate([[[1000, 1000, 400]], s[(s[:, 1] > 1400) | (s[:, 1] + s[:, 2] < 1000)]])
        wanted = []
        for value, c in brute(s):
            box = (c[0][0], c[0][1], c[-1][0] + c[-1][2], c[-1][1] + c[-1][2])
            if not any(box[0] >= o[0] and box[1] >= o[1] and box[2] <= o[2] and box[3] <= o[3] for _, o in wanted):
                wanted.append((value, box))
        got = passages.chains(s)

        def value(c):
            return c[:, 2].sum() - passages.GAP_COST * sum(y[0] - x[0] - x[2] + y[1] - x[1] - x[2] for x, y in zip(c.tolist(), c.tolist()[1:]))

        assert np.allclose([value(c) for c in got], [v for v, _ in wanted])


def test_a_long_passage_does_not_shadow_what_follows(spark):
    long, fuzzy = prose(400, 700), prose(96, 701).split()
    edited = " ".join(x for i in range(0, 96, 24) for x in [*fuzzy[i : i + 24], f"new{i}"])
    rows = [(1, f"{long} {prose(500, 702)} {' '.join(fuzzy)} {prose(60, 703)}", "s"), (2, f"{long} {prose(300, 704)} {edited} {prose(60, 705)}", "s")]
    got = passages.passages(make(spark, rows)).collect()
    spans = sorted((r["end"] - r["start"]) if r["doc_id"] == 1 else (r["other_end"] - r["other_start"]) for r in got)
    assert len(spans) == 2 and spans[0] >= 90 and spans[1] >= 400


@pytest.mark.parametrize("paired", [passages.PAIRED, 2])
def test_changed_passages_link_all_their_texts(spark, monkeypatch, paired):
    """Versions of a passage with different words changed: every pair is reported, also where all seeds are in more than ``paired`` texts."""
    monkeypatch.setattr(passages, "PAIRED", paired)
    monkeypatch.setattr(passages, "BLOCK", 2)
    whole = prose(120, 5000).split()
    # Half of the texts have the first part only, half the second, so that no text stands for all others.
    parts = [whole[:70], whole[:70], whole[:70], whole, whole[50:], whole[50:], whole[50:]]
    texts = {}
    for i, p in enumerate(parts):
        p = list(p)
        for at in (20 + i, 40 + i):
            p[at] = f"new{i}{at}"
        texts[i] = f"{prose(40, 5100 + i)} {' '.join(p)} {prose(40, 5200 + i)}"
    got = {frozenset((r["doc_id"], r["other_doc_id"])) for r in passages.passages(make(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    linked = [{0, 1, 2, 3}, {3, 4, 5, 6}]
    assert got == {frozenset((a, b)) for some in linked for a in some for b in some if a < b}


def test_copies_of_a_passage_do_not_make_all_pairs(spark, monkeypatch):
    """Of texts that share a passage word for word, or say one word again and again, one stands for all: no text is lost, and a changed version meets that one."""
    monkeypatch.setattr(passages, "PAIRED", 2)
    shared = prose(90, 6000).split()
    changed = [*shared[:40], "new", *shared[41:]]
    beside = lambda i, x: " ".join(f"{x}{i}n{j}" for j in range(40))
    texts = {i: f"{beside(i, 'p')} {' '.join(changed if i == 8 else shared)} {beside(i, 'q')}" for i in range(9)}
    texts |= {20 + i: f"{beside(i, 'r')} {'la ' * (60 + 5 * i)}{beside(i, 's')}" for i in range(6)}
    got = {frozenset((r["doc_id"], r["other_doc_id"])) for r in passages.passages(make(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert {i for p in got for i in p} == set(texts)
    # The changed version also meets a copy with which it alone shares a seed at the passage's end.
    assert any(8 in p for p in got) and len(got) < 7 + 5 + 8
    for group in set(range(8)), set(range(20, 26)):
        own = [p for p in got if p <= group]
        assert len(own) == len(group) - 1 and any(all(i in p for p in own) for i in group)
    assert all(max(p) < 20 or min(p) >= 20 for p in got)


def test_pairs_go_together_as_one_by_one(monkeypatch):
    """Matches, chains and alignments of many pairs at once are those of each pair by itself, also where texts repeat lines."""
    monkeypatch.setattr(passages, "TRIED", 500)
    monkeypatch.setattr(passages, "GAPS", 7)
    r = np.random.default_rng(12)
    base, lines = r.integers(1, 9999, 260), [r.integers(1, 9999, 11) for _ in range(4)]
    texts = []
    for i in range(14):
        t = base[r.integers(0, 60) : r.integers(180, 260)].tolist()
        for at in sorted(r.integers(0, len(t), 8).tolist(), reverse=True):
            t[at : at + int(r.integers(0, 3))] = r.integers(10000, 99999, int(r.integers(0, 3))).tolist()
        for _ in range(int(r.integers(0, 9)) if i % 2 else 0):
            at = int(r.integers(0, len(t)))
            t[at:at] = lines[int(r.integers(0, 4))].tolist()
        texts.append(np.array(t, np.uint32))
    seeds = []
    for t in texts:
        h = text.kmers(t.astype(np.uint64), passages.K)
        at = passages.winnow(h)
        seeds.append((h[at].view(np.int64), at))
    size = np.array([len(t) for t in texts])
    w, begin = np.concatenate(texts), np.cumsum(size) - size
    x, y = (np.array(v) for v in zip(*((i, j) for j in range(14) for i in range(j))))
    got, met = {}, {}
    for pair, segments in passages._segments(np.concatenate([h for h, _ in seeds]), np.concatenate([at for _, at in seeds]), np.repeat(np.arange(14), [len(at) for _, at in seeds]), x, y):
        for p in np.unique(pair).tolist():
            met[p] = sorted(segments[pair == p].tolist())
        of, sizes, kept = passages.many_chains(pair, segments)
        spans = passages.many_aligned(w, begin[x[of]], begin[y[of]], size[x[of]], size[y[of]], sizes, kept)
        for p, c, *span in zip(of.tolist(), np.split(kept, np.cumsum(sizes)[:-1]), *(v.tolist() for v in spans)):
            got.setdefault(p, []).append((c.tolist(), *span))
    several = 0
    for p, (i, j) in enumerate(zip(x, y)):
        matches = set()
        for h in np.intersect1d(seeds[i][0], seeds[j][0]):
            a, b = (seeds[k][1][seeds[k][0] == h].tolist() for k in (i, j))
            matches |= {(a[0], v) for v in b} | {(v, b[0]) for v in a}
        segments = passages.diagonals(*np.array(sorted(matches), np.int64).reshape(-1, 2).T) if matches else np.zeros((0, 3), np.int64)
        assert met.get(p, []) == sorted(segments.tolist())
        wanted = []
        for c in passages.chains(segments, least=passages.LEAST_SPAN) if len(segments) else []:
            la, lb = (max(0, int(v) - passages.MARGIN) for v in c[0, :2])
            x0, x1, y0, y1, same = passages.align(texts[i][la : c[-1, 0] + c[-1, 2] + passages.MARGIN], texts[j][lb : c[-1, 1] + c[-1, 2] + passages.MARGIN], c - np.array([la, lb, 0]))
            wanted.append((c.tolist(), x0 + la, x1 + la, y0 + lb, y1 + lb, same))
        several += len(wanted) > 1
        assert sorted(got.get(p, [])) == sorted(wanted)
    assert len(got) > 60 and several > 2


def test_texts_of_pairs_are_dealt_by_blocks(spark, monkeypatch):
    """A family of near copies in cells of a few pairs gives the rows that it gives in one cell, and its texts aren't sent with each pair."""
    whole = prose(160, 7000).split()
    texts = {}
    for i in range(24):
        p = list(whole)
        for at in (10 + 5 * i, (70 + 11 * i) % 150):
            p[at] = f"new{i}n{at}"
        texts[i] = " ".join(p)
    docs = make(spark, [(i, t, "s") for i, t in texts.items()])
    sent, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, label, *more: (lambda out: (sent.append(out.count()) if label == "cell-texts" else None, out)[1])(stored(df, label, *more)))
    all_rows = sorted(map(tuple, passages.passages(docs).collect()))
    assert {frozenset((r[0], r[3])) for r in all_rows} == {frozenset((i, j)) for i in texts for j in texts if i < j}
    monkeypatch.setattr(passages, "SIDE", 4)
    monkeypatch.setattr(passages, "CELL_PAIRS", 5)
    assert sorted(map(tuple, passages.passages(docs).collect())) == all_rows
    assert sent[0] == 24 < sent[1] < 24 * 23 / 2


def test_every_shared_run_is_reported(spark):
    """Texts that overlap in part, in all orders of their keys, against brute force."""
    n = passages.MIN_WORDS
    rows = []
    for f in range(8):
        p, q = prose(60, 800 + f).split(), prose(64, 820 + f).split()
        at = [f"{prose(40, 1000 + 10 * f + i)} {' '.join(x)} {prose(50, 2000 + 10 * f + i)}" for i, x in enumerate([p[:35], p, p, q[:34], q[30:], q, q[2:]])]
        # The passage twice in a text, the first time in part.
        r = prose(70, 840 + f).split()
        at += [f"{' '.join(r[:40])} {prose(30, 3000 + f)} {' '.join(r)} {prose(20, 3100 + f)} {' '.join(r[10:])}", f"{prose(25, 3200 + f)} {' '.join(r)}"]
        rows += [(100 * f + i, t, "s") for i, t in enumerate(at)]
    got = passages.passages(make(spark, rows)).collect()
    said = {}
    for r in got:
        said.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        said.setdefault(r["other_doc_id"], []).append((r["other_start"], r["other_end"]))
    where = {}
    for i, t, _ in rows:
        w = t.split()
        for k in range(len(w) - n + 1):
            where.setdefault(tuple(w[k : k + n]), []).append((i, k))
    shared = [x for v in where.values() if len({i for i, _ in v}) > 1 for x in v]
    assert len(shared) > 300
    missing = [(i, k) for i, k in shared if not any(a <= k and k + n <= z for a, z in said.get(i, []))]
    assert not missing
    words = {i: t.split() for i, t, _ in rows}
    for r in got:
        if r["identity"] == 1:
            assert words[r["doc_id"]][r["start"] : r["end"]] == words[r["other_doc_id"]][r["other_start"] : r["other_end"]]


def test_repeated_words_give_few_rows(spark):
    """Texts that repeat a word, a pair or a line hundreds of times; every shared run is reported all the same."""
    n = passages.MIN_WORDS
    line = prose(9, 4000)
    rows = [(1, "thor " * 900, "s"), (2, prose(30, 1) + " thor" * 300 + " " + prose(20, 2), "s"), (3, "thor " * 55, "s"), (4, "odd even " * 400, "s"), (5, "even odd " * 90, "s"), (6, f"{line} " * 60, "s"), (7, f"{prose(40, 3)} {line} " * 2 + f"{line} " * 12, "s")]
    got = passages.passages(make(spark, rows)).collect()
    assert len(got) <= 60
    said = {}
    for r in got:
        said.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        said.setdefault(r["other_doc_id"], []).append((r["other_start"], r["other_end"]))
    words = {i: t.split() for i, t, _ in rows}
    where = {}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            where.setdefault(tuple(w[k : k + n]), []).append((i, k))
    shared = [x for v in where.values() if len({i for i, _ in v}) > 1 for x in v]
    assert not [(i, k) for i, k in shared if not any(a <= k and k + n <= z for a, z in said.get(i, []))]
    for r in got:
        if r["identity"] == 1:
            assert words[r["doc_id"]][r["start"] : r["end"]] == words[r["other_doc_id"]][r["other_start"] : r["other_end"]]


# 7 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 3])
def test_topk(spark, monkeypatch, parts):
    """Against brute force over rows, where ids repeat, scores tie and a third of all vectors are one."""
    for name, value in (("SHARD_ROWS", 60), ("QUERY_BLOCK", 7), ("TOGETHER", 2), ("LEAF", 8)):
        monkeypatch.setattr(topk, name, value)
    if parts > 1:
        monkeypatch.setattr(topk, "ROOT_BYTES", 300)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(0, 0.3, 5).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 5) for i in range(300, 450)]  # ties
    rows += [(0, rows[0][1]), (20, rows[7][1]), (20, [0.5] * 5), (777, [2.0, 3.0]), (780, [1.0, -2.0])]
    out = [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (504, []), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows + out, "vec_id long, embedding array<double>").withColumns({x: F.lit(1) for x in ("label", "v", "dim", "score", "row", "cell", "asked")})
    got = sorted(map(tuple, topk.search(topk.whole(df, "vec_id", "embedding"), F.col("vec_id") % 20 == 0).collect()))
    v = [(i, [math.floor(1024 * c) for c in x]) for i, x in rows]
    want = []
    for a, (i, x) in enumerate(v):
        if i % 20 == 0:
            s = sorted((-sum(p * q for p, q in zip(x, y)), j) for b, (j, y) in enumerate(v) if b != a and len(x) == len(y))[:10]
            want += [(i, n + 1, j, -p) for n, (p, j) in enumerate(s)]
    assert got == sorted(want)
    none = topk.whole(df.where("false"), "vec_id", "embedding")
    assert topk.search(none, F.lit(True)).count() == 0


def test_topk_of_large_components(spark):
    big = [(1, [3e5, -3e5]), (2, [3e5, 3e5 + 1]), (3, [-3e5, 3e5])]  # beyond 2^53, within 63 bits
    got = topk.search(topk.whole(spark.createDataFrame(big, "vec_id long, e array<double>"), "vec_id", "e"), F.col("vec_id") == 2).collect()
    x = {i: [math.floor(1024 * c) for c in v] for i, v in big}
    assert {r["vec_id"]: r["score"] for r in got} == {i: sum(a * b for a, b in zip(x[i], x[2])) for i in (1, 3)}
    for bad in (1e10, 1e30):
        with pytest.raises(Exception, match="63 bits|2\\^62"):
            topk.search(topk.whole(spark.createDataFrame([(1, [bad] * 3), (2, [bad] * 3)], "vec_id long, e array<double>"), "vec_id", "e"), F.lit(True)).collect()


# 8 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("together", [1 << 20, 40])
def test_retrieval_is_exact_and_skips(monkeypatch, together):
    monkeypatch.setattr(decontaminate, "_TOGETHER", together)
    r = random.Random(1)
    items = [" ".join([*prose(n, 900 + n + 50 * k).split(), *(f"own{r.randrange(3000)}" for _ in range(n))]) for n in range(12, 60, 3) for k in range(6)]
    index = decontaminate.Index(list(range(len(items))), items)
    dense = np.zeros((len(index.ids), len(index.terms)))
    dense[index.item, index.term] = index.weight
    assert np.allclose(dense.sum(axis=1), 1) and sum(len(c.items) for c in index.classes) == len(items)
    every = read = 0
    for seed in range(40):
        h, _ = text.plain_words(pa.array([prose(80, seed) + " " + items[seed % len(items)]]))
        terms = np.unique(np.searchsorted(index.terms, h)[np.isin(h, index.terms)])
        score = dense[:, terms].sum(axis=1)
        for limit in (0.3, 0.6):
            start = index.read
            assert [i for i, _ in index.retrieve(terms, limit)] == np.flatnonzero(score >= limit).tolist()
            if limit == 0.6:
                read += index.read - start
                every += (dense[:, terms] > 0).sum()
    assert 0 < read < every / 2


def windows_by_hand(t, items):
    """(item, score) of every item and window of its class, with all items as BM25 documents; plain Python."""
    words = lambda x: re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", (x or "").lower())
    own = {i: words(x) for i, x in enumerate(items) if words(x)}
    mean = sum(map(len, own.values())) / len(own)
    df = Counter(w for x in own.values() for w in set(x))
    weigh = lambda x: {w: math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w, c in Counter(x).items()}
    out, text_words = {}, words(t)
    for i, x in own.items():
        step = 16
        while step < len(x):
            step *= 2
        weight = weigh(x)
        part = items[i].rfind("?") + 1
        sides = [words(items[i][:part]), words(items[i][part:])]
        for a in range(0, max(1, len(text_words) - step), step):
            seen = text_words[a : a + 2 * step]
            score = sum(v for w, v in weight.items() if w in set(seen)) / sum(weight.values())
            runs = lambda y: {tuple(y[j : j + 3]) for j in range(len(y) - 2)}
            q, s = (len(runs(y) & runs(seen)) / len(runs(y)) for y in sides)
            if score >= 0.6 and q >= 0.6 and s >= 0.5:
                out[i] = max(out.get(i, ()), (round(score, 6), round(q, 6), round(s, 6)))
    return out


def test_hits_against_plain_python(spark):
    """The whole operator: windows, scores, overlaps; a very long item changes nothing for the others."""
    items = [f"{prose(5 + i % 30, 5000 + i)}? {prose(4 + i % 9, 5100 + i)}." for i in range(40)] + [f"{prose(700, 5999)}? {prose(40, 5998)}"]
    r = random.Random(18)
    worn = lambda t: " ".join(w for w in t.split() if r.random() > 0.12)
    texts = [f"{prose(r.randrange(120), 6000 + i)} {worn(items[i % 41])} {prose(r.randrange(150), 7000 + i)}" for i in range(90)] + [items[0], "", prose(40, 3)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {x["doc_id"]: {h["item_id"]: tuple(round(h[c], 6) for c in ("score", "question", "answer")) for h in x["hits"]} for x in decontaminate.with_hits(make(spark, [(i, t, "s") for i, t in enumerate(texts)]), bench).collect()}
    want = {i: windows_by_hand(t, items) for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 40


def test_decontamination(spark, odd, empty):
    items = ["What grows in the garden at night? Mushrooms and silver moss grow there.", prose(40, 77) + ". " + prose(12, 78) + ".", None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").withColumn("score", F.lit(1))
    rows = [(1, prose(200, 5) + " " + items[1].upper().replace(".", " !!") + " " + prose(300, 6), "s"), (2, prose(500, 7), "s"), (3, items[0], "s"), (4, "What grows in the garden at night? Nobody knows. " + prose(50, 8), "s"), (5, " ".join(items[1].split()[:12]) + " " + prose(90, 9), "s")]
    docs = make(spark, rows)
    got = {(r["doc_id"], h["item_id"]) for r in decontaminate.with_hits(docs, bench).collect() for h in r["hits"]}
    assert got == {(1, 1), (3, 0)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 4, 5}
    assert decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.clean(empty, bench).count() == 0
    assert decontaminate.clean(docs, bench.where("false")).count() == 5
    assert len(list(decontaminate.indexes(bench, 100))) > 1


def test_parts_and_one_index_give_equal_hits(spark, monkeypatch):
    items = [f"{prose(6 + i % 23, 5000 + i)}? {prose(4 + i % 7, 5100 + i)}." for i in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    r = random.Random(8)

    def worn(t):
        return " ".join(w for w in t.split() if r.random() > 0.12)

    docs = make(spark, [(i, f"{prose(70, 6000 + i)} {worn(items[i % 60])} {prose(80, 7000 + i)}", "s") for i in range(240)])

    def hits():
        return sorted((x["doc_id"], h["item_id"], round(h["score"], 9)) for x in decontaminate.with_hits(docs, bench).collect() for h in x["hits"])

    whole = hits()
    parts = list(decontaminate.indexes(bench, 1500))
    assert len(parts) > 3 and len(whole) > 60
    monkeypatch.setattr(decontaminate, "indexes", lambda _: parts)
    assert hits() == whole


# 9 ------------------------------------------------------------------------------------------------
URLS = [None, "", "no scheme", "http://EXAMPLE.net/en/x", "https://a.b.Example.NET/en", "http://example.net", "http://example.net/?q", "http://x.org/fr/#a", "http://org/fr/", "http://badexample.net/en/", "http://example.com/de/a?b", "http://example.com/en/", "ftp://net/x://y/", "http://.net/", "http://a..net/z", "x\n://q.net/\nb", "http://net:80/a", "://net/a", "http://é.org/fr/é", "http://" + "a." * 20_000 + "net/x", "http://example.net/en/" + "p/" * 50_000, "http://.", "http://net./a"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_rules(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(3, URLS[3], "h"), (None, URLS[7], "h")], "page_id long, url string, html string").withColumns({"host": F.lit("z"), "path": F.lit("z"), "rule": F.lit("z")})
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = sorted(map(str, (tuple(r) for r in url_filter.judge(pages, rules).collect())))
    c = duckdb.connect()
    c.register("pages", pa.table({"page_id": [*range(len(URLS)), 3, None], "url": [*URLS, URLS[3], URLS[7]]}))
    assert got == sorted(map(str, c.sql(url_filter.ORACLE).fetchall()))
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.where("false")).collect()} == {"allow"}


# 10 -----------------------------------------------------------------------------------------------
def shingle_set(t):
    w = plain(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    s = [(i, shingle_set(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(s) for b, y in s[:k] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return union_find({i for i, _ in s}, links)


def near_family(n, size, edits, seed):
    r = random.Random(seed)
    base = prose(size, seed).split()
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(size)] = r.choice(WORDS)
        out.append(" ".join(w))
    return out


def test_jaccard_against_brute_force(spark):
    texts = near_family(40, 120, 3, 1) + near_family(25, 60, 1, 2) + near_family(20, 200, 9, 3) + [prose(100, 50 + i) for i in range(15)] + ["one two three", "one  two\nthree", "one two", "ONE TWO"]
    texts += [f"{prose(40, 999)} {prose(30, 700 + i)}" for i in range(25)] + [texts[0]] * 5
    random.Random(9).shuffle(texts)
    rows = list(enumerate(texts))
    docs = make(spark, [(i, t, "s") for i, t in rows])
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs).collect()}
    want = brute(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(shingle_set(t)) for i, t in rows}


def test_jaccard_second_round_alone_is_exact(spark, monkeypatch):
    """Without partners from round one, all links come from round two."""
    monkeypatch.setattr(jaccard, "_partners", lambda entries: entries.select("gid", F.col("gid").alias("head")).where("false"))
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SEEN", 2)
    texts = near_family(20, 80, 2, 21) + near_family(10, 50, 2, 22) + [prose(50, i) for i in range(5)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(make(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute(rows)


def test_sets_of_one_group_meet_without_round_one(spark, monkeypatch):
    """Nothing comes from round one, so sets that share a prefix must meet by what follows it."""
    calls, real = [], jaccard.verified

    def verified(docs, classes, pairs, k):
        calls.append(pairs.count())
        return real(docs, classes, pairs.where("false") if len(calls) == 1 else pairs, k)

    monkeypatch.setattr(jaccard, "verified", verified)
    monkeypatch.setattr(jaccard, "SEEN", 10**9)  # all shingles count as rare, so that near copies share prefixes
    monkeypatch.setattr(jaccard, "_partners", lambda entries: entries.select("gid", F.col("gid").alias("head")).where("false"))
    texts = near_family(150, 60, 1, 31) + near_family(60, 40, 1, 32) + near_family(40, 20, 2, 33) + near_family(60, 7, 1, 34)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(make(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert calls[0] > 10 and got == brute(rows)


def test_jaccard_edges(spark, odd, empty):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.jaccard_components(odd).collect())
    assert ("1", 0, "1") in got and ("2", 0, "2") in got and ("3", 0, "3") in got
    assert got.count(("4", 1, "4")) == 2 and ("5", 1, "4") in got and ("9", 29996 - 0, "8") in [(a, 29996, c) for a, n, c in got if a == "9"]
    assert len(got) == odd.count() and ("None", 0, "None") in got
    assert jaccard.jaccard_components(empty).count() == 0
    left = jaccard.near_duplicates_removed(odd)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["1", "2", "3", "4", "6", "7", "8", "None"])


def test_near_duplicates_go_by_row(spark):
    """Different texts under a null and a repeated doc_id stay, each group's one row."""
    x, y, z, p, q = (prose(80, 900 + i) for i in range(5))
    rows = [(None, p, "s"), (None, q, "s"), (None, z, "s"), (1, x, "s"), (1, y, "s"), (5, y, "s"), (6, z, "s"), (7, q, "s"), (7, q, "s"), (8, "", "s"), (8, None, "s")]
    left = jaccard.near_duplicates_removed(make(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left) == sorted([("None", p), ("1", x), ("1", y), ("6", z), ("7", q), ("8", "")])


@pytest.mark.parametrize("broadcast", [True, False])
def test_components(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (3, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}
    assert common.components(edges.where("false")).count() == 0


def test_components_of_any_shape(spark):
    """Paths, sorted and shuffled, a star about its largest node, and random graphs, all in one table; no cap on rounds."""
    r = random.Random(12)
    links = [(2, 100), *((i, i + 1) for i in range(100, 199)), (199, 1)]  # a path whose ends are the least
    links += [(i, i + 1) for i in range(1000, 1700)]
    names = r.sample(range(20_000, 90_000), 10_000)
    links += list(zip(names, names[1:]))
    links += [(9_999, i) for i in range(5_000, 6_000)]
    links += [(r.randrange(200_000, 200_400), r.randrange(200_000, 200_400)) for _ in range(260)]
    want = union_find({x for e in links for x in e}, links)
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in links if i >= 200_000) or i < 200_000}


def test_jaccard_follows_a_long_chain_of_versions(spark):
    base = prose(400, 77).split()
    new = prose(160 * 16, 78).split()
    rows = []
    for i in range(160):  # each version has 16 further words changed: links to its neighbours alone
        rows.append((i, " ".join(base), "s"))
        base = new[16 * i : 16 * i + 16] + base[:-16]
    r = random.Random(4)
    ids = r.sample(range(1000), 160)
    rows = [(ids[i], t, s) for i, t, s in rows]
    got = {x["component_id"] for x in jaccard.jaccard_components(make(spark, rows)).collect()}
    assert got == {min(ids)}


def test_compressed_tables_are_not_broadcast_unasked(spark):
    """A scratch table that its codec makes small isn't small for the driver."""
    common.ready(spark)
    keys = common.stored(spark.range(2_000_000).selectExpr("id div 1000 AS k", "id div 4 AS v"), "keys")
    plan = spark.range(10_000_000).withColumnRenamed("id", "v").join(keys, "v")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    small = common.stored(spark.range(50).withColumnRenamed("id", "v"), "few")
    assert "BroadcastHashJoin" in spark.range(10_000_000).withColumnRenamed("id", "v").join(small, "v")._jdf.queryExecution().executedPlan().toString()
