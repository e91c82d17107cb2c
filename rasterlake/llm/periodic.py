"""Periodic runs of words, by a suffix tree of each text, and texts with their repetitions collapsed.

Branching tandem repeats after Stoye and Gusfield: at each node of the suffix tree with a string of
D words, every leaf i that isn't under the node's largest child is tested for a partner i + D or
i - D under the same node whose next word breaks the repeat; a leaf is under a smaller child at
most log2(n) times. Each repeat is rotated to the left as far as it goes, and repeats that end at
one place and have one root are merged into the maximal run.

The trees of a batch of texts are held in arrays: suffixes in order (by prefix doubling, whose
ranks also answer how many words two places have in common, forwards and backwards), nodes as
intervals of them, parents and heavy paths. Words of different texts are different symbols, so no
node holds two texts. A run of ``LEAST`` words holds a repeat whose root has ``ROOT`` words or
more (a multiple of its period), so less deep nodes aren't built; roots that are powers are
taken down to their period. Nothing is shuffled; a text is the largest thing in memory.

Defined cases: null and empty texts have no words and no run (empty digests); rows that repeat are
each judged; a null doc_id stays and rewrites nothing; an empty table gives no row; ties of the
longest run go to the smallest start, then period; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import common

#: Least words of a run, and of the root of the repeats looked for: a power of two of at most LEAST / 4 + 1.
LEAST, ROOT = 12, 4
#: Words that are put into one set of trees (more in one text: a set of its own).
_TOGETHER = 1 << 19


def _order(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """The order by two keys below n."""
    bits = max(1, int(n).bit_length())
    if 3 * bits < 63:
        packed = (first << (2 * bits)) | (second << bits) | np.arange(len(first))
        packed.sort()
        return packed & ((1 << bits) - 1)
    return np.lexsort((second, first))


def ranks(sym: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """By prefix doubling: the ranks of all suffixes by their first 1, 2, 4, ... symbols up to all, and the suffixes whose first ``ROOT`` symbols come again."""
    n = len(sym)
    count = np.bincount(sym)
    levels = [(np.cumsum(count) - count)[sym]]
    active = np.flatnonzero(count[sym] > 1)
    base, k = active, 1
    while len(active):
        rank = levels[-1]
        order = _order(rank[active], rank[active + k], n)
        at = active[order]
        f, s = rank[at], rank[at + k]
        whole = np.append(True, f[1:] != f[:-1])
        new = whole.copy()
        new[1:] |= s[1:] != s[:-1]
        place = np.arange(len(at))
        rank = rank.copy()
        rank[at] = f + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(whole, place, 0))
        levels.append(rank)
        active = at[~(new & np.append(new[1:], True))]
        active.sort()
        k *= 2
        if k <= ROOT:
            base = active
    return levels, base


def common_after(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i on equal those from j on (i and j different)."""
    at, by = i.copy(), j - i
    for k in range(len(levels) - 1, -1, -1):
        at += (levels[k][at] == levels[k][at + by]).astype(np.int64) << k
    return at - i


def common_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols before i equal those before j (i < j)."""
    at, by = i.copy(), j - i
    for k in range(len(levels) - 1, -1, -1):
        to = np.maximum(at - (1 << k), 0)
        at = np.where((at >= 1 << k) & (levels[k][to] == levels[k][to + by]), to, at)
    return i - at


class Tree:
    """The nodes of ``ROOT`` symbols and more: leaf intervals, depths, parents and heads of heavy paths (the way down by largest children)."""

    def __init__(self, levels: list[np.ndarray], base: np.ndarray):
        self.leaves = leaves = base[np.argsort(levels[-1][base])]
        m = len(leaves)
        lcp = np.zeros(m + 1, np.int64)
        lcp[1:m] = common_after(levels, leaves[:-1], leaves[1:])
        lcp[lcp < ROOT] = 0
        inner = np.flatnonzero(lcp)
        low = [lcp]  # minima of 2 ** k neighbours
        while len(low[-1]) > 1 << (len(low) - 1):
            half = 1 << (len(low) - 1)
            low.append(np.minimum(low[-1][:-half], low[-1][half:]))
        own, a, z = lcp[inner], inner.copy(), inner + 1
        for k in range(len(low) - 1, -1, -1):
            if not len(low[k]):
                continue
            to = np.maximum(a - (1 << k), 0)
            a = np.where((a >= 1 << k) & (low[k][np.minimum(to, len(low[k]) - 1)] >= own), to, a)
            on = np.minimum(z, len(low[k]) - 1)
            z = np.where((z < len(low[k])) & (low[k][on] >= own), z + (1 << k), z)
        key, first, back = np.unique((a - 1) * (m + 1) + z, return_index=True, return_inverse=True)
        node = np.full(m + 1, -1)
        node[inner] = back
        self.depth = own[first]
        self.left, self.right = key // (m + 1), key % (m + 1) - 1

        def above(lo, hi):
            return np.where(lcp[lo] >= lcp[hi], node[lo], node[hi])

        self.parent = above(self.left, self.right + 1)
        self.leaf_parent = above(np.arange(m), np.arange(1, m + 1))
        size, n = self.right - self.left + 1, len(key)
        by = np.lexsort((size, self.parent))
        up = self.parent[by]
        last = by[np.append(up[1:] != up[:-1], True)] if n else by
        heavy = np.zeros(n, dtype=bool)
        heavy[last] = True
        heavy[self.parent < 0] = False
        only = np.ones(n, dtype=bool)  # nodes with leaves only: their first leaf is the largest child
        only[self.parent[self.parent >= 0]] = False
        self.heavy_leaf = np.zeros(m, dtype=bool)
        self.heavy_leaf[self.left[only]] = True
        top = np.where(heavy, self.parent, np.arange(n))
        while not np.array_equal(further := top[top], top):
            top = further
        self.top = top

    def visits(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(leaves, nodes): each leaf with each node at which it is under a smaller child."""
        leaf = np.arange(len(self.leaves))
        up = self.leaf_parent
        node = np.where(self.heavy_leaf, self.parent[self.top[up]], up) if len(self.parent) else up
        while True:
            on = node >= 0
            leaf, node = leaf[on], node[on]
            if not len(leaf):
                return
            yield leaf, node
            node = self.parent[self.top[node]]


def branching(sym: np.ndarray, levels: list[np.ndarray], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and root lengths of all branching tandem repeats whose root has ``ROOT`` symbols or more, by end and length."""
    n, found = len(sym), []
    if len(base):
        tree = Tree(levels, base)
        place = np.full(n, -1)
        place[tree.leaves] = np.arange(len(base))
        for leaf, node in tree.visits():
            i, d = tree.leaves[leaf], tree.depth[node]
            for j, start in ((i + d, i), (i - d, i - d)):
                at = place[np.maximum(j, 0)]
                hit = np.flatnonzero((j >= 0) & (at >= tree.left[node]) & (at <= tree.right[node]))
                s, e = start[hit], d[hit]
                breaks = sym[s + e] != sym[s + 2 * e]
                found.append((s[breaks] + 2 * e[breaks]) * (n + 1) + e[breaks])
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key // (n + 1), key % (n + 1)


def maximal_runs(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of ``LEAST`` symbols or more, by start and period; ``sym``: small numbers, each text's last one of its own."""
    levels, base = ranks(sym)
    end, root = branching(sym, levels, base)
    out = []
    while len(end):
        new = np.append(True, end[1:] != end[:-1])
        e, d = end[new], root[new]
        q = d.copy()
        for p in range(1, ROOT):  # longer periods have repeats of their own, which come first
            i = e - 2 * d
            power = np.flatnonzero((q == d) & (d % p == 0))
            whole = common_after(levels, i[power], i[power] + p) >= 2 * d[power] - p
            q[power[whole]] = p
        s = e - 2 * d
        s -= common_before(levels, s, s + q)
        out.append((s, e - s, q))
        # Other repeats at the same end that are powers of this root belong to this run.
        of = np.cumsum(new) - 1
        left = ~new & ((root % q[of] != 0) | (2 * root > e[of] - s[of]))
        end, root = end[left], root[left]
    s, n, q = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    keep = np.flatnonzero((n >= LEAST) & (n >= 2 * q))
    keep = keep[np.lexsort((q[keep], s[keep]))]
    return s[keep], n[keep], q[keep]


def rewritten(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a planted period in one text of ten, told by the doc_id (a fixed rule of the query)."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), n - a))


def runs_of(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, lengths and periods of each text's runs."""
    out: list = []
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) < _TOGETHER):
            held += len(texts[to])
            to += 1
        parts, first, known = [], [0], 0
        for words in texts[at:to]:
            number: dict[bytes, int] = {}
            put = number.setdefault
            ids = np.fromiter((put(w, len(number)) for w in words), np.int64, len(words))
            parts += [ids + known, np.array([known + len(number)])]
            known += len(number) + 1
            first.append(first[-1] + len(words) + 1)
        s, n, q = maximal_runs(np.concatenate(parts))
        cut = np.searchsorted(s, first)
        out += [(s[a:z] - f, n[a:z], q[a:z]) for a, z, f in zip(cut[:-1], cut[1:], first)]
        at = to
    return out


def kept(n: int, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of n words stay: those in no run, or in every run that holds them among its first period."""
    s, length, q = runs
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, s + q, 1)
    np.add.at(steps, s + length, -1)
    return np.cumsum(steps[:n]) == 0


def collapse(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """Per document its runs (start, length, period) and its text without repetitions, words joined by one space."""
    common.ready(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            if rewrite:
                texts = [rewritten(i, w) for i, w in zip(ids, texts)]
            found = runs_of(texts)
            rows = [[{"start": a, "length": b, "period": c} for a, b, c in zip(*(x.tolist() for x in r))] for r in found]
            new = [b" ".join(itertools.compress(w, kept(len(w), r).tolist()) if len(r[0]) else w).decode() for w, r in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind), pa.array(new, pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse(common.table(spark, sf_dir, "documents"), rewrite=True)
    # Longest first, then the smallest start and period.
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS l, r.start AS start, r.period AS period)))")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("b.l")
    return out.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"), F.expr("(-b.l * 1000) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
