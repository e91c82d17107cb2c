"""Passages that documents share, exact or with small changes, by collinear chaining.

1. Texts that are equal are one text; its copies are reported against one of their documents.
2. Seeds are runs of ``K`` words chosen by winnowing: of every ``W`` neighbouring runs the one
   of least hash, so any common run of ``K + W - 1`` words has a common seed.
3. Seeds that texts share are joined, every pair of texts: under a seed of up to ``PAIRED`` texts
   all its texts meet. Texts that share wider spread seeds alone meet under two such seeds at most
   ``REACH`` words apart, which every chain of such seeds has; so no pair with a chain is left out,
   and a common line of one seed makes no pairs. Of texts whose stretches of such seeds have equal
   words, one stands for all and the others are reported against it; likewise the longest run of a
   word said again and again. So copies make no pairs, but pairs still grow with the square
   of a family of texts that all differ. Pairs are dealt out in cells of two blocks of texts, to which
   each text goes once, and the pairs of a cell are matched, chained and aligned together. A pair's
   matches are all its shared seeds; a seed that a text repeats has its first place in either text
   matched with every place in the other.
4. For each pair of texts, matches on one diagonal are put together, and chained in order in both
   texts: a chain's score is its matched words less a cost for the words it skips, and the best
   predecessor of each match, of those within ``MAX_GAP`` words in both texts, comes from a tree
   of range maxima. Every chain of the pair is taken: the best, then the best of what is left.
5. Chains are aligned on the words themselves: ends grow while words agree, gaps are aligned
   by least edits. A passage is reported with ``MIN_WORDS`` words or more on both sides
   and an identity (agreeing words / words of the longer side) of ``IDENTITY`` or more.
6. Runs of ``MIN_WORDS`` words whose seeds are all shared and that no reported passage covers
   (both texts repeat them, say) are hashed and joined, every occurrence with one. So every
   occurrence of an exact run of ``MIN_WORDS`` words that stands in two texts or more lies in a
   reported passage.

Defined cases: null or short texts share nothing; rows that repeat a document are one; a null
doc_id is reported as null; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import common, text

K, W, MIN_WORDS, IDENTITY, MAX_GAP, GAP_COST = 8, 12, 50, 0.8, 40, 0.1
#: Chains with fewer words between their outer seeds can't reach MIN_WORDS; requests for slices of one text that travel together.
LEAST_SPAN, TOGETHER = MIN_WORDS - 2 * (W - 1), 128
MARGIN, BROADCAST_CHAINS = K + W, 200_000
#: Matches or links that are tried together, gaps that are aligned together, and keys of a cell that meet together; texts and bytes of text on one side of a cell of pairs; pairs and bytes that go through a task's memory together.
TRIED, GAPS, KEYS, SIDE, SIDE_BYTES, CELL_PAIRS, CELL_BYTES = 1 << 18, 4096, 1024, 256, 8 << 20, 16384, 16 << 20
#: The columns of reported passages.
PASSAGE = "b start end a other_start other_end identity"
KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
SPANS = "b long, start int, end int, a long, other_start int, other_end int, identity double"
#: Texts of a seed up to which it makes pairs by itself; words between the starts of neighbouring matches of a chain at most; texts of a block that meets others.
PAIRED, REACH, BLOCK = 32, MAX_GAP + K, 512


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Of each window of w values, by doubling."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def winnow(h: np.ndarray, w: int = W) -> np.ndarray:
    """Places of the least value in some window of w values (all values, if fewer)."""
    if len(h) <= w:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    low = _sliding_min(h, w)
    pad = np.concatenate([np.full(w - 1, 0, np.uint64), low, np.full(w - 1, 0, np.uint64)])
    most = ~_sliding_min(~pad, w)  # the largest window minimum among windows that hold the place
    return np.flatnonzero(h == most)


def seeds(own: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(h, tk, pos) of the chosen runs of words; own: tk, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = text.words(batch.column("text"))
            runs = text.kmers(h, k)
            places, counts = [], []
            for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
                at = winnow(runs[a : z - k + 1], w) if z - a >= k else np.zeros(0, np.int64)
                places.append(at + a)
                counts.append(len(at))
            at = np.concatenate(places) if places else np.zeros(0, np.int64)
            tk = np.repeat(batch.column("tk").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(runs[at].view(np.int64)), pa.array(tk), pa.array((at - np.repeat(first[:-1], counts)).astype(np.int32))], names=["h", "tk", "pos"])

    return own.select("tk", "text").mapInArrow(run, "h long, tk long, pos int")


class RangeMax:
    """Maxima over ranges of places, with the place that holds each; values come and go."""

    def __init__(self, n: int):
        self.n = n
        self.best = [(-np.inf, -1)] * (2 * n)

    def put(self, i: int, value: float) -> None:
        self._set(i, (value, i))

    def drop(self, i: int) -> None:
        self._set(i, (-np.inf, -1))

    def _set(self, i: int, x: tuple[float, int]) -> None:
        best = self.best
        i += self.n
        best[i] = x
        while i > 1:
            i >>= 1
            best[i] = max(best[2 * i], best[2 * i + 1])

    def among(self, lo: int, hi: int) -> tuple[float, int]:
        """Of the places from lo up to hi, without hi."""
        out, best = (-np.inf, -1), self.best
        lo, hi = lo + self.n, hi + self.n
        while lo < hi:
            if lo & 1:
                out = max(out, best[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                out = max(out, best[hi])
            lo >>= 1
            hi >>= 1
        return out


def diagonals(a: np.ndarray, b: np.ndarray, k: int = K, w: int = W) -> np.ndarray:
    """Matches (places in both texts) as segments (a0, b0, length): neighbours on one diagonal are one."""
    order = np.lexsort((b, a - b))
    a, b = a[order], b[order]
    new = np.append(True, ((a - b)[1:] != (a - b)[:-1]) | (np.diff(b) > k + w))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(a)) - 1
    return np.stack([a[at], b[at], b[last] - b[at] + k], axis=1)


def _scores(segments: np.ndarray, gap_cost: float, max_gap: int) -> tuple[list[float], list[int]]:
    """For each segment, in order of starts in b, the score of the best chain that ends with it, and its predecessor there (or -1).

    The tree holds the segments that end within ``max_gap`` before the place in b, by their ends in a.
    """
    a0, b0, n = segments.T
    by_end = np.argsort(a0 + n, kind="stable")
    leaf = np.empty(len(n), dtype=np.int64)
    leaf[by_end] = np.arange(len(n))
    low = np.searchsorted((a0 + n)[by_end], a0 - max_gap).tolist()
    high = np.searchsorted((a0 + n)[by_end], a0, "right").tolist()
    tree = RangeMax(len(n))
    score, before = n.astype(float).tolist(), [-1] * len(n)
    order, leaf, by_end = np.argsort(b0 + n, kind="stable").tolist(), leaf.tolist(), by_end.tolist()
    end, start, b0 = (b0 + n).tolist(), (a0 + b0).tolist(), b0.tolist()
    past = (a0 + n).tolist()
    put = gone = 0
    for j in range(len(end)):
        while put < len(order) and end[order[put]] <= b0[j]:
            i = order[put]
            tree.put(leaf[i], score[i] + gap_cost * (past[i] + end[i]))
            put += 1
        while gone < put and end[order[gone]] < b0[j] - max_gap:
            tree.drop(leaf[order[gone]])
            gone += 1
        value, i = tree.among(low[j], high[j])
        if i >= 0 and value - gap_cost * start[j] > 0:
            score[j] += value - gap_cost * start[j]
            before[j] = by_end[i]
    return score, before


def _greedy(segments: np.ndarray, gap_cost: float, max_gap: int) -> list[tuple[float, int, list[int]]]:
    """(score less than 0, last segment, segments) of each chain: the best, then the best of what is left; segments in order of starts in b."""
    found, part = [], np.arange(len(segments))
    while len(part):
        score, before = _scores(segments[part], gap_cost, max_gap)
        used = [False] * len(part)
        for j in sorted(range(len(part)), key=lambda k: (-score[k], k)):
            if used[j]:
                continue
            chain, i = [], j
            while i >= 0 and not used[i]:
                chain.append(i)
                i = before[i]
            if i >= 0:  # a better chain has it: what is left is chained again
                break
            for x in chain:
                used[x] = True
            found.append((-score[j], int(part[j]), part[chain[::-1]].tolist()))
        part = part[~np.array(used)]
    return found


def _outer(found: list[tuple[float, int, list[int]]], segments: np.ndarray, least: int) -> list[np.ndarray]:
    """Of chains as ``_greedy`` gives them, best first, those that span ``least`` words or more and don't lie within a better one."""
    out: list[np.ndarray] = []
    for _, _, at in sorted(found, key=lambda x: x[:2]):
        c = segments[at]
        a0, b0, a1, b1 = c[0, 0], c[0, 1], c[-1, 0] + c[-1, 2], c[-1, 1] + c[-1, 2]
        if min(a1 - a0, b1 - b0) >= least and not any(a0 >= o[0, 0] and b0 >= o[0, 1] and a1 <= o[-1, 0] + o[-1, 2] and b1 <= o[-1, 1] + o[-1, 2] for o in out):
            out.append(c)
    return out


def chains(segments: np.ndarray, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP, least: int = 0) -> list[np.ndarray]:
    """Collinear chains that share no segment, best first: the best of all, then the best of the segments left, and so on.

    Chains that span fewer than ``least`` words of either text, or lie within a better chain on both sides, are left out.
    """
    segments = segments[np.lexsort((segments[:, 0], segments[:, 1]))]
    found: list[tuple[float, int, list[int]]] = []
    # No chain reaches over a stretch of b without segments that is longer than a gap.
    upto = np.maximum.accumulate(segments[:, 1] + segments[:, 2])
    for part in np.split(np.arange(len(segments)), np.flatnonzero(segments[1:, 1] - upto[:-1] > max_gap) + 1):
        if min((segments[part, x] + segments[part, 2]).max() - segments[part, x].min() for x in (0, 1)) >= least:
            found += [(score, int(part[j]), part[at].tolist()) for score, j, at in _greedy(segments[part], gap_cost, max_gap)]
    return _outer(found, segments, least)


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: which count each of their sum stands for, and its number there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _best_first(i: list[int], j: list[int], ends: list[float], starts: list[float], n: list[int], leaf: list[int], score: list[float], before: list[int]) -> list[tuple[float, int, list[int]]]:
    """As ``_greedy``, from the links (i, j) of the segments and the scores of all: only what followed a chain that is taken is scored again."""
    behind: list[list[int]] = [[] for _ in n]
    ahead: list[list[int]] = [[] for _ in n]
    for x, y in zip(i, j):
        behind[y].append(x)
        ahead[x].append(y)
    left, found = [True] * len(n), []
    value = [s + e for s, e in zip(score, ends)]  # to those that follow
    order = [(-s, k) for k, s in enumerate(score)]
    heapq.heapify(order)
    while order:
        s, k = heapq.heappop(order)
        if not left[k] or -s != score[k]:
            continue
        chain = []
        while k >= 0:
            chain.append(k)
            left[k], value[k] = False, -np.inf
            k = before[k]
        found.append((s, chain[0], chain[::-1]))
        again = [y for x in chain for y in ahead[x] if left[y] and before[y] == x]
        heapq.heapify(again)
        while again:
            y = heapq.heappop(again)
            best, x = -np.inf, -1
            for k in behind[y]:
                if value[k] >= best and (value[k] > best or x < 0 or leaf[k] > leaf[x]):
                    best, x = value[k], k
            fits = best - starts[y] > 0
            own = n[y] + (best - starts[y]) if fits else float(n[y])
            before[y] = x if fits else -1
            if own != score[y]:
                score[y], value[y] = own, own + ends[y]
                heapq.heappush(order, (-own, y))
                for z in ahead[y]:
                    if left[z] and before[z] == y:
                        heapq.heappush(again, z)
    return found


def _links(of: np.ndarray, segments: np.ndarray, max_gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all segments j that may follow i in a chain, in order of j; of: the pair of each segment, in order."""
    a0, b0, n = segments.T
    wide = int((segments[:, :2] + n[:, None]).max()) + max_gap + 2
    near = []
    for start in (a0, b0):
        key = of * wide + start + n
        order = np.argsort(key, kind="stable")
        key = key[order]
        low = np.searchsorted(key, of * wide + np.maximum(start - max_gap, 0))
        near.append((order, low, np.searchsorted(key, of * wide + start, "right") - low))
    # By ends in a or in b, whichever leaves fewer to be tried.
    by_a = near[0][2] < near[1][2]
    found = []
    for (order, low, count), own in zip(near, (by_a, ~by_a)):
        own = own.nonzero()[0]
        cut = np.searchsorted(np.cumsum(count[own]), np.arange(TRIED, int(count[own].sum()) + TRIED, TRIED))
        for part in np.split(own, np.unique(cut)):
            at, k = _spread(count[part])
            j = part[at]
            i = order[low[j] + k]
            ga, gb = a0[j] - a0[i] - n[i], b0[j] - b0[i] - n[i]
            fit = (ga >= 0) & (ga <= max_gap) & (gb >= 0) & (gb <= max_gap)
            found.append((i[fit], j[fit]))
    i, j = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(j, kind="stable")
    return i[order], j[order]


def many_chains(of: np.ndarray, segments: np.ndarray, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP, least: int = LEAST_SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same chains as ``chains`` gives for each pair, for many pairs at once: their pairs, numbers of segments, and all segments; of: the pair of each segment.

    Scores of all pairs grow link by link together. Where no segment has two that follow it, the chains are the paths; all else is left to ``_best_first``.
    """
    order = np.lexsort((segments[:, 0], segments[:, 1], of))
    of, segments = of[order], segments[order]
    i, j = _links(of, segments, max_gap)
    # A segment by itself that is too short is no chain and in none.
    kept = segments[:, 2] >= least
    kept[i] = kept[j] = True
    new = np.cumsum(kept) - 1
    of, segments, i, j = of[kept], segments[kept], new[i], new[j]
    if not len(of):
        return of, of, segments
    a0, b0, n = segments.T
    ends, starts = gap_cost * (a0 + b0 + 2 * n), gap_cost * (a0 + b0)
    leaf = np.empty(len(n), np.int64)
    leaf[np.lexsort((np.arange(len(n)), a0 + n))] = np.arange(len(n))
    score, before = n.astype(float), np.full(len(n), -1)
    live = np.ones(len(j), bool)
    while live.any():
        # Segments that follow one whose score has changed.
        x, y = i[live], j[live]
        first = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
        value = score[x] + ends[x]
        best = np.maximum.reduceat(value, first)
        size = np.diff(np.append(first, len(y)))
        top = np.maximum.reduceat(np.where(value == np.repeat(best, size), leaf[x], -1), first)
        y = y[first]
        gain = best - starts[y]
        after = np.where(gain > 0, n[y] + gain, n[y].astype(float))
        by_leaf = np.empty(len(n), np.int64)
        by_leaf[leaf] = np.arange(len(n))
        before[y] = np.where(gain > 0, by_leaf[top], -1)
        changed = np.zeros(len(n), bool)
        changed[y] = after != score[y]
        score[y] = after
        if not changed.any():
            break
        touched = np.zeros(len(n), bool)
        touched[j[changed[i]]] = True
        live = touched[j]
    linked = before >= 0
    follows = np.bincount(before[linked], minlength=len(n))
    odd = follows > 1
    odd[linked] |= score[linked] <= score[before[linked]]
    pairs = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    sizes = np.diff(np.append(pairs, len(of)))
    plain = ~np.repeat(np.logical_or.reduceat(odd, pairs), sizes)
    # Paths from their ends, a step at a time.
    here = tail = np.flatnonzero(plain & (follows == 0))
    steps = []
    while len(here):
        steps.append((tail, here))
        on = before[here] >= 0
        here, tail = before[here[on]], tail[on]
    kept_pairs, sizes_kept, at = ([np.zeros(0, np.int64)] for _ in range(3))
    found: list[tuple[int, np.ndarray]] = []
    if steps:
        t, h = (np.concatenate(x) for x in zip(*steps))
        turn = np.repeat(np.arange(len(steps)), [len(x) for x, _ in steps])
        order = np.lexsort((-turn, t))
        t, h = t[order], h[order]
        cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        size = np.diff(np.append(cut, len(t)))
        last = h[cut + size - 1]
        long = np.minimum(a0[last] - a0[h[cut]], b0[last] - b0[h[cut]]) + n[last] >= least
        cut, size, last = cut[long], size[long], last[long]
        pair = of[last]
        alone = np.append(True, pair[1:] != pair[:-1]) & np.append(pair[1:] != pair[:-1], True) if len(pair) else long[long]
        chain, k = _spread(size[alone])
        kept_pairs.append(pair[alone])
        sizes_kept.append(size[alone])
        at.append(h[cut[alone][chain] + k])
        several: dict[int, list] = {}
        for p, c, z in zip(pair[~alone].tolist(), cut[~alone].tolist(), (cut + size)[~alone].tolist()):
            several.setdefault(p, []).append((-score[h[z - 1]], int(h[z - 1]), h[c:z].tolist()))
        found += [(p, c) for p, own in several.items() for c in _outer(own, segments, least)]
    odd = ~plain[pairs]
    for s, z in zip(pairs[odd].tolist(), (pairs + sizes)[odd].tolist()):
        own = slice(*np.searchsorted(j, (s, z)).tolist())
        best = _best_first((i[own] - s).tolist(), (j[own] - s).tolist(), *(v[s:z].tolist() for v in (ends, starts, n, leaf, score)), np.where(before[s:z] >= 0, before[s:z] - s, -1).tolist())
        found += [(int(of[s]), c) for c in _outer(best, segments[s:z], least)]
    kept_pairs.append(np.array([p for p, _ in found], np.int64))
    sizes_kept.append(np.array([len(c) for _, c in found], np.int64))
    return np.concatenate(kept_pairs), np.concatenate(sizes_kept), np.concatenate([segments[np.concatenate(at)], *(c for _, c in found)])


def _exact_chains(matches: DataFrame) -> DataFrame:
    """Candidate chains of each pair: a, b, spans and segments; matches: a, apos, b, bpos of runs of MIN_WORDS words, of which each stretch on a diagonal is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cols):
            a, b, apos, bpos = cols
            cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            rows: list[tuple] = []
            for s, z in zip(cut.tolist(), np.append(cut[1:], len(a)).tolist()):
                for c in diagonals(apos[s:z].astype(np.int64), bpos[s:z].astype(np.int64), MIN_WORDS, 0)[:, None]:
                    rows.append((int(a[s]), int(b[s]), int(c[0, 0]), int(c[-1, 0] + c[-1, 2]), int(c[0, 1]), int(c[-1, 1] + c[-1, 2]), c.astype("<i4").tobytes()))
            return _batch(rows, "a b a0 a1 b0 b1 segments", pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary())

        held = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            a, b = cols[:2]
            if not len(a):
                continue
            at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[-1]
            if at:
                yield found([c[:at] for c in cols])
            held = [c[at:] for c in cols]
        if held is not None:
            yield found(held)

    # They lie on one diagonal, so a pair that repeats a passage many times is dealt out by them.
    dealt = matches.select("a", "b", "apos", "bpos").repartition("a", "b", F.col("apos") - F.col("bpos")).sortWithinPartitions("a", "b")
    return dealt.mapInArrow(run, "a long, b long, a0 int, a1 int, b0 int, b1 int, segments binary")


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """Words that stand in both in order (longest common subsequence), a row of the table at a time, as bits of one number."""
    if not len(x) or not len(y):
        return 0
    where: dict[int, int] = {}
    for i, v in enumerate(y.tolist()):
        where[v] = where.get(v, 0) | 1 << i
    whole = row = (1 << len(y)) - 1  # a bit is 0 where the row's value grows
    for v in x.tolist():
        if met := row & where.get(v, 0):
            row = ((row + met) | (row - met)) & whole
    return len(y) - row.bit_count()


def _grow(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    off = np.flatnonzero(x[:n] != y[:n])
    return int(off[0]) if len(off) else n


def align(x: np.ndarray, y: np.ndarray, segments: np.ndarray) -> tuple[int, int, int, int, float]:
    """Spans in x and y and identity of a chain; segments: places in x and y, and length."""
    back = _grow(x[: segments[0, 0]][::-1], y[: segments[0, 1]][::-1])
    x0, y0 = int(segments[0, 0]) - back, int(segments[0, 1]) - back
    px, py, same = x0, y0, 0
    for a, b, n in segments.tolist():
        if a < px or b < py:  # grown into by the one before
            d = max(px - a, py - b)
            a, b, n = a + d, b + d, n - d
            if n <= 0:
                continue
        # The segment before grew to the right; what is left between is aligned.
        same += agreeing(x[px:a], y[py:b])
        same += int((x[a : a + n] == y[b : b + n]).sum())  # on one diagonal
        px, py = a + n, b + n
        d = _grow(x[px:], y[py:])
        px, py, same = px + d, py + d, same + d
    return x0, px, y0, py, same / max(px - x0, py - y0)


def _agree(w: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """How many of the n words from i, and from j, agree before the first that don't; step: 1 forwards, -1 backwards."""
    of, k = _spread(n)
    off = w[i[of] + step * k] != w[j[of] + step * k]
    out = n.copy()
    np.minimum.at(out, of[off], k[off])
    return out


def many_agreeing(w: np.ndarray, i: np.ndarray, ni: np.ndarray, j: np.ndarray, nj: np.ndarray) -> np.ndarray:
    """As ``agreeing``, of the ni words from each i and the nj (64 at most) from each j; a step takes one word of all."""
    order = np.argsort(-ni, kind="stable")
    i, ni, j, nj = i[order], ni[order], j[order], nj[order]
    bits = np.arange(64)
    whole = np.uint64(2**64 - 1) >> (64 - nj).astype(np.uint64)
    there = w[np.minimum(j[:, None] + bits, len(w) - 1)]
    row = whole.copy()
    for k in range(int(ni.max(initial=0))):
        n = int(np.searchsorted(-ni, -k))  # those with more than k words
        met = np.packbits(there[:n] == w[i[:n] + k][:, None], axis=1, bitorder="little").view("<u8")[:, 0] & row[:n]
        row[:n] = ((row[:n] + met) | (row[:n] - met)) & whole[:n]
    out = np.empty(len(i), np.int64)
    out[order] = nj - np.bitwise_count(row)
    return out


def many_aligned(w: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, sizes: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans and identities, as of ``align``, of many chains, whose ends grow by MARGIN words at most.

    w: words of all texts; x, y, nx, ny: where each chain's texts begin in them, and their lengths; sizes: numbers of segments.
    """
    of = np.repeat(np.arange(len(sizes)), sizes)
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    a, b, n = segments.T
    i, j = x[of] + a, y[of] + b
    same = np.zeros(len(n), np.int64)
    for part in _parts(n):  # on one diagonal
        at, k = _spread(n[part])
        same[part] = np.bincount(at[w[i[part][at] + k] == w[j[part][at] + k]], minlength=len(part))
    # Between two segments: words that agree after the one before, then before the next, then the rest by least edits.
    s = np.flatnonzero(np.append(of[1:] == of[:-1], False))
    ga, gb = a[s + 1] - a[s] - n[s], b[s + 1] - b[s] - n[s]
    both = np.minimum(ga, gb)
    after = _agree(w, i[s] + n[s], j[s] + n[s], both, 1)
    # The segment before may grow into the next one: such chains go one by one.
    into = (after == both) & (w[i[s] + n[s] + after] == w[j[s] + n[s] + after])
    until = _agree(w, i[s + 1] - 1, j[s + 1] - 1, both - after, -1)
    same[s] += after + until
    ra, rb = ga - after - until, gb - after - until
    rest = np.flatnonzero((ra > 0) & (rb > 0) & (ra + rb > 2))
    for part in np.split(rest, range(GAPS, len(rest), GAPS)):
        same[s[part]] += many_agreeing(w, (i[s] + n[s] + after)[part], ra[part], (j[s] + n[s] + after)[part], rb[part])
    a1, b1 = a[last] + n[last], b[last] + n[last]
    back = _agree(w, i[first] - 1, j[first] - 1, np.minimum(MARGIN, np.minimum(a[first], b[first])), -1)
    on = _agree(w, x + a1, y + b1, np.minimum(MARGIN, np.minimum(nx - a1, ny - b1)), 1)
    total = np.add.reduceat(same, first) + back + on if len(first) else first
    x0, x1, y0, y1 = a[first] - back, a1 + on, b[first] - back, b1 + on
    share = total / np.maximum(x1 - x0, y1 - y0)
    for c in np.unique(of[s[into]]).tolist():
        own = segments[first[c] : last[c] + 1]
        la, lb = np.maximum(own[0, :2] - MARGIN, 0)
        u, v = w[x[c] + la : x[c] + min(nx[c], a1[c] + MARGIN)], w[y[c] + lb : y[c] + min(ny[c], b1[c] + MARGIN)]
        p0, p1, q0, q1, share[c] = align(u, v, own - np.array([la, lb, 0]))
        x0[c], x1[c], y0[c], y1[c] = p0 + la, p1 + la, q0 + lb, q1 + lb
    return x0, x1, y0, y1, share


def _aligned(one: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reported passages (b, start, end, a, other_start, other_end, identity) of candidate chains; one: tk, text. Stored."""
    ask = F.explode(F.array(F.struct(F.col("a").alias("tk"), F.lit(0).alias("side"), F.col("a0").alias("lo"), F.col("a1").alias("hi")), F.struct(F.col("b").alias("tk"), F.lit(1).alias("side"), F.col("b0").alias("lo"), F.col("b1").alias("hi"))))
    asked = wanted.select("cid", ask.alias("r")).select("cid", "r.*").withColumn("chunk", F.lit(None).cast("long"))
    often = common.stored(asked.groupBy("tk").agg(F.ceil(F.count("*") / TOGETHER).alias("chunks")), "slice-chunks")
    asked = common.salted_join(asked.drop("chunk"), often, "tk", "cid").groupBy("tk", F.pmod(F.xxhash64("cid"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct("cid", "side", "lo", "hi")).alias("asked"))
    asked = common.stored(asked, "slices-asked")
    common.discard(often)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, side, low, data = [], [], [], []
            h, first = text.words(batch.column("text"))
            h32 = (h >> np.uint64(32)).astype("<u4")
            for i, requests in enumerate(batch.column("asked").to_pylist()):
                words = h32[first[i] : first[i + 1]]
                for r in requests:
                    lo = max(0, r["lo"] - MARGIN)
                    cid.append(r["cid"])
                    side.append(r["side"])
                    low.append(lo)
                    data.append(words[lo : r["hi"] + MARGIN].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(side, pa.int32()), pa.array(low, pa.int32()), pa.array(data, pa.binary())], names=["cid", "side", "low", "words"])

    few = wanted.count() <= BROADCAST_CHAINS  # then the requests are a few tens of MB
    cut = one.join(F.broadcast(asked) if few else asked, "tk").select("text", "asked").mapInArrow(slices, "cid long, side int, low int, words binary")
    segments = wanted.select("cid", F.lit(-1).alias("side"), F.lit(0).alias("low"), F.col("segments").alias("words"), "a", "b")
    both = cut.withColumn("a", F.lit(None).cast("long")).withColumn("b", F.lit(None).cast("long")).unionByName(segments)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            rows: list[tuple] = []
            for cid, side, low, words, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if side == -1:
                    seen = {"cid": cid, "a": a, "b": b, -1: np.frombuffer(words, "<i4").reshape(-1, 3).astype(np.int64)}
                    continue
                if seen.get("cid") != cid or side in seen:  # a row that repeats a document
                    continue
                seen[side] = (low, np.frombuffer(words, "<u4"))
                if 0 in seen and 1 in seen:
                    (la, x), (lb, y) = seen[0], seen[1]
                    x0, x1, y0, y1, same = align(x, y, seen[-1] - np.array([la, lb, 0]))
                    if min(x1 - x0, y1 - y0) >= MIN_WORDS and same >= IDENTITY:
                        rows.append((seen["b"], y0 + lb, y1 + lb, seen["a"], x0 + la, x1 + la, round(same, 6)))
            yield _batch(rows, PASSAGE, *KINDS)

    aligned = both.select("cid", "side", "low", "words", "a", "b").repartition("cid").sortWithinPartitions("cid", "side").mapInArrow(compare, SPANS)
    return common.stored(aligned, "aligned")


def _areas(marks: DataFrame, reported: DataFrame) -> DataFrame:
    """(tk, lo, hi, known) of stretches of words that may hold a shared run of MIN_WORDS words.

    Every seed of such a run is shared, and neighbouring seeds are at most W places apart;
    marks: tk, pos of all shared seeds. ``known`` has the spans that are reported of the text
    (bytes of pairs of int32), ``left`` tells whether a run may stand outside them. Stored.
    """
    spans = reported.select(F.col("b").alias("tk"), "start", "end").unionByName(reported.select(F.col("a").alias("tk"), F.col("other_start").alias("start"), F.col("other_end").alias("end")))
    spans = spans.groupBy("tk", "start").agg(F.max("end").alias("end")).groupBy("tk").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for tk, pos, spans in zip(*(batch.column(c) for c in ("tk", "pos", "spans"))):
                at = np.unique(pos.values.to_numpy())
                cut = np.flatnonzero(np.append(True, np.diff(at) > W))
                lo = np.maximum(0, at[cut] - W + 1)
                hi = at[np.append(cut[1:], len(at)) - 1] + W - 1 + K
                fit = hi - lo >= MIN_WORDS
                if not fit.any():
                    continue
                lo, hi = lo[fit], hi[fit]
                known = np.zeros((0, 2), np.int64)
                if spans.is_valid and len(spans.values):
                    known = np.stack([spans.values.field(x).to_numpy() for x in ("start", "end")], axis=1).astype(np.int64)
                wanted = _starts(lo, hi, int(hi[-1]))
                left = bool((wanted & ~_starts(*known.T, int(hi[-1]))).any())
                rows.append((tk.as_py(), np.stack([lo, hi], axis=1).astype("<i4").tobytes(), known.astype("<i4").tobytes(), left))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.bool_()))], names=["tk", "areas", "known", "left"])

    held = marks.groupBy("tk").agg(F.collect_list("pos").alias("pos")).join(spans, "tk", "left")
    return common.stored(held.select("tk", "pos", "spans").mapInArrow(run, "tk long, areas binary, known binary, left boolean"), "areas")


def _starts(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Of n places, those where a run of MIN_WORDS words begins that lies within one of the spans."""
    lo, last = np.asarray(lo, np.int64), np.asarray(hi, np.int64) - MIN_WORDS + 1
    fit = (last > lo) & (lo < n)
    step = np.bincount(lo[fit], minlength=n + 1)[: n + 1] - np.bincount(np.minimum(last[fit], n), minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


def _stretches(h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal hashes at even steps that overlap (a repeated word, say) as one: order of the places, where stretches start in it, their steps and lengths."""
    order = np.lexsort((pos, h))
    h, pos = h[order], pos[order]
    gap = np.diff(pos)
    same = (h[1:] == h[:-1]) & (gap <= MIN_WORDS)
    new = np.append(True, ~same)[: len(h)]
    new[2:] |= same[1:] & same[:-1] & (gap[1:] != gap[:-1])
    at = np.flatnonzero(new)
    reps = np.diff(np.append(at, len(h)))
    step = np.where(reps > 1, np.append(gap, 0)[at] if len(h) else 0, 0)
    return order, at, step, reps


def _left_over(one: DataFrame, areas: DataFrame) -> DataFrame:
    """Matches (a, apos, b, bpos) of runs of MIN_WORDS words that texts share and that are not yet reported of some text.

    Every such occurrence meets an occurrence in one other text: the text where the run is repeated
    most (that text itself meets the one of least or of greatest key). Repeats meet repeats in step, so that
    a text that says one word a thousand times has long matches, not a thousand short ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = text.words(batch.column("text"))
            runs = text.kmers(h, MIN_WORDS)
            areas, known = batch.column("areas").to_pylist(), batch.column("known").to_pylist()
            cols: list[list] = [[] for _ in range(6)]
            for i, (f, l) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                n = max(0, l - f - MIN_WORDS + 1)
                lo, hi = np.frombuffer(areas[i], "<i4").reshape(-1, 2).T
                here = np.flatnonzero(_starts(lo, hi, n))
                if not len(here):
                    continue
                left = ~_starts(*np.frombuffer(known[i], "<i4").reshape(-1, 2).T, n)[here]
                own = runs[here + f]
                order, at, step, reps = _stretches(own, here)
                for col, v in zip(cols, (own[order][at], np.full(len(at), i), here[order][at], step, reps, np.logical_or.reduceat(left[order], at))):
                    col.append(v)
            own, of, pos, step, reps, left = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(cols, (np.uint64, np.int64, np.int64, np.int64, np.int64, bool)))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), batch.column("tk").take(pa.array(of)), *(pa.array(x.astype(np.int32)) for x in (pos, step, reps)), pa.array(left)], names=["h", "tk", "pos", "step", "reps", "open"])

    found = common.stored(one.join(areas, "tk").select("tk", "text", "areas", "known").mapInArrow(run, "h long, tk long, pos int, step int, reps int, open boolean"), "runs")
    fields = ("tk", "pos", "step", "reps")
    place = F.struct(*fields)
    ends = found.groupBy("h").agg(F.max(F.struct("reps", "tk", "pos", "step")).alias("m"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.count(F.when(F.col("open"), 1)).alias("rows")).where("rows > 0 and lo.tk < hi.tk")
    ends = ends.select("h", F.struct(*(F.col(f"m.{c}").alias(c) for c in fields)).alias("l"), F.when(F.col("m.tk") == F.col("lo.tk"), F.col("hi")).otherwise(F.col("lo")).alias("z"), "rows")
    ends = common.stored(ends, "run-ends")
    met = common.skew_join(found.where("open"), ends, "h", "rows").withColumn("p", F.when(F.col("tk") != F.col("l.tk"), F.col("l")).otherwise(F.col("z")))
    met = met.select("tk", "pos", "step", "p", F.explode(F.sequence(F.lit(0), F.col("reps") - 1)).alias("j"))
    own = F.struct("tk", (F.col("pos") + F.col("j") * F.col("step")).alias("pos"))
    other = F.struct(F.col("p.tk").alias("tk"), (F.col("p.pos") + F.col("j") % F.col("p.reps") * F.col("p.step")).alias("pos"))
    less = F.col("p.tk") < F.col("tk")
    met = met.select(F.when(less, other).otherwise(own).alias("x"), F.when(less, own).otherwise(other).alias("y"))
    met = met.select(F.col("x.tk").alias("a"), F.col("x.pos").alias("apos"), F.col("y.tk").alias("b"), F.col("y.pos").alias("bpos"))
    out = common.stored(met.distinct(), "left-over")
    common.discard(found, ends)
    return out


def _long_stretches(h: pa.ListScalar, at: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, seeds, start of the stretch of each) of a text's seeds at most REACH words apart in stretches of LEAST_SPAN words or more."""
    at = at.values
    pos = at.flatten().to_numpy().astype(np.int64)
    order = np.argsort(pos, kind="stable")
    pos, own = pos[order], np.repeat(h.values.to_numpy(), np.diff(at.offsets.to_numpy()))[order]
    cut = np.flatnonzero(np.append(True, np.diff(pos) > REACH))
    size = np.diff(np.append(cut, len(pos)))
    long = np.repeat(pos[cut + size - 1] - pos[cut] + K >= LEAST_SPAN, size)
    return pos[long], own[long], np.repeat(pos[cut], size)[long]


def _batch(rows: list[tuple], names: str, *kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names.split())


def _contents(one: DataFrame, held: DataFrame) -> DataFrame:
    """(tk, lo, e0, e1, c): stretches of wide spread seeds, from word e0 up to e1, and a hash of these words. Stored.

    A stretch is extended by neighbouring runs of K words as long as another text has them in or beside a stretch. No passage
    that such seeds alone give leaves it, as every word that a chain grows by ends a run of K words of both texts (and
    after W of them there were another common seed). So texts of equal contents have the same passages there,
    and a stretch of fewer than MIN_WORDS words has none. held: tk, hs, ats; one: tk, text.
    """
    long, int32 = pa.int64(), pa.int32()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for tk, h, at in zip(batch.column("tk").to_pylist(), batch.column("hs"), batch.column("ats")):
                pos, _, stretch = _long_stretches(h, at)
                if len(pos):
                    last = np.append(np.flatnonzero(np.diff(stretch)), len(pos) - 1)
                    rows.append((tk, stretch[last].tolist(), (pos[last] + K).tolist()))
            yield _batch(rows, "tk los his", long, pa.list_(int32), pa.list_(int32))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = text.words(batch.column("text"))
            rows: list[tuple] = []
            for i, (tk, los, his) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tk", "los", "his")))):
                own = h[first[i] : first[i + 1]]
                rows += [(tk, lo, hi, max(0, lo - W), own[max(0, lo - W) : hi + W].tobytes()) for lo, hi in zip(los, his)]
            yield _batch(rows, "tk lo hi start words", long, int32, int32, int32, pa.binary())

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            for i, (lo, hi, start, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "start", "words")))):
                w = np.frombuffer(data, np.uint64)
                run = text.kmers(w, K)[: len(w) - K + 1].view(np.int64)
                place = start + np.arange(len(run))
                for col, v in zip(cols, (run, np.full(len(run), i), place, (place < lo) | (place > hi - K))):
                    col.append(v)
            run, of, place, beside = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(cols, (np.int64, np.int64, np.int64, bool)))
            yield pa.RecordBatch.from_arrays([pa.array(run), *(batch.column(c).take(pa.array(of)) for c in ("tk", "lo")), pa.array(place.astype(np.int32)), pa.array(beside)], names=["run", "tk", "lo", "place", "beside"])

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for tk, lo, hi, start, data, places in zip(*(batch.column(c).to_pylist() for c in ("tk", "lo", "hi", "start", "words", "places"))):
                beside, e0, e1 = set(places or ()), lo, hi
                while e0 - 1 in beside:
                    e0 -= 1
                while e1 - K + 1 in beside:
                    e1 += 1
                if e1 - e0 >= MIN_WORDS:
                    rows.append((tk, lo, e0, e1, data[8 * (e0 - start) : 8 * (e1 - start)]))
            yield _batch(rows, "tk lo e0 e1 words", long, int32, int32, int32, pa.binary())

    where = common.sized(common.stored(held.mapInArrow(spans, "tk long, los array<int>, his array<int>"), "wide-stretches"), common.BROADCAST_KEYS)
    areas = common.stored(one.join(where, "tk").select("tk", "text", "los", "his").mapInArrow(words, "tk long, lo int, hi int, start int, words binary"), "wide-words").dropDuplicates(["tk", "lo"])
    beside = common.stored(areas.mapInArrow(runs, "run long, tk long, lo int, place int, beside boolean"), "wide-runs")
    met = beside.groupBy("run").agg(F.min("tk").alias("x"), F.max("tk").alias("y"), F.max("beside").alias("any")).where("x < y AND any").select("run")
    places = beside.where("beside").join(met, "run").groupBy("tk", "lo").agg(F.collect_list("place").alias("places"))
    out = areas.join(places, ["tk", "lo"], "left").select("tk", "lo", "hi", "start", "words", "places").mapInArrow(extended, "tk long, lo int, e0 int, e1 int, words binary")
    out = common.stored(out.select("tk", "lo", "e0", "e1", F.xxhash64("words").alias("c")), "wide-contents")
    common.discard(beside)
    return out


def _close_seeds(held: DataFrame) -> DataFrame:
    """(h1, h2, tk, at, size): wide spread seeds of a text at most REACH words apart, in order, in the stretches that begin at ``los``. Stored.

    A seed that stands in each of these stretches as one run of neighbouring places (one word said again and again) doesn't
    meet itself: its longest run, if of LEAST_SPAN words or more, has its place and size, and h1 = h2. All else has null there.
    held: tk, hs, ats, los.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: list[int] = []
            rows: list[tuple] = []
            for i, (h, at, los) in enumerate(zip(batch.column("hs"), batch.column("ats"), batch.column("los"))):
                pos, own, stretch = _long_stretches(h, at)
                kept = np.isin(stretch, los.values.to_numpy())
                pos, own, stretch = pos[kept], own[kept], stretch[kept]
                if not len(pos):
                    continue
                known, own = np.unique(own, return_inverse=True)
                both, shift = [np.zeros(0, np.int64)], 1
                while shift < len(pos) and len(near := np.flatnonzero(pos[shift:] - pos[:-shift] <= REACH)):
                    both.append((own[near] * len(known) + own[near + shift])[own[near] != own[near + shift]])
                    shift += 1
                both = np.unique(np.concatenate(both))
                order = np.lexsort((pos, stretch, own))
                pos, own, stretch = pos[order], own[order], stretch[order]
                cut = np.flatnonzero(np.append(True, (np.diff(own) != 0) | (np.diff(stretch) != 0)))
                size = np.diff(np.append(cut, len(pos)))
                first, own = pos[cut], own[cut]
                apart = np.unique(own[pos[cut + size - 1] - first != size - 1])
                rows += [(x, y, None, None) for x, y in zip(known[both // len(known)].tolist(), known[both % len(known)].tolist())]
                rows += [(x, x, None, None) for x in known[apart].tolist()]
                # Of the other seeds, the longest run (ties: the first).
                order = np.lexsort((first, -size, own))
                order = order[np.append(True, np.diff(own[order]) != 0)]
                order = order[(size[order] + K - 1 >= LEAST_SPAN) & ~np.isin(own[order], apart)]
                rows += [(x, x, y, z + K - 1) for x, y, z in zip(known[own[order]].tolist(), first[order].tolist(), size[order].tolist())]
                of += [i] * (len(rows) - len(of))
            made = _batch(rows, "h1 h2 at size", pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*made.columns, batch.column("tk").take(pa.array(of, pa.int64()))], names=[*made.schema.names, "tk"])

    return common.stored(held.mapInArrow(run, "h1 long, h2 long, at int, size int, tk long"), "close-seeds")


def _copied(rows: DataFrame) -> DataFrame:
    """Candidate chains, as of ``_exact_chains``, of stretches of equal words; rows: a, apos, b, bpos, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, apos, b, bpos, n = (batch.column(c).to_pylist() for c in ("a", "apos", "b", "bpos", "n"))
            made = [(x, y, p, p + k, q, q + k, np.array([p, q, k], "<i4").tobytes()) for x, p, y, q, k in zip(a, apos, b, bpos, n)]
            yield _batch(made, "a b a0 a1 b0 b1 segments", pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary())

    return rows.select("a", "apos", "b", "bpos", "n").mapInArrow(run, "a long, b long, a0 int, a1 int, b0 int, b1 int, segments binary")


def _blocks(texts: DataFrame, size: int) -> DataFrame:
    """(tk, block): texts of one ``least`` text are dealt into blocks of ``size`` or so, or of SIDE_BYTES if they tell their sizes; texts: tk, least."""
    count = F.count("*") / size
    own = texts.groupBy("least").agg(F.ceil(F.greatest(count, F.sum("size") / SIDE_BYTES) if "size" in texts.columns else count).alias("blocks"))
    return texts.join(own, "least").select("tk", F.xxhash64("least", F.pmod(F.xxhash64("tk"), F.col("blocks"))).alias("block"))


def _all_pairs(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): texts that meet under a key, a < b. Stored. keyed: keys, tk.

    Texts that meet one text are dealt into blocks, and two blocks that share keys meet in one place, with the texts of
    these keys; so a pair is made once for KEYS of its keys, not once for each.
    """
    keyed = keyed.select(F.xxhash64(*keys).alias("k"), "tk").distinct()
    size = common.stored(keyed.groupBy("k").agg(F.count("*").alias("c"), F.min("tk").alias("least")).where("c > 1"), "pair-keys")
    kept = common.stored(common.skew_join(keyed, size, "k", "c"), "keyed-texts")
    block = common.stored(_blocks(kept.groupBy("tk").agg(F.min("least").alias("least")), BLOCK), "text-blocks")
    # A key's texts of one block are one row.
    own = common.stored(kept.join(block, "tk").groupBy("k", "block").agg(F.collect_list("tk").alias("tks")), "block-keys")
    x, y = (own.select("k", F.col("block").alias(b), F.col("tks").alias(t)) for b, t in (("x", "xs"), ("y", "ys")))
    met = x.join(y, "k").where("x < y OR x = y AND size(xs) > 1").select(F.xxhash64("x", "y").alias("cell"), "k", "xs", F.when(F.col("x") < F.col("y"), F.col("ys")).alias("ys"))

    def found(xs: list, ys: list) -> tuple[np.ndarray, np.ndarray]:
        def table(some: list) -> tuple[np.ndarray, np.ndarray]:
            tks, at = np.unique(np.concatenate(some), return_inverse=True)
            out = np.zeros((len(some), len(tks)), np.float32)
            out[np.repeat(np.arange(len(some)), [len(v) for v in some]), at] = 1
            return tks, out

        tx, u = table(xs)
        ty, v = table([x if y is None else y for x, y in zip(xs, ys)])
        i, j = np.nonzero(u.T @ v)
        a, b = tx[i], ty[j]
        if ys[0] is None:
            a, b = a[a < b], b[a < b]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, xs, ys = None, [], []
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 2]
            for cell, x, y in zip(batch.column("cell").to_pylist(), batch.column("xs"), batch.column("ys")):
                if xs and (cell != held or len(xs) >= KEYS):
                    out.append(found(xs, ys))
                    xs, ys = [], []
                held = cell
                xs.append(x.values.to_numpy())
                ys.append(y.values.to_numpy() if y.is_valid else None)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b"])
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found(xs, ys)], names=["a", "b"])

    out = common.stored(met.repartition("cell").sortWithinPartitions("cell").select("cell", "xs", "ys").mapInArrow(run, "a long, b long"), "keyed-pairs")
    common.discard(size, kept, block, own)
    return out


def text_pairs(one: DataFrame, own: DataFrame, many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b, of every two texts that may have a chain and aren't told by a copy; and copied stretches (a, apos, b, bpos, n).

    own: h, tk, at of shared seeds; many: h, texts of those of over PAIRED texts; one: tk, text. Stored.
    """
    wide_keys = common.sized(many.select("h"))
    few, wide = own.join(wide_keys, "h", "left_anti"), own.join(wide_keys, "h")

    # One text stands for all that have a stretch of equal words.
    held = wide.groupBy("tk").agg(F.collect_list(F.struct("h", "at")).alias("s")).select("tk", F.col("s.h").alias("hs"), F.col("s.at").alias("ats"))
    held = common.stored(held, "wide-places")
    contents = _contents(one, held)
    first = contents.groupBy("c").agg(F.min(F.struct("tk", "lo", "e0", "e1")).alias("r"))
    stand = first.groupBy(F.col("r.tk").alias("tk")).agg(F.collect_list("r.lo").alias("los"))
    close = _close_seeds(held.join(stand, "tk"))
    copies = contents.join(first, "c").where("tk <> r.tk").select(F.col("r.tk").alias("a"), F.col("r.e0").alias("apos"), F.col("tk").alias("b"), F.col("e0").alias("bpos"), F.expr("e1 - e0").alias("n"))
    # Of a word said again and again, the text with the longest run stands for those with one run.
    plain, full = close.where("at IS NOT NULL"), close.where("at IS NULL").select("h1", "h2", "tk")
    most = plain.groupBy("h1", "h2").agg(F.min_by(F.struct("tk", "at"), F.struct(-F.col("size"), "tk")).alias("m"))
    most = common.stored(most.select("h1", "h2", "m.*"), "longest-runs")
    runs = plain.join(most.select("h1", F.col("tk").alias("m"), F.col("at").alias("m_at")), "h1").where("m <> tk")
    ends = F.array_sort(F.array(F.struct("tk", "at"), F.struct(F.col("m").alias("tk"), F.col("m_at").alias("at"))))
    runs = runs.select(ends.alias("e"), "size").select(F.col("e")[0]["tk"].alias("a"), F.col("e")[0]["at"].alias("apos"), F.col("e")[1]["tk"].alias("b"), F.col("e")[1]["at"].alias("bpos"), F.col("size").alias("n"))

    met = few.select("h", F.col("tk").alias("a")).join(few.select("h", F.col("tk").alias("b")), "h").where("a < b").select("a", "b").distinct()
    pairs = met.unionByName(_all_pairs(full.unionByName(most.select(*full.columns)), ["h1", "h2"])).distinct()
    pairs = common.stored(pairs, "text-pairs")
    copies = common.stored(copies.unionByName(runs).distinct().join(pairs, ["a", "b"], "left_anti"), "copied-stretches")
    common.discard(held, contents, close, most)
    return pairs, copies


def _pair_cells(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cell, a, b): pairs with a cell that they share with others of the same texts, of SIDE ** 2 pairs or so at most. Stored.

    Texts are put together by the least text that each meets, as most of a family meet one, and dealt into
    blocks; a cell has the pairs of two blocks. sizes: tk, size.
    """
    texts = pairs.groupBy(F.col("b").alias("tk")).agg(F.min("a").alias("least")).unionByName(pairs.select(F.col("a").alias("tk"), F.col("a").alias("least")).distinct())
    texts = common.stored(texts.groupBy("tk").agg(F.min("least").alias("least")).join(sizes, "tk"), "paired-texts")
    x, y = (_blocks(texts, SIDE).select(F.col("tk").alias(t), F.col("block").alias(f"{t}_block")) for t in ("a", "b"))
    out = common.stored(pairs.join(x, "a").join(y, "b").select(F.xxhash64("a_block", "b_block").alias("cell"), "a", "b"), "pair-cells")
    common.discard(texts)
    return out


def _segments(h: np.ndarray, pos: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, segments) of the pairs of texts x, y, in parts; h, pos, of: seeds, their places and texts.

    A pair's matches are all its shared seeds; one that a text repeats has its first place in either text matched with every place in the other.
    """
    known, h = np.unique(h, return_inverse=True)
    order = np.lexsort((pos, h, of))
    h, pos, of = h[order], pos[order], of[order]
    once = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]) | (pos[1:] != pos[:-1]))  # rows that repeat a document
    h, pos, key = h[once], pos[once], of[once] * len(known) + h[once]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size, h, key = np.diff(np.append(first, len(key))), h[first], key[first]
    begin = np.searchsorted(key, x * len(known))
    tried = np.searchsorted(key, (x + 1) * len(known)) - begin
    for part in _parts(tried):
        pair, k = _spread(tried[part])
        i = begin[part][pair] + k
        wanted = y[part][pair] * len(known) + h[i]
        j = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        hit = key[j] == wanted
        pair, i, j = part[pair[hit]], i[hit], j[hit]
        n = size[i] + size[j] - 1
        cut = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else pair
        for some in _parts(np.add.reduceat(n, cut)) if len(cut) else ():
            own = slice(cut[some[0]], cut[some[-1] + 1] if some[-1] + 1 < len(cut) else len(n))
            m, k = _spread(n[own])
            i0, j0, nj, p = first[i[own]][m], first[j[own]][m], size[j[own]][m], pair[own][m]
            a, b = pos[i0 + np.maximum(k - nj + 1, 0)], pos[j0 + np.where(k < nj, k, 0)]
            order = np.lexsort((b, a - b, p))
            a, b, p = a[order], b[order], p[order]
            at = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | ((a - b)[1:] != (a - b)[:-1]) | (np.diff(b) > K + W)))
            last = np.append(at[1:], len(a)) - 1
            yield p[at], np.stack([a[at], b[at], b[last] - b[at] + K], axis=1)


def _parts(n: np.ndarray) -> list[np.ndarray]:
    """Numbers of neighbouring counts that make TRIED or so together."""
    return [x for x in np.split(np.arange(len(n)), np.unique(np.searchsorted(np.cumsum(n), np.arange(TRIED, int(n.sum()), TRIED)))) if len(x)]


def _paired(one: DataFrame, own: DataFrame, cells: DataFrame) -> DataFrame:
    """Reported passages, as of ``_aligned``, of all chains of each pair; own: h, tk, at of shared seeds; cells: cell, a, b; one: tk, text. Stored."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = text.words(batch.column("text"))
            h32 = (h >> np.uint64(32)).astype("<u4")
            said = [h32[s:z].tobytes() for s, z in zip(first[:-1].tolist(), first[1:].tolist())]
            seeds, places = [], []
            for h, at in zip(batch.column("hs"), batch.column("ats")):
                seeds.append(np.repeat(h.values.to_numpy(), np.diff(at.values.offsets.to_numpy())).tobytes())
                places.append(at.values.flatten().to_numpy().astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("tk"), *(pa.array(x, pa.binary()) for x in (said, seeds, places))], names=["tk", "words", "seeds", "places"])

    def found(texts: dict[int, tuple], a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        tks = np.array(sorted(texts), np.int64)
        held = [texts[t] for t in tks.tolist()]
        w, h, pos = (np.frombuffer(b"".join(x[i] for x in held), t) for i, t in enumerate(("<u4", "<i8", "<i4")))
        size = np.array([len(x[0]) // 4 for x in held])
        begin = np.cumsum(size) - size
        x, y = np.searchsorted(tks, a), np.searchsorted(tks, b)
        for pair, segments in _segments(h, pos.astype(np.int64), np.repeat(np.arange(len(tks)), [len(x[2]) // 4 for x in held]), x, y):
            pair, sizes, segments = many_chains(pair, segments)
            u, v = x[pair], y[pair]
            x0, x1, y0, y1, same = many_aligned(w, begin[u], begin[v], size[u], size[v], sizes, segments)
            fit = (np.minimum(x1 - x0, y1 - y0) >= MIN_WORDS) & (same >= IDENTITY)
            cols = [c[fit] for c in (b[pair], y0, y1, a[pair], x0, x1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, [round(x, 6) for x in same[fit].tolist()]], KINDS)], names=PASSAGE.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, tuple] = {}
        met: list[tuple[np.ndarray, np.ndarray]] = []
        size = pairs = 0
        for batch in batches:
            cell, b = batch.column("cell").to_numpy(), batch.column("b")
            cut = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            for s, z in zip(cut.tolist(), [*cut[1:].tolist(), len(cell)]):
                # Texts of a cell come before its pairs.
                n = b.slice(s, z - s).null_count
                if n and met and (size >= CELL_BYTES or pairs >= CELL_PAIRS):
                    yield from found(texts, *(np.concatenate(c) for c in zip(*met)))
                    texts, met, size, pairs = {}, [], 0, 0
                own = batch.slice(s, n)
                for tk, *data in zip(*(own.column(c).to_pylist() for c in ("a", "words", "seeds", "places"))):
                    if tk not in texts:
                        texts[tk] = tuple(data)
                        size += sum(map(len, data))
                if z > s + n:
                    met.append((batch.column("a").slice(s + n, z - s - n).to_numpy(), b.slice(s + n, z - s - n).to_numpy()))
                    pairs += z - s - n
        if met:
            yield from found(texts, *(np.concatenate(c) for c in zip(*met)))

    seeds = own.groupBy("tk").agg(F.collect_list(F.struct("h", "at")).alias("s")).select("tk", F.col("s.h").alias("hs"), F.col("s.at").alias("ats"))
    where = common.stored(cells.select(F.explode(F.array("a", "b")).alias("tk"), "cell").distinct(), "cell-texts")
    needed = where.select("tk").distinct()
    said = common.stored(one.join(seeds.join(needed, "tk"), "tk").select("tk", "text", "hs", "ats").mapInArrow(words, "tk long, words binary, seeds binary, places binary"), "paired-words")
    rows = where.join(said, "tk").select("cell", F.col("tk").alias("a"), F.lit(None).cast("long").alias("b"), "words", "seeds", "places")
    rows = rows.unionByName(cells, allowMissingColumns=True)
    tasks = max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells.count() // CELL_PAIRS)
    out = rows.repartition(tasks, "cell").sortWithinPartitions("cell", "b", "a").mapInArrow(run, SPANS)
    out = common.stored(out, "paired")
    common.discard(where, said)
    return out


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, other_doc_id, other_start, other_end (words), identity of each shared passage."""
    spark = docs.sparkSession
    common.ready(spark)
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))
    copies = common.stored(own.select("doc_id", "tk", F.octet_length("text").alias("size")).distinct(), "texts")
    reps = common.stored(copies.groupBy("tk").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "text-classes")
    lead = common.sized(reps.select(F.col("tk").alias("lead"), "rep"))
    one = own.join(lead, (F.col("tk") == F.col("lead")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("tk", "text")
    found = common.stored(seeds(one), "seeds")
    shared = common.stored(found.groupBy("h").agg(F.min("tk").alias("x"), F.max("tk").alias("y")).where("x < y").select("h"), "shared-seeds")
    marks = common.stored(found.join(common.sized(shared), "h"), "marks")
    common.discard(found)
    own_seeds = common.stored(marks.groupBy("h", "tk").agg(F.sort_array(F.collect_list("pos")).alias("at")), "shared-places")
    wide = common.stored(own_seeds.groupBy("h").agg(F.count("*").alias("texts")).where(F.col("texts") > PAIRED), "wide-seeds")
    common.discard(shared)
    pairs, copied = text_pairs(one, own_seeds, wide)
    cells = _pair_cells(pairs, copies.groupBy("tk").agg(F.max("size").alias("size")))
    common.discard(pairs)
    common.release(spark)
    aligned = _paired(one, own_seeds, cells)
    common.discard(own_seeds, wide, cells)
    wanted = common.stored(_copied(copied).withColumn("cid", F.monotonically_increasing_id()), "chains")
    aligned = aligned.unionByName(_aligned(one, wanted))
    common.discard(copied)
    common.release(spark)

    # Exact passages that are not reported (both texts repeat their seeds) are matched by whole runs.
    areas = _areas(marks.select("tk", "pos"), aligned)
    common.discard(marks)
    if not areas.where("left").isEmpty():
        left = _left_over(one, areas)
        common.release(spark)
        more = common.stored(_exact_chains(left).withColumn("cid", F.monotonically_increasing_id()), "chains")
        aligned = aligned.unionByName(_aligned(one, more))
    # Texts that many passages name meet their documents' ids by size-checked or salted joins.
    shown = aligned
    for x, other in ("a", "b"), ("b", "a"):
        named = common.stored(reps.select(F.col("tk").alias(x), F.col("rep").alias(f"{x}_doc")).join(aligned.select(x).distinct(), x), "named-texts")
        shown = common.salted_join(shown, named, x, other)
    shown = shown.select(F.col("b_doc").alias("doc_id"), "start", "end", F.col("a_doc").alias("other_doc_id"), "other_start", "other_end", "identity")

    many = common.sized(reps.where("n > 1").select(F.col("tk").alias("lead"), "rep"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = text.words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rep"), pa.array(np.diff(first).astype(np.int32))], names=["doc_id", "rep", "n"])

    equal = own.join(many, F.col("tk") == F.col("lead")).where("not (doc_id <=> rep)").select("doc_id", "rep", "text").mapInArrow(sizes, "doc_id long, rep long, n int").where(F.col("n") >= MIN_WORDS)
    zero, whole = F.lit(0), F.col("n")
    return shown.unionByName(equal.distinct().select("doc_id", zero.alias("start"), whole.alias("end"), F.col("rep").alias("other_doc_id"), zero.alias("other_start"), whole.alias("other_end"), F.lit(1.0).alias("identity")))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(common.table(spark, sf_dir, "documents"))
