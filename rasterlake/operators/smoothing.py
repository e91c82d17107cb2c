"""Smoothing of borders: pixels move where that leaves fewer runs shorter than both neighbours.

A canvas is a bounded group; canvases are worked on in stacks, inside one Arrow stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from rasterlake.operators import stacks
from rasterlake.operators.kernels import bends, chain_runs, colour_masks, monotone, stack_borders, straight

_NEAR = ((1, 0), (-1, 0), (0, 1), (0, -1))
REPORT = ("moved", "passes", "remaining", "over_limit", "geometric", "no_move")


Dip = tuple[list[tuple[int, int]], bool, int, bool]


def dips(mask: np.ndarray) -> list[Dip]:
    """(points, horizontal, gap to the shorter neighbour, on a digital line) of each run shorter than both its neighbours, but for turns and for dips of a lasting slope."""
    return _stack_dips(mask[None])[0]


def _stack_dips(masks: np.ndarray) -> list[list[Dip]]:
    out: list[list[Dip]] = [[] for _ in masks]
    for mine, bend, found in zip(out, bends(masks), stack_borders(masks)):
        for _, points in found:
            for chain in monotone(points):
                flat, runs = chain_runs(chain)
                n = [len(r) for r in runs]
                low = [i for i in range(1, len(n) - 1) if n[i - 1] > n[i] < n[i + 1]]
                for i in low:
                    lasting = 1 < i < len(n) - 2 and n[i - 2] > n[i - 1] and n[i + 2] > n[i + 1]
                    (ax, ay), (bx, by) = (runs[k][n[k] // 2] for k in (i - 1, i + 1))
                    if not lasting and bend[ay, ax] * bend[by, bx] >= 0:
                        mine.append((runs[i], flat, min(n[i - 1], n[i + 1]) - n[i], straight(n)))
    return out


class _Counted:
    """Dips of a canvas's colours; a mask met before isn't gone through again."""

    def __init__(self) -> None:
        self.seen: dict[bytes, list[Dip]] = {}

    def of(self, v: np.ndarray, idx: int) -> list[Dip]:
        mask = v == idx
        known = mask.tobytes()
        if known not in self.seen:
            self.seen[known] = dips(mask)
        return self.seen[known]

    def number(self, v: np.ndarray, colours: set[int]) -> int:
        return sum(len(self.of(v, i)) for i in colours if i > 0)


def moves(v: np.ndarray, points: list[tuple[int, int]], flat: bool, idx: int) -> list[tuple[int, int, int]]:
    """(x, y, index) that may mend a dip: the pixel past either end takes the run's colour, or, if it has it, the commonest other colour around it (ties: the smaller)."""
    h, w = v.shape
    dx, dy = (1, 0) if flat else (0, 1)
    out = []
    for x, y in ((points[-1][0] + dx, points[-1][1] + dy), (points[0][0] - dx, points[0][1] - dy)):
        if not (0 <= x < w and 0 <= y < h):
            continue
        if v[y, x] != idx:
            out.append((x, y, idx))
            continue
        near = [int(v[y + b, x + a]) for a, b in _NEAR if 0 <= x + a < w and 0 <= y + b < h and v[y + b, x + a] != idx]
        if near:
            out.append((x, y, min(near, key=lambda i: (-near.count(i), i))))
    return out


def smooth(v: np.ndarray, most: int = 1, rounds: int = 8, losers: bool = False) -> dict[str, int]:
    """Smooth one canvas in place and report on it (``REPORT``)."""
    return smooth_stack(v[None], most, rounds, losers)[0]


def smooth_stack(stack: np.ndarray, most: int = 1, rounds: int = 8, losers: bool = False) -> list[dict[str, int]]:
    """``smooth`` for a stack; the dips that canvases begin with are found for all of them at once."""
    counted = [_Counted() for _ in stack]
    of, _, masks = colour_masks(stack)
    for i, mask, found in zip(of.tolist(), masks, _stack_dips(masks)):
        counted[i].seen[mask.tobytes()] = found
    return [_smooth(v, c, most, rounds, losers) for v, c in zip(stack, counted)]


def _smooth(v: np.ndarray, counted: _Counted, most: int, rounds: int, losers: bool) -> dict[str, int]:
    moved = passes = 0
    colours = lambda: np.unique(v[v > 0]).astype(int).tolist()
    for passes in range(1, max(rounds, 1) + 1):
        now = 0
        for idx, (points, flat, gap, line) in [(i, d) for i in colours() for d in counted.of(v, i)]:
            if gap > most or line or any(v[y, x] != idx for x, y in points):
                continue
            tries = moves(v, points, flat, idx)
            touched = {idx, *(to for _, _, to in tries), *(int(v[y, x]) for x, y, _ in tries if losers)}
            least, best = counted.number(v, touched), None
            for x, y, to in tries:
                old, v[y, x] = v[y, x], to
                left = counted.number(v, touched)
                v[y, x] = old
                if left < least:
                    least, best = left, (x, y, to)
            if best:
                v[best[1], best[0]] = best[2]
                now += 1
        moved += now
        if not now:
            break
    last = [d for i in colours() for d in counted.of(v, i)]
    over = sum(gap > most for _, _, gap, _ in last)
    lines = sum(gap <= most and line for _, _, gap, line in last)
    return dict(zip(REPORT, (moved, passes, len(last), over, lines, len(last) - over - lines)))


def smoothed(px: DataFrame, most: int = 1, rounds: int = 8, losers: bool = False, key=("asset",)) -> DataFrame:
    """(keys, x, y, idx, smoothed): borders of all opaque colours, smoothed.

    A dip is mended by the move that leaves the fewest dips of the colours that the moves give; a move that
    doesn't lower their number isn't made, nor are dips deeper than ``most`` and those of digital lines touched.
    ``losers``: the colours that moves take from count as well, so a canvas's dips never become more.
    Null indexes stay null and belong to no colour; an empty table gives no rows.
    """

    def work(stack: np.ndarray) -> np.ndarray:
        out = stack.astype(np.int64)
        smooth_stack(out, most, rounds, losers)
        return out

    made = stacks.on_stacks(px, work, "smoothed", key=key)
    return made.selectExpr(*key, "x", "y", "idx", "nullif(smoothed, -1) AS smoothed")


def smooth_report(px: DataFrame, most: int = 1, rounds: int = 8, losers: bool = False, key=("asset",)) -> DataFrame:
    """(keys, moved, passes, remaining, over_limit, geometric, no_move): what ``smoothed`` did to each canvas, and why the dips that remain do."""

    def work(stack: np.ndarray) -> dict[str, np.ndarray]:
        done = smooth_stack(np.nan_to_num(stack, nan=-1).astype(np.int64), most, rounds, losers)
        return {n: np.array([[r[n]] for r in done]) for n in REPORT}

    return stacks.per_canvas(px, work, ", ".join(f"{n} int" for n in REPORT), key)
