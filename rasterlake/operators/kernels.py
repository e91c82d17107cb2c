"""Kernels that go through a canvas in an order: contours, error diffusion, straightness, colour clusters.

Each works on one canvas, a bounded group, inside ``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.operators import stacks

#: Neighbours clockwise from the east (y grows downwards).
_AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
#: After a step in a direction: where the clear neighbour looked at before it lies, as seen from the new place.
_BACK = [_AROUND.index((px - x, py - y)) for (x, y), (px, py) in zip(_AROUND, _AROUND[-1:] + _AROUND[:-1])]


def trace(cells: list[bool], stride: int, start: int, came: int) -> list[int]:
    """A border, clockwise by eight neighbours, from a set cell and the clear neighbour (a turn) that it is looked at from.

    cells: rows of a mask one after the other, with a clear edge around it. It ends when the start is left
    again towards the second cell, not when the start is met first: a thin shape passes it more than once.
    """
    step = [x + y * stride for x, y in _AROUND]
    at, back, out = start, came, [start]
    while True:
        for turn in range(1, 9):
            d = (back + turn) % 8
            if cells[at + step[d]]:
                break
        else:
            return out  # a single pixel
        to = at + step[d]
        if len(out) > 1 and at == start and to == out[1]:
            return out[:-1]
        # The last clear neighbour looked at, as seen from the new place.
        back = _BACK[d]
        at = to
        out.append(at)


def borders(mask: np.ndarray) -> list[tuple[bool, list[tuple[int, int]]]]:
    """(hole, points) of each component's outer border and of each hole, by eight neighbours, in raster order of their starts."""
    return stack_borders(mask[None])[0]


def stack_borders(masks: np.ndarray) -> list[list[tuple[bool, list[tuple[int, int]]]]]:
    """``borders`` of each mask of a stack; components are found for all of them at once."""
    from rasterlake.operators.regions import NEAR8, label_arrays

    n, h, w = masks.shape
    out: list[list[tuple[bool, list[tuple[int, int]]]]] = [[] for _ in range(n)]
    if not masks.size:
        return out
    stride = w + 2
    cells = np.pad(masks.astype(bool), ((0, 0), (1, 1), (1, 1))).reshape(n, -1).tolist()
    points = [(i % stride - 1, i // stride - 1) for i in range(stride * (h + 2))]
    for hole in (False, True):
        lab = label_arrays(np.where(masks != hole, 0, -1), NEAR8)
        first = lab.reshape(n, -1) == np.arange(h * w)
        if hole:
            edge = np.concatenate([lab[:, 0], lab[:, -1], lab[:, :, 0], lab[:, :, -1]], axis=1)
            i, j = np.nonzero(edge >= 0)
            first[i, edge[i, j]] = False
        for i, root in zip(*(a.tolist() for a in np.nonzero(first))):
            start = (root // w + 1 - hole) * stride + root % w + 1
            out[i].append((hole, [points[c] for c in trace(cells[i], stride, start, 2 if hole else 4)]))
    return out


def monotone(points: list[tuple[int, int]], closed: bool = True) -> list[list[tuple[int, int]]]:
    """Chains of a border that turn back on neither axis and leave their main axis for one step at most."""
    if len(points) < 2:
        return [points] if points else []
    parts = _cut([*points, points[0]] if closed else points)
    if closed and len(parts) > 1 and len(_cut(parts[-1] + parts[0][1:])) == 1:
        parts = [parts[-1] + parts[0][1:], *parts[1:-1]]  # the seam is no turn
    return parts


def _cut(points: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    out, own = [], [points[0]]
    sign, main, aside = [0, 0], None, 0
    for a, b in zip(points, points[1:]):
        step = ((b[0] > a[0]) - (b[0] < a[0]), (b[1] > a[1]) - (b[1] < a[1]))
        axis = None if step[0] and step[1] else 0 if step[0] else 1  # none: diagonal
        if any(s and t and s != t for s, t in zip(step, sign)):
            out.append(own)
            own, sign, main, aside = [a], [0, 0], None, 0
        elif main is not None and axis is not None and axis != main and aside:
            last = own.pop()
            out.append(own)
            own, sign, main, aside = [own[-1], last], [0, 0], None, 0
        sign = [t or s for s, t in zip(sign, step)]
        if main is None:
            main = axis
        aside = aside + 1 if axis is not None and axis != main else 0
        own.append(b)
    return [*out, own] if len(own) > 1 else out


def chain_runs(chain: list[tuple[int, int]]) -> tuple[bool, list[list[tuple[int, int]]]]:
    """Whether a chain is horizontal, and its points by runs along its main axis."""
    (x0, y0), (x1, y1) = chain[0], chain[-1]
    flat = abs(x1 - x0) >= abs(y1 - y0)
    runs: list[list[tuple[int, int]]] = []
    for p in chain:
        if runs and runs[-1][-1][flat] == p[flat]:
            runs[-1].append(p)
        else:
            runs.append([p])
    return flat, runs


def _grids(p: pd.DataFrame) -> np.ndarray:
    v = np.zeros((p.y.max() + 1, p.x.max() + 1), dtype=np.int64)
    v[p.y, p.x] = p.idx
    return v


def contours(px: DataFrame, key: str = "asset") -> DataFrame:
    """(key, contour, hole, seq, x, y): the borders of each canvas's opaque components and of their holes."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, hole, n, x, y) for i, (hole, pts) in enumerate(borders(_grids(p) != 0)) for n, (x, y) in enumerate(pts)]
        out = pd.DataFrame(rows, columns=["contour", "hole", "seq", "x", "y"])
        out.insert(0, key, p[key].iloc[0])
        return out

    return px.groupBy(key).applyInPandas(run, f"{key} {dict(px.dtypes)[key]}, contour int, hole boolean, seq int, x int, y int")


def bends(masks: np.ndarray) -> np.ndarray:
    """Of each mask of a stack: sign of the curvature (minus the Laplacian of the signed distance, edges repeated) of each pixel."""
    _, h, w = masks.shape
    y, x = np.mgrid[:h, :w]
    edge = 3.0 * np.minimum(np.minimum(x + 1, y + 1), np.minimum(w - x, h - y))
    far = np.where(masks, stacks.chamfer(~masks), stacks.chamfer(masks))
    d = np.pad(np.where(masks, 1, -1) * np.minimum(far, edge) / 3, ((0, 0), (1, 1), (1, 1)), mode="edge")
    k = 4 * d[:, 1:-1, 1:-1] - d[:, :-2, 1:-1] - d[:, 2:, 1:-1] - d[:, 1:-1, :-2] - d[:, 1:-1, 2:]
    return np.where(np.abs(k) > 1e-3, np.sign(k), 0).astype(int)


def colour_masks(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(canvas, index, mask) of every opaque colour of each canvas of a stack, in order."""
    flat = stack.reshape(len(stack), -1)
    of, idx = np.unique(np.stack([np.repeat(np.arange(len(flat)), flat.shape[1]), flat.reshape(-1)]), axis=1) if flat.size else np.zeros((2, 0))
    of, idx = of[idx > 0].astype(int), idx[idx > 0].astype(int)
    return of, idx, stack[of] == idx[:, None, None]


def colour_runs(px: DataFrame, key: str = "asset") -> DataFrame:
    """Runs of the monotone chains of every opaque colour's borders.

    key, idx, chain, run, horizontal, straight (the chain), len, bend (sign of the curvature of the
    colour's distance field at the run's middle), x, y (middle), ax, ay (first), bx, by (last), abend, bbend (at these).
    """
    names = ["idx", "chain", "run", "horizontal", "straight", "len", "bend", "x", "y", "ax", "ay", "bx", "by", "abend", "bbend"]

    def work(stack: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        of, idx, masks = colour_masks(np.nan_to_num(stack))
        rows, chains = [], [0] * len(stack)
        for i, v, bend, found in zip(of.tolist(), idx.tolist(), bends(masks).tolist(), stack_borders(masks)):
            for _, points in found:
                for chain in monotone(points):
                    flat, parts = chain_runs(chain)
                    line = straight([len(q) for q in parts])
                    for j, q in enumerate(parts):
                        (x, y), (ax, ay), (bx, by) = q[len(q) // 2], q[0], q[-1]
                        rows.append((i, v, chains[i], j, flat, line, len(q), bend[y][x], x, y, ax, ay, bx, by, bend[ay][ax], bend[by][bx]))
                    chains[i] += 1
        made = np.array(rows, dtype=np.int64).reshape(-1, len(names) + 1).T
        return made[0], dict(zip(names, made[1:]))

    out = stacks.rows_of(px, work, ", ".join(f"{n} int" for n in names), (key,))
    return out.withColumns({c: F.col(c) == 1 for c in ("horizontal", "straight")})


def diffuse(px: DataFrame, levels: list[float], key: str = "asset", value: str = "v") -> DataFrame:
    """Error diffusion (7, 3, 5, 1 sixteenths) of a value to the nearest of some levels, in raster order."""
    table = np.array(levels)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        h, w = p.y.max() + 1, p.x.max() + 1
        v = np.zeros((h + 1, w + 2))
        v[p.y, p.x + 1] = p[value]
        idx = np.zeros((h, w), dtype=np.int32)
        for y in range(h):
            for x in range(w):
                i = int(np.abs(table - v[y, x + 1]).argmin())
                e = v[y, x + 1] - table[i]
                idx[y, x] = i
                v[y, x + 2] += e * 7 / 16
                v[y + 1, x] += e * 3 / 16
                v[y + 1, x + 1] += e * 5 / 16
                v[y + 1, x + 2] += e * 1 / 16
        return pd.DataFrame({key: p[key], "x": p.x, "y": p.y, "idx": idx[p.y, p.x]})

    return px.groupBy(key).applyInPandas(run, f"{key} {dict(px.dtypes)[key]}, x int, y int, idx int")


def straight(lengths: list[int]) -> bool:
    """Whether run lengths are those of a digital line: two neighbouring lengths, one of them always alone, and so on upwards.

    A length that is met once shows no slope yet; fewer than three runs can't contradict one.
    """
    first = True
    while len(lengths) > 2:
        lengths = lengths[1:-1]  # cut ends say nothing
        low, high = min(lengths), max(lengths)
        if high - low > 1:
            return False
        if high == low:
            return not first or len(lengths) > 1
        alone = [v for v in (low, high) if not any(a == b == v for a, b in zip(lengths, lengths[1:]))]
        if not alone or first and lengths.count(alone[0]) == 1:
            return False
        single, first = alone[0], False
        at = [i for i, v in enumerate(lengths) if v == single]
        lengths = [b - a for a, b in zip([-1, *at], [*at, len(lengths)])]
    return True
