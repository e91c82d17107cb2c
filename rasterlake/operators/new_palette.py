"""A palette for each picture: boxes of OKLab cut by variance (Wu), then means refined by weighted k-means.

Distinct colours with counts come from one aggregation over all pictures; so do the boxes' moments, per bin. What
goes through numpy is one picture's bins (at most 8192) or its distinct colours, whatever its pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.operators import color, quantize, stacks

#: Bins of lightness, green to red and blue to yellow, and the range of each over all sRGB colours.
BINS = (32, 16, 16)
RANGE = ((0.0, 1.0), (-0.23388757, 0.27621675), (-0.31152815, 0.19856972))
ROUNDS = 100
#: Pictures that are worked on at once, at most.
TOGETHER = 64


def colours(px: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, r, g, b, n, l, a_, b_): each picture's distinct colours; rows without a colour are transparent and left out."""
    return color.with_oklab(px.where("r is not null").groupBy(*key, "r", "g", "b").agg(F.count("*").alias("n")))


def _bin(c: str, i: int):
    low, high = RANGE[i]
    return F.least(F.greatest(F.floor((F.col(c) - low) / (high - low) * BINS[i]), F.lit(0)), F.lit(BINS[i] - 1)).cast("int")


def cumulative(place: np.ndarray, moments: np.ndarray, bins: tuple = BINS) -> np.ndarray:
    """Sums of moments over all bins up to each corner of the cube, of one picture or (place with a fourth column, in front, and as many axes of ``bins``) of several."""
    cube = np.zeros((*bins[:-3], *(n + 1 for n in bins[-3:]), moments.shape[1]))
    np.add.at(cube, (*place.T[:-3], *(place.T[-3:] + 1)), moments)
    for axis in range(-4, -1):
        cube.cumsum(axis=axis, out=cube)
    return cube


def _inside(cubes: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Moments in boxes of bins (low to high - 1, last axis: the three bounds) of the pictures ``of``, from their eight corners."""
    out = 0.0
    for corner in range(8):
        at = tuple(high[..., i] if corner >> i & 1 else low[..., i] for i in range(3))
        out = out + (1 if corner.bit_count() % 2 else -1) * cubes[(of, *at)]
    return out


def _scatter(m: np.ndarray) -> np.ndarray:
    """Sum of squared distances to the mean; moments: count, three sums, sum of squares."""
    return np.where(m[..., 0] > 0, m[..., 4] - (m[..., 1:4] ** 2).sum(axis=-1) / np.where(m[..., 0] > 0, m[..., 0], 1), 0.0)


def _cuts(cubes: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, axis, place) of the cut of each box that leaves the least scatter in both parts; not found if every cut leaves one empty. Ties: the first axis, then the first place."""
    whole, gains, cuts = _inside(cubes, of, low, high)[:, None], [], []
    for axis in range(3):
        places = np.arange(1, cubes.shape[axis + 1] - 1)
        upto = np.repeat(high[:, None], len(places), axis=1)
        upto[:, :, axis] = places
        part = _inside(cubes, of[:, None], low[:, None], upto)
        rest = whole - part
        some = (part[..., 0] > 0.5) & (rest[..., 0] > 0.5) & (places > low[:, axis, None]) & (places < high[:, axis, None])
        n = [np.where(some, x[..., 0], 1) for x in (part, rest)]
        gains.append(np.where(some, (part[..., 1:4] ** 2).sum(axis=-1) / n[0] + (rest[..., 1:4] ** 2).sum(axis=-1) / n[1], -np.inf).round(9))
        cuts += [(axis, x) for x in places.tolist()]
    gain = np.concatenate([*gains, np.full((len(of), 1), -np.inf)], axis=1)
    best = gain.argmax(axis=1)
    axis, place = np.array([*cuts, (0, 0)])[best].T
    return gain[np.arange(len(gain)), best] > -np.inf, axis, place


def boxes_of(cubes: np.ndarray, bins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, count): of each picture at most k boxes: the one of the largest scatter is cut, again and again, while one can be cut.

    bins: how many each picture has along the axes. A step is made for all pictures at once.
    """
    n = len(cubes)
    low, high, scatter, count = np.zeros((n, k, 3), int), np.zeros((n, k, 3), int), np.full((n, k), -np.inf), np.ones(n, int)
    high[:, 0] = bins
    scatter[:, 0] = _scatter(_inside(cubes, np.arange(n), low[:, 0], high[:, 0]))
    while True:
        at = scatter.argmax(axis=1)
        of = np.flatnonzero((count < k) & (scatter[np.arange(n), at] > 1e-9))
        if not len(of):
            return low, high, count
        at = at[of]
        found, axis, place = _cuts(cubes, of, low[of, at], high[of, at])
        scatter[of[~found], at[~found]] = 0.0  # one bin
        of, at, axis, place = of[found], at[found], axis[found], place[found]
        later = np.arange(k) - (np.arange(k) > at[:, None])
        low[of], high[of] = (np.take_along_axis(x[of], later[:, :, None], axis=1) for x in (low, high))
        scatter[of] = np.take_along_axis(scatter[of], later, axis=1)
        high[of, at, axis], low[of, at + 1, axis] = place, place
        for half in (at, at + 1):
            scatter[of, half] = _scatter(_inside(cubes, of, low[of, half], high[of, half]))
        count[of] += 1


def boxes(cube: np.ndarray, k: int) -> list[tuple[tuple, tuple]]:
    """The boxes of one picture."""
    low, high, count = boxes_of(cube[None], np.array(cube.shape[:3]) - 1, k)
    return [(tuple(x), tuple(y)) for x, y in zip(low[0, : count[0]].tolist(), high[0, : count[0]].tolist())]


def means_of(labs: list[np.ndarray], weights: list[np.ndarray], starts: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Of each picture weighted k-means from given centres until nothing moves; ties go to the first centre, and one without colours stays."""
    n, k = len(labs), max(map(len, starts), default=0)
    lab, weight = np.zeros((n, max(map(len, labs), default=0), 3)), np.zeros((n, max(map(len, labs), default=0)))
    centres, none = np.zeros((n, k, 3)), np.ones((n, k), bool)
    for i, (x, w, c) in enumerate(zip(labs, weights, starts)):
        lab[i, : len(x)], weight[i, : len(w)], centres[i, : len(c)], none[i, : len(c)] = x, w, c, False
    left = np.arange(n)
    for _ in range(rounds):
        if not len(left):
            break
        x, w, c = lab[left], weight[left], centres[left]
        far = ((x[:, :, None] - c[:, None]) ** 2).sum(axis=3).round(12)
        near = (np.where(none[left][:, None], np.inf, far).argmin(axis=2) + k * np.arange(len(left))[:, None]).ravel()
        size = np.bincount(near, w.ravel(), k * len(left)).reshape(-1, k, 1)
        moved = np.stack([np.bincount(near, (w * x[:, :, i]).ravel(), k * len(left)).reshape(-1, k) for i in range(3)], axis=2) / np.maximum(size, 1e-12)
        moved = np.where(size > 0, moved, c)
        on = np.abs(moved - c).max(axis=(1, 2), initial=0) >= 1e-9
        left = left[on]
        centres[left] = moved[on]
    return [c[: len(s)] for c, s in zip(centres, starts)]


def means(lab: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The means of one picture."""
    return means_of([lab], [weight], [start], rounds)[0]


def _starts(pictures: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The means of at most k boxes of each picture; its rows: three bins and moments.

    The cubes have the bins that a picture has; cuts between others part its colours in no other way.
    """
    of = np.repeat(np.arange(len(pictures)), [len(v) for v in pictures])
    rows = np.concatenate(pictures)
    place, bins = [of], []
    for i in range(3):
        had = np.zeros((len(pictures), BINS[i]), int)
        had[of, rows[:, i].astype(int)] = 1
        rank = had.cumsum(axis=1)
        place.append(rank[of, rows[:, i].astype(int)] - 1)
        bins.append(rank[:, -1])
    cubes = cumulative(np.stack(place, axis=1), rows[:, 3:8], (len(pictures), *(int(b.max()) for b in bins)))
    low, high, count = boxes_of(cubes, np.stack(bins, axis=1), k)
    m = _inside(cubes, np.arange(len(pictures))[:, None], low, high)
    return [x[:c, 1:4] / x[:c, :1] for x, c in zip(m, count.tolist())]


def _chunks(pictures: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Pictures one after the other, few enough that their cubes and padded rows stay small (one picture at least)."""
    chunk: list[np.ndarray] = []
    for v in pictures:
        if chunk and (len(chunk) >= TOGETHER or (len(chunk) + 1) * max(len(v), *map(len, chunk)) > stacks.CELLS):
            yield chunk
            chunk = []
        chunk.append(v)
    if chunk:
        yield chunk


def _per_picture(rows: DataFrame, fields: list[str], work: Callable[[list[np.ndarray]], list[np.ndarray]], key) -> DataFrame:
    """(keys, l, a_, b_): ``work`` gets some pictures' rows, in order, as arrays and gives the centres of each."""
    stacks.bounded(rows)
    wide = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("p"))
    wide = wide.select(*key, *[F.expr(f"transform(p, v -> cast(v.{f} as double))").alias(f"_{f}") for f in fields])
    schema = T.StructType([*(wide.schema[k] for k in key), *(T.StructField(c, T.DoubleType()) for c in ("l", "a_", "b_"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pictures = [np.stack(v, axis=1) for v in zip(*(batch.column(f"_{f}").to_numpy(zero_copy_only=False) for f in fields))]
            made = [m for chunk in _chunks(pictures) for m in work(chunk)]
            of = np.repeat(np.arange(len(made)), [len(m) for m in made])
            flat = np.concatenate(made) if made else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of)) for k in key), *(pa.array(flat[:, i]) for i in range(3))], names=[*key, "l", "a_", "b_"])

    return wide.mapInArrow(run, schema)


def wu(px: DataFrame, k: int, key=("asset",)) -> DataFrame:
    """(keys, l, a_, b_): the means of at most k boxes of each picture."""
    c = colours(px, key).withColumns({f"i{i}": _bin(x, i) for i, x in enumerate(("l", "a_", "b_"))})
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(x)).alias(f"s{x}") for x in ("l", "a_", "b_")], F.sum(F.col("n") * (F.col("l") * F.col("l") + F.col("a_") * F.col("a_") + F.col("b_") * F.col("b_"))).alias("sq")]
    return _per_picture(c.groupBy(*key, "i0", "i1", "i2").agg(*sums), ["i0", "i1", "i2", "n", "sl", "sa_", "sb_", "sq"], lambda pictures: _starts(pictures, k), key)


def kmeans(px: DataFrame, k: int, key=("asset",)) -> DataFrame:
    """(keys, l, a_, b_): those means refined over all of a picture's colours."""
    c = colours(px, key).withColumns({f"i{i}": _bin(x, i) for i, x in enumerate(("l", "a_", "b_"))})

    def work(pictures: list[np.ndarray]) -> list[np.ndarray]:
        labs, weights = [v[:, 4:7] for v in pictures], [v[:, 3] for v in pictures]
        moments = [np.concatenate([v[:, :4], lab * n[:, None], (n * (lab**2).sum(axis=1))[:, None]], axis=1) for v, lab, n in zip(pictures, labs, weights)]
        return means_of(labs, weights, _starts(moments, k))

    return _per_picture(c, ["i0", "i1", "i2", "n", "l", "a_", "b_"], work, key)


def palette(centres: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, idx, r, g, b): centres as colours, sorted and without repeats."""
    rgb = centres.select(*key, *[c.alias(n) for n, c in zip("rgb", quantize.to_rgb(F.col("l"), F.col("a_"), F.col("b_")))]).distinct()
    return rgb.withColumn("idx", (F.row_number().over(Window.partitionBy(*key).orderBy("r", "g", "b")) - 1).cast("int")).select(*key, "idx", "r", "g", "b")


def quantise(px: DataFrame, k: int, refine: bool = True, key=("asset",)) -> DataFrame:
    """(keys, idx, r, g, b): a palette of at most k colours (256 at most) for each picture; none for one without opaque pixels."""
    if not 1 <= k <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    return palette((kmeans if refine else wu)(px, k, key), key)


def _nearest(px: DataFrame, pal: DataFrame, key, *more: str) -> DataFrame:
    """(keys, r, g, b, n, l, a_, b_, m): each picture's distinct colours and, in m, the nearest entry p_idx of its own palette with ``more`` columns; ties go to the lowest index."""
    p = color.named(color.with_oklab(pal), "p_").withColumnsRenamed({f"p_{k}": k for k in key})
    of = F.struct(F.round(color.distance_sq("", "p_"), 12).alias("d"), "p_idx", *more)
    return colours(px, key).join(p, list(key)).groupBy(*key, "r", "g", "b").agg(*(F.first(c).alias(c) for c in ("n", "l", "a_", "b_")), F.min(of).alias("m"))


def applied(px: DataFrame, pal: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, x, y, idx): each pixel's nearest entry of its own picture's palette; ties go to the lowest index."""
    return px.join(_nearest(px, pal, key), [*key, "r", "g", "b"]).select(*key, "x", "y", F.col("m.p_idx").alias("idx"))


def error(px: DataFrame, pal: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, pixels, used, error): how many pixels and entries a palette serves, and the mean squared distance to the entries."""
    d = _nearest(px, pal, key, "p_l", "p_a_", "p_b_").select(*key, "n", "l", "a_", "b_", "m.*").withColumn("d", color.distance_sq("", "p_"))
    return d.groupBy(*key).agg(F.sum("n").alias("pixels"), F.count_distinct("p_idx").alias("used"), (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("error"))
