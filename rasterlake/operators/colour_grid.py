"""Estimating the cell size of enlarged pictures from their colours: five gates, an edge fit, and a verdict for each canvas.

Pictures are (keys, x, y, r, g, b), whole rectangles; a missing pixel counts as black. Variances are sums
over red, green and blue of values in 0 to 1. A canvas goes through numpy once, for its integral images
(``curves``): four reads give a cell's variance whatever its size. All that follows is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.operators import color, grid, stacks

_TINY = 1.1920929e-07


@dataclass(frozen=True)
class Gates:
    """Thresholds by which candidates are judged.

    epsilon: share of the picture's variance that cells may have. delta, tau: colour difference and share of
    pixels that may be off their cell's mean. bands, cells: bands on each axis, and cells that each needs.
    drift: how far bands' phases may be apart, as a share of the size. agreement: loss by one phase for all bands.
    contrast: growth of variance half a cell off. confidence: least margin, divided by the size. suppression, floor:
    of peaks of edge energy; slope, residual, peaks: fit of a line through them that may stand in for drift.
    """

    largest: int = 16
    epsilon: float = 0.15
    delta: float = 0.15
    tau: float = 0.05
    bands: int = 4
    cells: int = 2
    drift: float = 0.28
    agreement: float = 0.18
    contrast: float = 1.12
    confidence: float = 0.095
    suppression: float = 0.625
    floor: float = 1.5
    slope: float = 0.0125
    residual: float = 0.15
    peaks: int = 4


def integral(images: np.ndarray) -> np.ndarray:
    """Of a stack (canvas, row, column, channel): sums of r, g, b and of all squares over the rectangle up to each corner."""
    v = images.astype(np.int64)
    v = np.concatenate([v, (v * v).sum(axis=3, keepdims=True)], axis=3)
    out = np.zeros((v.shape[0], v.shape[1] + 1, v.shape[2] + 1, 4), np.int64)
    out[:, 1:, 1:] = v.cumsum(axis=1).cumsum(axis=2)
    return out


def _spread(sums: np.ndarray, n: int) -> np.ndarray:
    """Variances of areas of n pixels from their sums."""
    return np.maximum(sums[..., 3] / n - ((sums[..., :3] / n) ** 2).sum(axis=-1), 0) / 65025


def _band_means(line: np.ndarray, p: int, s: int, length: int, bands: int) -> np.ndarray:
    """Means over bands of a line of cells of size s that starts at p; NaN for a band without a whole cell."""
    edge = length * np.arange(bands + 1) // bands
    lo, hi = np.maximum(-(-(edge[:-1] - p) // s), 0), np.minimum((edge[1:] - p) // s, line.shape[1])
    upto = np.concatenate([np.zeros((len(line), 1)), line.cumsum(axis=1)], axis=1)
    n = hi - lo
    lo, hi = (np.clip(x, 0, line.shape[1]) for x in (lo, hi))
    return np.where(n > 0, (upto[:, hi] - upto[:, lo]) / np.maximum(n, 1), np.nan)


def _of_size(sums: np.ndarray, s: int, most: int, cells: int) -> dict[str, list]:
    """For each canvas of a stack: the best phase, its variance and those half a cell off, and the bands' curves through it."""
    n, h, w = sums.shape[0], sums.shape[1] - 1, sums.shape[2] - 1
    v = np.full((n, s, s), np.inf)
    across: dict[int, np.ndarray] = {b: np.full((n, s, s, b), np.nan) for b in range(2, most + 1)}  # (canvas, dy, dx, band)
    down = {b: x.copy() for b, x in across.items()}
    for dy in range(s):
        for dx in range(s):
            corner = sums[:, dy::s, dx::s]
            own = _spread(np.diff(np.diff(corner, axis=1), axis=2), s * s)
            if not own.shape[1] * own.shape[2]:
                continue
            v[:, dy, dx] = own.mean(axis=(1, 2))
            for b in across:
                across[b][:, dy, dx] = _band_means(own.mean(axis=1), dx, s, w, b)
                down[b][:, dy, dx] = _band_means(own.mean(axis=2), dy, s, h, b)
    v = v.round(9)
    at = v.reshape(n, -1).argmin(axis=1)
    dy, dx, of, half = at // s, at % s, np.arange(n), max(1, s // 2)
    out = {"s": np.full(n, s), "dx": dx, "dy": dy, "v": v[of, dy, dx], "vx": v[of, dy, (dx + half) % s], "vy": v[of, (dy + half) % s, dx], "by_x": [None] * n, "by_y": [None] * n}
    for b in range(2, most + 1):  # the most bands that can be measured
        x, y = across[b][of, dy].transpose(0, 2, 1).round(9), down[b][of, :, dx].transpose(0, 2, 1).round(9)
        thick = ((w - dx) // s >= cells * b) & ((h - dy) // s >= cells * b)
        for i in np.flatnonzero(thick & (~np.isnan(x)).any(axis=2).all(axis=1) & (~np.isnan(y)).any(axis=2).all(axis=1)):
            out["by_x"][i], out["by_y"][i] = ([[None if np.isnan(q) else q for q in c] for c in z[i].tolist()] for z in (x, y))
    return out


def curves(px: DataFrame, gates: Gates = Gates(), key=("asset",)) -> DataFrame:
    """(keys, w, h, iv, s, dx, dy, v, vx, vy, by_x, by_y): each canvas's candidates with the picture's variance.

    by_x, by_y: the phase curves of bands of columns and of rows; null where the bands would be too thin.
    """
    stacks.bounded(px)
    cell = F.array_sort(F.collect_list(F.struct("y", "x", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int").alias("c"))))
    wide = px.groupBy(*key).agg(cell.alias("p"))
    wide = wide.select(*key, *[F.expr(f"transform(p, v -> v.{f})").alias(f"_{f}") for f in "xyc"])
    own = "w int, h int, iv double, s int, dx int, dy int, v double, vx double, vy double, by_x array<array<double>>, by_y array<array<double>>"
    schema = T.StructType([*(wide.schema[k] for k in key), *T._parse_datatype_string(own).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, cs = (batch.column(f"_{c}").to_numpy(zero_copy_only=False) for c in "xyc")
            sizes: dict[tuple[int, int], list[int]] = {}
            for i, (x, y) in enumerate(zip(xs, ys)):
                sizes.setdefault((int(y.max()) + 1, int(x.max()) + 1), []).append(i)
            for (h, w), rows in stacks.parts(sizes):
                stack = np.zeros((len(rows), h, w, 3), np.uint8)
                for j, i in enumerate(rows):
                    for k in range(3):
                        stack[j, ys[i], xs[i], k] = (cs[i] >> (8 * (2 - k))) & 255
                sums = integral(stack)
                whole = _spread(sums[:, -1, -1], h * w)
                for s in range(2, min(gates.largest, h, w) + 1):
                    got = _of_size(sums, s, gates.bands, gates.cells)
                    of = [batch.column(k).take(pa.array(rows)) for k in key]
                    first = [pa.array(np.full(len(rows), x), pa.int32()) for x in (w, h)] + [pa.array(whole)]
                    rest = [pa.array(v, pa.list_(pa.list_(pa.float64())) if c.startswith("by") else pa.int32() if c in ("s", "dx", "dy") else pa.float64()) for c, v in got.items()]
                    yield pa.RecordBatch.from_arrays([*of, *first, *rest], names=[*key, "w", "h", "iv", *got])

    return wide.mapInArrow(run, schema)


# Gates as columns ------------------------------------------------------------------------------------
def phase(curve: Column) -> Column:
    """The phase of a curve's least value (the first, if several)."""
    return F.array_position(curve, F.array_min(curve)).cast("int") - 1


def refined(curve: Column) -> Column:
    """The phase at the bottom of a parabola through the least value and its cyclic neighbours."""
    p, s = phase(curve), F.size(curve)
    left, at, right = (F.get(curve, F.pmod(p + d, s)) for d in (-1, 0, 1))
    bend = left - 2 * at + right
    moved = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (left - right) / F.when(bend > 0, bend)))
    return p + F.when((s >= 3) & bend.isNotNull() & (bend > 0), moved).otherwise(F.lit(0.0))


def drift(by: Column, s: Column, fine: bool = False) -> Column:
    """The largest cyclic distance between the phases of two bands."""
    return grid.cyclic_spread(F.transform(by, refined if fine else phase), s)


def axis_loss(by: Column) -> Column:
    """(joint - separate) / (mean - separate) over the bands' curves without gaps; null for fewer than two, or flat ones."""
    whole = F.filter(by, lambda c: F.forall(c, lambda v: v.isNotNull()))
    total = F.reduce(F.slice(whole, 2, 100), F.get(whole, 0), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    separate = F.reduce(F.transform(whole, F.array_min), F.lit(0.0), lambda a, v: a + v)
    depth = F.reduce(total, F.lit(0.0), lambda a, v: a + v) / F.size(total) - separate
    return F.when((F.size(whole) >= 2) & (depth > _TINY), (F.array_min(total) - separate) / depth)


def agreement(by_x: Column, by_y: Column) -> Column:
    """Mean of both axes' losses; null if none can be measured."""
    both = F.array_compact(F.array(axis_loss(by_x), axis_loss(by_y)))
    return F.when(F.size(both) > 0, F.reduce(both, F.lit(0.0), lambda a, v: a + v) / F.size(both))


def half_off(v: Column, vx: Column, vy: Column) -> Column:
    """How many times the variance grows half a cell off, mean of both axes."""
    r = [F.when(v > _TINY, x / F.when(v > _TINY, v)).otherwise(F.when(x > _TINY, 1e6).otherwise(1.0)) for x in (vx, vy)]
    return (r[0] + r[1]) / 2


def recon(px: DataFrame, cand: DataFrame, delta: float, key=("asset",)) -> DataFrame:
    """(keys, s, rate): of each candidate the share of pixels that are off their whole cell's mean colour by more than ``delta`` in OKLab."""
    j = px.join(cand.select(*key, "s", "dx", "dy", "w", "h"), list(key))
    cx, cy = F.floor((F.col("x") - F.col("dx")) / F.col("s")), F.floor((F.col("y") - F.col("dy")) / F.col("s"))
    j = j.withColumns({"cx": cx, "cy": cy}).where("cx >= 0 AND cy >= 0 AND dx + (cx + 1) * s <= w AND dy + (cy + 1) * s <= h")
    n = j.groupBy(*key, "s", "cx", "cy", "r", "g", "b").agg(F.count("*").alias("n"))
    cell = Window.partitionBy(*key, "s", "cx", "cy")
    mean = {f"m{c}": F.round(F.sum(F.col(c) * F.col("n")).over(cell) / F.sum("n").over(cell)) for c in "rgb"}
    n = color.with_oklab(n.withColumns(mean)).select(*key, "s", "n", "mr", "mg", "mb", *[F.col(c).alias(f"p_{c}") for c in ("l", "a_", "b_")])
    m = color.with_oklab(n.withColumnsRenamed({"mr": "r", "mg": "g", "mb": "b"})).withColumnsRenamed({c: f"q_{c}" for c in ("l", "a_", "b_")})
    off = F.sum(F.when(F.sqrt(color.distance_sq("p_", "q_")) > delta, F.col("n")).otherwise(0))
    return m.groupBy(*key, "s").agg((off / F.sum("n")).alias("rate"))


def energies(px: DataFrame, order: int, key=("asset",)) -> DataFrame:
    """(keys, axis, e): for columns (axis 0) and rows (1), by place the sums of the sizes of colour differences.

    order 1: to the place before, 0 at the first; order 2: second differences, from the second place to the last but one.
    """
    line = F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("x").alias("i"), F.col("y").alias("j")), F.struct(F.lit(1).alias("axis"), F.col("y").alias("i"), F.col("x").alias("j"))))
    p = px.select(*key, "r", "g", "b", line.alias("o")).select(*key, "o.*", "r", "g", "b")
    at = Window.partitionBy(*key, "axis", "j").orderBy("i")
    if order == 1:
        d = sum((F.abs(F.col(c) - F.lag(c).over(at)) for c in "rgb"), F.lit(0))
        d = F.coalesce(d, F.lit(0))
    else:
        d = sum((F.abs(F.lead(c).over(at) - 2 * F.col(c) + F.lag(c).over(at)) for c in "rgb"), F.lit(0))
    e = p.withColumn("d", d).where("d is not null").groupBy(*key, "axis", "i").agg(F.sum("d").alias("e"))
    return e.groupBy(*key, "axis").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda v: v["e"].cast("double")).alias("e"))


def _mean(a: Column) -> Column:
    return F.reduce(a, F.lit(0.0), lambda t, v: t + v) / F.size(a)


def candidate_sizes(px: DataFrame, largest: int, key=("asset",)) -> DataFrame:
    """(keys, sizes): sizes at which edges repeat (the autocorrelations of both axes sum to more than 0), and their divisors; all sizes if none."""
    e = energies(px, 1, key)
    e = e.withColumn("m", _mean(F.col("e"))).withColumn("c", F.expr("transform(e, v -> v - m)")).withColumn("norm", F.expr("reduce(c, 0D, (t, v) -> t + v * v)"))
    vote = F.expr(f"transform(sequence(2, {largest}), k -> CASE WHEN k < size(c) AND norm > 2.3e-16 THEN reduce(zip_with(slice(c, k + 1, size(c)), slice(c, 1, size(c) - least(k, size(c))), (a, b) -> coalesce(a * b, 0D)), 0D, (t, v) -> t + v) / norm ELSE 0D END)")
    votes = e.select(*key, F.posexplode(vote).alias("k", "v")).groupBy(*key, "k").agg(F.sum("v").alias("v"))
    up = votes.groupBy(*key).agg(F.array_compact(F.collect_list(F.when(F.round("v", 9) > 0, F.col("k") + 2))).alias("up"))
    sizes = F.expr(f"filter(sequence(2, {largest}), d -> size(up) = 0 OR exists(up, t -> t % d = 0))")
    return up.select(*key, sizes.alias("sizes"))


def edge_fit(px: DataFrame, cand: DataFrame, gates: Gates = Gates(), key=("asset",)) -> DataFrame:
    """(keys, axis, s, n, spacing, rms): for each candidate the line through the peaks of second differences on each axis, three or more.

    A peak is above the mean's multiple and not below its neighbours (the first of equals), and is refined by a parabola.
    """
    e = energies(px, 2, key).withColumn("least", _mean(F.col("e")) * gates.floor).where("size(e) > 0")
    e = e.join(cand.select(*key, "s", F.greatest(F.lit(1), F.floor(F.col("s") * gates.suppression + 0.5)).cast("int").alias("r")), list(key))
    top = "filter(sequence(0, size(e) - 1), j -> e[j] > least AND coalesce(array_max(slice(e, greatest(j - r, 0) + 1, least(r, j))) < e[j], true) AND coalesce(array_max(slice(e, j + 2, r)) <= e[j], true))"
    at = e.select(*key, "axis", "s", "e", F.explode(F.expr(top)).alias("j")).selectExpr(*key, "axis", "s", "j", "e[j] AS v", "get(e, j - 1) AS a", "get(e, j + 1) AS b")
    bend = F.col("a") - 2 * F.col("v") + F.col("b")
    moved = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("a") - F.col("b")) / bend))
    peaks = at.select(*key, "axis", "s", (1 + F.col("j") + F.coalesce(F.when(bend < 0, moved), F.lit(0.0))).alias("place"))
    return grid.spacing(peaks, F.col("s"), (*key, "axis", "s"))


def candidates(px: DataFrame, gates: Gates = Gates(), key=("asset",)) -> DataFrame:
    """(keys, w, h, iv, s, dx, dy, v, drift, loss, contrast, rate, fits, accepted): what each gate says of each size.

    Drift may be excused by an edge fit on both axes; the rate is measured of sizes that pass the other gates only, null else.
    """
    c = curves(px, gates, key)
    far = F.greatest(*[drift(F.col(b), F.col("s")) for b in ("by_x", "by_y")])
    told = {"drift": far, "loss": agreement(F.col("by_x"), F.col("by_y")), "contrast": half_off(F.col("v"), F.col("vx"), F.col("vy"))}
    # The exchange keeps these expressions from being evaluated again for every later use.
    c = c.select(*key, "w", "h", "iv", "s", "dx", "dy", "v", *[x.alias(n) for n, x in told.items()]).repartition(*key)
    steady = F.coalesce((F.col("v") <= gates.epsilon * F.col("iv")) & (F.col("loss") <= gates.agreement) & (F.col("contrast") >= gates.contrast), F.lit(False))
    c = c.withColumns({"steady": steady, "near": F.coalesce(F.col("drift") <= gates.drift * F.col("s"), F.lit(False))})
    fit = edge_fit(px, c.where("steady AND NOT near"), gates, key)
    good = (F.col("n") >= gates.peaks) & (F.abs(F.col("spacing") / F.col("s") - 1) <= gates.slope) & (F.col("rms") / F.col("s") <= gates.residual)
    fit = fit.where(good).groupBy(*key, "s").agg((F.count("*") == 2).alias("fits"))
    c = c.join(fit, [*key, "s"], "left").withColumn("fits", F.coalesce("fits", F.lit(False)))
    rate = recon(px, c.where("steady AND (near OR fits)"), gates.delta, key)
    c = c.join(rate, [*key, "s"], "left")
    return c.withColumn("accepted", F.coalesce(F.col("rate") <= gates.tau, F.lit(False))).drop("steady", "near")


def estimate(px: DataFrame, gates: Gates = Gates(), key=("asset",)) -> DataFrame:
    """(keys, s, dx, dy, v, confidence, verdict): the largest size that all gates accept.

    Sizes at which edges repeat are tried first; all sizes, if none of those is accepted or none can be held
    against it. confidence: how much worse the best larger size is that is no multiple. verdict: ok, low_confidence,
    not_found; too_small for canvases of one row or column.
    """
    c = candidates(px, gates, key)
    sizes = candidate_sizes(px, gates.largest, key)
    one = F.struct("s", "dx", "dy", "v", "accepted")
    g = c.groupBy(*key).agg(F.collect_list(one).alias("all"), F.max("iv").alias("iv")).join(sizes, list(key))

    def best(of: str) -> str:
        hat = f"array_max(filter({of}, c -> c.accepted))"
        rest = f"array_min(transform(filter({of}, c -> c.s > {hat}.s AND c.s % {hat}.s <> 0), c -> c.v))"
        return f"named_struct('hat', {hat}, 'rest', {rest})"

    g = g.withColumn("some", F.expr("filter(all, c -> array_contains(sizes, c.s))"))
    g = g.withColumn("m", F.expr(f"CASE WHEN ({best('some')}).rest IS NULL THEN {best('all')} ELSE {best('some')} END"))
    margin = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("m.rest") - F.col("m.hat.v")) / F.when(F.col("iv") > 0, F.col("iv")))), F.lit(0.0))
    g = g.select(*key, *[F.col(f"m.hat.{f}").alias(f) for f in ("s", "dx", "dy", "v")], F.when(F.col("m.hat").isNotNull(), F.round(margin, 9)).alias("confidence"))
    out = px.groupBy(*key).agg(F.least(F.max("x"), F.max("y")).alias("side")).join(g, list(key), "left")
    verdict = F.when(F.col("side") < 1, "too_small").when(F.col("s").isNull(), "not_found").when(F.col("confidence") >= gates.confidence / F.col("s"), "ok").otherwise("low_confidence")
    return out.withColumn("verdict", verdict).drop("side")


def conform(px: DataFrame, estimates: DataFrame, key=("asset",)) -> DataFrame:
    """Pictures whose size was found, one pixel for each whole cell: its most frequent colour (ties: the largest)."""
    size = Window.partitionBy(*key)
    j = px.withColumns({"_w": F.max("x").over(size) + 1, "_h": F.max("y").over(size) + 1}).join(estimates.where("verdict = 'ok'").select(*key, "s", "dx", "dy"), list(key))
    cx, cy = F.floor((F.col("x") - F.col("dx")) / F.col("s")), F.floor((F.col("y") - F.col("dy")) / F.col("s"))
    j = j.withColumns({"cx": cx.cast("int"), "cy": cy.cast("int")}).where("cx >= 0 AND cy >= 0 AND dx + (cx + 1) * s <= _w AND dy + (cy + 1) * s <= _h")
    n = j.groupBy(*key, "cx", "cy", "r", "g", "b").agg(F.count("*").alias("n"))
    m = n.groupBy(*key, "cx", "cy").agg(F.max(F.struct("n", "r", "g", "b")).alias("m"))
    return m.select(*key, F.col("cx").alias("x"), F.col("cy").alias("y"), "m.r", "m.g", "m.b")
