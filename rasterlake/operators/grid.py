"""Estimating the cell size of enlarged canvases, as one plan over all canvases, sizes and phases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import stacks, tiles


def _cells(v: np.ndarray, s: int, dx: int, dy: int) -> np.ndarray:
    """A stack's whole cells of a size and phase: (canvas, cell row, cell column, pixel)."""
    n, h, w = v.shape
    rows, cols = (h - dy) // s, (w - dx) // s
    part = v[:, dy : dy + rows * s, dx : dx + cols * s].reshape(n, rows, s, cols, s)
    return part.transpose(0, 1, 3, 2, 4).reshape(n, rows, cols, s * s)


def _variance(v: np.ndarray, s: int, dx: int, dy: int) -> np.ndarray:
    """Mean over a canvas's whole cells of their variance (NaN without any); a cell with a missing pixel isn't whole."""
    c = _cells(v, s, dx, dy)
    if not c.shape[1] * c.shape[2]:
        return np.full(len(v), np.nan)
    own = (c * c).sum(axis=3) / (s * s) - (c.sum(axis=3) / (s * s)) ** 2  # whole numbers: sums are exact, so equal cells give equal bits
    whole = ~np.isnan(own)
    return np.where(whole, own, 0).sum(axis=(1, 2)) / np.where(whole.any(axis=(1, 2)), whole.sum(axis=(1, 2)), np.nan)


def _phases(sizes: range) -> list[tuple[int, int, int]]:
    return [(s, dx, dy) for s in sizes for dy in range(s) for dx in range(s)]


def cell_variance(px: DataFrame, largest: int, key=("asset",)) -> DataFrame:
    """(keys, s, dx, dy, v): mean variance of the whole cells of each size and phase; canvases of one size go through together."""
    tried = _phases(range(2, largest + 1))

    def work(v: np.ndarray) -> dict[str, np.ndarray]:
        n = len(v)
        out = {c: np.repeat(np.array([t[i] for t in tried])[None], n, axis=0) for i, c in enumerate(("s", "dx", "dy"))}
        return out | {"v": np.stack([_variance(v, *t) for t in tried], axis=1)}

    return stacks.per_canvas(px, work, "s int, dx int, dy int, v double", key)


def best_phase(variance: DataFrame, key=("asset",)) -> DataFrame:
    """The phase of least variance (by nine digits) of each size; ties go to the first by dy, dx."""
    m = F.min(F.struct(F.round("v", 9).alias("near"), "dy", "dx", "v"))
    return variance.groupBy(*key, "s").agg(m.alias("m")).select(*key, "s", F.col("m.dx").alias("dx"), F.col("m.dy").alias("dy"), F.col("m.v").alias("v"))


def confidence(best: DataFrame, image: DataFrame, share: float = 0.9, key=("asset",)) -> DataFrame:
    """The largest size whose variance is below a share of the image's, and its margin over larger sizes that are neither multiple nor divisor (0 without any)."""
    b = best.join(image, list(key))
    hat = b.where(F.col("v") <= share * F.col("iv")).groupBy(*key).agg(F.max(F.struct("s", "v", "iv")).alias("h")).select(*key, F.col("h.s").alias("hat"), F.col("h.v").alias("hv"), F.col("h.iv").alias("iv"))
    other = best.join(hat, list(key)).where("s > hat AND s % hat <> 0")
    rival = other.groupBy(*key).agg(F.min("v").alias("rival"))
    margin = F.coalesce((F.col("rival") - F.col("hv")) / F.when(F.col("iv") > 0, F.col("iv")), F.lit(0.0))
    return hat.join(rival, list(key), "left").select(*key, "hat", F.least(F.greatest(margin, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def image_variance(px: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, iv): by Welford's updates in reading order, so that a canvas has one result whatever the order of its rows; a share of it may tie with a cell variance."""

    def work(v: np.ndarray) -> dict[str, np.ndarray]:
        n, mean, squares = (np.zeros(len(v)) for _ in range(3))
        for x in v.reshape(len(v), -1).T:
            there = ~np.isnan(x)
            n = n + there
            off = np.where(there, x - mean, 0.0)
            after = mean + off / np.maximum(n, 1)
            squares = squares + np.where(there, (x - after) * off, 0.0)
            mean = after
        return {"iv": np.where(n > 0, squares / np.maximum(n, 1), np.nan)[:, None]}

    return stacks.per_canvas(px, work, "iv double", key)


def autocorrelation(px: DataFrame, largest: int, key=("asset",)) -> DataFrame:
    """(keys, k, r): of the columns' edge energy about its mean, at each lag."""
    row = Window.partitionBy(*key, "y").orderBy("x")
    e = px.withColumn("e", F.abs(F.col("idx") - F.lag("idx").over(row))).where("e is not null").groupBy(*key, "x").agg(F.sum("e").alias("e"))
    whole = Window.partitionBy(*key)
    c = e.withColumn("c", F.col("e") - F.avg("e").over(whole)).select(*key, "x", "c")
    lagged = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(largest)))).select(*key, "k", (F.col("x") + F.col("k")).alias("x"), F.col("c").alias("d"))
    num = c.join(lagged, [*key, "x"]).groupBy(*key, "k").agg(F.sum(F.col("c") * F.col("d")).alias("n"))
    den = c.groupBy(*key).agg(F.sum(F.col("c") * F.col("c")).alias("den"))
    return num.join(den, list(key)).select(*key, "k", (F.col("n") / F.when(F.col("den") > 0, F.col("den"))).alias("r"))


def uniformity(votes: DataFrame, key=("asset",), value: str = "k") -> DataFrame:
    """The most frequent local size (ties: the least) and its share."""
    n = votes.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    m = n.groupBy(*key).agg(F.max(F.struct("n", (-F.col(value)).alias("k"))).alias("m"), F.sum("n").alias("all"))
    return m.select(*key, (-F.col("m.k")).alias("scale"), (F.col("m.n") / F.col("all")).alias("share"))


# Measures of one candidate ---------------------------------------------------------------------------
def _at_phase(px: DataFrame, best: DataFrame, key) -> DataFrame:
    """Pixels with the cells that they lie in at their canvas's sizes and phases; only whole cells."""
    j = px.join(best.select(*key, "s", "dx", "dy"), list(key))
    c = j.withColumns({"cx": F.floor((F.col("x") - F.col("dx")) / F.col("s")), "cy": F.floor((F.col("y") - F.col("dy")) / F.col("s"))})
    n = F.count("*").over(Window.partitionBy(*key, "s", "cx", "cy"))
    return c.withColumn("_n", n).where("_n = s * s").drop("_n")


def recon(px: DataFrame, best: DataFrame, delta: float, key=("asset",)) -> DataFrame:
    """(keys, s, rate): the share of pixels that are off their cell's mean by more than ``delta``."""
    cell = Window.partitionBy(*key, "s", "cx", "cy")
    off = _at_phase(px, best, key).withColumn("off", F.abs(F.col("idx") - F.avg("idx").over(cell)))
    return off.groupBy(*key, "s").agg(F.avg((F.round("off", 9) > delta).cast("int")).alias("rate"))


def contrast(variance: DataFrame, best: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, s, contrast): how many times the variance grows half a cell off the best phase, mean of both axes; 1 or 1e6 where the best is 0."""
    v = variance.select(*key, "s", F.col("dx").alias("ox"), F.col("dy").alias("oy"), F.col("v").alias("w"))
    half = F.floor(F.col("s") / 2)
    b = best.select(*key, "s", "dx", "dy", "v")
    out = b
    for axis, ox, oy in (("x", (F.col("dx") + half) % F.col("s"), F.col("dy")), ("y", F.col("dx"), (F.col("dy") + half) % F.col("s"))):
        w = v.select(*key, "s", "ox", "oy", F.col("w").alias(f"w{axis}"))
        out = out.withColumns({"ox": ox.cast("int"), "oy": oy.cast("int")}).join(w, [*key, "s", "ox", "oy"], "left").drop("ox", "oy")
    ratio = lambda c: F.when(F.round("v", 12) > 0, F.col(c) / F.col("v")).otherwise(F.when(F.round(c, 12) > 0, F.lit(1e6)).otherwise(F.lit(1.0)))
    return out.select(*key, "s", ((ratio("wx") + ratio("wy")) / 2).alias("contrast"))


def split_gain(px: DataFrame, best: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, s, gain): the share of the cells' variance that goes when cells of an even size are quartered."""
    c = _at_phase(px, best.where("s % 2 = 0"), key)
    own = Window.partitionBy(*key, "s", "cx", "cy")
    half = F.col("s") / 2
    quarter = Window.partitionBy(*key, "s", "cx", "cy", F.floor((F.col("x") - F.col("dx")) / half), F.floor((F.col("y") - F.col("dy")) / half))
    dev = c.withColumns({"a": F.col("idx") - F.avg("idx").over(own), "b": F.col("idx") - F.avg("idx").over(quarter)})
    g = dev.groupBy(*key, "s").agg(F.sum(F.col("a") * F.col("a")).alias("a"), F.sum(F.col("b") * F.col("b")).alias("b"))
    return g.select(*key, "s", F.when(F.round("a", 9) > 0, 1 - F.col("b") / F.col("a")).otherwise(F.lit(0.0)).alias("gain"))


def bands(px: DataFrame, s: int, height: int, key=("asset",)) -> DataFrame:
    """(keys, band, dx, v): the best phase across each band of rows for one size (ties: the lower)."""
    own = px.withColumns({"band": F.expr(f"cast(y div {height} as int)"), "y": F.expr(f"cast(y % {height} as int)")})
    tried = [(s, dx, 0) for dx in range(s)]

    def work(v: np.ndarray) -> dict[str, np.ndarray]:
        return {"dx": np.repeat(np.arange(s)[None], len(v), axis=0), "v": np.stack([_variance(v, *t) for t in tried], axis=1)}

    curve = stacks.per_canvas(own, work, "dx int, v double", (*key, "band"))
    m = curve.groupBy(*key, "band").agg(F.min(F.struct(F.round("v", 9).alias("v"), "dx")).alias("m"))
    return m.select(*key, "band", "m.dx", "m.v")


def drift(bands_: DataFrame, s: int, key=("asset",)) -> DataFrame:
    """(keys, bands, drift): the largest cyclic distance between two bands' phases."""
    a, b = (bands_.select(*key, F.col("dx").alias(c)).distinct() for c in "pq")  # phases, at most s of them
    d = F.abs(F.col("p") - F.col("q"))
    far = a.join(b, list(key)).groupBy(*key).agg(F.max(F.least(d, s - d)).alias("drift"))
    return bands_.groupBy(*key).agg(F.count("*").alias("bands")).join(far, list(key))


# Edge energy -----------------------------------------------------------------------------------------
def energy(px: DataFrame, order: int = 1, key=("asset",)) -> DataFrame:
    """(keys, x, e): sums over rows of the size of first or second differences; columns without one are left out."""
    row = Window.partitionBy(*key, "y").orderBy("x")
    one, two = F.lag("idx").over(row), F.lag("idx", 2).over(row)
    d = F.col("idx") - one if order == 1 else F.col("idx") - 2 * one + two
    return px.withColumn("_d", F.abs(d)).where("_d is not null").groupBy(*key, "x").agg(F.sum("_d").alias("e"))


def folded(e: DataFrame, s: int, key=("asset",)) -> DataFrame:
    """(keys, phase, e): energy summed by place modulo a size."""
    return e.groupBy(*key, F.pmod("x", F.lit(s)).cast("int").alias("phase")).agg(F.sum("e").alias("e"))


def relief(profile: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, relief): deviation over mean of a folded profile."""
    return profile.groupBy(*key).agg((F.stddev_pop("e") / F.when(F.avg("e") > 0, F.avg("e"))).alias("relief"))


def peaks(e: DataFrame, s: int, key=("asset",)) -> DataFrame:
    """(keys, x, place): places of largest energy nearby, above 1.5 times the mean (the first of a plateau), refined by a parabola."""
    r = max(1, round(s * 0.625))
    line = Window.partitionBy(*key).orderBy("x")
    p = e.withColumns({"_m": F.avg("e").over(Window.partitionBy(*key)), "_l": F.max("e").over(line.rangeBetween(-r, -1)), "_r": F.max("e").over(line.rangeBetween(1, r)), "_a": F.lag("e").over(line), "_b": F.lead("e").over(line)})
    p = p.where((F.col("e") > 1.5 * F.col("_m")) & (F.col("e") > F.coalesce("_l", F.lit(-1))) & (F.col("e") >= F.coalesce("_r", F.lit(-1))))
    bend = F.col("_a") - 2 * F.col("e") + F.col("_b")
    return p.select(*key, "x", (F.col("x") + F.coalesce(F.when(bend < 0, (F.col("_a") - F.col("_b")) / (2 * bend)), F.lit(0.0))).alias("place"))


def spacing(peaks_: DataFrame, s: int, key=("asset",)) -> DataFrame:
    """(keys, n, spacing, rms): the line through three peaks or more over their whole-number places, and its error."""
    line = Window.partitionBy(*key).orderBy("place")
    step = F.greatest(F.lit(1), F.floor((F.col("place") - F.lag("place").over(line)) / s + 0.5))
    p = peaks_.withColumn("_s", F.coalesce(step, F.lit(0))).withColumn("k", F.sum("_s").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    g = p.groupBy(*key).agg(F.count("*").alias("n"), F.regr_slope("place", "k").alias("spacing"), F.regr_sxx("place", "k").alias("xx"), F.regr_syy("place", "k").alias("yy"), F.regr_sxy("place", "k").alias("xy")).where("n >= 3")
    return g.select(*key, "n", "spacing", F.sqrt(F.greatest(F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx"), F.lit(0.0)) / F.col("n")).alias("rms"))


# Sizes and scaling ----------------------------------------------------------------------------------
def period(px: DataFrame, largest: int, key=("asset",)) -> DataFrame:
    """(keys, px_, py_, period): the lag of the best autocorrelation of edges on each axis, and the lesser where the two agree (by 1, or as multiples)."""
    def lag(df: DataFrame, name: str) -> DataFrame:
        r = autocorrelation(df, largest, key).where("k >= 2 AND r is not null")
        return r.groupBy(*key).agg(F.max(F.struct(F.round("r", 9).alias("r"), (-F.col("k")).alias("k"))).alias("m")).select(*key, (-F.col("m.k")).alias(name))

    turned = px.select(*key, F.col("y").alias("x"), F.col("x").alias("y"), "idx")
    j = lag(px, "px_").join(lag(turned, "py_"), list(key))
    low, high = F.least("px_", "py_"), F.greatest("px_", "py_")
    return j.withColumn("period", F.when((high - low <= 1) | (high % low == 0), low))


def block_size(px: DataFrame, w: int, largest: int, key=("asset",)) -> DataFrame:
    """(keys, k): the largest size of which a whole canvas (side ``w``) is made of even blocks; null for a flat one."""
    return tiles.mixel_votes(px, w, largest, key).select(*key, "k")


def downscale_mean(px: DataFrame, s: int, key=("asset",)) -> DataFrame:
    """The mean of each whole cell, cut to a whole number."""
    c = px.groupBy(*key, F.expr(f"cast(x div {s} as int)").alias("x"), F.expr(f"cast(y div {s} as int)").alias("y")).agg(F.sum("idx").alias("t"), F.count("*").alias("n"))
    return c.where(F.col("n") == s * s).select(*key, "x", "y", F.expr("cast(t div n as int)").alias("idx"))


def upscale(px: DataFrame, s: int, dx: int = 0, dy: int = 0, key=("asset",)) -> DataFrame:
    """Each pixel as a block of s x s; the first ``dx`` columns and ``dy`` rows are cut off."""
    o = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(s) for j in range(s)))).alias("o")
    p = px.select(*key, "x", "y", "idx", o).select(*key, (F.col("x") * s + F.col("o.i") - dx).cast("int").alias("x"), (F.col("y") * s + F.col("o.j") - dy).cast("int").alias("y"), "idx")
    return p.where("x >= 0 AND y >= 0")


def cyclic_spread(a: Column, s: int) -> Column:
    """The largest cyclic distance between two values of an array."""
    far = lambda x, y: F.least(F.abs(x - y), s - F.abs(x - y))
    return F.array_max(F.transform(a, lambda x: F.array_max(F.transform(a, lambda y: far(x, y)))))
