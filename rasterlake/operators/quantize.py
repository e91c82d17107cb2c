"""Palettes forced on images, ramps, reduction of colours, and cleaning of indexed canvases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.operators import color, lint, points, regions

#: The published inverse OKLab matrices.
TO_ROOTS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
TO_LINEAR = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
HUE_LIGHT, HUE_DARK, LEAST_LIGHT, LEAST_CHROMA = 100.0, 300.0, 0.12, 0.02
MOST = 256


def linear_rgb(l: Column, a: Column, b: Column) -> list[Column]:  # noqa: E741
    """Linear red, green and blue of OKLab columns, unclipped."""
    roots = [x * l + y * a + z * b for x, y, z in TO_ROOTS]
    cones = [r * r * r for r in roots]
    return [sum((m * c for m, c in zip(row[1:], cones[1:])), row[0] * cones[0]) for row in TO_LINEAR]


def to_rgb(l: Column, a: Column, b: Column) -> list[Column]:  # noqa: E741
    """Whole sRGB channels of OKLab columns, clipped and rounded."""
    return [_channel(c) for c in linear_rgb(l, a, b)]


def _channel(c: Column) -> Column:
    v = F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def spread(pal: DataFrame, transparent: int = 0) -> DataFrame:
    """(spread): the mean step between neighbouring lightnesses of a palette's opaque entries; one row."""
    l = color.with_oklab(pal).where(F.col("idx") != transparent)  # noqa: E741
    return l.agg(F.coalesce(F.when(F.count("*") > 1, (F.max("l") - F.min("l")) / (F.count("*") - 1)), F.lit(0.0)).alias("spread"))


def direct(rgb: DataFrame, pal: DataFrame, side: int = 0, strength: float = 1.0, weight: float = 1.0, transparent: int = 0, key=("asset",)) -> DataFrame:
    """(keys, x, y, idx): the nearest opaque entry for each pixel (keys, x, y, r, g, b), with an ordered dither of a matrix side if given.

    Distinct colours and thresholds meet the palette (256 entries at most), not pixels.
    """
    t = points.bayer(F.col("x"), F.col("y"), side) if side else F.lit(0)
    p = rgb.withColumn("_t", t.cast("int"))
    off = (F.col("_t") / (side * side) - 0.5) * F.col("spread") * strength if side else F.lit(0.0)
    c = color.with_oklab(p.select("r", "g", "b", "_t").distinct()).join(F.broadcast(spread(pal, transparent)), F.lit(True)).withColumn("l", F.col("l") + off)
    own = F.broadcast(color.named(color.with_oklab(pal).where(F.col("idx") != transparent), "p_"))
    near = c.join(own, F.lit(True)).groupBy("r", "g", "b", "_t").agg(F.min(F.struct(F.round(color.distance_sq("", "p_", weight), 12).alias("d"), F.col("p_idx"))).alias("m"))
    return p.join(near, ["r", "g", "b", "_t"]).select(*key, "x", "y", F.col("m.p_idx").alias("idx"))


def nearest_other(pal: DataFrame, transparent: int = 0) -> DataFrame:
    """(idx, other, distance): for each opaque entry the nearest other one; ties go to the lower index."""
    p = color.with_oklab(pal).where(F.col("idx") != transparent)
    j = color.named(p, "x_").join(F.broadcast(color.named(p, "y_")), F.col("x_idx") != F.col("y_idx"))
    m = j.groupBy("x_idx").agg(F.min(F.struct(F.round(color.distance_sq("x_", "y_"), 12).alias("d"), F.col("y_idx"))).alias("m"))
    return m.select(F.col("x_idx").alias("idx"), F.col("m.y_idx").alias("other"), F.sqrt("m.d").alias("distance"))


def merge_small(px: DataFrame, pal: DataFrame, least: int, key=("asset",)) -> DataFrame:
    """Colours with fewer than ``least`` pixels of a canvas become the nearest colour that the canvas has more of."""
    a = color.areas(px, key).join(F.broadcast(color.with_oklab(pal)), "idx")
    small, big = a.where(F.col("area") < least), a.where(F.col("area") >= least)
    pick = lambda df, p: df.select(*key, *(F.col(c).alias(f"{p}{c}") for c in ("idx", "l", "a_", "b_")))
    j = pick(small, "x_").join(pick(big, "y_"), list(key))
    to = j.groupBy(*key, "x_idx").agg(F.min(F.struct(F.round(color.distance_sq("x_", "y_"), 12).alias("d"), F.col("y_idx"))).alias("m")).select(*key, F.col("x_idx").alias("idx"), F.col("m.y_idx").alias("_to"))
    return px.join(to, [*key, "idx"], "left").select(*key, "x", "y", F.coalesce("_to", "idx").alias("idx"))


# Ramps ---------------------------------------------------------------------------------------------
def in_gamut(l: Column, c: Column, h: Column) -> Column:  # noqa: E741
    """Whether a colour by lightness, chroma and hue (degrees) can be shown."""
    a, b = c * F.cos(F.radians(h)), c * F.sin(F.radians(h))
    rgb = linear_rgb(l, a, b)
    eps = 1e-4 / 12.92
    ok = F.lit(True)
    for v in rgb:
        ok = ok & (v >= -eps) & (v <= 1 + 1e-4 * 2.2)
    return ok


def clip_chroma(l: Column, c: Column, h: Column, steps: int = 24) -> Column:  # noqa: E741
    """The largest chroma up to ``c`` that can be shown, by halving."""
    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        ok = in_gamut(l, mid, h)
        return F.struct(F.when(ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(ok, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), c.cast("double").alias("hi")), halve, lambda acc: acc["lo"])
    return F.when(in_gamut(l, c, h), c).otherwise(found)


def chroma_factor(curve: str, t: Column) -> Column:
    """Of a ramp's chroma along it (0 dark, 1 light)."""
    return {"uniform": F.lit(1.0), "middle": 0.55 + 0.45 * F.sin(3.141592653589793 * t), "shadow": 1 - 0.45 * t, "light": 0.55 + 0.45 * t}[curve]


def ramp(bases: DataFrame, steps: int, low: float = 0.2, high: float = 0.95, shift: float = 20.0, curve: str = "middle") -> DataFrame:
    """(idx, step, r, g, b): for each base colour a ramp from dark to light whose hue turns to violet below and to yellow above."""
    b = color.with_oklab(bases).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    t = F.col("step") / (steps - 1)
    hue = F.pmod(F.degrees(F.atan2("b_", "a_")) + 360, F.lit(360.0))
    target = F.when(t >= 0.5, F.lit(HUE_LIGHT)).otherwise(F.lit(HUE_DARK))
    gap = F.pmod(target - F.col("_h") + 540, F.lit(360.0)) - 180  # -180 up to 180
    b = b.withColumn("_h", hue).withColumn("_l", F.lit(max(low, LEAST_LIGHT)) + (high - max(low, LEAST_LIGHT)) * t)
    b = b.withColumn("_turn", F.signum(gap) * F.least(F.abs(gap), shift * F.abs(2 * t - 1))).withColumn("_h", F.pmod(F.col("_h") + F.col("_turn") + 360, F.lit(360.0)))
    c = F.hypot("a_", "b_") * chroma_factor(curve, t)
    b = b.withColumn("_c", F.when(F.col("step") == 0, F.greatest(c, F.lit(LEAST_CHROMA))).otherwise(c))
    # Each step is a column of its own, so that no expression holds another many times over.
    b = b.withColumn("_c", clip_chroma(F.col("_l"), F.col("_c"), F.col("_h")))
    b = b.withColumns({"_a": F.col("_c") * F.cos(F.radians("_h")), "_bb": F.col("_c") * F.sin(F.radians("_h"))})
    return with_rgb(b.select("idx", "step", "_l", "_a", "_bb"), "_l", "_a", "_bb")


def with_rgb(df: DataFrame, l: str, a: str, b: str) -> DataFrame:  # noqa: E741
    """In place of OKLab columns whole sRGB channels r, g, b."""
    roots = {f"_q{i}": x * F.col(l) + y * F.col(a) + z * F.col(b) for i, (x, y, z) in enumerate(TO_ROOTS)}
    d = df.withColumns(roots).withColumns({f"_k{i}": F.col(f"_q{i}") * F.col(f"_q{i}") * F.col(f"_q{i}") for i in range(3)})
    d = d.withColumns({f"_n{i}": row[0] * F.col("_k0") + row[1] * F.col("_k1") + row[2] * F.col("_k2") for i, row in enumerate(TO_LINEAR)})
    rgb = F.array(F.struct(*(_channel(F.col(f"_n{i}")).alias(n) for i, n in enumerate("rgb"))))
    kept = [c for c in df.columns if c not in (l, a, b)]
    return d.select(*kept, F.explode(rgb).alias("_rgb")).select(*kept, "_rgb.r", "_rgb.g", "_rgb.b")


# Palettes ------------------------------------------------------------------------------------------
def denormalised(px: DataFrame, table: DataFrame, key=("asset",)) -> DataFrame:
    """Canvas of indices by lightness back to the palette's own; table: idx, new_idx."""
    return px.withColumnRenamed("idx", "new_idx").join(F.broadcast(table.select("idx", "new_idx")), "new_idx").select(*key, "x", "y", "idx")


def with_entry(pal: DataFrame, idx: int, r: int, g: int, b: int) -> DataFrame:
    """Palette with one entry replaced, or added at the end; more than 256 entries are an error."""
    kept = pal.where(F.col("idx") != idx)
    n = F.when(F.lit(idx) >= MOST, F.raise_error(F.lit("a palette has 256 entries at most")).cast("int")).otherwise(F.lit(idx))
    one = pal.sparkSession.range(1).select(n.alias("idx"), *(F.lit(v).alias(c) for v, c in zip((r, g, b), "rgb")))
    return kept.unionByName(one)


def ramp_neighbours(ramps: DataFrame) -> DataFrame:
    """(a, b): pairs of indices next to each other in some ramp (ramp, pos, idx), a < b."""
    nxt = F.lead("idx").over(Window.partitionBy("ramp").orderBy("pos"))
    p = ramps.withColumn("n", nxt).where("n is not null")
    return p.select(F.least("idx", "n").alias("a"), F.greatest("idx", "n").alias("b")).distinct()


def colour_report(px: DataFrame, pal: DataFrame, key=("asset",)) -> DataFrame:
    """Of each colour of a canvas: area, regions, largest region, share and lightness."""
    s = regions.stats(regions.label(px, key), key).where("idx <> 0").groupBy(*key, "idx").agg(F.sum("area").alias("area"), F.count("*").alias("regions"), F.max("area").alias("largest"))
    l = F.broadcast(color.with_oklab(pal).select("idx", "l"))  # noqa: E741
    return s.join(l, "idx").withColumn("share", F.col("area") / F.sum("area").over(Window.partitionBy(*key)))


# Cleaning ------------------------------------------------------------------------------------------
def remove_isolated(px: DataFrame, least: int, key=("asset",)) -> DataFrame:
    """Opaque regions below ``least`` pixels take the colour that they touch most (ties: the lower index)."""
    lab = regions.label(px, key)
    small = lab.where("idx <> 0").groupBy(*key, "root").agg(F.count("*").alias("n")).where(F.col("n") < least).select(*key, "root")
    near = lint.around(lab, key)
    side = lint.around(lab, key, "root")
    both = near.join(side.select(*key, "x", "y", *(F.col(c).alias(f"r{c}") for c in "lrud")), [*key, "x", "y"]).join(small, [*key, "root"], "left_semi")
    touch = both.select(*key, "root", F.explode(F.array(*(F.struct(F.col(c).alias("i"), F.col(f"r{c}").alias("o")) for c in "lrud"))).alias("t")).where("t.o is not null AND t.o <> root")
    to = touch.groupBy(*key, "root", "t.i").agg(F.count("*").alias("n")).groupBy(*key, "root").agg(F.max(F.struct("n", (-F.col("i")).alias("i"))).alias("m")).select(*key, "root", (-F.col("m.i")).alias("_to"))
    return lab.join(to, [*key, "root"], "left").select(*key, "x", "y", F.coalesce("_to", "idx").alias("idx"))


def remove_between(px: DataFrame, pal: DataFrame, tolerance: float, most: int, key=("asset",)) -> DataFrame:
    """Colours with at most ``most`` pixels that are about the mean of two larger colours become the nearer of these."""
    a = color.areas(px, key).join(F.broadcast(color.with_oklab(pal)), "idx")
    c, x, y = (a.select(*key, *(F.col(k).alias(f"{p}{k}") for k in ("idx", "area", "l", "a_", "b_"))) for p in ("c_", "x_", "y_"))
    j = c.where(F.col("c_area") <= most).join(x, list(key)).where("x_area > c_area").join(y, list(key)).where("y_area > c_area AND x_idx < y_idx")
    off = [F.col(f"c_{k}") - (F.col(f"x_{k}") + F.col(f"y_{k}")) / 2 for k in ("l", "a_", "b_")]
    j = j.withColumn("d", F.round(F.sqrt(sum((o * o for o in off[1:]), off[0] * off[0])), 9)).where(F.col("d") <= tolerance)
    dx, dy = (F.round(color.distance_sq("c_", p), 12) for p in ("x_", "y_"))
    to = j.groupBy(*key, "c_idx").agg(F.min(F.struct("d", "x_idx", "y_idx", F.when(dx <= dy, F.col("x_idx")).otherwise(F.col("y_idx")).alias("to"))).alias("m")).select(*key, F.col("c_idx").alias("idx"), F.col("m.to").alias("_to"))
    return px.join(to, [*key, "idx"], "left").select(*key, "x", "y", F.coalesce("_to", "idx").alias("idx"))


def pattern_match(px: DataFrame, opts: dict, key=("asset",)) -> DataFrame:
    """Dither windows with the best share of pixels that a regular pattern explains: checkers of 1 and 2, three Bayer levels, each at four offsets."""
    s = opts["window"]
    k = [*key, "wx", "wy"]
    w = px.withColumns({"wx": F.expr(f"cast(x div {s} as int)"), "wy": F.expr(f"cast(y div {s} as int)")}).join(lint.dither_windows(px, opts, key), k).where("idx = a OR idx = b")
    hits = []
    for ox, oy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        x, y = F.col("x") + ox, F.col("y") + oy
        for set_ in (points.checker(x, y, 1), points.checker(x, y, 2), *(points.bayer(x, y, 4) >= n for n in (4, 8, 12))):
            hits.append(F.avg((F.when(set_, F.col("a")).otherwise(F.col("b")) == F.col("idx")).cast("int")))
    return w.groupBy(*k).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.greatest(*hits).alias("match"), F.count_if(F.col("idx") == F.col("a")).alias("na"), F.count("*").alias("n"))


def denoise(px: DataFrame, opts: dict, regular: float = 0.85, key=("asset",)) -> DataFrame:
    """Windows of irregular dither get a Bayer pattern of the same density."""
    s = opts["window"]
    k = [*key, "wx", "wy"]
    bad = pattern_match(px, opts, key).where(F.round("match", 9) < regular).select(*k, "a", "b", F.floor(F.col("na") / F.col("n") * 16 + 0.5).cast("int").alias("level"))
    w = px.withColumns({"wx": F.expr(f"cast(x div {s} as int)"), "wy": F.expr(f"cast(y div {s} as int)")}).join(bad, k, "left")
    new = F.when(points.bayer(F.col("x"), F.col("y"), 4) >= F.col("level"), F.col("a")).otherwise(F.col("b"))
    return w.select(*key, "x", "y", F.when((F.col("idx") == F.col("a")) | (F.col("idx") == F.col("b")), new).otherwise(F.col("idx")).alias("idx"))


def bayer_table(spark: SparkSession, side: int) -> DataFrame:
    """(x, y, rank) of a threshold matrix."""
    g = spark.range(side * side).select((F.col("id") % side).cast("int").alias("x"), F.expr(f"cast(id div {side} as int)").alias("y"))
    return g.withColumn("rank", points.bayer(F.col("x"), F.col("y"), side))
