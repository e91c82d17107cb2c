"""Outlines in the colours of what they surround: removed, black, tinted, against a background, or shaded by a light.

Two stages: every border pixel wants a colour made from the one inside it; then each canvas admits the most wanted
colours that its palette lacks, ``most`` at most, and all wants go to the nearest entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.lineage import cut
from rasterlake.operators import color, quantize

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))
#: Fixed value: towards a light that shines to the lower left.
LIGHT = (0.6, -0.8)
STYLES = ("none", "black", "tinted", "contrast", "shaded")


def borders(px: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, x, y, idx, ox, oy, open): opaque pixels, the sum of the sides at which they meet clear pixels or the edge, and how many those are."""
    solid = px.where("idx <> 0")
    side = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in SIDES]))
    met = solid.select(*key, "x", "y", side.alias("s")).select(*key, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"))
    shut = met.groupBy(*key, "x", "y").agg(F.sum("dx").alias("sx"), F.sum("dy").alias("sy"), F.count("*").alias("n"))
    # What meets a pixel from its left comes with dx = 1: the closed sides are the opposite ones.
    j = solid.join(shut, [*key, "x", "y"], "left")
    return j.select(*key, "x", "y", "idx", F.coalesce("sx", F.lit(0)).cast("int").alias("ox"), F.coalesce("sy", F.lit(0)).cast("int").alias("oy"), (4 - F.coalesce("n", F.lit(0))).cast("int").alias("open"))


def inward(px: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, x, y, idx, ox, oy, inner): border pixels with the colour of the first pixel inward (slanting, then sideways, then up or down) that is opaque and no border; null where there is none."""
    b = cut(borders(px, key))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), (sx * -F.signum("ox")).cast("int").alias("dx"), (sy * -F.signum("oy")).cast("int").alias("dy")) for i, (sx, sy) in enumerate(((1, 1), (1, 0), (0, 1)))])
    edge = b.where("open > 0")
    to = edge.select(*key, "x", "y", F.explode(steps).alias("s")).where("s.dx <> 0 OR s.dy <> 0").select(*key, "x", "y", "s.i", (F.col("x") + F.col("s.dx")).alias("qx"), (F.col("y") + F.col("s.dy")).alias("qy"))
    inside = b.where("open = 0").select(*key, F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("idx").alias("v"))
    first = to.join(inside, [*key, "qx", "qy"]).groupBy(*key, "x", "y").agg(F.min_by("v", "i").alias("inner"))
    return edge.join(first, [*key, "x", "y"], "left").select(*key, "x", "y", "idx", "ox", "oy", "inner")


def _lit(light: tuple[float, float]) -> Column:
    """Cosine between the outward direction and the light's; 0 where a pixel is open to opposite sides."""
    size = F.sqrt((F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy")).cast("double"))
    return F.coalesce((F.col("ox") * light[0] + F.col("oy") * light[1]) / F.when(size > 0, size), F.lit(0.0))


def wants(edge: DataFrame, pal: DataFrame, style: str, light=LIGHT, selective: bool = False, bright: bool = True, darken: float = 0.45, tolerance: float = 0.03, key=("asset",)) -> DataFrame:
    """(keys, x, y, ox, oy, l, a_, b_): the colour that each border pixel's outline should have; none where nothing is inside, nor, if selective, on the lit side.

    bright: the background is brighter than the colour (style contrast).
    """
    e = edge.where("inner is not null").withColumn("lit", _lit(light))
    e = e.where("lit <= 0") if selective else e
    base = F.broadcast(color.with_oklab(pal).select(F.col("idx").alias("inner"), *[(F.round(F.col(c) / (tolerance * 4)) * (tolerance * 4)).alias(f"q{c}") for c in ("l", "a_", "b_")]))
    e = e.join(base, "inner")
    k = F.lit(darken) + (1 - darken) * 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("lit"))) if style == "shaded" else F.lit(darken)
    kc = F.greatest(k, F.lit(0.5))
    dark = [F.greatest(F.col("ql") * k, F.lit(0.02)), F.col("qa_") * kc, F.col("qb_") * kc]
    pale = [F.least(F.col("ql") + (1 - F.col("ql")) * (1 - darken), F.lit(0.98)), F.col("qa_"), F.col("qb_")]
    lab = [F.lit(0.0)] * 3 if style == "black" else pale if style == "contrast" and not bright else dark
    return e.select(*key, "x", "y", "ox", "oy", *[c.alias(n) for c, n in zip(lab, ("l", "a_", "b_"))])


def admitted(wanted: DataFrame, pal: DataFrame, most: int = 4, tolerance: float = 0.03, key=("asset",)) -> DataFrame:
    """(keys, idx, r, g, b): of each canvas's ``most`` most wanted colours (ties: the darkest), in order, those that no entry nor one admitted before is near; numbered after the palette, up to 256 entries."""
    n = wanted.groupBy(*key, *[F.round(F.col(c), 4).alias(c) for c in ("l", "a_", "b_")]).agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "l", "a_", "b_"))).where(F.col("k") <= most)
    rgb = top.withColumns({f"t{c}": F.col(c) for c in ("l", "a_", "b_")}).withColumns(dict(zip("rgb", quantize.to_rgb(F.col("l"), F.col("a_"), F.col("b_"))))).drop("l", "a_", "b_")
    lab = color.with_oklab(rgb)
    near = F.broadcast(color.named(color.with_oklab(pal).where("idx <> 0"), "p_"))
    t = {"l": F.col("tl") - F.col("p_l"), "a_": F.col("ta_") - F.col("p_a_"), "b_": F.col("tb_") - F.col("p_b_")}
    far = lab.join(near, F.sqrt(sum((d * d for d in t.values()), F.lit(0.0))) <= tolerance, "left_anti")
    c = far.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "r", "g", "b", "l", "a_", "b_", "tl", "ta_", "tb_"))).alias("c"))
    beside = f"sqrt(power(o.l - e.tl, 2) + power(o.a_ - e.ta_, 2) + power(o.b_ - e.tb_, 2)) <= {tolerance}"
    kept = F.expr(f"reduce(c, slice(c, 1, 0), (kept, e) -> CASE WHEN exists(kept, o -> {beside}) THEN kept ELSE array_append(kept, e) END)")
    size = pal.agg(F.max("idx")).first()[0] + 1
    return c.select(*key, F.posexplode(kept).alias("i", "v")).select(*key, (F.col("i") + size).alias("idx"), "v.r", "v.g", "v.b").where("idx < 256")


def outlined(px: DataFrame, pal: DataFrame, style: str = "tinted", outer: bool = False, most: int = 4, tolerance: float = 0.03, key=("asset",), **options) -> tuple[DataFrame, DataFrame]:
    """The canvases (keys, x, y, idx) with their outlines, and the colours admitted (keys, idx, r, g, b).

    none: border pixels take the colour inside. outer: the clear pixels beside the border are painted, not the border
    (of several wants the last counts, by row, column and side).
    """
    if style not in STYLES:
        raise ValueError(f"no style {style!r}")
    edge = cut(inward(px, key))
    if style == "none":
        to = edge.where("inner is not null").select(*key, "x", "y", F.col("inner").alias("to"))
        new = pal.limit(0).crossJoin(px.select(*key).limit(0)).select(*key, "idx", "r", "g", "b")
    else:
        w = wants(edge, pal, style, tolerance=tolerance, key=key, **options)
        if outer:
            side = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(SIDES)]))
            w = w.select(*key, F.struct("y", "x").alias("p"), "l", "a_", "b_", "x", "y", side.alias("s"))
            w = w.select(*key, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.struct("p", "s.i").alias("o"), "l", "a_", "b_")
            w = w.join(px.where("idx = 0").select(*key, "x", "y"), [*key, "x", "y"])
        else:
            w = w.withColumn("o", F.lit(0))
        w = cut(w)
        new = cut(admitted(w, pal, most, tolerance, key))
        last = w.groupBy(*key, "x", "y").agg(F.max_by(F.struct("l", "a_", "b_"), "o").alias("c")).select(*key, "x", "y", *[c.alias(n) for n, c in zip("rgb", quantize.to_rgb(F.col("c.l"), F.col("c.a_"), F.col("c.b_")))])
        every = px.select(*key).distinct().join(F.broadcast(pal.where("idx <> 0").select("idx", "r", "g", "b"))).unionByName(new)
        tones = color.with_oklab(last.select(*key, "r", "g", "b").distinct())
        entries = color.with_oklab(every).select(*key, *[F.col(c).alias(f"p_{c}") for c in ("idx", "l", "a_", "b_")])
        near = tones.join(entries, list(key)).groupBy(*key, "r", "g", "b").agg(F.min(F.struct(F.round(color.distance_sq("", "p_"), 12).alias("d"), F.col("p_idx"))).alias("m"))
        to = last.join(near, [*key, "r", "g", "b"]).select(*key, "x", "y", F.col("m.p_idx").alias("to"))
    out = px.join(to, [*key, "x", "y"], "left").select(*key, "x", "y", F.coalesce("to", "idx").cast("int").alias("idx"))
    return out, new
