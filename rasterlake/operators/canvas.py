"""Algebra on indexed canvases as relations: one row for each pixel (keys, x, y, idx).

Canvases are told apart by key columns; every operator keeps them, so all canvases are
worked on at once and a canvas never has to fit one row or one task. Index ``TRANSPARENT``
marks see-through pixels. Pixels outside a canvas do not exist: reads give null, writes are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSPARENT = 0
KEY = ("asset",)
NEAR4 = ((1, 0), (-1, 0), (0, 1), (0, -1))


def filled(keys: DataFrame, width: int, height: int, idx: int) -> DataFrame:
    """A constant canvas for each row of keys."""
    return keys.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("idx", F.lit(idx))


def from_pixels(wide: DataFrame, width: str = "w", pixels: str = "pixels", key=KEY) -> DataFrame:
    """The wide form (pixels in row order) as rows."""
    p = wide.select(*key, F.col(width).alias("_w"), F.posexplode(pixels).alias("_p", "idx"))
    return p.select(*key, F.expr("cast(_p % _w as int)").alias("x"), F.expr("cast(_p div _w as int)").alias("y"), "idx")


def to_pixels(px: DataFrame, key=KEY) -> DataFrame:
    """The rows of each canvas as one wide row, in row order."""
    cell = F.array_sort(F.collect_list(F.struct("y", "x", "idx")))
    return px.groupBy(*key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.transform(cell, lambda c: c["idx"]).alias("pixels"))


def opaque(px: DataFrame) -> DataFrame:
    return px.where(F.col("idx") != TRANSPARENT)


def mask_of(px: DataFrame, idx: int) -> DataFrame:
    return px.where(F.col("idx") == idx)


def remap(px: DataFrame, table: dict[int, int]) -> DataFrame:
    """Indices replaced by a table of at most 256 entries; others stay."""
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return px.withColumn("idx", F.coalesce(F.element_at(pairs, F.col("idx")), F.col("idx")))


def bbox(px: DataFrame, key=KEY) -> DataFrame:
    """Bounding box of the opaque pixels; no row for a canvas without any."""
    return opaque(px).groupBy(*key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


def crop(px: DataFrame, x0: int, y0: int, w: int, h: int, fill: int = TRANSPARENT, key=KEY) -> DataFrame:
    """A rectangle of each canvas, with its own origin; filled where it reaches outside."""
    inside = px.where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1)).select(*key, (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), "idx")
    grid = filled(px.select(*key).distinct(), w, h, fill).withColumnRenamed("idx", "_fill")
    return grid.join(inside, [*key, "x", "y"], "left").select(*key, "x", "y", F.coalesce("idx", "_fill").alias("idx"))


def blit(base: DataFrame, top: DataFrame, dx: int, dy: int, skip_transparent: bool = True, key=KEY) -> DataFrame:
    """``top`` drawn over ``base`` at an offset; what falls outside is lost."""
    t = top.select(*key, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("idx").alias("_top"))
    if skip_transparent:
        t = t.where(F.col("_top") != TRANSPARENT)
    return base.join(t, [*key, "x", "y"], "left").select(*key, "x", "y", F.coalesce("_top", "idx").alias("idx"))


def boundary(px: DataFrame, key=KEY) -> DataFrame:
    """Opaque pixels with a neighbour (of four) that is not opaque or outside."""
    m = opaque(px).select(*key, "x", "y")
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEAR4])
    near = m.select(*key, F.explode(offsets).alias("o"), "x", "y").select(*key, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    inner = near.groupBy(*key, "x", "y").agg(F.count("*").alias("n")).where("n = 4").select(*key, "x", "y")
    return m.join(inner, [*key, "x", "y"], "left_anti")


def inverted(px: DataFrame, mask: DataFrame, key=KEY) -> DataFrame:
    return px.select(*key, "x", "y").join(mask, [*key, "x", "y"], "left_anti")


def diff(a: DataFrame, b: DataFrame, key=KEY) -> DataFrame:
    """Pixels that differ, with both indices; canvases of other sizes are an error."""
    none = F.lit(None).cast("int")
    both = a.select(*key, "x", "y", F.col("idx").alias("before"), none.alias("after")).unionByName(b.select(*key, "x", "y", none.alias("before"), F.col("idx").alias("after")))
    met = both.groupBy(*key, "x", "y").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    alone = F.col("before").isNull() | F.col("after").isNull()
    return met.where(F.when(alone, F.raise_error(F.lit("canvases of different sizes")).cast("boolean")).otherwise(F.col("before") != F.col("after")))


def mirror(px: DataFrame, width: int) -> DataFrame:
    return px.withColumn("x", F.lit(width - 1) - F.col("x"))


def quarter_turn(px: DataFrame, height: int) -> DataFrame:
    """Clockwise."""
    return px.withColumn("_x", F.lit(height - 1) - F.col("y")).withColumn("y", F.col("x")).withColumn("x", F.col("_x")).drop("_x")


def offset(px: DataFrame, dx: int, dy: int, w: int, h: int) -> DataFrame:
    return px.withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy).where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))


def sample(px: DataFrame, w: int, h: int, source_x: Column, source_y: Column, fill: int = TRANSPARENT, key=KEY) -> DataFrame:
    """Inverse mapping: each pixel of a w x h canvas takes the pixel at (source_x, source_y), else the fill."""
    grid = filled(px.select(*key).distinct(), w, h, fill).withColumnRenamed("idx", "_fill").withColumn("_sx", source_x.cast("int")).withColumn("_sy", source_y.cast("int"))
    src = px.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("x").alias("_px"), F.col("y").alias("_py"), "idx")
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("_sx") == F.col("_px"), F.col("_sy") == F.col("_py")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return grid.join(src, cond, "left").select(*key, "x", "y", F.coalesce("idx", "_fill").alias("idx"))


def affine_nearest(px: DataFrame, w: int, h: int, a: int, b: int, c: int, d: int, den: int, key=KEY) -> DataFrame:
    """Nearest sampling through a matrix of whole numbers over ``den``, about the origin."""
    return sample(px, w, h, F.floor((a * F.col("x") + b * F.col("y")) / den), F.floor((c * F.col("x") + d * F.col("y")) / den), key=key)


def squash(px: DataFrame, w: int, h: int, new_h: int, key=KEY) -> DataFrame:
    """Height scaled to ``new_h`` from the bottom edge, pixel centres mapped back."""
    sy = F.floor((2 * (F.col("y") - (h - new_h)) + 1) * h / (2 * new_h))
    return sample(px, w, h, F.col("x"), F.when(F.col("y") >= h - new_h, sy), key=key)


def union_of_frames(px: DataFrame, back: int, key=KEY) -> DataFrame:
    """For each frame the opaque pixels of it and of the ``back`` frames before it."""
    m = opaque(px).select(*key, "frame", "x", "y")
    last = m.select(*key, "frame").distinct()
    spread = m.withColumn("frame", F.explode(F.sequence(F.col("frame"), F.col("frame") + back)))
    return spread.join(last, [*key, "frame"], "left_semi").distinct()


def afterimage(px: DataFrame, trail: int, key=KEY) -> DataFrame:
    """Pixels that the last ``trail`` frames had and the frame has not, with the age of the youngest."""
    m = opaque(px).select(*key, "frame", "x", "y")
    old = m.withColumn("age", F.explode(F.sequence(F.lit(1), F.lit(trail)))).withColumn("frame", F.col("frame") + F.col("age"))
    shown = old.join(m.select(*key, "frame").distinct(), [*key, "frame"], "left_semi").join(m, [*key, "frame", "x", "y"], "left_anti")
    return shown.groupBy(*key, "frame", "x", "y").agg(F.min("age").alias("age"))


def stroke(points: DataFrame, radius: int, order: str = "seq", key=KEY) -> DataFrame:
    """Pixels of a round brush along the straight lines between points in order (as many steps as the longer axis)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order)
    seg = points.withColumn("_nx", F.coalesce(F.lead("x").over(w), F.col("x"))).withColumn("_ny", F.coalesce(F.lead("y").over(w), F.col("y")))
    n = F.greatest(F.abs(F.col("_nx") - F.col("x")), F.abs(F.col("_ny") - F.col("y")))
    step = seg.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda a, b: (F.col(a) + F.when(F.col("_n") == 0, F.lit(0)).otherwise(F.round((F.col(b) - F.col(a)) * F.col("_i") / F.col("_n")))).cast("int")
    disc = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    dots = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in disc])
    line = step.select(*key, at("x", "_nx").alias("_x"), at("y", "_ny").alias("_y"), F.explode(dots).alias("d"))
    return line.select(*key, (F.col("_x") + F.col("d.dx")).alias("x"), (F.col("_y") + F.col("d.dy")).alias("y")).distinct()
