"""Stacks of layers, facing directions, shading fields, outlines, air perspective and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import canvas, color

DIRECTIONS = ("n", "ne", "e", "se", "s", "sw", "w", "nw")
MIRRORED = {"ne": "nw", "e": "w", "se": "sw", "nw": "ne", "w": "e", "sw": "se"}


def stack(layers: DataFrame, anchors: DataFrame, w: int, h: int, key=("asset",)) -> DataFrame:
    """Layers drawn in order of ``layer``, each moved so that its anchor meets the base's; anchors: keys, layer, ax, ay."""
    base = anchors.where("layer = 0").select(*key, F.col("ax").alias("bx"), F.col("ay").alias("by"))
    at = anchors.join(base, list(key)).select(*key, "layer", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"))
    moved = layers.where("idx <> 0").join(at, [*key, "layer"]).withColumn("x", F.col("x") + F.col("dx")).withColumn("y", F.col("y") + F.col("dy")).where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    return moved.groupBy(*key, "x", "y").agg(F.max_by("idx", "layer").alias("idx"))


def missing_directions(have: DataFrame, key=("asset",)) -> DataFrame:
    """For each asset the directions it lacks, and the one whose mirror image would do (null: none)."""
    names = F.array(*map(F.lit, DIRECTIONS))
    every = have.select(*key).distinct().withColumn("direction", F.explode(names))
    lack = every.join(have, [*key, "direction"], "left_anti")
    pair = F.create_map(*[F.lit(v) for kv in MIRRORED.items() for v in kv])
    lack = lack.withColumn("source", F.element_at(pair, F.col("direction")))
    found = have.select(*key, F.col("direction").alias("source"), F.lit(True).alias("_has"))
    return lack.join(found, [*key, "source"], "left").select(*key, "direction", F.when(F.col("_has"), F.col("source")).alias("source"))


def box_blur(field: DataFrame, w: int, h: int, value: str = "d", key=("asset",)) -> DataFrame:
    """Mean of 3 x 3; beyond the edge the edge repeats."""
    row, col = Window.partitionBy(*key, "y").orderBy("x"), Window.partitionBy(*key, "x").orderBy("y")
    side = lambda c, w: F.col(c) + F.coalesce(F.lag(c).over(w), F.col(c)) + F.coalesce(F.lead(c).over(w), F.col(c))
    return field.withColumn("_b", side(value, row)).withColumn(value, side("_b", col) / 9).select(*key, "x", "y", value)


def bounce_distance(px: DataFrame, reach: int, key=("asset",)) -> DataFrame:
    """For opaque pixels: how many opaque pixels lie below before the first that isn't, up to ``reach``."""
    m = canvas.opaque(px).select(*key, "x", "y")
    look = m.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(reach)))).select(*key, "x", F.col("y").alias("oy"), (F.col("y") + F.col("k")).alias("y"), "k")
    out = look.join(m, [*key, "x", "y"], "left_anti").groupBy(*key, "x", F.col("oy").alias("y")).agg((F.min("k") - 1).alias("bounce"))
    return m.join(out, [*key, "x", "y"], "left")


def incidence(nx: Column, ny: Column, lx: float, ly: float) -> Column:
    """Illuminance of a directional light (a unit vector towards it)."""
    return F.greatest(nx * lx + ny * ly, F.lit(0.0))


def ramp_index(t: Column, steps: int) -> Column:
    return F.least(F.floor(t * (steps - 1) + 1e-9), F.lit(steps - 1))


def outline(px: DataFrame, idx: int, w: int, h: int, key=("asset",)) -> DataFrame:
    """Clear pixels next to (four ways) an opaque one take the outline's index."""
    offs = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in canvas.NEAR4])
    m = canvas.opaque(px).select(*key, "x", "y")
    ring = m.withColumn("o", F.explode(offs)).select(*key, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct().withColumn("_ring", F.lit(True))
    j = px.join(ring, [*key, "x", "y"], "left")
    return j.select(*key, "x", "y", F.when((F.col("idx") == 0) & F.col("_ring"), F.lit(idx)).otherwise(F.col("idx")).alias("idx"))


def atmosphere(pal: DataFrame, sky: int, amount: float) -> DataFrame:
    """For each entry the palette's entry nearest to it after mixing with the sky's colour in OKLab."""
    lab = color.with_oklab(pal)
    s = F.broadcast(color.named(lab.where(F.col("idx") == sky), "s_"))  # one row
    mixed = lab.join(s, F.lit(True)).select(F.col("idx").alias("m_idx"), *[(F.col(c) * (1 - amount) + F.col(f"s_{c}") * amount).alias(f"m_{c}") for c in ("l", "a_", "b_")])
    d = mixed.join(F.broadcast(color.named(lab, "p_")), F.lit(True)).withColumn("d", F.round(color.distance_sq("m_", "p_"), 12))
    return d.groupBy(F.col("m_idx").alias("idx")).agg(F.min(F.struct("d", "p_idx")).alias("n")).select("idx", F.col("n.p_idx").alias("to_idx"))


def dimetric(px: DataFrame, w: int, h: int, key=("asset",)) -> DataFrame:
    """A canvas seen as a side wall at one step down for two across: each column sinks by half its x."""
    return px.withColumn("y", (F.col("y") + F.floor(F.col("x") / 2)).cast("int"))


def parallax(depths: DataFrame, speed: float) -> DataFrame:
    """Scroll offset of each depth: farther layers move less; depths: layer, depth (0 is nearest)."""
    return depths.withColumn("offset", F.round(F.lit(speed) / (1 + F.col("depth")), 6))


def hold_last(px: DataFrame, key=("asset",)) -> DataFrame:
    """The last opaque index that each pixel of a sequence has had."""
    w = Window.partitionBy(*key, "x", "y").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumn("held", F.last(F.when(F.col("idx") != 0, F.col("idx")), ignorenulls=True).over(w))


def palette_merges(px: DataFrame, limit: int, key: str = "asset") -> DataFrame:
    """(base, equip, colours, over): colours that two canvases have together, for all pairs of a small set of canvases.

    A canvas has 256 colours at most, so its set is one array.
    """
    c = px.groupBy(key).agg(F.collect_set("idx").alias("c"))
    both = c.select(F.col(key).alias("base"), F.col("c").alias("a")).join(c.select(F.col(key).alias("equip"), F.col("c").alias("b")), F.col("base") < F.col("equip"))
    n = F.size(F.array_union("a", "b"))
    return both.select("base", "equip", n.alias("colours"), (n > limit).alias("over"))


def pick(frame: Column, delay: Column, count: Column, wrap: bool) -> Column:
    """Which of ``count`` frames (from 0) a part shows at a frame: it lags by its delay, held at the ends or going round."""
    at = frame - delay
    return F.pmod(at, count) if wrap else F.least(F.greatest(at, F.lit(0)), count - 1)


def composed(parts: DataFrame, layout: DataFrame, w: int, h: int, wrap: bool = False, key=("asset",)) -> DataFrame:
    """(keys, frame, x, y, idx) of parts drawn over each other; parts: keys, layer, frame (from 0), x, y, idx; layout: keys, layer, dx, dy, delay.

    There are as many frames as the longest part has; a part's frames are picked by its delay.
    """
    n = parts.groupBy(*key, "layer").agg((F.max("frame") + 1).alias("count"))
    most = n.groupBy(*key).agg(F.max("count").alias("most"))
    shown = n.join(layout, [*key, "layer"]).join(most, list(key)).withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("most").cast("int") - 1)))
    shown = shown.select(*key, "layer", "dx", "dy", F.col("frame").alias("_at"), pick(F.col("frame"), F.col("delay"), F.col("count"), wrap).cast("int").alias("frame"))
    p = parts.where("idx <> 0").join(shown, [*key, "layer", "frame"])
    p = p.select(*key, F.col("_at").alias("frame"), "layer", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "idx").where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    return p.groupBy(*key, "frame", "x", "y").agg(F.max_by("idx", "layer").alias("idx"))


def hidden(placed: DataFrame, w: int, h: int, key=("asset",)) -> DataFrame:
    """(keys, layer, covered, outside): opaque pixels under a higher layer, and beyond the canvas; placed: keys, layer, x, y, idx."""
    m = placed.where("idx <> 0")
    inside = F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1)
    top = F.max("layer").over(Window.partitionBy(*key, "x", "y"))
    c = m.withColumn("_top", top)
    return c.groupBy(*key, "layer").agg(F.count_if(inside & (F.col("_top") > F.col("layer"))).alias("covered"), F.count_if(~inside).alias("outside"))


def canvas_of(boxes: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, x, y, w, h): the smallest canvas about all placed parts; boxes: keys, x, y, w, h."""
    g = boxes.groupBy(*key).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return g.select(*key, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def substituted(template: Column, values: Column) -> Column:
    """``${name}`` parts of a text replaced by a map's values; a name that the map lacks is an error."""
    names = F.regexp_extract_all(template, F.lit(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1))
    bad = F.filter(names, lambda n: ~F.map_contains_key(values, n))
    done = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("no value for "), F.element_at(bad, 1))).cast("string")).otherwise(done)


def variants(df: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """Each row with every combination of the lists' values, numbered with the last list fastest (a product as small as the lists)."""
    out = df.withColumn("variant", F.lit(0))
    for name, values in lists.items():
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("_p", name)).withColumn("variant", F.col("variant") * len(values) + F.col("_p")).drop("_p")
    return out


def turned(px: DataFrame, size: int, quarters: int) -> DataFrame:
    """Square canvases turned clockwise by quarters, exactly."""
    for _ in range(quarters % 4):
        px = canvas.quarter_turn(px, size)
    return px


def scaled(px: DataFrame, w: int, h: int, num: int, den: int, key=("asset",)) -> DataFrame:
    """Canvases scaled by num / den: each new pixel takes the one under its middle."""
    nw, nh = w * num // den, h * num // den
    at = lambda c: F.floor((2 * F.col(c) + 1) * den / (2 * num))
    return canvas.sample(px, nw, nh, at("x"), at("y"), key=key)


def clipped(px: DataFrame, w: int, h: int, a: int, b: int, c: int, d: int, den: int, key=("asset",)) -> DataFrame:
    """(keys, clipped): opaque pixels that a forward matrix over ``den`` moves out of a w x h canvas."""
    x, y = F.floor((a * F.col("x") + b * F.col("y")) / den), F.floor((c * F.col("x") + d * F.col("y")) / den)
    return px.groupBy(*key).agg(F.count_if((F.col("idx") != 0) & ~(x.between(0, w - 1) & y.between(0, h - 1))).alias("clipped"))


#: Forward matrices over 2 of the projections of a wall facing left or right, and of a floor.
PROJECTIONS = {"dimetric_left": (2, 0, 1, 2), "dimetric_right": (2, 0, -1, 2), "floor": (2, -2, 1, 1), "oblique": (2, -1, 0, 1)}


def projected(px: DataFrame, name: str) -> DataFrame:
    """Pixels moved by a projection's forward matrix (floor of halves); several may land on one place."""
    a, b, c, d = PROJECTIONS[name]
    at = lambda p, q: F.floor((p * F.col("x") + q * F.col("y")) / 2).cast("int")
    return px.withColumns({"_x": at(a, b), "_y": at(c, d)}).withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y")


def guide(keys: DataFrame, w: int, h: int, step: int) -> DataFrame:
    """(keys, x, y, line, checker): the lines of a grid at one down for two across, and the checker of its cells."""
    g = canvas.filled(keys, w, h, 0).drop("idx")
    p, q = F.col("x") + 2 * F.col("y"), F.col("x") - 2 * F.col("y")
    cell = lambda v: F.floor(v / (2 * step))
    return g.select(*keys.columns, "x", "y", ((F.pmod(p, F.lit(2 * step)) < 2) | (F.pmod(q, F.lit(2 * step)) < 2)).alias("line"), (F.pmod(cell(p) + cell(q), F.lit(2)) == 0).alias("checker"))


def rendered(px: DataFrame, pal: DataFrame, zoom: int, key=("asset",)) -> DataFrame:
    """(keys, x, y, r, g, b, a): colours of each pixel as a block of zoom x zoom; clear ones show a checker of blocks."""
    o = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(zoom) for j in range(zoom)))).alias("o")
    p = px.join(F.broadcast(pal), "idx").select(*key, (F.col("x") * zoom).alias("bx"), (F.col("y") * zoom).alias("by"), "idx", "r", "g", "b", o, ((F.col("x") + F.col("y")) % 2).alias("odd"))
    clear = F.col("idx") == 0
    grey = F.when(F.col("odd") == 0, 204).otherwise(153)
    return p.select(*key, (F.col("bx") + F.col("o.i")).alias("x"), (F.col("by") + F.col("o.j")).alias("y"), *(F.when(clear, grey).otherwise(F.col(c)).alias(c) for c in "rgb"), F.lit(255).alias("a"))


def rewritten(before: DataFrame, after: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, share): of the pixels that are opaque in both, the share whose index differs."""
    j = before.where("idx <> 0").join(after.where("idx <> 0").withColumnRenamed("idx", "_new"), [*key, "x", "y"])
    return j.groupBy(*key).agg(F.avg((F.col("idx") != F.col("_new")).cast("int")).alias("share"))
