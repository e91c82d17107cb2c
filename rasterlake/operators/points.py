"""Points, rectangles, lines, inks and edits: drawing as relations, and patches that can be taken back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.operators import canvas, regions

KEY = ("asset",)


def manhattan(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.abs(ax - bx) + F.abs(ay - by)


def chebyshev(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.greatest(F.abs(ax - bx), F.abs(ay - by))


def contains(x: Column, y: Column, r: Column) -> Column:
    """Whether a rectangle (struct x, y, w, h) holds a point."""
    return (x >= r["x"]) & (y >= r["y"]) & (x < r["x"] + r["w"]) & (y < r["y"] + r["h"])


def _rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def rect_union(a: Column, b: Column) -> Column:
    """The smallest rectangle about two; an empty one counts for nothing."""
    both = _rect(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"]))
    empty = lambda r: (r["w"] <= 0) | (r["h"] <= 0)
    return F.when(empty(a), b).when(empty(b), a).otherwise(both)


def rect_clip(a: Column, b: Column) -> Column:
    """What two rectangles share; null if nothing."""
    r = _rect(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), F.least(a["x"] + a["w"], b["x"] + b["w"]), F.least(a["y"] + a["h"], b["y"] + b["h"]))
    return F.when((r["w"] > 0) & (r["h"] > 0), r)


def line(ends: DataFrame, key=KEY) -> DataFrame:
    """(keys, seq, x, y): the pixels of straight lines (x0, y0) to (x1, y1), one for each step of the longer axis; halves go away from the start."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.abs(dx), F.abs(dy))
    p = ends.withColumn("_n", n).withColumn("seq", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    at = lambda a, d: (F.col(a) + F.when(F.col("_n") > 0, F.signum(d) * F.floor((2 * F.abs(d) * F.col("seq") + F.col("_n")) / (2 * F.col("_n")))).otherwise(0)).cast("int")
    return p.select(*key, "seq", at("x0", dx).alias("x"), at("y0", dy).alias("y"))


def pixel_perfect(points: DataFrame, key=KEY) -> DataFrame:
    """(keys, seq, x, y) of a path without the corner of every L: a point goes if it turns between the last point kept and the next."""
    p = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    near = lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]) == 1

    def keep(kept: Column, i: Column) -> Column:
        a, b, c = F.element_at(kept, -1), F.get("p", i), F.get("p", i + 1)
        corner = near(a, b) & near(b, c) & (a["x"] != c["x"]) & (a["y"] != c["y"])
        return F.when(F.coalesce(corner, F.lit(False)), kept).otherwise(F.concat(kept, F.array(b)))

    rest = F.filter(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: i < F.size("p"))
    return p.select(*key, F.explode(F.aggregate(rest, F.slice("p", 1, 1), keep)).alias("q")).select(*key, "q.seq", "q.x", "q.y")


def bayer(x: Column, y: Column, side: int) -> Column:
    """The threshold matrix of a power-of-two side, by halves."""
    if side <= 1:
        return F.lit(0)
    half = side // 2
    right, low = x % side >= half, y % side >= half
    quadrant = F.when(right & low, 1).when(right, 2).when(low, 3).otherwise(0)
    return 4 * bayer(x % half, y % half, half) + quadrant


def checker(x: Column, y: Column, size: int = 1) -> Column:
    return (F.floor(x / size) + F.floor(y / size)) % 2 == 0


def custom(x: Column, y: Column, rows: list[str]) -> Column:
    """Whether a repeating pattern (rows of 0 and 1) is set at a place."""
    own = F.array(*map(F.lit, rows))
    row = F.element_at(own, (F.pmod(y, F.lit(len(rows))) + 1).cast("int"))
    return F.substring(row, (F.pmod(x, F.lit(len(rows[0]))) + 1).cast("int"), F.lit(1)) == "1"


def paint(px: DataFrame, targets: DataFrame, ink: Column, key=KEY) -> DataFrame:
    """The patch (keys, x, y, before, after) of an ink written to target places; a null ink writes nothing, places outside are ignored."""
    t = px.join(targets.select(*key, "x", "y").distinct(), [*key, "x", "y"], "left_semi")
    p = t.select(*key, "x", "y", F.col("idx").alias("before"), ink.cast("int").alias("after"))
    return p.where("after is not null AND after <> before")


def apply(px: DataFrame, patch: DataFrame, back: bool = False, key=KEY) -> DataFrame:
    """A canvas with a patch done (or taken back); a pixel that isn't what the patch expects is an error."""
    old, new = ("after", "before") if back else ("before", "after")
    j = px.join(patch.select(*key, "x", "y", F.col(old).alias("_old"), F.col(new).alias("_new")), [*key, "x", "y"], "left")
    wrong = F.col("_old").isNotNull() & (F.col("_old") != F.col("idx"))
    idx = F.when(wrong, F.raise_error(F.lit("the canvas has changed since the patch was made")).cast("int")).otherwise(F.coalesce("_new", "idx"))
    return j.select(*key, "x", "y", idx.alias("idx"))


def put(px: DataFrame, cells: DataFrame, key=KEY) -> DataFrame:
    """Canvas with cells (keys, x, y, idx, seq) written in order of seq; the last wins, places outside are ignored."""
    last = cells.groupBy(*key, "x", "y").agg(F.max(F.struct("seq", "idx")).alias("m")).select(*key, "x", "y", F.col("m.idx").alias("_new"))
    return px.join(last, [*key, "x", "y"], "left").select(*key, "x", "y", F.coalesce("_new", "idx").alias("idx"))


def look(px: DataFrame, places: DataFrame, key=KEY) -> DataFrame:
    """The index at each place; null outside."""
    return places.join(px, [*key, "x", "y"], "left")


def fill(px: DataFrame, seeds: DataFrame, contiguous: bool = True, diagonal: bool = False, key=KEY) -> DataFrame:
    """(keys, x, y): the places that a fill from each canvas's seed takes: its region, or all of its colour."""
    if not contiguous:
        colour = px.join(seeds.select(*key, "x", "y"), [*key, "x", "y"]).select(*key, F.col("idx").alias("_idx"))
        return px.join(colour, list(key)).where("idx = _idx").select(*key, "x", "y")
    lab = regions.label(px, key, diagonal)
    root = lab.join(seeds.select(*key, "x", "y"), [*key, "x", "y"]).select(*key, F.col("root").alias("_root"))
    return lab.join(root, list(key)).where("root = _root").select(*key, "x", "y")


def brush(places: DataFrame, size: int, shape: str = "square", key=KEY) -> DataFrame:
    """Places with a square (side ``size``, about its middle) or disc (radius ``size``) about each."""
    lo, hi = (-(size // 2), size - size // 2) if shape == "square" else (-size, size + 1)
    spots = [(a, b) for a in range(lo, hi) for b in range(lo, hi) if shape == "square" or a * a + b * b <= size * size]
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in spots))).alias("o")
    return places.select(*key, "x", "y", o).select(*key, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct()


def first_set(px: DataFrame, key=KEY) -> DataFrame:
    """(keys, n, x, y): how many pixels are opaque, and the first of them row by row."""
    return canvas.opaque(px).groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("m")).select(*key, "n", "m.x", "m.y")
