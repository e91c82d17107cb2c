"""Tiles: extraction and dedupe under mirror and turn, colours, block votes, sheets and autotile masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODES = {"exact": (0,), "flip": (0, 1, 2, 3), "flip-rotate": tuple(range(8))}
#: Limits of the target profiles: entries of the palette (or none), colours in a tile, tile size, largest width and height, display frames a second.
PROFILES = {"gb": (4, 4, 8, 160, 144, 59.73), "nes": (None, 4, 8, 256, 240, 60.0988), "snes": (None, 16, 8, 256, 224, 60.0988), "gba": (None, 16, 8, 240, 160, 59.7275), "pico8": (16, 16, 8, 128, 128, 30.0)}
#: What no profile can judge from canvases alone.
UNCHECKED = ("sprites on a scan line", "assignment of palettes", "number of tiles in video memory")
N, E, S, W, NE, SE, SW, NW = (1 << i for i in range(8))


def cut(px: DataFrame, size: int, key=("asset",)) -> DataFrame:
    """(keys, tx, ty, tile): the indices of each whole tile in row order."""
    c = px.select(*key, F.expr(f"cast(x div {size} as int)").alias("tx"), F.expr(f"cast(y div {size} as int)").alias("ty"), F.struct(F.expr(f"y % {size}").alias("y"), F.expr(f"x % {size}").alias("x"), "idx").alias("c"))
    t = c.groupBy(*key, "tx", "ty").agg(F.array_sort(F.collect_list("c")).alias("c")).where(F.size("c") == size * size)
    return t.select(*key, "tx", "ty", F.transform("c", lambda s: s["idx"]).alias("tile"))


def _place(size: int, form: int) -> list[int]:
    """Where each pixel of a form comes from: bit 0 mirrors x, bit 1 mirrors y, bit 2 swaps the axes first."""
    out = []
    for y in range(size):
        for x in range(size):
            sx, sy = (y, x) if form & 4 else (x, y)
            sx = size - 1 - sx if form & 1 else sx
            sy = size - 1 - sy if form & 2 else sy
            out.append(sy * size + sx)
    return out


def form(tile, size: int, f: int):
    return F.array(*[F.element_at(tile, p + 1) for p in _place(size, f)])


def extract(px: DataFrame, size: int, mode: str = "exact", key=("asset",)) -> DataFrame:
    """Each tile's canonical form (the least of its forms) and an id by first appearance in its canvas."""
    t = cut(px, size, key)
    forms = [form(F.col("tile"), size, f) for f in MODES[mode]]
    t = t.withColumn("canon", F.least(*forms) if len(forms) > 1 else F.col("tile"))
    first = t.groupBy(*key, "canon").agg(F.min(F.struct("ty", "tx")).alias("first"))
    ids = first.withColumn("tile_id", F.dense_rank().over(Window.partitionBy(*key).orderBy("first")) - 1)
    return t.join(ids, [*key, "canon"]).select(*key, "tx", "ty", "tile_id", "canon", "tile")


def rebuild(extracted: DataFrame, size: int, mode: str = "exact", key=("asset",)) -> DataFrame:
    """Pixels from canonical tiles: the form that gives the tile back (the lowest such form)."""
    forms = [form(F.col("canon"), size, f) for f in MODES[mode]]
    tile = F.coalesce(*[F.when(f == F.col("tile"), f) for f in forms])
    p = extracted.select(*key, "tx", "ty", F.posexplode(tile).alias("p", "idx"))
    return p.select(*key, (F.col("tx") * size + F.expr(f"p % {size}")).cast("int").alias("x"), (F.col("ty") * size + F.expr(f"p div {size}")).cast("int").alias("y"), "idx")


def mirror_reliant(px: DataFrame, size: int, key=("asset",)) -> DataFrame:
    """Tiles that only mirroring or turning makes equal to another: exact tiles beyond one for each canonical form."""
    t = extract(px, size, "flip-rotate", key)
    return t.groupBy(*key, "canon").agg(F.count_distinct("tile").alias("forms")).groupBy(*key).agg(F.sum(F.col("forms") - 1).alias("reliant"), F.count("*").alias("canonical"))


def colours_per_tile(px: DataFrame, size: int, limit: int, key=("asset",)) -> DataFrame:
    """Tiles with more colours (the transparent one too) than the limit."""
    t = px.withColumn("tx", F.expr(f"cast(x div {size} as int)")).withColumn("ty", F.expr(f"cast(y div {size} as int)"))
    return t.groupBy(*key, "tx", "ty").agg(F.count_distinct("idx").alias("colours")).where(F.col("colours") > limit)


def sizes(px: DataFrame, key=("asset",)) -> DataFrame:
    """Width and height of each canvas."""
    return px.groupBy(*key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def check_sizes(size: DataFrame, key=("asset",)) -> DataFrame:
    """Canvases that aren't whole tiles, or too large, by profile; size: w, h. Profiles are few and broadcast."""
    spark = size.sparkSession
    p = spark.createDataFrame([(n, v[2], v[3], v[4]) for n, v in PROFILES.items()], "profile string, tile int, mw int, mh int")
    j = size.join(F.broadcast(p), F.lit(True))
    bad = F.array_compact(F.array(F.when((F.col("w") % F.col("tile") != 0) | (F.col("h") % F.col("tile") != 0), "tile_size"), F.when((F.col("w") > F.col("mw")) | (F.col("h") > F.col("mh")), "size")))
    return j.select(*key, "profile", F.explode(bad).alias("constraint"), F.lit(1).cast("long").alias("n"))


def check_timing(frames: DataFrame, tolerance: float = 1.0, key=("asset",)) -> DataFrame:
    """How many frames last no whole number of display frames (within a tolerance in ms), by profile; frames: ms."""
    spark = frames.sparkSession
    p = spark.createDataFrame([(n, 1000.0 / v[5]) for n, v in PROFILES.items()], "profile string, period double")
    j = frames.where("ms > 0").join(F.broadcast(p), F.lit(True))
    gap = F.abs(F.col("ms") - F.greatest(F.round(F.col("ms") / F.col("period")), F.lit(1.0)) * F.col("period"))
    return j.where(F.round(gap, 9) > tolerance).groupBy(*key, "profile").agg(F.count("*").alias("n")).select(*key, "profile", F.lit("frame_ms").alias("constraint"), "n")


def check_palette(pal: DataFrame, transparent: int | None = 0) -> DataFrame:
    """(profile, constraint): palettes with too many entries, or whose transparent entry isn't the first."""
    spark = pal.sparkSession
    p = spark.createDataFrame([(n, v[0]) for n, v in PROFILES.items()], "profile string, most int")
    n = F.broadcast(pal.agg(F.count("*").alias("n")))  # one row
    late = F.lit(transparent is not None and transparent != 0)
    bad = F.array_compact(F.array(F.when(F.col("n") > F.col("most"), "colours"), F.when(late, "transparent_index")))
    return p.join(n, F.lit(True)).select("profile", F.explode(bad).alias("constraint"), "n")


def validate(px: DataFrame, pal: DataFrame, key=("asset",)) -> DataFrame:
    """Violations of each target profile: palette, colours in a tile, size."""
    assets = px.select(*key).distinct()
    out = check_sizes(sizes(px, key), key).unionByName(assets.join(F.broadcast(check_palette(pal)), F.lit(True)).select(*key, "profile", "constraint", F.lit(1).cast("long").alias("n")))
    for limit, size in sorted({(v[1], v[2]) for v in PROFILES.values()}):
        names = F.array(*(F.lit(n) for n, v in PROFILES.items() if (v[1], v[2]) == (limit, size)))
        t = colours_per_tile(px, size, limit, key).groupBy(*key).agg(F.count("*").alias("n"))
        out = out.unionByName(t.select(*key, F.explode(names).alias("profile"), F.lit("tile_colours").alias("constraint"), "n"))
    return out


def downscale_modal(px: DataFrame, s: int, key=("asset",)) -> DataFrame:
    """The most frequent index of each whole cell; ties go to the largest."""
    c = px.groupBy(*key, F.expr(f"cast(x div {s} as int)").alias("x"), F.expr(f"cast(y div {s} as int)").alias("y"), "idx").agg(F.count("*").alias("n"))
    return c.groupBy(*key, "x", "y").agg(F.max(F.struct("n", "idx")).alias("m"), F.sum("n").alias("all")).where(F.col("all") == s * s).select(*key, "x", "y", F.col("m.idx").alias("idx"))


def mixel_votes(px: DataFrame, window: int, largest: int, key=("asset",)) -> DataFrame:
    """The largest k for which each window is made of k x k blocks of one index (flat windows: null)."""
    w = px.withColumn("wx", F.expr(f"cast(x div {window} as int)")).withColumn("wy", F.expr(f"cast(y div {window} as int)"))
    flat = w.groupBy(*key, "wx", "wy").agg((F.min("idx") == F.max("idx")).alias("flat"))
    ks = [k for k in range(1, largest + 1) if window % k == 0]
    b = w.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    block = b.groupBy(*key, "wx", "wy", "k", F.expr("cast(x div k as int)").alias("bx"), F.expr("cast(y div k as int)").alias("by")).agg((F.min("idx") == F.max("idx")).alias("one"))
    good = block.groupBy(*key, "wx", "wy", "k").agg(F.min("one").alias("ok")).where("ok").groupBy(*key, "wx", "wy").agg(F.max("k").alias("k"))
    return flat.join(good, [*key, "wx", "wy"]).select(*key, "wx", "wy", F.when(~F.col("flat"), F.col("k")).alias("k"))


def autotile_masks(spark: SparkSession) -> DataFrame:
    """The neighbour masks that count: a corner only next to both of its sides (47 of 256)."""
    m = spark.range(256).select(F.col("id").cast("int").alias("raw"))
    keep = F.col("raw")
    for corner, a, b in ((NE, N, E), (SE, S, E), (SW, S, W), (NW, N, W)):
        keep = F.when(F.col("raw").bitwiseAND(a | b) == a | b, keep).otherwise(keep.bitwiseAND(255 - corner))
    return m.select(keep.alias("mask")).distinct().withColumn("tile", F.row_number().over(Window.orderBy("mask")) - 1)


def sheet_pack(boxes: DataFrame, columns: int, pad: int = 1) -> DataFrame:
    """Places of equal cells on a sheet in order of asset; boxes: asset, w, h."""
    cell = boxes.agg(F.max("w").alias("cw"), F.max("h").alias("ch"))
    n = numbered(boxes.select("asset", "w", "h"), "asset").join(F.broadcast(cell), F.lit(True))  # one row
    return n.select("asset", (F.expr(f"n % {columns}") * (F.col("cw") + pad)).alias("px"), (F.expr(f"n div {columns}") * (F.col("ch") + pad)).alias("py"), "cw", "ch")


def gid(tile_id, flip_x, flip_y, flip_d, first: int = 1):
    """A map cell's global id with its three flip bits."""
    bits = (F.when(flip_x, F.lit(1 << 31)).otherwise(F.lit(0)), F.when(flip_y, F.lit(1 << 30)).otherwise(F.lit(0)), F.when(flip_d, F.lit(1 << 29)).otherwise(F.lit(0)))
    out = (tile_id + first).cast("long")
    for b in bits:
        out = out.bitwiseOR(b.cast("long"))
    return out


STATES = ("convex", "edge_h", "edge_v", "concave", "inner")
#: Quadrants by the bits of their horizontal, vertical and diagonal neighbours.
QUADRANTS = {"nw": (W, N, NW), "ne": (E, N, NE), "sw": (W, S, SW), "se": (E, S, SE)}


def corner_state(mask: Column, quadrant: str) -> Column:
    """Which of five pieces a quadrant of a tile shows, by the neighbours in an 8-bit mask."""
    h, v, d = (mask.bitwiseAND(b) != 0 for b in QUADRANTS[quadrant])
    return F.when(~h & ~v, "convex").when(h & ~v, "edge_h").when(~h & v, "edge_v").when(d, "inner").otherwise("concave")


def autotile_plan(masks: DataFrame) -> DataFrame:
    """(mask, tile, quadrant, state): the four pieces of each tile."""
    parts = F.array(*(F.struct(F.lit(q).alias("quadrant"), corner_state(F.col("mask"), q).alias("state")) for q in QUADRANTS))
    return masks.select("mask", "tile", F.explode(parts).alias("p")).select("mask", "tile", "p.quadrant", "p.state")


def all_quadrants(base: DataFrame, size: int) -> DataFrame:
    """(quadrant, state, x, y, idx): pieces drawn for the north west mirrored to all quadrants; base: state, x, y, idx."""
    flip = lambda c, on: (F.lit(size - 1) - F.col(c)) if on else F.col(c)
    out = None
    for q in QUADRANTS:
        p = base.select(F.lit(q).alias("quadrant"), "state", flip("x", q[1] == "e").alias("x"), flip("y", q[0] == "s").alias("y"), "idx")
        out = p if out is None else out.unionByName(p)
    return out


def autotile_build(masks: DataFrame, art: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(tile, x, y, idx) of every tile put together from its pieces, and (quadrant, state) of pieces that are missing."""
    plan = autotile_plan(masks)
    right, low = F.col("quadrant").isin("ne", "se"), F.col("quadrant").isin("sw", "se")
    px = plan.join(F.broadcast(art), ["quadrant", "state"]).select("tile", (F.col("x") + F.when(right, size).otherwise(0)).alias("x"), (F.col("y") + F.when(low, size).otherwise(0)).alias("y"), "idx")
    return px, plan.select("quadrant", "state").distinct().join(art.select("quadrant", "state").distinct(), ["quadrant", "state"], "left_anti")


def seam_doubled(px: DataFrame, size: int, key=("tile",)) -> DataFrame:
    """(keys, n): places on both sides of a tile's middle column or row where a line one pixel wide is doubled by the mirror."""
    from rasterlake.operators import lint

    n = lint.around(px, key)
    m = size // 2
    x, y = F.col("x"), F.col("y")
    across = (x == m - 1) & (F.col("r") == F.col("idx")) & (F.col("l") != F.col("idx"))
    down = (y == m - 1) & (F.col("d") == F.col("idx")) & (F.col("u") != F.col("idx"))
    return n.where("idx <> 0").groupBy(*key).agg(F.count_if(across | down).alias("n"))


def choose_columns(n: Column) -> Column:
    """Columns of a sheet of n cells: fewest empty cells, then closest to square, of the root up to twice it."""
    low = F.ceil(F.sqrt(n.cast("double"))).cast("int")

    def cost(c: Column) -> Column:
        rows = F.ceil(n / c)
        return F.struct((c * rows - n).alias("empty"), F.floor(F.round(F.abs(c / rows - 1) * 1000, 6)).alias("aspect"), c.alias("columns"))

    return F.when(n <= 1, F.lit(1)).otherwise(F.array_min(F.transform(F.sequence(low, 2 * low), cost))["columns"])


def numbered(df: DataFrame, order: str, name: str = "n", buckets: int = 1024) -> DataFrame:
    """Rows numbered from 0 in the order of a whole-number column, without one task for all: numbers within equal ranges of it, and counts of the ranges before."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    width = 1 if lo is None else (hi - lo) // buckets + 1
    d = df.withColumn("_b", F.floor((F.col(order) - (lo or 0)) / width))
    count = d.groupBy("_b").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offset = count.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return d.withColumn(name, own).join(F.broadcast(offset), "_b").withColumn(name, F.col(name) + F.col("_before")).drop("_b", "_before")


def tsx(sets: DataFrame) -> DataFrame:
    """(name, tsx): tile set files; sets: name, tile, columns, count, image."""
    f = '<?xml version="1.0" encoding="UTF-8"?><tileset version="1.10" name="%s" tilewidth="%d" tileheight="%d" tilecount="%d" columns="%d"><image source="%s" width="%d" height="%d"/></tileset>'
    return sets.select("name", F.format_string(f, "name", "tile", "tile", "count", "columns", "image", F.col("tile") * F.col("columns"), F.col("tile") * F.ceil(F.col("count") / F.col("columns"))).alias("tsx"))


def tmx(cells: DataFrame, source: str, tile: int, key=("asset",)) -> DataFrame:
    """(keys, tmx): map files of canvases of global tile ids (keys, x, y, gid), row by row; a map is a bounded group."""
    w, h = F.max("x") + 1, F.max("y") + 1
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "gid"))), lambda c: c["gid"].cast("string")), ",")
    g = cells.groupBy(*key).agg(w.alias("w"), h.alias("h"), data.alias("data"))
    f = f'<map version="1.10" orientation="orthogonal" width="%d" height="%d" tilewidth="{tile}" tileheight="{tile}"><tileset firstgid="1" source="{source}"/><layer id="1" name="tiles" width="%d" height="%d"><data encoding="csv">%s</data></layer></map>'
    return g.select(*key, F.format_string(f, "w", "h", "w", "h", "data").alias("tmx"))


def sheet_json(sheet: DataFrame) -> DataFrame:
    """(json): one document of a sheet's cells in order; sheet: asset, px, py, cw, ch. A sheet is a bounded group."""
    cell = F.struct("asset", "px", "py", "cw", "ch")
    return sheet.agg(F.array_sort(F.collect_list(cell)).alias("cells")).select(F.to_json(F.struct(F.lit(1).alias("version"), "cells")).alias("json"))


def sheet_cells(doc: DataFrame) -> DataFrame:
    """The cells of sheet documents (json) again."""
    c = F.from_json("json", "version int, cells array<struct<asset: long, px: long, py: long, cw: long, ch: long>>")
    return doc.select(F.explode(c["cells"]).alias("c")).select("c.*")
