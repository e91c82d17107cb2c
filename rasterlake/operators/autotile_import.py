"""Pieces of autotiles taken from sheets whose order says which piece is which; nothing is guessed from the pictures.

All sets are worked on at once. What is joined with them is a plan of 188 rows at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.operators import tiles

#: The order of states in a sheet, and how many pieces each layout has.
ORDER = ("convex", "edge_h", "edge_v", "inner", "concave")
LAYOUTS = {"quadrants-5": 5, "quadrants-20": 20, "blob-47": 47}


def _same(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Left join on keys of which some may be null."""
    b = b.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), *(c for c in b.columns if c not in key))
    on = reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)))
    return a.join(b, on, "left").drop(*(f"_k{i}" for i in range(len(key))))


def plan(spark: SparkSession, layout: str, tile: int) -> DataFrame:
    """(piece, quadrant, state, ox, oy, fx, fy): where each piece's parts go; a part starts at (ox, oy) and is flipped by fx, fy."""
    half = tile // 2
    if layout == "blob-47":
        p = tiles.autotile_plan(tiles.autotile_masks(spark))
        right, low = F.col("quadrant").isin("ne", "se"), F.col("quadrant").isin("sw", "se")
        return p.select(F.col("tile").alias("piece"), "quadrant", "state", F.when(right, half).otherwise(0).alias("ox"), F.when(low, half).otherwise(0).alias("oy"), F.lit(False).alias("fx"), F.lit(False).alias("fy"))
    five = layout == "quadrants-5"
    rows = [(s if five else 5 * q + s, quadrant, state, 0, 0, five and quadrant[1] == "e", five and quadrant[0] == "s") for q, quadrant in enumerate(tiles.QUADRANTS) for s, state in enumerate(ORDER)]
    return spark.createDataFrame(rows, "piece int, quadrant string, state string, ox int, oy int, fx boolean, fy boolean")


def import_quadrants(px: DataFrame, layout: str, tile: int, key=("asset",)) -> tuple[DataFrame, DataFrame]:
    """(art, report) of sets of pieces; px: keys, piece (from 0, in the layout's order), x, y, idx.

    art (keys, quadrant, state, x, y, idx): the 20 pieces of each set that has no problem. ``quadrants-5``: pieces of half a
    tile for the north west, mirrored for the others; ``quadrants-20``: all pieces, quadrant by quadrant; ``blob-47``: whole
    tiles in order of their masks, of which equal quadrants must have equal pixels.
    report (keys, pieces, mirrored, cross_checked, conflicts, problem): parts met again, pairs of quadrant and state whose parts
    differ, and 'count', 'size' or 'conflict' (the first that holds) or null. A pixel given twice counts once, with its least
    index; a set without rows has no report; null indexes are values like others.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"no layout {layout}")
    if tile <= 0 or tile % 2:
        raise ValueError(f"a tile of {tile} has no halves")
    n, half = LAYOUTS[layout], tile // 2
    size = tile if layout == "blob-47" else half
    p = F.broadcast(plan(px.sparkSession, layout, tile))  # 188 rows at most
    cells = px.groupBy(*key, "piece", "x", "y").agg(F.min("idx").alias("idx"))
    whole = (F.count("*") == size * size) & (F.min("x") == 0) & (F.min("y") == 0) & (F.max("x") == size - 1) & (F.max("y") == size - 1)
    sets = cells.groupBy(*key, "piece").agg(whole.alias("whole")).groupBy(*key)
    sets = sets.agg(F.count("*").alias("pieces"), F.every("whole").alias("whole"), ((F.count("*") == n) & (F.count("piece") == n) & (F.min("piece") == 0) & (F.max("piece") == n - 1)).alias("full"))

    def parts(cells: DataFrame, *more) -> DataFrame:
        """Parts of pieces where they go, with aggregates ``more``."""
        c = cells.join(p, "piece").where((F.col("x") >= F.col("ox")) & (F.col("x") < F.col("ox") + half) & (F.col("y") >= F.col("oy")) & (F.col("y") < F.col("oy") + half))
        flipped = lambda c, o, f: F.when(F.col(f), half - 1 - (F.col(c) - F.col(o))).otherwise(F.col(c) - F.col(o)).alias(c)
        c = c.select(*key, "quadrant", "state", flipped("x", "ox", "fx"), flipped("y", "oy", "fy"), "idx")
        differ = (F.min("idx") != F.max("idx")) | ((F.count("idx") > 0) & (F.count("idx") < F.count("*")))
        return c.groupBy(*key, "quadrant", "state", "x", "y").agg(F.min("idx").alias("idx"), F.coalesce(differ, F.lit(False)).alias("differ"), *more)

    cut = parts(cells, F.count("*").alias("met"))
    checks = cut.groupBy(*key, "quadrant", "state").agg(F.max("differ").alias("differ"), (F.max("met") - 1).alias("again"))
    checks = checks.groupBy(*key).agg(F.sum("again").alias("cross_checked"), F.count_if("differ").alias("conflicts"))

    problem = F.when(~F.col("full"), "count").when(~F.col("whole"), "size").when(F.col("conflicts") > 0, "conflict")
    report = _same(sets, checks, key).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cross_checked", "conflicts")})
    report = report.select(*key, "pieces", F.lit(layout == "quadrants-5").alias("mirrored"), "cross_checked", "conflicts", problem.alias("problem"))
    # Art is found by windows over a set, so pixels are dealt out by sets once and meet no report.
    one, all_ = Window.partitionBy(*key, "piece"), Window.partitionBy(*key)
    over = lambda w: (F.min("x").over(w) == 0) & (F.min("y").over(w) == 0) & (F.max("x").over(w) == size - 1) & (F.max("y").over(w) == size - 1) & (F.count("*").over(w) == size * size)
    # The set's window comes first, so that those of its pieces need no other shuffle; whole pieces' cells tell how many they are.
    full = (F.count("*").over(all_) == n * size * size) & (F.count("piece").over(all_) == n * size * size) & (F.min("piece").over(all_) == 0) & (F.max("piece").over(all_) == n - 1)
    fit = cells.withColumn("full", full).where("full").withColumn("whole", F.coalesce(over(one), F.lit(False)))
    fit = fit.withColumn("fit", F.every("whole").over(all_)).where("fit").select(*key, "piece", "x", "y", "idx")
    good = parts(fit).withColumn("conflict", F.max("differ").over(all_)).where("not conflict")
    return good.select(*key, "quadrant", "state", "x", "y", "idx"), report


def resolved(px: DataFrame, size: int, key=("asset",)) -> tuple[DataFrame, DataFrame]:
    """(art, report) of pieces that may name their quadrant; px: keys, piece, state, quadrant (null: all of them), x, y, idx.

    A state's pieces name all four quadrants, or none: then the one with the smallest number is drawn for the north west and
    mirrored for the others. report (keys, state, mirrored, problem): 'state' (unknown), 'mixed', 'missing' or null; only states
    without a problem are in art (keys, quadrant, state, x, y, idx). A quadrant named by several pieces takes the first.
    """
    pieces = px.groupBy(*key, "state", "quadrant").agg(F.min("piece").alias("piece"))
    named = F.col("quadrant").isNotNull()
    states = pieces.groupBy(*key, "state").agg(F.count_if(named).alias("named"), F.count_if(~named).alias("bare"), F.count_if(F.col("quadrant").isin(*tiles.QUADRANTS)).alias("known"))
    problem = F.when(F.coalesce(~F.col("state").isin(*tiles.STATES), F.lit(True)), "state").when((F.col("named") > 0) & (F.col("bare") > 0), "mixed").when((F.col("bare") == 0) & (F.col("known") < 4), "missing")
    report = states.select(*key, "state", (F.col("named") == 0).alias("mirrored"), problem.alias("problem"))
    first = _same(px, pieces.select(*key, "state", "quadrant", F.col("piece").alias("first")), [*key, "state", "quadrant"]).where("piece = first")
    first = _same(first, report.where("problem is null").select(*key, "state", F.lit(True).alias("good")), [*key, "state"]).where("good")
    to = F.explode(F.when(named, F.array("quadrant")).otherwise(F.array(*map(F.lit, tiles.QUADRANTS)))).alias("to")
    art = first.select(*key, "state", to, named.alias("named"), "x", "y", "idx").where(F.col("to").isin(*tiles.QUADRANTS))
    flip = lambda c, at, side: F.when(~F.col("named") & (F.substring("to", at, 1) == side), size - 1 - F.col(c)).otherwise(F.col(c)).alias(c)
    return art.select(*key, F.col("to").alias("quadrant"), "state", flip("x", 2, "e"), flip("y", 1, "s"), "idx"), report


def assembled(art: DataFrame, tile: int, key=("asset",)) -> DataFrame:
    """(keys, tile, x, y, idx): the 47 tiles of each set of art (keys, quadrant, state, x, y, idx)."""
    p = plan(art.sparkSession, "blob-47", tile).select(F.col("piece").alias("tile"), "quadrant", "state", "ox", "oy")
    j = art.join(F.broadcast(p), ["quadrant", "state"])  # 188 rows
    return j.select(*key, "tile", (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y"), "idx")
