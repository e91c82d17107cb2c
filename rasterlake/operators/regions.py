"""Connected components of canvases, and relations between regions.

A canvas is a bounded group, so its components are found inside one Arrow kernel that works on
many canvases of one size at once (smallest label among equal neighbours, then labels of labels,
until nothing changes). A region's ``root`` is the raster place of its first pixel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import stacks

NEAR4 = ((0, 1), (1, 0))
NEAR8 = (*NEAR4, (1, 1), (1, -1))


def label_arrays(v: np.ndarray, near=NEAR4) -> np.ndarray:
    """Labels of a stack of canvases (canvas, row, column); values below 0 belong to no region (label -1)."""
    n, h, w = v.shape
    lab = np.broadcast_to(np.arange(h * w, dtype=np.int64).reshape(h, w), v.shape).copy()
    sides = []
    for dy, dx in near:
        a = (slice(None), slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(None), slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        sides.append((a, b, (v[a] == v[b]) & (v[a] >= 0)))
    while True:
        old = lab.copy()
        for a, b, same in sides:
            low = np.minimum(lab[a], lab[b])
            lab[a] = np.where(same, low, lab[a])
            lab[b] = np.where(same, np.minimum(lab[b], low), lab[b])
        flat = lab.reshape(n, -1)
        flat = np.take_along_axis(flat, flat, axis=1)
        lab = flat.reshape(v.shape)
        if (lab == old).all():
            return np.where(v >= 0, lab, -1)


def label(px: DataFrame, key=("asset",), diagonal: bool = False, value: str = "idx") -> DataFrame:
    """Adds ``root``; pixels whose value is null belong to no region (root null)."""
    near = NEAR8 if diagonal else NEAR4
    out = stacks.on_stacks(px, lambda v: label_arrays(v, near), "root", "int", key, value)
    return out.withColumn("root", F.when(F.col("root") >= 0, F.col("root")))


def _shifted(lab: DataFrame, dx: int, dy: int, key) -> DataFrame:
    return lab.select(*key, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("root").alias("other"), F.col("idx").alias("other_idx"))


def stats(lab: DataFrame, key=("asset",)) -> DataFrame:
    """Area, perimeter (sides towards another region or the outside), box, compactness and boundary excess."""
    right, down = (lab.join(_shifted(lab, dx, dy, key), [*key, "x", "y"]).where("root = other").groupBy(*key, "root").agg(F.count("*").alias("inner")) for dx, dy in ((1, 0), (0, 1)))
    inner = right.unionByName(down).groupBy(*key, "root").agg(F.sum("inner").alias("inner"))
    s = lab.groupBy(*key, "root", "idx").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    out = s.join(inner, [*key, "root"], "left").withColumn("perimeter", 4 * F.col("area") - 2 * F.coalesce("inner", F.lit(0))).drop("inner")
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy("root")) - 1
    return out.withColumn("rid", rank).withColumn("compactness", F.col("perimeter") * F.col("perimeter") / F.col("area")).withColumn("excess", F.col("perimeter") / (2 * (F.col("w") + F.col("h"))))


def adjacency(lab: DataFrame, key=("asset",)) -> DataFrame:
    """Distinct pairs of regions that share a side: (a, b) roots with a < b, and their indices."""
    out = None
    for dx, dy in ((1, 0), (0, 1)):
        p = lab.join(_shifted(lab, dx, dy, key), [*key, "x", "y"]).where("root <> other")
        out = p if out is None else out.unionByName(p)
    less = F.col("root") < F.col("other")
    pick = lambda a, b, n: F.when(less, F.col(a)).otherwise(F.col(b)).alias(n)
    return out.select(*key, pick("root", "other", "a"), pick("other", "root", "b"), pick("idx", "other_idx", "a_idx"), pick("other_idx", "idx", "b_idx")).distinct()


def diagonal_pairs(lab: DataFrame, key=("asset",)) -> DataFrame:
    """Distinct pairs of regions that meet at a corner of a pixel."""
    out = None
    for dx, dy in ((1, 1), (-1, 1)):
        p = lab.join(_shifted(lab, dx, dy, key), [*key, "x", "y"]).where("root <> other")
        out = p if out is None else out.unionByName(p)
    less = F.col("root") < F.col("other")
    pick = lambda a, b, n: F.when(less, F.col(a)).otherwise(F.col(b)).alias(n)
    return out.select(*key, pick("root", "other", "a"), pick("other", "root", "b"), pick("idx", "other_idx", "a_idx"), pick("other_idx", "idx", "b_idx")).distinct()


def corner_touching(lab: DataFrame, key=("asset",)) -> DataFrame:
    """Pairs that meet at corners only."""
    return diagonal_pairs(lab, key).join(adjacency(lab, key).select(*key, "a", "b"), [*key, "a", "b"], "left_anti")


def euler(px: DataFrame, key=("asset",)) -> DataFrame:
    """Components of the opaque pixels, holes (diagonally joined clear regions off the border) and their difference."""
    opaque = F.when(F.col("idx") != 0, F.lit(1))
    clear = F.when(F.col("idx") == 0, F.lit(1))
    size = Window.partitionBy(*key)
    whole = px.withColumn("_w", F.max("x").over(size)).withColumn("_h", F.max("y").over(size))
    edge = whole.select(*key, "x", "y", ((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("_w")) | (F.col("y") == F.col("_h"))).alias("edge"))
    parts = label(px.withColumn("_m", opaque), key, False, "_m").groupBy(*key).agg(F.count_distinct("root").alias("components"))
    holes = label(px.withColumn("_m", clear), key, True, "_m").where("root is not null").join(edge, [*key, "x", "y"]).groupBy(*key, "root").agg(F.max("edge").alias("edge")).where("not edge").groupBy(*key).agg(F.count("*").alias("holes"))
    out = parts.join(holes, list(key), "left").withColumn("holes", F.coalesce("holes", F.lit(0)))
    return out.withColumn("chi", F.col("components") - F.col("holes"))
