"""Distances and derivatives on pixel relations; distances go through whole canvases, two passes for a stack of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import stacks


def signed_distance(px: DataFrame, w: int, h: int, key=("asset",)) -> DataFrame:
    """Chamfer 3-4 distance in pixels to the other side of the mask, above 0 inside.

    The outside of the canvas counts as the other side for both sides of the mask.
    """

    def work(v: np.ndarray) -> np.ndarray:
        inside = v == 1
        to_clear, to_set = stacks.chamfer(~inside), stacks.chamfer(inside)
        y, x = np.mgrid[: v.shape[1], : v.shape[2]]
        edge = 3.0 * np.minimum(np.minimum(x + 1, y + 1), np.minimum(w - x, h - y))
        return np.where(inside, 1, -1) * np.minimum(np.where(inside, to_clear, to_set), edge) / 3

    mask = px.withColumn("_in", (F.col("idx") != 0).cast("int"))
    return stacks.on_stacks(mask, work, "d", "double", key, "_in", 0).drop("idx")


def normal_and_curvature(field: DataFrame, key=("asset",), value: str = "d") -> DataFrame:
    """Unit gradient by central differences (null on ridges) and minus the Laplacian; edges repeat."""
    row, col = Window.partitionBy(*key, "y").orderBy("x"), Window.partitionBy(*key, "x").orderBy("y")
    side = lambda f, w: F.coalesce(f(value).over(w), F.col(value))
    f = field.withColumns({"_l": side(F.lag, row), "_r": side(F.lead, row), "_u": side(F.lag, col), "_d": side(F.lead, col)})
    gx, gy = (F.col("_r") - F.col("_l")) / 2, (F.col("_d") - F.col("_u")) / 2
    f = f.withColumns({"_gx": gx, "_gy": gy, "_n": F.sqrt(gx * gx + gy * gy), "curvature": 4 * F.col(value) - F.col("_l") - F.col("_r") - F.col("_u") - F.col("_d")})
    ok = F.col("_n") > 1e-6
    return f.select(*key, "x", "y", F.when(ok, F.col("_gx") / F.col("_n")).alias("nx"), F.when(ok, F.col("_gy") / F.col("_n")).alias("ny"), "curvature")


def ridge(field: DataFrame, key=("asset",), value: str = "d") -> DataFrame:
    """Inner pixels whose gradient vanishes."""
    n = normal_and_curvature(field, key, value).where("nx is null").select(*key, "x", "y")
    return field.where(F.col(value) > 0).join(n, [*key, "x", "y"], "left_semi").select(*key, "x", "y")
