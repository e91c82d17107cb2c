"""Air perspective: colours step through the palette towards the sky, the farther the layer the more.

Palettes have 256 rows at most and there are three depths, so what is joined with pixels is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.operators import color

DEPTHS = ("foreground", "midground", "background")


def steps(pal: DataFrame, sky: tuple[int, int, int], amounts: tuple[float, float, float], tolerance: float = 0.04, clear: int = 0) -> DataFrame:
    """(depth, idx, to_idx, l, to_l): where each entry steps at each depth; to_idx is null without a step (or at an amount of 0).

    A step is the entry nearest to the mix with the sky among those at most ``tolerance`` off the line to the sky and
    nearer to it (ties: the smaller index). The clear entry neither steps nor is stepped to. Amounts lie in 0 to 1 and
    don't fall from the front to the back.
    """
    if not all(0 <= a <= 1 for a in amounts):
        raise ValueError(f"amounts outside 0 to 1: {amounts}")
    if list(amounts) != sorted(amounts):
        raise ValueError(f"amounts fall towards the back: {amounts}")
    spark = pal.sparkSession
    lab = color.with_oklab(pal.where(F.col("idx") != clear)).select("idx", "l", "a_", "b_")
    to = color.with_oklab(spark.createDataFrame([sky], "r int, g int, b int")).select(*(F.col(c).alias(f"s_{c}") for c in ("l", "a_", "b_")))
    depth = spark.createDataFrame(list(zip(DEPTHS, map(float, amounts))), "depth string, amount double")
    x = lab.join(F.broadcast(to), F.lit(True)).join(F.broadcast(depth), F.lit(True))  # one row, three rows
    x = x.select("depth", "amount", "idx", *(F.col(c).alias(f"x_{c}") for c in ("l", "a_", "b_")), "s_l", "s_a_", "s_b_")
    x = x.withColumns({f"t_{c}": F.col(f"x_{c}") * (1 - F.col("amount")) + F.col(f"s_{c}") * F.col("amount") for c in ("l", "a_", "b_")})
    far = lambda p, q: F.round(F.sqrt(color.distance_sq(p, q)), 9)
    pairs = x.join(F.broadcast(color.named(lab, "p_")), (F.col("idx") != F.col("p_idx")) & (F.col("amount") > 0))  # 256 rows
    pairs = pairs.withColumns({"span": far("x_", "s_"), "da": far("p_", "x_"), "db": far("p_", "s_"), "off": far("p_", "t_")})
    found = pairs.where("span > 0 AND db < span").where(F.round(F.col("da") + F.col("db") - F.col("span"), 9) <= tolerance).groupBy("depth", "idx").agg(F.min(F.struct("off", "p_idx", "p_l")).alias("best"))
    return x.join(found, ["depth", "idx"], "left").select("depth", "idx", F.col("best.p_idx").alias("to_idx"), F.col("x_l").alias("l"), F.coalesce("best.p_l", "x_l").alias("to_l"))


def hazed(px: DataFrame, step: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, depth, x, y, idx): pixels at their depths after their steps; px: keys, depth, x, y, idx. Clear pixels, unknown depths and null indexes stay as they are."""
    s = step.where("to_idx is not null").select("depth", "idx", "to_idx")
    return px.join(F.broadcast(s), ["depth", "idx"], "left").select(*key, "depth", "x", "y", F.coalesce("to_idx", "idx").alias("idx"))  # 768 rows


def report(px: DataFrame, step: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, depth, colours, moved, no_step, collapsed, pixels, before, after): colours in use, those that stepped and that could not, how many fell together, pixels changed, and the range of lightness."""
    used = px.groupBy(*key, "depth", "idx").agg(F.count("*").alias("n")).join(F.broadcast(step), ["depth", "idx"])  # 768 rows
    went = F.col("to_idx").isNotNull()
    end = F.coalesce("to_idx", "idx")
    out = used.groupBy(*key, "depth").agg(
        F.count("*").alias("colours"), F.count_if(went).alias("moved"), F.count_if(~went).alias("no_step"), (F.count("*") - F.count_distinct(end)).alias("collapsed"),
        F.coalesce(F.sum(F.when(went, F.col("n"))), F.lit(0)).alias("pixels"), (F.max("l") - F.min("l")).alias("before"), (F.max("to_l") - F.min("to_l")).alias("after"),
    )
    return out
