"""One palette for many parts: numbers for all colours of a group, a map for each part, and palettes joined with shared ends.

All groups go through one plan. A palette has 256 entries at most; entry 0 stands for transparent pixels. A group with
more colours, or a pixel whose index its palette lacks, is an error when its rows are computed, never another colour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import color

MOST = 256


def used(px: DataFrame, palettes: DataFrame, part: tuple = ("group", "part")) -> DataFrame:
    """(part, idx, r, g, b): the opaque entries that each part's pixels use. palettes: (part, idx, r, g, b)."""
    u = px.where("idx <> 0").select(*part, "idx").distinct().join(palettes.select(*part, "idx", "r", "g", "b"), [*part, "idx"], "left")
    lost = F.raise_error(F.concat(F.lit("a pixel's index is beyond its palette: "), F.col("idx").cast("string"))).cast("int")
    return u.withColumn("r", F.when(F.col("r").isNull(), lost).otherwise(F.col("r")))


def unified(uses: DataFrame, group: tuple = ("group",)) -> DataFrame:
    """(group, idx, r, g, b): every colour of a group's parts once, numbered from 1 in order of r, g, b."""
    one = uses.select(*group, "r", "g", "b").distinct()
    n = F.row_number().over(Window.partitionBy(*group).orderBy("r", "g", "b"))
    full = F.raise_error(F.lit(f"a group has more than {MOST - 1} opaque colours")).cast("int")
    return one.withColumn("idx", F.when(n < MOST, n).otherwise(full)).select(*group, "idx", "r", "g", "b")


def maps(uses: DataFrame, palette: DataFrame, group: tuple = ("group",), part: tuple = ("group", "part")) -> DataFrame:
    """(part, idx, new_idx): where each part's entries went."""
    return uses.join(palette.withColumnRenamed("idx", "new_idx"), [*group, "r", "g", "b"]).select(*part, "idx", "new_idx")


def remapped(px: DataFrame, map_: DataFrame, part: tuple = ("group", "part")) -> DataFrame:
    """The pixels under their group's palette; transparent ones stay 0."""
    return px.join(map_, [*part, "idx"], "left").withColumn("idx", F.when(F.col("idx") == 0, 0).otherwise(F.col("new_idx"))).drop("new_idx")


def merged(palettes: DataFrame, share: bool = False, threshold: float = 0.0, group: tuple = ("group",)) -> DataFrame:
    """(group, idx, r, g, b): the colours of a group's palettes (group, p, idx, r, g, b) once, numbered from 0 by first appearance.

    share: the darkest and the lightest colour of each palette of two or more are its ends; going through a
    group's ends in order, an end within ``threshold`` of an earlier one that was kept becomes that one everywhere.
    """
    p = color.with_oklab(palettes).withColumn("o", F.struct("p", "idx"))
    tone = F.struct("r", "g", "b", "l", "a_", "b_").alias("c")
    if share:
        order = F.struct("l", "r", "g", "b")
        ends = p.groupBy(*group, "p").agg(F.count("*").alias("n"), F.min_by(tone, order).alias("dark"), F.max_by(tone, order).alias("light")).where("n > 1")
        ends = ends.groupBy(*group).agg(F.expr("flatten(transform(array_sort(collect_list(struct(p, dark, light))), v -> array(v.dark, v.light)))").alias("ends"))
        near = "sqrt(power(k.l - {c}.l, 2) + power(k.a_ - {c}.a_, 2) + power(k.b_ - {c}.b_, 2)) <= " + repr(float(threshold))
        first = f"reduce(ends, slice(ends, 1, 0), (kept, e) -> CASE WHEN exists(kept, k -> {near.format(c='e')}) THEN kept ELSE array_append(kept, e) END)"
        p = p.withColumn("c", tone).join(ends.withColumn("kept", F.expr(first)), list(group), "left")
        same = "(k.r = c.r AND k.g = c.g AND k.b = c.b)"
        new = F.expr(f"CASE WHEN exists(ends, k -> {same}) THEN get(filter(kept, k -> NOT {same} AND {near.format(c='c')}), 0) END")
        p = p.withColumn("new", F.coalesce(new, F.col("c"))).select(*group, "o", "new.r", "new.g", "new.b")
    first_seen = p.groupBy(*group, "r", "g", "b").agg(F.min("o").alias("o"))
    return first_seen.withColumn("idx", (F.row_number().over(Window.partitionBy(*group).orderBy("o")) - 1).cast("int")).select(*group, "idx", "r", "g", "b")
