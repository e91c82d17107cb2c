"""Colour as columns: OKLab, distances, palettes (at most 256 rows, so they are broadcast), ramps and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The published OKLab matrices (linear sRGB to cone response, its cube root to Lab).
TO_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
COVER = (50, 80, 90, 95)


def linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def with_oklab(pal: DataFrame) -> DataFrame:
    """Adds l, a_, b_ for r, g, b."""
    rgb = [linear(F.col(c)) for c in "rgb"]
    cones = [F.cbrt(sum((m * c for m, c in zip(row[1:], rgb[1:])), row[0] * rgb[0])) for row in TO_CONES]
    out = pal.withColumns({f"_c{i}": c for i, c in enumerate(cones)})
    lab = [row[0] * F.col("_c0") + row[1] * F.col("_c1") + row[2] * F.col("_c2") for row in TO_LAB]
    return out.withColumns(dict(zip(("l", "a_", "b_"), lab))).drop("_c0", "_c1", "_c2")


def oklab_sql(source: str) -> str:
    """The same for DuckDB, over a relation with idx, r, g, b."""
    lin = {c: f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)" for c in "rgb"}
    cones = [f"cbrt({m[0]} * {lin['r']} + {m[1]} * {lin['g']} + {m[2]} * {lin['b']})" for m in TO_CONES]
    lab = [f"{m[0]} * c0 + {m[1]} * c1 + {m[2]} * c2" for m in TO_LAB]
    return f"SELECT * EXCLUDE (c0, c1, c2), {lab[0]} AS l, {lab[1]} AS a_, {lab[2]} AS b_ FROM (SELECT *, {cones[0]} AS c0, {cones[1]} AS c1, {cones[2]} AS c2 FROM {source})"


def distance_sq(x: str, y: str, weight: float = 1.0) -> Column:
    """Of two colours whose columns carry the given prefixes."""
    d = lambda c: F.col(f"{x}{c}") - F.col(f"{y}{c}")
    return weight * d("l") * d("l") + d("a_") * d("a_") + d("b_") * d("b_")


def named(pal: DataFrame, prefix: str) -> DataFrame:
    return pal.select(*[F.col(c).alias(f"{prefix}{c}") for c in pal.columns])


def nearest(colours: DataFrame, pal: DataFrame, weight: float = 1.0) -> DataFrame:
    """For each distinct colour (r, g, b) the nearest palette entry; ties go to the lowest index."""
    c = with_oklab(colours.select("r", "g", "b").distinct())
    p = F.broadcast(named(with_oklab(pal), "p_"))  # a palette has 256 entries at most
    j = c.join(p, F.lit(True)).withColumn("d", F.round(distance_sq("", "p_", weight), 12))
    return j.groupBy("r", "g", "b").agg(F.min(F.struct("d", "p_idx")).alias("m")).select("r", "g", "b", F.col("m.p_idx").alias("idx"), F.col("m.d").alias("distance"))


def areas(px: DataFrame, key=("asset",)) -> DataFrame:
    return px.where("idx <> 0").groupBy(*key, "idx").agg(F.count("*").alias("area"))


def shares(px: DataFrame, key=("asset",)) -> DataFrame:
    """Area, share and cumulative share of each colour of a canvas, largest first."""
    a = areas(px, key)
    by = Window.partitionBy(*key)
    order = by.orderBy(F.desc("area"), "idx").rowsBetween(Window.unboundedPreceding, 0)
    return a.withColumn("total", F.sum("area").over(by)).withColumn("cum", F.sum("area").over(order)).withColumn("share", F.col("area") / F.col("total"))


def cover_counts(px: DataFrame, key=("asset",)) -> DataFrame:
    """How many colours cover 50, 80, 90 and 95 percent of the opaque area."""
    s = shares(px, key)
    need = [F.count_if((F.col("cum") - F.col("area")) * 100 < F.col("total") * q).alias(f"cover{q}") for q in COVER]
    return s.groupBy(*key).agg(*need, F.count("*").alias("colours"), F.max("total").alias("opaque"))


def contrast_pairs(px: DataFrame, pal: DataFrame, top: int = 4, key=("asset",)) -> DataFrame:
    """Lightness and colour difference of each pair of a canvas's largest colours."""
    rank = Window.partitionBy(*key).orderBy(F.desc("area"), "idx")
    main = areas(px, key).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).join(F.broadcast(with_oklab(pal)), "idx")
    a, b = (main.select(*key, *[F.col(c).alias(f"{p}{c}") for c in ("idx", "rank", "l", "a_", "b_")]) for p in ("x_", "y_"))
    pairs = a.join(b, list(key)).where("x_rank < y_rank")
    return pairs.select(*key, "x_idx", "y_idx", F.abs(F.col("x_l") - F.col("y_l")).alias("contrast"), F.sqrt(distance_sq("x_", "y_")).alias("delta_e"))


def used_colours(px: DataFrame, pal: DataFrame) -> DataFrame:
    """The colours that any canvas uses, in order of r, g, b."""
    used = px.where("idx <> 0").select("idx").distinct()
    rgb = pal.join(used, "idx", "left_semi").select("r", "g", "b").distinct()
    return rgb.withColumn("idx", F.row_number().over(Window.orderBy("r", "g", "b")) - 1)  # 256 rows at most


def normalised(pal: DataFrame) -> DataFrame:
    """Forward permutation by lightness."""
    return with_oklab(pal).withColumn("new_idx", F.row_number().over(Window.orderBy(F.round("l", 9), "idx")) - 1).select("idx", "new_idx", "l")


def merged(palettes: list[DataFrame]) -> DataFrame:
    """All colours of the palettes once, in order of first appearance."""
    out = None
    for i, p in enumerate(palettes):
        q = p.select(F.lit(i).alias("p"), "idx", "r", "g", "b")
        out = q if out is None else out.unionByName(q)
    first = out.groupBy("r", "g", "b").agg(F.min(F.struct("p", "idx")).alias("f"))
    return first.withColumn("idx", F.row_number().over(Window.orderBy("f.p", "f.idx")) - 1).select("idx", "r", "g", "b")


def ramp_step(px: DataFrame, ramp: list[int], delta: int) -> DataFrame:
    """Indices of a ramp moved along it, held at its ends; others stay."""
    table = {v: ramp[min(max(i + delta, 0), len(ramp) - 1)] for i, v in enumerate(ramp)}
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return px.withColumn("idx", F.coalesce(F.element_at(pairs, F.col("idx")), F.col("idx")))


def hue_gap(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def intermediates(px: DataFrame, pal: DataFrame, tolerance: float = 0.05, key=("asset",)) -> DataFrame:
    """Pixels whose colour is about the mean of two colours with larger areas of the same canvas."""
    a = areas(px, key).join(F.broadcast(with_oklab(pal)), "idx")
    c, x, y = (a.select(*key, *[F.col(k).alias(f"{p}{k}") for k in ("idx", "area", "l", "a_", "b_")]) for p in ("c_", "x_", "y_"))
    j = c.join(x, list(key)).where("x_area > c_area").join(y, list(key)).where("y_area > c_area AND x_idx < y_idx")
    off = [F.col(f"c_{k}") - (F.col(f"x_{k}") + F.col(f"y_{k}")) / 2 for k in ("l", "a_", "b_")]
    near = j.where(F.sqrt(sum((o * o for o in off[1:]), off[0] * off[0])) <= tolerance)
    return near.select(*key, "c_idx", "c_area").distinct().groupBy(*key).agg(F.sum("c_area").alias("pixels"))
