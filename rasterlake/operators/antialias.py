"""Intermediate colours between two others: found in a palette, and taken out of canvases again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.lineage import cut
from rasterlake.operators import color, kernels, quantize

_TINY = 1.1920929e-07


def _far(x: str, y: str) -> Column:
    return F.sqrt(color.distance_sq(x, y))


def between(pal: DataFrame, tolerance: float = 0.05, transparent: int = 0) -> DataFrame:
    """(m, x, y, dx, dy, l, a_, b_): entries m on the way from x to y (x < y): nearer to each than they are to each other, with a detour of ``tolerance`` at most.

    A palette has 256 entries at most, so this has at most some 8 million rows.
    """
    p = F.broadcast(color.with_oklab(pal).where(F.col("idx") != transparent))
    m, x, y = (color.named(p, c) for c in ("m_", "x_", "y_"))
    j = x.join(F.broadcast(y), F.col("x_idx") < F.col("y_idx")).withColumn("span", _far("x_", "y_")).where(F.col("span") > _TINY).join(F.broadcast(m), (F.col("m_idx") != F.col("x_idx")) & (F.col("m_idx") != F.col("y_idx")))
    j = j.withColumns({"dx": F.round(_far("m_", "x_"), 12), "dy": F.round(_far("m_", "y_"), 12)}).where(f"dx < span AND dy < span AND dx + dy - span <= {tolerance}")
    return j.select(F.col("m_idx").alias("m"), F.col("x_idx").alias("x"), F.col("y_idx").alias("y"), "dx", "dy", F.col("m_l").alias("l"), F.col("m_a_").alias("a_"), F.col("m_b_").alias("b_"))


def nearest_between(wanted: DataFrame, pal: DataFrame, tolerance: float = 0.05, transparent: int = 0) -> DataFrame:
    """``wanted`` (x, y, t, ...) with idx: the entry between x and y nearest to the colour a share t of the way from x to y; null if none lies between. Ties go to the lowest index."""
    own = F.broadcast(color.with_oklab(pal))
    ends = [own.select(F.col("idx").alias(c), *[F.col(v).alias(f"{c}{v}") for v in ("l", "a_", "b_")]) for c in "xy"]
    w = wanted.join(ends[0], "x").join(ends[1], "y")
    w = w.withColumns({f"_{v}": F.col(f"x{v}") + (F.col(f"y{v}") - F.col(f"x{v}")) * F.col("t") for v in ("l", "a_", "b_")})
    b = between(pal, tolerance, transparent).select(F.col("m"), F.col("x").alias("lo"), F.col("y").alias("hi"), "l", "a_", "b_")
    keys = [F.least("x", "y") == F.col("lo"), F.greatest("x", "y") == F.col("hi")]
    j = w.join(b, keys[0] & keys[1]).withColumn("d", F.round(color.distance_sq("", "_"), 12))
    best = j.groupBy("x", "y", "t").agg(F.min(F.struct("d", "m")).alias("k")).select("x", "y", "t", F.col("k.m").alias("idx"))
    return wanted.join(best, ["x", "y", "t"], "left")


def stripped(px: DataFrame, pal: DataFrame, tolerance: float = 0.05, transparent: int = 0, key=("asset",)) -> DataFrame:
    """(keys, x, y, idx, placed): canvases without antialiasing.

    A pixel whose colour lies between two others of the eight around it takes the one that more of its four
    neighbours have (the nearer one, if as many); of several such pairs the one with the nearest end counts, then
    the one seen first from the upper left. Whole canvases are judged as they were before.
    """
    near = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(int(not (dx and dy))).alias("straight")) for i, (dx, dy) in enumerate(near)]))
    solid = px.where(F.col("idx") != transparent)
    seen = solid.select(*key, "x", "y", "idx", side.alias("s")).select(*key, (F.col("x") - F.col("s.dx")).alias("x"), (F.col("y") - F.col("s.dy")).alias("y"), F.col("idx").alias("v"), "s.i", "s.straight")
    around = seen.join(solid.select(*key, "x", "y", F.col("idx").alias("m")), [*key, "x", "y"]).where("v <> m").groupBy(*key, "x", "y", "m", "v").agg(F.min("i").alias("i"), F.sum("straight").alias("n"))
    at = (*key, "x", "y", "m")
    a, b = (around.select(*at, F.col("v").alias(f"v{c}"), F.col("i").alias(f"i{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    way = between(pal, tolerance, transparent).select("m", F.col("x").alias("va"), F.col("y").alias("vb"), "dx", "dy")
    j = a.join(b, list(at)).where("va < vb").join(F.broadcast(way) if pal.count() <= 32 else way, ["m", "va", "vb"])
    to = F.when((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("dx") <= F.col("dy"))), F.col("va")).otherwise(F.col("vb"))
    best = j.groupBy(*key, "x", "y").agg(F.min(F.struct(F.least("dx", "dy").alias("d"), "ia", "ib", to.alias("to"))).alias("k"))
    out = px.join(best, [*key, "x", "y"], "left")
    return out.select(*key, "x", "y", F.coalesce("k.to", "idx").alias("idx"), F.col("k").isNotNull().alias("placed"))


def wanted(base: DataFrame, placed: DataFrame, pal: DataFrame, least_run: int = 3, span: float = 0.08, offset: float = 0.04, outline: bool = False, transparent: int = 0) -> DataFrame:
    """(asset, x, y, a, b, t, chain, run): pixels of a canvas without antialiasing that should lie a share t of the way from their colour a to b.

    They are the ends of runs of ``least_run`` or more where their border turns into the next run (diagonals are
    left alone), beside an opaque colour b at ``span`` or more (the one that most of the four neighbours have; ties:
    the lowest); next to clear pixels or the edge only with ``outline``. t is off the middle, to the brighter side
    where the border bulges in the middle of its chain, or is hollow towards its ends. ``placed``: pixels not to touch.
    """
    chain = Window.partitionBy("asset", "idx", "chain")
    upto = chain.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = kernels.colour_runs(base).withColumns({"runs": F.count("*").over(chain), "longest": F.max("len").over(chain), "total": F.sum("len").over(chain), "seen": F.sum("len").over(upto) - F.col("len")})
    r = r.where((F.col("runs") > 1) & (F.col("longest") > 1) & (F.col("len") >= max(least_run, 2)))
    third = F.floor(F.greatest(F.col("total"), F.lit(3)) / 3)
    r = r.withColumn("inner", (F.col("seen") >= third) & (F.col("seen") + third < F.col("total")))
    ends = F.array(*[F.struct(F.lit(e).alias("e"), F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y"), F.col(f"{c}bend").alias("bend"), ok.alias("ok")) for e, (c, ok) in enumerate([("a", F.col("run") > 0), ("b", F.col("run") + 1 < F.col("runs"))])])
    r = r.select("asset", F.col("idx").alias("a"), "chain", "run", "inner", F.explode(ends).alias("p")).where("p.ok")
    # A pixel that ends several runs goes by the last of them.
    last = F.max(F.struct("chain", "run", "p.e", ((F.col("p.bend") > 0) == F.col("inner")).alias("brighter")))
    r = r.groupBy("asset", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "a").agg(last.alias("k")).select("asset", "x", "y", "a", "k.brighter", "k.chain", "k.run")
    r = r.join(placed.select("asset", "x", "y"), ["asset", "x", "y"], "left_anti")
    side = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    met = r.withColumn("s", side).join(base.select("asset", (F.col("x")).alias("nx"), F.col("y").alias("ny"), F.col("idx").alias("v")).withColumnRenamed("asset", "na"), (F.col("na") == F.col("asset")) & (F.col("nx") == F.col("x") + F.col("s.dx")) & (F.col("ny") == F.col("y") + F.col("s.dy")), "left")
    counts = met.groupBy("asset", "x", "y", "a", "brighter", "chain", "run", "v").agg(F.count("*").alias("n"))
    clear = F.max((F.col("v").isNull() | (F.col("v") == transparent)).cast("int"))
    other = F.max(F.when(F.col("v").isNotNull() & (F.col("v") != transparent) & (F.col("v") != F.col("a")), F.struct("n", (-F.col("v")).alias("v"))))
    c = counts.groupBy("asset", "x", "y", "a", "brighter", "chain", "run").agg(clear.alias("clear"), other.alias("o")).where("o is not null")
    c = (c if outline else c.where("clear = 0")).select("asset", "x", "y", "a", "brighter", "chain", "run", (-F.col("o.v")).alias("b"))
    own = F.broadcast(color.with_oklab(pal))
    for e in "ab":
        c = c.join(own.select(F.col("idx").alias(e), *[F.col(v).alias(f"{e}_{v}") for v in ("l", "a_", "b_")]), e)
    far = _far("a_", "b_")
    shift = F.least(F.lit(offset), far * 0.4) * F.when(F.col("brighter") == (F.col("a_l") < F.col("b_l")), 1).otherwise(-1)
    return c.where(far >= span).select("asset", "x", "y", "a", "b", F.round(0.5 + shift / far, 9).alias("t"), "chain", "run")


def added(px: DataFrame, pal: DataFrame, tolerance: float = 0.05, transparent: int = 0, **options) -> tuple[DataFrame, DataFrame]:
    """(asset, x, y, idx) with intermediate colours at the ends of runs, and the colours made for it (asset, idx, r, g, b).

    Antialiasing that is there already is judged away first and stays as it is. An entry that lies between two
    colours is used where the palette has one; else a canvas gets one for the pair, as its first pixel (by colour, chain
    and run) wants it, numbered after the palette in order of r, g, b, as long as there is room (256 entries). Colours
    made for one pair are not tried for another.
    """
    base = cut(stripped(px, pal, tolerance, transparent))
    w = cut(wanted(base, base.where("placed"), pal, transparent=transparent, **options))
    found = nearest_between(w.select(F.col("a").alias("x"), F.col("b").alias("y"), "t").distinct(), pal, tolerance, transparent)
    pair = {"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}
    known = cut(w.join(found.withColumnsRenamed({"x": "a", "y": "b"}), ["a", "b", "t"]).withColumns(pair))
    first = known.where("idx is null").groupBy("asset", "lo", "hi").agg(F.min_by(F.struct("a", "b", "t"), F.struct("a", "chain", "run")).alias("k")).select("asset", "lo", "hi", F.col("k.a").alias("x"), F.col("k.b").alias("y"), "k.t")
    own = F.broadcast(color.with_oklab(pal))
    for e in "xy":
        first = first.join(own.select(F.col("idx").alias(e), *[F.col(v).alias(f"{e}{v}") for v in ("l", "a_", "b_")]), e)
    tone = quantize.to_rgb(*[F.col(f"x{v}") + (F.col(f"y{v}") - F.col(f"x{v}")) * F.col("t") for v in ("l", "a_", "b_")])
    new = first.select("asset", "lo", "hi", *[c.alias(n) for n, c in zip("rgb", tone)])
    size = pal.agg(F.max("idx")).first()[0] + 1
    number = F.dense_rank().over(Window.partitionBy("asset").orderBy("r", "g", "b")) - 1 + size
    new = cut(new.withColumn("idx", number).where("idx < 256"))
    paint = known.join(new.select("asset", "lo", "hi", F.col("idx").alias("made")), ["asset", "lo", "hi"], "left").select("asset", "x", "y", F.coalesce("idx", "made").alias("to"))
    out = px.join(paint, ["asset", "x", "y"], "left").select("asset", "x", "y", F.coalesce("to", "idx").cast("int").alias("idx"))
    return out, new.select("asset", "idx", "r", "g", "b").distinct()
