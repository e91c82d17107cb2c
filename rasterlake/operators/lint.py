"""Quality rules as queries; each gives rows of one violation schema, and a report unites them.

Violations: asset, rule, severity, scope, n (how many places). What a rule could not judge shows in ``coverage``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import color, geometry, regions

BLOCKING = {1, 3, 4, 5, 7, 9, 10, 22, 23, 24, 25, 26}
KEYFRAME, SEQUENCE = {4, 8, 12, 14, 19, 20}, {22, 23, 24, 25, 26, 27}
DITHER = {"window": 8, "dominance": 0.92, "alternation": 0.40}


def severity(rule: int) -> str:
    return "blocking" if rule in BLOCKING else "advisory"


def scope(rule: int) -> str:
    return "keyframe" if rule in KEYFRAME else "sequence" if rule in SEQUENCE else "static"


def _violations(df: DataFrame, rule: int, key=("asset",)) -> DataFrame:
    return df.select(*key, F.lit(rule).alias("rule"), F.lit(severity(rule)).alias("severity"), F.lit(scope(rule)).alias("scope"), F.col("n").cast("long").alias("n"))


def rule_1(px: DataFrame, pal: DataFrame, key=("asset",)) -> DataFrame:
    """Indices outside the palette."""
    return _violations(px.join(F.broadcast(pal), "idx", "left_anti").groupBy(*key).agg(F.count("*").alias("n")), 1, key)


def rule_3(lab: DataFrame, pal: DataFrame, max_area: int = 2, stray: float = 0.22, key=("asset",)) -> DataFrame:
    """Small regions of a colour used nowhere else in the canvas, with one opaque neighbouring colour, which is no shade of theirs."""
    s = regions.stats(lab, key)
    only = s.groupBy(*key, "idx").agg(F.count("*").alias("regions"))
    adj = regions.adjacency(lab, key)
    both = adj.select(*key, F.col("a").alias("root"), F.col("b_idx").alias("near")).unionByName(adj.select(*key, F.col("b").alias("root"), F.col("a_idx").alias("near")))
    near = both.where("near <> 0").groupBy(*key, "root").agg(F.count_distinct("near").alias("colours"), F.min("near").alias("near")).where("colours = 1")
    bad = s.where((F.col("area") < max_area) & (F.col("idx") != 0)).join(only.where("regions = 1"), [*key, "idx"]).join(near, [*key, "root"])
    lab_ = color.with_oklab(pal)
    bad = bad.join(F.broadcast(color.named(lab_, "x_")), F.col("idx") == F.col("x_idx")).join(F.broadcast(color.named(lab_, "y_")), F.col("near") == F.col("y_idx"))
    bad = bad.where(F.sqrt(color.distance_sq("x_", "y_")) >= stray)
    return _violations(bad.groupBy(*key).agg(F.count("*").alias("n")), 3, key)


def _adjacent_colours(lab: DataFrame, pal: DataFrame, least: int, key) -> DataFrame:
    """Distinct pairs of colours of adjacent opaque regions of some size, with their Lab values."""
    big = regions.stats(lab, key).where(F.col("area") >= least).select(*key, "root")
    adj = regions.adjacency(lab, key).where("a_idx <> 0 AND b_idx <> 0")
    adj = adj.join(big.withColumnRenamed("root", "a"), [*key, "a"], "left_semi").join(big.withColumnRenamed("root", "b"), [*key, "b"], "left_semi")
    pair = adj.select(*key, F.least("a_idx", "b_idx").alias("x_idx"), F.greatest("a_idx", "b_idx").alias("y_idx")).distinct()
    lab_ = color.with_oklab(pal)
    return pair.join(F.broadcast(color.named(lab_, "x_")), "x_idx").join(F.broadcast(color.named(lab_, "y_")), "y_idx")


def rule_6(lab: DataFrame, pal: DataFrame, dl: float = 0.15, gap: float = 3.0, chroma: float = 0.02, key=("asset",)) -> DataFrame:
    """Adjacent colours that differ in lightness but hardly in hue."""
    p = _adjacent_colours(lab, pal, 1, key)
    c = lambda q: F.sqrt(F.col(f"{q}a_") * F.col(f"{q}a_") + F.col(f"{q}b_") * F.col(f"{q}b_"))
    h = lambda q: F.degrees(F.atan2(F.col(f"{q}b_"), F.col(f"{q}a_")))
    bad = p.where((F.abs(F.col("x_l") - F.col("y_l")) >= dl) & (c("x_") >= chroma) & (c("y_") >= chroma) & (color.hue_gap(h("x_"), h("y_")) < gap))
    return _violations(bad.groupBy(*key).agg(F.count("*").alias("n")), 6, key)


def rule_11(lab: DataFrame, pal: DataFrame, least: int = 4, dl: float = 0.06, key=("asset",)) -> DataFrame:
    """Adjacent colours too close in lightness."""
    bad = _adjacent_colours(lab, pal, least, key).where(F.abs(F.col("x_l") - F.col("y_l")) < dl)
    return _violations(bad.groupBy(*key).agg(F.count("*").alias("n")), 11, key)


def rule_13(px: DataFrame, pal: DataFrame, w: int, h: int, limit: float = 0.85, least: int = 64, key=("asset",)) -> DataFrame:
    """Lightness that follows the distance from the silhouette."""
    p = pillow(px, pal, w, h, key).where((F.col("pixels") >= least) & (F.col("corr") > limit))
    return _violations(p.withColumn("n", F.lit(1)), 13, key)


def pillow(px: DataFrame, pal: DataFrame, w: int, h: int, key=("asset",)) -> DataFrame:
    d = geometry.signed_distance(px, w, h, key).where("d > 0")
    l = color.with_oklab(pal).select("idx", "l")  # noqa: E741
    j = d.join(px, [*key, "x", "y"]).join(F.broadcast(l), "idx")
    corr = F.try_divide(F.covar_pop("d", "l"), F.stddev_pop("d") * F.stddev_pop("l"))  # null where nothing varies
    return j.groupBy(*key).agg(corr.alias("corr"), F.count("*").alias("pixels"))


def dither_windows(px: DataFrame, opts: dict = DITHER, key=("asset",)) -> DataFrame:
    """Windows of mostly two colours that change often between neighbours."""
    s = opts["window"]
    w = px.withColumn("wx", F.expr(f"cast(x div {s} as int)")).withColumn("wy", F.expr(f"cast(y div {s} as int)"))
    k = [*key, "wx", "wy"]
    c = w.groupBy(*k, "idx").agg(F.count("*").alias("n"))
    top = c.groupBy(*k).agg(F.sum("n").alias("total"), F.count("*").alias("colours"), F.slice(F.sort_array(F.collect_list(F.struct("n", (-F.col("idx")).alias("i"))), False), 1, 2).alias("t"))
    top = top.where("colours >= 2").withColumn("two", F.col("t")[0]["n"] + F.col("t")[1]["n"])
    pairs = None
    for dx, dy in ((1, 0), (0, 1)):
        q = w.select(*k, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("idx").alias("other"))
        p = w.join(q, [*k, "x", "y"]).groupBy(*k).agg(F.count("*").alias("pairs"), F.count_if(F.col("idx") != F.col("other")).alias("swaps"))
        pairs = p if pairs is None else pairs.unionByName(p)
    pairs = pairs.groupBy(*k).agg(F.sum("pairs").alias("pairs"), F.sum("swaps").alias("swaps"))
    j = top.join(pairs, k).where((F.col("two") >= opts["dominance"] * F.col("total")) & (F.col("swaps") >= opts["alternation"] * F.col("pairs")))
    return j.select(*k, (-F.col("t")[0]["i"]).alias("a"), (-F.col("t")[1]["i"]).alias("b"), "total", "pairs", "swaps")


def dither_ratio(px: DataFrame, opts: dict = DITHER, key=("asset",)) -> DataFrame:
    """Share of a canvas's pixels in dither windows."""
    d = dither_windows(px, opts, key).groupBy(*key).agg(F.sum("total").alias("dithered"))
    return px.groupBy(*key).agg(F.count("*").alias("all")).join(d, list(key), "left").select(*key, (F.coalesce("dithered", F.lit(0)) / F.col("all")).alias("ratio"))


def rule_15(px: DataFrame, opts: dict = DITHER, limit: float = 0.35, key=("asset",)) -> DataFrame:
    return _violations(dither_ratio(px, opts, key).where(F.col("ratio") > limit).withColumn("n", F.lit(1)), 15, key)


def rule_16(px: DataFrame, pal: DataFrame, share: float = 0.25, chroma: float = 0.16, light: float = 0.85, key=("asset",)) -> DataFrame:
    """A large area in a very saturated or very light colour."""
    s = color.shares(px, key).where(F.col("share") >= share).join(F.broadcast(color.with_oklab(pal)), "idx")
    bad = s.where((F.sqrt(F.col("a_") * F.col("a_") + F.col("b_") * F.col("b_")) > chroma) | (F.col("l") > light))
    return _violations(bad.groupBy(*key).agg(F.count("*").alias("n")), 16, key)


def rule_18(pal: DataFrame, light: float = 0.06, chroma: float = 0.01) -> DataFrame:
    """Entries that are pure black; entry 0 is transparent and no colour."""
    p = color.with_oklab(pal).where("idx <> 0")
    return p.where((F.col("l") <= light) & (F.sqrt(F.col("a_") * F.col("a_") + F.col("b_") * F.col("b_")) <= chroma)).select("idx", "l")


def rule_19(lab_mask: DataFrame, limit: float = 1.20, least: int = 8, key=("asset",)) -> DataFrame:
    """Silhouette parts whose outline is long for their box; lab_mask: labels of the opaque mask."""
    m = lab_mask.where("root is not null").withColumn("idx", F.lit(1))
    bad = regions.stats(m, key).where((F.col("area") >= least) & (F.col("excess") > limit))
    return _violations(bad.groupBy(*key).agg(F.count("*").alias("n")), 19, key)


def rule_20(lab: DataFrame, least: int = 16, key=("asset",)) -> DataFrame:
    """Large opaque regions that meet at a corner only."""
    big = regions.stats(lab, key).where(F.col("area") >= least).select(*key, "root")
    p = regions.corner_touching(lab, key).where("a_idx <> 0 AND b_idx <> 0")
    p = p.join(big.withColumnRenamed("root", "a"), [*key, "a"], "left_semi").join(big.withColumnRenamed("root", "b"), [*key, "b"], "left_semi")
    return _violations(p.groupBy(*key).agg(F.count("*").alias("n")), 20, key)


def rule_21(lab: DataFrame, least: int = 16, key=("asset",)) -> DataFrame:
    """Regions of one colour that meet at a corner."""
    big = regions.stats(lab, key).where(F.col("area") >= least).select(*key, "root")
    p = regions.diagonal_pairs(lab, key).where("a_idx = b_idx AND a_idx <> 0")
    p = p.join(big.withColumnRenamed("root", "a"), [*key, "a"], "left_semi").join(big.withColumnRenamed("root", "b"), [*key, "b"], "left_semi")
    return _violations(p.groupBy(*key).agg(F.count("*").alias("n")), 21, key)


def around(px: DataFrame, key=("asset",), value: str = "idx") -> DataFrame:
    """Adds l, r, u, d: the value of each of the four neighbours, null where there is none."""
    row, col = Window.partitionBy(*key, "y").orderBy("x"), Window.partitionBy(*key, "x").orderBy("y")

    def side(move, w, at: str, step: int):
        return F.when(move(at).over(w) == F.col(at) + step, move(value).over(w))

    return px.withColumns({"l": side(F.lag, row, "x", -1), "r": side(F.lead, row, "x", 1), "u": side(F.lag, col, "y", -1), "d": side(F.lead, col, "y", 1)})


def outline_index(near: DataFrame, share: float = 0.6, interior: float = 0.05, key=("asset",)) -> DataFrame:
    """(keys, outline): the colour that most pixels next to clear ones have, if it is a line (hardly any pixel among its own); near: ``around``."""
    n = near.where("idx <> 0").groupBy(*key, "idx").agg(F.count_if(F.expr("l = 0 OR r = 0 OR u = 0 OR d = 0")).alias("ring"), F.count_if(F.expr("l = idx AND r = idx AND u = idx AND d = idx")).alias("inner"), F.count("*").alias("area"))
    top = n.where("ring > 0").groupBy(*key).agg(F.max(F.struct("ring", (-F.col("idx")).alias("i"), "inner", "area")).alias("m"), F.sum("ring").alias("all"))
    return top.where((F.col("m.ring") >= share * F.col("all")) & (F.col("m.inner") <= interior * F.col("m.area"))).select(*key, (-F.col("m.i")).alias("outline"), F.col("m.area").alias("area"))


def rule_4(px: DataFrame, share: float = 0.6, interior: float = 0.05, least: int = 2, low: float = 0.06, high: float = 0.7, key=("asset",)) -> DataFrame:
    """Outlines that are doubled at corners: squares of 2 x 2 outline pixels, next to clear ones, but not between clear ones on opposite sides."""
    near = around(px, key)
    line = near.join(outline_index(near, share, interior, key), list(key)).where("idx = outline")
    origin = F.explode(F.array(*(F.struct((F.col("x") - i).alias("sx"), (F.col("y") - j).alias("sy")) for i in (0, 1) for j in (0, 1)))).alias("s")
    clear = {c: F.max(F.coalesce(F.col(c) == 0, F.lit(False))).alias(c) for c in "lrud"}
    square = line.select(*key, "x", "y", "area", *"lrud", origin).groupBy(*key, "s.sx", "s.sy").agg(F.count("*").alias("n"), F.max("area").alias("area"), *clear.values()).where("n = 4 AND (l OR r OR u OR d) AND NOT (l AND r) AND NOT (u AND d)")
    own = F.explode(F.array(*(F.struct((F.col("sx") + i).alias("x"), (F.col("sy") + j).alias("y")) for i in (0, 1) for j in (0, 1)))).alias("p")
    held = square.select(*key, "sx", "sy", "area", own).groupBy(*key).agg(F.count_distinct("p").alias("held"), F.count_distinct("sx", "sy").alias("n"), F.max("area").alias("area"))
    return _violations(held.where((F.col("n") >= least) & F.expr("held / area").between(low, high)), 4, key)


def rule_5(ramps: DataFrame, pal: DataFrame) -> DataFrame:
    """(ramp, rising): ramps of three colours or more whose chroma only rises or only falls; ramps: ramp, pos, idx."""
    c = ramps.join(F.broadcast(color.with_oklab(pal)), "idx").withColumn("c", F.round(F.hypot("a_", "b_"), 9))
    step = c.withColumn("up", F.col("c") - F.lag("c").over(Window.partitionBy("ramp").orderBy("pos")))
    g = step.groupBy("ramp").agg(F.count("*").alias("n"), F.min("up").alias("lo"), F.max("up").alias("hi")).where("n >= 3")
    return g.where("lo >= 0 OR hi <= 0").select("ramp", (F.col("lo") >= 0).alias("rising"))


def shading(px: DataFrame, pal: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, samples, gx, gy): opaque pixels with four opaque neighbours, and the direction in which they grow lighter (null: none)."""
    l = px.join(F.broadcast(color.with_oklab(pal).select("idx", F.col("l").alias("light"))), "idx").withColumn("light", F.when(F.col("idx") != 0, F.col("light")))  # noqa: E741
    n = around(l, key, "light").where("light is not null AND l is not null AND r is not null AND u is not null AND d is not null")
    g = n.groupBy(*key).agg(F.count("*").alias("samples"), F.sum((F.col("r") - F.col("l")) / 2).alias("sx"), F.sum((F.col("d") - F.col("u")) / 2).alias("sy"))
    size = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    unit = lambda c: F.when(F.round(size, 12) > 0, F.col(c) / size)
    return g.select(*key, "samples", unit("sx").alias("gx"), unit("sy").alias("gy"))


def agreement(px: DataFrame, pal: DataFrame, light: tuple[float, float], least: int = 64, key=("asset",)) -> DataFrame:
    """(keys, agreement): cosine between the shading and the way to a distant light, where there are samples enough."""
    return shading(px, pal, key).where((F.col("samples") >= least) & F.col("gx").isNotNull()).select(*key, (F.col("gx") * light[0] + F.col("gy") * light[1]).alias("agreement"))


def rule_7(px: DataFrame, pal: DataFrame, light: tuple[float, float], limit: float = 0.55, least: int = 64, key=("asset",)) -> DataFrame:
    """Shading that doesn't agree with the declared light."""
    return _violations(agreement(px, pal, light, least, key).where(F.col("agreement") < limit).withColumn("n", F.lit(1)), 7, key)


def jaggies(runs_: DataFrame, most: int = 1, key=("asset",)) -> DataFrame:
    """Runs of a chain shorter than both neighbours, but for turns and for valleys of a lasting slope; runs_: ``kernels.colour_runs``.

    target: the shorter neighbour; within: whether the gap is at most ``most``.
    """
    w = Window.partitionBy(*key, "chain").orderBy("run")
    at = lambda n, c="len": F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w)
    r = runs_.withColumns({"p": at(1), "n": at(-1), "p2": at(2), "n2": at(-2), "before": at(1, "bend"), "after": at(-1, "bend")})
    valley = (F.col("p") > F.col("len")) & (F.col("len") < F.col("n"))
    lasting = F.coalesce((F.col("p2") > F.col("p")) & (F.col("n2") > F.col("n")), F.lit(False))
    j = r.where(valley & ~lasting & ~(F.col("before") * F.col("after") < 0)).withColumn("target", F.least("p", "n"))
    return j.select(*key, "idx", "chain", "run", "len", "target", (F.col("target") - F.col("len") <= most).alias("within"), "straight", "x", "y")


def jaggy_report(runs_: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, chains, runs, jaggies, fixable, rate)."""
    j = jaggies(runs_, key=key).groupBy(*key).agg(F.count("*").alias("jaggies"), F.count_if("within").alias("fixable"))
    all_ = runs_.groupBy(*key).agg(F.count_distinct("chain").alias("chains"), F.count("*").alias("runs"))
    none = F.lit(0)
    out = all_.join(j, list(key), "left").withColumns({"jaggies": F.coalesce("jaggies", none), "fixable": F.coalesce("fixable", none)})
    return out.withColumn("rate", F.col("jaggies") / F.col("runs"))


def rule_8(runs_: DataFrame, key=("asset",)) -> DataFrame:
    return _violations(jaggies(runs_, key=key).groupBy(*key).agg(F.count("*").alias("n")), 8, key)


def rule_9(votes: DataFrame, key=("asset",)) -> DataFrame:
    """Cells of several sizes, one of them single pixels; votes: k of each window (null: flat)."""
    v = votes.where("k is not null").groupBy(*key).agg(F.count_distinct("k").alias("n"), F.min("k").alias("least"))
    return _violations(v.where("n >= 2 AND least = 1"), 9, key)


def mixel_coverage(votes: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, windows, pinned, flat, judged): whether two windows or more could say something."""
    return votes.groupBy(*key).agg(F.count("*").alias("windows"), F.count("k").alias("pinned"), F.count_if(F.col("k").isNull()).alias("flat")).withColumn("judged", F.col("pinned") >= 2)


def _windowed(px: DataFrame, opts: dict) -> DataFrame:
    s = opts["window"]
    return px.withColumn("wx", F.expr(f"cast(x div {s} as int)")).withColumn("wy", F.expr(f"cast(y div {s} as int)"))


def rule_10(px: DataFrame, opts: dict = DITHER, clump: int = 6, key=("asset",)) -> DataFrame:
    """Dither windows in which one colour runs on."""
    k = [*key, "wx", "wy"]
    inside = _windowed(px, opts).join(dither_windows(px, opts, key).select(*k), k)
    low = inside.groupBy(*k).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    own = inside.join(low, k).withColumn("x", F.col("x") - F.col("x0")).withColumn("y", F.col("y") - F.col("y0"))
    s = regions.label(own, k).groupBy(*k, "root").agg(F.count("*").alias("area"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("far"))
    bad = s.where((F.col("area") > 1) & (F.col("far") + 1 > clump)).select(*k).distinct()
    return _violations(bad.groupBy(*key).agg(F.count("*").alias("n")), 10, key)


def rule_12(runs_: DataFrame, gap: int = 3, least: int = 8, key=("asset",)) -> DataFrame:
    """Chains that run side by side with the same run lengths, within some pixels; a canvas's chains are few and meet on its key."""
    c = runs_.groupBy(*key, "chain", "horizontal").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "len"))), lambda s: s["len"]).alias("lens"), F.min_by(F.struct("ax", "ay"), "run").alias("a"), F.max_by(F.struct("bx", "by"), "run").alias("b"))
    flat = F.col("horizontal")
    c = c.where(F.size("lens") >= least).select(*key, "chain", "horizontal", "lens", F.when(flat, F.least("a.ax", "b.bx")).otherwise(F.least("a.ay", "b.by")).alias("lo"), F.when(flat, F.greatest("a.ax", "b.bx")).otherwise(F.greatest("a.ay", "b.by")).alias("hi"), F.when(flat, F.col("a.ay")).otherwise(F.col("a.ax")).alias("across"))
    o = c.select(*key, F.col("chain").alias("chain2"), "horizontal", F.col("lens").alias("lens2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("across").alias("across2"))
    p = c.join(o, [*key, "horizontal"]).where("chain < chain2").where(F.abs(F.col("across") - F.col("across2")).between(1, gap) & (F.col("hi") >= F.col("lo2")) & (F.col("hi2") >= F.col("lo")))
    bad = p.where(shared_runs(F.col("lens"), F.col("lens2")) >= least).select(*key, "horizontal", "lo", "across").distinct()
    return _violations(bad.groupBy(*key).agg(F.count("*").alias("n")), 12, key)


def shared_runs(a: Column, b: Column) -> Column:
    """The most leading values of one array that the other holds in a row from some place on."""

    def from_(x: Column, y: Column) -> Column:
        def leading(offset: Column) -> Column:
            n = F.least(F.size(x) - offset, F.size(y))
            same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(x, offset + i - 1) == F.get(y, i - 1))
            first = F.array_position(same, F.lit(False))
            return F.when(first > 0, first - 1).otherwise(n)

        return F.array_max(F.transform(F.sequence(F.lit(0), F.size(x) - 1), leading))

    return F.greatest(from_(a, b), from_(b, a))


def rule_14(px: DataFrame, pal: DataFrame, limit: float = 0.55, tolerance: float = 0.05, key=("asset",)) -> DataFrame:
    """Too many pixels in colours between others."""
    n = px.where("idx <> 0").groupBy(*key).agg(F.count("*").alias("all"))
    bad = color.intermediates(px, pal, tolerance, key).join(n, list(key)).where(F.col("pixels") > limit * F.col("all"))
    return _violations(bad.withColumn("n", F.col("pixels")), 14, key)


def rule_17(px: DataFrame, pal: DataFrame, opts: dict = DITHER, limit: float = 0.35, key=("asset",)) -> DataFrame:
    """Dither windows of two colours far apart in lightness."""
    l = color.with_oklab(pal).select("idx", "l")  # noqa: E741
    x, y = (F.broadcast(l.select(F.col("idx").alias(c), F.col("l").alias(f"l{c}"))) for c in "ab")
    bad = dither_windows(px, opts, key).join(x, "a").join(y, "b").where(F.abs(F.col("la") - F.col("lb")) > limit)
    return _violations(bad.groupBy(*key).agg(F.count("*").alias("n")), 17, key)


def rule_2(best: DataFrame, image: DataFrame, found: DataFrame, like: float = 0.05, least: float = 0.1, key=("asset",)) -> DataFrame:
    """Canvases with a size whose cells are nearly even, but without a size that is accepted; found: ``grid.confidence``."""
    some = best.join(image, list(key)).where(F.col("v") <= like * F.col("iv")).select(*key).distinct()
    bad = some.join(found.where(F.col("confidence") >= least), list(key), "left_anti")
    return _violations(bad.withColumn("n", F.lit(1)), 2, key)


def in_scope(violations: DataFrame, kinds: DataFrame, key=("asset",)) -> DataFrame:
    """Without rules for key frames on frames that lie between; kinds: keys, kind (key, breakdown, inbetween)."""
    k = violations.join(kinds, list(key), "left")
    return k.where((F.col("scope") != "keyframe") | F.coalesce(F.col("kind").isin("key", "breakdown"), F.lit(True))).drop("kind")


def hints(violations: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, hint): each asset's blocking findings as lines of text, by rule."""
    line = F.struct("rule", F.format_string("rule %d: %d", "rule", "n").alias("t"))
    lines = violations.where("severity = 'blocking'").groupBy(*key).agg(F.array_sort(F.collect_list(line)).alias("t"))
    return lines.select(*key, F.array_join(F.transform("t", lambda s: s["t"]), "\n").alias("hint"))


def report(parts: list[DataFrame]) -> DataFrame:
    """All violations; with totals by rule and severity."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("rule", "severity", "scope").agg(F.count("*").alias("assets"), F.sum("n").alias("violations"))


def predicates(px: DataFrame, opts: dict = DITHER, key=("asset",)) -> DataFrame:
    """What recipes may ask of a canvas: (keys, clear, colours, size, dithered)."""
    c = px.groupBy(*key).agg(F.max(F.col("idx") == 0).alias("clear"), F.count_distinct(F.when(F.col("idx") != 0, F.col("idx"))).alias("colours"), (F.greatest(F.max("x"), F.max("y")) + 1).alias("size"))
    d = dither_windows(px, opts, key).select(*key).distinct().withColumn("_d", F.lit(True))
    return c.join(d, list(key), "left").withColumn("dithered", F.col("_d").isNotNull()).drop("_d")
