"""Decisions over stored sweep rows: gates, the chosen size, confidence, outcomes and scores, for many gate settings at once.

Candidates are rows (item_id, scale, v, recon, drift_ok, curve_ok, contrast, phase); cases are rows
(item_id, image_var, has_grid, truth_scale, truth_phase, filter). Settings are a small table that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTINGS = "param_id int, epsilon double, tau double, min_contrast double, min_confidence double, per_scale boolean, any_phase boolean"


def settings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SETTINGS)


def _gates(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """``of`` gives a candidate's columns by name."""
    phase = F.when(F.col("any_phase"), of("drift_ok") | of("curve_ok")).otherwise(of("drift_ok") & of("curve_ok"))
    return {
        "epsilon": of("v") <= F.col("epsilon") * of("image_var"), "recon": of("recon") <= F.col("tau"),
        "phase": F.coalesce(phase, F.lit(True)), "contrast": of("contrast") >= F.col("min_contrast"),  # what can't be measured passes
    }


def gated(cands: DataFrame, cases: DataFrame, params: DataFrame) -> DataFrame:
    """Candidates under every setting with the names of the gates that they fail, all of them, and whether they pass."""
    j = cands.join(cases, "item_id").join(F.broadcast(params), F.lit(True))
    failed = F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in _gates().items())))
    return j.withColumn("failed", failed).withColumn("passes", F.size("failed") == 0)


def _apart(t: Column, s: Column) -> Column:
    """Sizes above ``s`` that are no multiple of it (a larger size is never a divisor)."""
    return (t > s) & (t % s != 0)


def settled(cands: DataFrame, cases: DataFrame, params: DataFrame) -> DataFrame:
    """Every case under every setting: (param_id, item_id, the case's columns, truth_passes) and, of the largest passing size
    (null where none passes), (hat, hat_phase, rival, confidence, floor, accepted).

    An item's sizes are a handful, so they lie in its row: items are shuffled once, and settings multiply rows after that.
    """
    j = cands.join(cases, "item_id").withColumn("truth", F.col("scale") == F.col("truth_scale"))
    sizes = F.collect_list(F.struct("scale", "phase", "v", "image_var", "recon", "drift_ok", "curve_ok", "contrast", "truth"))
    items = j.groupBy("item_id").agg(*(F.first(c).alias(c) for c in ("has_grid", "truth_scale", "truth_phase", "filter")), sizes.alias("sizes"))
    passes = lambda x: reduce(lambda p, q: p & q, (F.coalesce(ok, F.lit(True)) for ok in _gates(lambda c: x[c]).values()))
    r = items.join(F.broadcast(params), F.lit(True)).withColumn("passing", F.filter("sizes", passes))
    h = F.array_max(F.transform("passing", lambda x: F.struct(x["scale"].alias("scale"), x["phase"].alias("phase"), x["v"].alias("v"), x["image_var"].alias("image_var"))))
    r = r.withColumns({"h": h, "truth_passes": F.exists("passing", lambda x: F.coalesce(x["truth"], F.lit(False)))}).drop("passing")
    r = r.withColumn("rival", F.array_min(F.transform(F.filter("sizes", lambda x: _apart(x["scale"], F.col("h.scale"))), lambda x: x["v"]))).drop("sizes")
    floor = F.when(F.col("per_scale"), F.col("min_confidence") / F.col("h.scale")).otherwise(F.col("min_confidence"))
    c = F.when((F.col("h.image_var") > 0) & F.col("rival").isNotNull(), F.least(F.greatest((F.col("rival") - F.col("h.v")) / F.col("h.image_var"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    some = F.col("h").isNotNull()
    r = r.withColumns({"hat": F.col("h.scale"), "hat_phase": F.col("h.phase"), "floor": F.when(some, floor), "confidence": F.when(some, c)})
    return r.withColumn("accepted", F.when(some, F.col("rival").isNotNull() & (F.round("confidence", 9) >= F.round("floor", 9)))).select("param_id", "item_id", "has_grid", "truth_scale", "truth_phase", "filter", "truth_passes", "hat", "hat_phase", "rival", "confidence", "floor", "accepted")


def decided(rows: DataFrame) -> DataFrame:
    """(param_id, item_id, hat, hat_phase, rival, confidence, floor, accepted) of the largest passing size; rows: ``settled``."""
    return rows.where("hat is not null").select("param_id", "item_id", "hat", "hat_phase", "rival", "confidence", "floor", "accepted")


def outcomes(rows: DataFrame, *more: str) -> DataFrame:
    """(param_id, item_id, has_grid, tier, hat, outcome, missed) of every case under every setting, and ``more`` columns; rows: ``settled``.

    missed: why a true size that passes all gates was not found: confidence, choice or phase.
    """
    j = rows.withColumn("ok", F.coalesce("accepted", F.lit(False)))
    right = F.col("hat") == F.col("truth_scale")
    same = F.coalesce(F.col("hat_phase") == F.col("truth_phase"), F.lit(False))
    out = F.when(~F.col("ok") & F.col("has_grid"), "rejected").when(~F.col("ok"), "correct_rejection").when(~F.col("has_grid") | ~right, "wrong").when(same, "exact").otherwise("scale_only")
    why = F.when(F.col("has_grid") & F.col("truth_passes"), F.when(~F.col("ok"), "confidence").when(~right, "choice").when(~same, "phase"))
    tier = F.when(F.col("has_grid"), F.when(F.col("filter") == "nearest", "A").when(F.col("filter").isin("bilinear", "bicubic"), "B").otherwise("C"))
    return j.select("param_id", "item_id", "has_grid", tier.alias("tier"), F.when(F.col("ok"), F.col("hat")).alias("hat"), out.alias("outcome"), why.alias("missed"), *more)


def score(out: DataFrame) -> DataFrame:
    """Counts of each setting's outcomes and tiers, and the mean of the two classes' rates."""
    n = lambda c: F.count_if(c)
    o = F.col("outcome")
    tiers = [x for t in "ABC" for x in (n((F.col("tier") == t) & (o == "exact")).alias(f"{t.lower()}_exact"), n(F.col("tier") == t).alias(f"{t.lower()}_n"))]
    g = out.groupBy("param_id").agg(n(F.col("has_grid")).alias("grid_n"), n(~F.col("has_grid")).alias("nogrid_n"), *(n(o == x).alias(x) for x in ("exact", "scale_only", "rejected", "correct_rejection", "wrong")), *tiers)
    return g.withColumn("macro_rate", (F.col("exact") / F.greatest("grid_n", F.lit(1)) + F.col("correct_rejection") / F.greatest("nogrid_n", F.lit(1))) / 2)


def fallout(rows: DataFrame) -> DataFrame:
    """(param_id, gates, n): true sizes that fail, by the gates that they fail together."""
    t = rows.where("has_grid AND scale = truth_scale AND NOT passes")
    return t.groupBy("param_id", F.array_join("failed", "+").alias("gates")).agg(F.count("*").alias("n"))


def kinship(rows: DataFrame) -> DataFrame:
    """Candidates as truth, multiple, divisor or other of the true size, with mean reconstruction and variance share."""
    s, t = F.col("scale"), F.col("truth_scale")
    kind = F.when(s == t, "truth").when((s > t) & (s % t == 0), "multiple").when((s < t) & (t % s == 0), "divisor").otherwise("other")
    return rows.where("has_grid").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.avg("recon").alias("recon"), F.avg(F.col("v") / F.when(F.col("image_var") > 0, F.col("image_var"))).alias("share"))


def separation(rows: DataFrame, value: str, positive: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, threshold, score): the value up to which the positive rows are best told from the others (balanced accuracy; ties: the smaller).

    From counts of each value, so no group needs a list of its rows.
    """
    c = rows.groupBy(*by, F.col(value).alias("threshold")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up = w.orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"all_p": F.sum("p").over(w), "all_q": F.sum("q").over(w), "up_p": F.sum("p").over(up), "up_q": F.sum("q").over(up)}).where("all_p > 0 AND all_q > 0")
    s = F.round((F.col("up_p") / F.col("all_p") + (F.col("all_q") - F.col("up_q")) / F.col("all_q")) / 2, 9)
    m = c.withColumn("score", s).groupBy(*by).agg(F.max(F.struct("score", (-F.col("threshold")).alias("t"))).alias("m"))
    return m.select(*by, (-F.col("m.t")).alias("threshold"), F.col("m.score").alias("score"))


def distribution(rows: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """n, least, 5 %, median, 95 % and most of a value by nearest rank, from counts of values."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    c = c.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * q + 0.5), F.col(value)))
    return c.groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("least"), at(0.05).alias("q05"), at(0.5).alias("median"), at(0.95).alias("q95"), F.max(value).alias("most"))


def fired_at(rows: DataFrame, value: str, bad: Column, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, threshold, bad_fired, bad_n, good_fired, good_n): rows above each threshold; values are counted before they meet thresholds."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v"), bad.alias("_b")).agg(F.count("*").alias("c"))
    t = c.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    n = lambda ok: F.sum(F.when(ok, F.col("c")).otherwise(0))
    over = F.col("_v") > F.col("threshold")
    return t.groupBy(*by, "threshold").agg(n(F.col("_b") & over).alias("bad_fired"), n(F.col("_b")).alias("bad_n"), n(~F.col("_b") & over).alias("good_fired"), n(~F.col("_b")).alias("good_n"))


def band_trend(rows: DataFrame, value: str, band: str, by: tuple[str, ...]) -> DataFrame:
    """(by, bands, spread, relative, slope) of a value's means over bands: their range, its share of the mean, and the least-squares slope."""
    m = rows.groupBy(*by, band).agg(F.avg(value).alias("m"))
    g = m.groupBy(*by).agg(F.count("*").alias("bands"), (F.max("m") - F.min("m")).alias("spread"), F.avg("m").alias("mean"), F.regr_slope("m", band).alias("slope"))
    return g.select(*by, "bands", "spread", (F.col("spread") / F.when(F.col("mean") != 0, F.col("mean"))).alias("relative"), "slope")
