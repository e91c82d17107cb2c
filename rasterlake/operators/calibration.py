"""Metrics over sweep rows: outcomes, rates, calibration error, risk against coverage, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BINS, STEPS = 10, 101
#: Factor levels of the synthetic design: scale, filter, resize, compression.
DESIGN = ([2, 3, 4, 6, 8, 12], ["nearest", "bilinear", "bicubic", "lanczos"], ["keep", "x0.9", "x1.1"], ["none", "q90", "q75", "q50"])


def outcome(floor: float = 0.0) -> Column:
    """exact, scale_only, wrong, rejected or correct_rejection; an answer below the floor counts as none."""
    none = ~F.col("found") | (F.col("conf_bin") / 10.0 < floor)
    right = F.col("scale_hat") == F.col("truth_scale")
    return F.when(none & F.col("has_grid"), "rejected").when(none, "correct_rejection").when(~F.col("has_grid") | ~right, "wrong").when(F.col("phase_ok"), "exact").otherwise("scale_only")


def outcome_sql(floor: float = 0.0) -> str:
    none = f"(NOT found OR conf_bin / 10.0 < {floor})"
    return f"CASE WHEN {none} AND has_grid THEN 'rejected' WHEN {none} THEN 'correct_rejection' WHEN NOT has_grid OR scale_hat <> truth_scale THEN 'wrong' WHEN phase_ok THEN 'exact' ELSE 'scale_only' END"


def _rate(what: Column, of: Column) -> Column:
    n = F.count_if(of)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(what & of) / n)


def summary(rows: DataFrame, floor: float = 0.0) -> DataFrame:
    """Rates of each parameter set, with and without a grid, and the mean of the two classes."""
    r = rows.withColumn("o", outcome(floor))
    o, grid = F.col("o"), F.col("has_grid")
    out = r.groupBy("param_id").agg(
        F.count("*").alias("n"), _rate(o.isin("exact", "correct_rejection"), F.lit(True)).alias("correct_rate"), F.count_if(grid).alias("grid_n"),
        _rate(o == "exact", grid).alias("exact_rate"), _rate(o.isin("exact", "scale_only"), grid).alias("scale_rate"), _rate(o == "rejected", grid).alias("false_reject_rate"),
        _rate(o == "correct_rejection", ~grid).alias("reject_rate"),
    )
    return out.withColumn("macro_rate", (F.col("exact_rate") + F.col("reject_rate")) / 2)


def ece(rows: DataFrame) -> DataFrame:
    """Calibration error of each parameter set: ten bins of confidence, the last closed; answers only, no floor."""
    ok = outcome().isin("exact", "correct_rejection")
    r = rows.where("found").withColumn("ok", ok.cast("int")).withColumn("bin", F.least(F.floor(F.col("conf_bin") * F.lit(BINS) / 10), F.lit(BINS - 1)))
    b = r.groupBy("param_id", "bin").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"), F.sum("conf_bin").alias("c"))
    return b.groupBy("param_id").agg((F.sum(F.abs(F.col("ok") - F.col("c") / 10.0)) / F.sum("n")).alias("ece"))


def risk_coverage(rows: DataFrame, by=("param_id",)) -> DataFrame:
    """For 101 thresholds the share of answers kept and the share of these that are not exact."""
    binned = rows.groupBy(*by, F.when(F.col("found"), F.col("conf_bin")).alias("c")).agg(F.count("*").alias("n"), F.count_if(outcome() != "exact").alias("w"))
    t = binned.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))  # bins, not rows, meet thresholds
    kept = F.col("c").isNotNull() & (F.col("c") * 10 >= F.col("step"))
    g = t.groupBy(*by, "step").agg(F.sum("n").alias("total"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("covered"), F.sum(F.when(kept, F.col("w")).otherwise(0)).alias("wrong"))
    return g.select(*by, "step", "covered", (F.col("covered") / F.col("total")).alias("coverage"), F.when(F.col("covered") == 0, F.lit(0.0)).otherwise(F.col("wrong") / F.col("covered")).alias("risk"))


def operating_point(curve: DataFrame, target: float, by=("param_id",)) -> DataFrame:
    """The smallest threshold with answers whose risk is within the target."""
    ok = curve.where((F.col("covered") > 0) & (F.round("risk", 9) <= round(1 - target, 9)))
    return ok.groupBy(*by).agg(F.min(F.struct("step", "coverage", "risk")).alias("m")).select(*by, "m.*")


def tier() -> Column:
    return F.when(F.col("filter") == "nearest", "A").when(F.col("filter").isin("bilinear", "bicubic"), "B").otherwise("C")


def tiers(rows: DataFrame, floor: float = 0.0) -> DataFrame:
    """Exact share by tier of filter, with totals over splits, tiers and both."""
    r = rows.where("has_grid").withColumn("tier", tier()).withColumn("exact", (outcome(floor) == "exact").cast("int"))
    return r.rollup("split", "tier").agg(F.count("*").alias("n"), F.sum("exact").alias("exact"))


def best_threshold(rows: DataFrame, by=("param_id",)) -> DataFrame:
    """The confidence from which 'exact' is best told from the rest by balanced accuracy (ties: the smaller)."""
    r = rows.where("found").groupBy(*by, "conf_bin").agg(F.count_if(outcome() == "exact").alias("p"), F.count_if(outcome() != "exact").alias("q"))
    w = Window.partitionBy(*by)
    up = w.orderBy("conf_bin").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("all_p", F.sum("p").over(w)).withColumn("all_q", F.sum("q").over(w)).withColumn("below_p", F.coalesce(F.sum("p").over(up), F.lit(0))).withColumn("below_q", F.coalesce(F.sum("q").over(up), F.lit(0)))
    score = ((F.col("all_p") - F.col("below_p")) / F.col("all_p") + F.col("below_q") / F.col("all_q")) / 2
    best = r.where("all_p > 0 AND all_q > 0").withColumn("score", F.round(score, 9)).groupBy(*by).agg(F.max(F.struct("score", (-F.col("conf_bin")).alias("t"))).alias("m"))
    return best.select(*by, (-F.col("m.t")).alias("conf_bin"), F.col("m.score").alias("score"))


def quartiles(rows: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Nearest-rank quartiles: the values at round((n - 1) q), from value counts, so a group needs no list of its rows."""
    c = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    c = c.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * q + 0.5), F.col(value)))
    return c.groupBy(*by).agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("n").alias("n"))


def factorial(spark: SparkSession, count: int = 500) -> DataFrame:
    """Items of the factorial design: the id's digits in mixed radix pick the levels."""
    df, div = spark.range(count).withColumnRenamed("id", "item_id"), 1
    for name, levels in zip(("scale", "filter", "resize", "compression"), DESIGN):
        df = df.withColumn(name, F.element_at(F.array(*map(F.lit, levels)), (F.floor(F.col("item_id") / div) % len(levels) + 1).cast("int")))
        div *= len(levels)
    return df.withColumn("split", F.when(F.col("item_id") % 5 < 3, "validation").otherwise("test")).withColumn("has_grid", F.col("resize") == "keep")


def param_grid(spark: SparkSession, lists: dict[str, list[float]]) -> DataFrame:
    """All combinations of parameter lists, numbered as nested loops would (the last list fastest)."""
    df = spark.range(1).select(F.lit(0).cast("long").alias("param_id"))
    for name, values in lists.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("_p", name)).withColumn("param_id", F.col("param_id") * len(values) + F.col("_p")).drop("_p")
    return df
