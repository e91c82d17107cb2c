"""Runs along scanlines as gaps and islands, and what their lengths say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_lengths(px: DataFrame, key=("asset",), along: str = "x", across: str = "y", value: str = "idx") -> DataFrame:
    """(keys, across, run, value, start, len): islands of equal value along an axis; a missing pixel ends a run."""
    line = Window.partitionBy(*key, across).orderBy(along)
    new = (F.lag(value).over(line).isNull() | (F.lag(value).over(line) != F.col(value)) | (F.lag(along).over(line) != F.col(along) - 1)).cast("int")
    marked = px.withColumn("_new", new).withColumn("run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*key, across, "run", value).agg(F.min(along).alias("start"), F.count("*").alias("len"))


def valleys(runs: DataFrame, key=("asset", "y"), order: str = "run") -> DataFrame:
    """Runs strictly shorter than both neighbours."""
    w = Window.partitionBy(*key).orderBy(order)
    return runs.withColumn("_p", F.lag("len").over(w)).withColumn("_n", F.lead("len").over(w)).where("_p > len AND len < _n").drop("_p", "_n")


def sustained_valleys(runs: DataFrame, slope: int = 2, key=("asset", "y"), order: str = "run") -> DataFrame:
    """Valleys towards which lengths fall, and from which they rise, for ``slope`` steps each."""
    w = Window.partitionBy(*key).orderBy(order)
    out, cond = runs, F.lit(True)
    for i in range(1, slope + 1):
        out = out.withColumn(f"_p{i}", F.lag("len", i).over(w)).withColumn(f"_n{i}", F.lead("len", i).over(w))
        near = "len" if i == 1 else None
        cond = cond & (F.col(f"_p{i}") > F.col(near or f"_p{i - 1}")) & (F.col(f"_n{i}") > F.col(near or f"_n{i - 1}"))
    return out.where(cond).select(*runs.columns)


def banding(runs: DataFrame, least: int = 3, key=("asset", "y"), order: str = "run") -> DataFrame:
    """Stretches of ``least`` or more neighbouring runs of one length."""
    w = Window.partitionBy(*key).orderBy(order)
    new = (F.lag("len").over(w).isNull() | (F.lag("len").over(w) != F.col("len"))).cast("int")
    island = runs.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "_i").agg(F.min(order).alias("first_run"), F.max("len").alias("len"), F.count("*").alias("repeats")).where(F.col("repeats") >= least).drop("_i")
