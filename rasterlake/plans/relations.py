"""Graphs of steps as relations: levels and ancestry by joins along the edges, as deep as the graph is.

A way through a graph without cycles has fewer edges than the graph has steps; one that goes on is a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.lineage import cut as _cut


def _steps(edges: DataFrame) -> int:
    return edges.select(F.explode(F.array("src", "dst")).alias("step")).distinct().count()


def levels(edges: DataFrame) -> DataFrame:
    """(step, level): the longest way from a step without dependencies; edges: src, dst."""
    e = _cut(edges.select("src", "dst").distinct())
    now = e.select(F.col("src").alias("step")).join(e.select(F.col("dst").alias("step")), "step", "left_anti").distinct().withColumn("level", F.lit(0))
    out = now
    for depth in range(1, _steps(e) + 1):
        now = now.join(e, F.col("step") == F.col("src")).select(F.col("dst").alias("step")).distinct().withColumn("level", F.lit(depth))
        now = _cut(now)
        if now.isEmpty():
            return out.groupBy("step").agg(F.max("level").alias("level"))
        out = _cut(out.unionByName(now))
    raise ValueError("the graph has a cycle")


def ancestry(edges: DataFrame) -> DataFrame:
    """(step, ancestor): all pairs, along any number of edges."""
    e = _cut(edges.select("src", "dst").distinct())
    new = e.select(F.col("dst").alias("step"), F.col("src").alias("ancestor"))
    out = new
    for _ in range(_steps(e) + 1):
        longer = new.join(e, F.col("step") == F.col("src")).select(F.col("dst").alias("step"), "ancestor").distinct()
        new = _cut(longer.join(out, ["step", "ancestor"], "left_anti"))
        if new.isEmpty():
            return out
        out = _cut(out.unionByName(new))
    raise ValueError("more ways than steps")
