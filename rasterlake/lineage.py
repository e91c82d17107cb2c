"""Cutting the lineage of tables that several later steps read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """With its lineage cut by a table in the folder of ``spark.checkpoint.dir``; kept in memory where none is set."""
    sc = df.sparkSession.sparkContext
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()
