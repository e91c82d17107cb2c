"""Palette files as relations: hex lists, GIMP, JASC and raw colour tables; and hex lists written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, each read whole (palette files are small)."""
    t = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return t.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).select("file", "idx", "r", "g", "b")


def _checked(rows: DataFrame) -> DataFrame:
    bad = F.col("idx") > 255
    return rows.withColumn("idx", F.when(bad, F.raise_error(F.lit("a palette has 256 entries at most"))).otherwise(F.col("idx")).cast("int"))


def read_hex(spark: SparkSession, path: str) -> DataFrame:
    """One RRGGBB in each line; ``#`` starts a comment; the order of lines is the index. Other lines are an error."""
    line = F.trim(F.regexp_replace("line", r"#.*", ""))
    rows = _lines(spark, path).withColumn("c", line).where("c <> ''")
    c = F.when(F.col("c").rlike("^[0-9A-Fa-f]{6}$"), F.col("c")).otherwise(F.raise_error(F.concat(F.lit("not RRGGBB: "), F.col("c"))))
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("int")
    return _checked(_numbered(rows.select("file", "line_no", part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))))


def read_gpl(spark: SparkSession, path: str) -> DataFrame:
    """GIMP palettes: red, green and blue in each line after the header."""
    rows = _lines(spark, path).where(F.col("line").rlike(r"^\s*\d+\s+\d+\s+\d+"))
    part = lambda i: F.regexp_extract("line", r"^\s*(\d+)\s+(\d+)\s+(\d+)", i).cast("int")
    return _checked(_numbered(rows.select("file", "line_no", part(1).alias("r"), part(2).alias("g"), part(3).alias("b"))))


def read_pal(spark: SparkSession, path: str) -> DataFrame:
    """JASC palettes: as many colours as the third line says."""
    rows = _lines(spark, path)
    n = rows.where("line_no = 2").select("file", F.trim("line").cast("int").alias("n"))
    rows = rows.join(n, "file").where("line_no >= 3 AND line_no < 3 + n AND trim(line) <> ''")
    part = lambda i: F.regexp_extract("line", r"^\s*(\d+)\s+(\d+)\s+(\d+)", i).cast("int")
    return _checked(_numbered(rows.select("file", "line_no", part(1).alias("r"), part(2).alias("g"), part(3).alias("b"))))


def read_act(spark: SparkSession, path: str) -> DataFrame:
    """Raw tables of 256 colours of three bytes."""
    b = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.hex("content").alias("h")).where(F.length("h") >= 1536)
    i = b.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(255))))
    part = lambda k: F.conv(F.substring(F.col("h"), F.col("idx") * 6 + 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    return i.select("file", "idx", part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def hex_lines(pal: DataFrame) -> DataFrame:
    """A palette as (idx, value): one RRGGBB for each entry, transparent entries too, so indices don't shift."""
    two = lambda c: F.lower(F.lpad(F.hex(F.col(c).cast("int")), 2, "0"))
    return pal.select("idx", F.concat(two("r"), two("g"), two("b")).alias("value"))


def write_hex(pal: DataFrame, path: str) -> None:
    hex_lines(pal).orderBy("idx").select("value").coalesce(1).write.mode("overwrite").text(path)  # 256 lines at most
