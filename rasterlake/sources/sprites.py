"""Text sprites (TOML: meta, palette map, frames of character rows) as relations, and back."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
KEYS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_META = {"format", "name", "layer", "depth", "anchors", "subpixel_exclude", "kind", "tile_size", "dither_phase"}
_FRAME = {"name", "kind", "duration_ms", "quadrant", "data"}
SCHEMA = "file string, name string, frame int, kind string, duration_ms int, x int, y int, idx int"


def parse(text: str, file: str = "") -> list[tuple]:
    """(file, name, frame, kind, duration_ms, x, y, idx) of every pixel; strict about fields, keys and row lengths."""
    doc = tomllib.loads(text)
    if set(doc) - {"meta", "palette", "frame"} or set(doc["meta"]) - _META:
        raise ValueError(f"{file}: unknown fields")
    if doc["meta"]["format"] != FORMAT:
        raise ValueError(f"{file}: format must be {FORMAT}")
    table = doc["palette"]["map"]
    if any(len(k) != 1 for k in table):
        raise ValueError(f"{file}: palette keys are single characters")
    clear = [k for k, v in table.items() if v == "transparent"]
    if len(clear) > 1:
        raise ValueError(f"{file}: one key at most is transparent")
    idx = {k: 0 if v == "transparent" else v for k, v in table.items()}
    out = []
    for n, frame in enumerate(doc["frame"], 1):
        if set(frame) - _FRAME:
            raise ValueError(f"{file}: unknown fields in frame {n}")
        lines = [r for r in frame["data"].split("\n") if r]
        if len({len(r) for r in lines}) > 1:
            raise ValueError(f"{file}: rows of frame {n} differ in length")
        for y, row in enumerate(lines):
            for x, ch in enumerate(row):
                if ch not in idx:
                    raise ValueError(f"{file}: {ch!r} isn't in the palette")
                out.append((file, doc["meta"]["name"], n, frame.get("kind", "key"), frame.get("duration_ms", 100), x, y, idx[ch]))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for t, f in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist()) for r in parse(t, f)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file")).mapInArrow(run, SCHEMA)


def to_text(px: DataFrame, palette_ref: str = "palette.hex") -> DataFrame:
    """(name, value): each sprite as text; index i is written as the i-th of the 62 keys."""
    ch = F.substring(F.lit(KEYS), F.col("idx") + 1, F.lit(1))
    ok = F.when(F.col("idx") < len(KEYS), ch).otherwise(F.raise_error(F.lit("more colours than keys")))
    row = px.withColumn("ch", ok).groupBy("name", "frame", "kind", "duration_ms", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ch"))), lambda c: c["ch"]), "").alias("row"))
    frame = row.groupBy("name", "frame", "kind", "duration_ms").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda c: c["row"]), "\n").alias("data"))
    text = F.concat(F.lit("\n[[frame]]\nname = \"f"), "frame", F.lit('"\nkind = "'), "kind", F.lit('"\nduration_ms = '), "duration_ms", F.lit("\ndata = '''\n"), "data", F.lit("\n'''\n"))
    body = frame.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", text.alias("t")))), lambda c: c["t"]), "").alias("frames"))
    used = px.groupBy("name").agg(F.array_sort(F.collect_set("idx")).alias("used"))
    entry = F.transform("used", lambda i: F.concat(F.lit('"'), F.substring(F.lit(KEYS), i + 1, F.lit(1)), F.lit('" = '), F.when(i == 0, F.lit('"transparent"')).otherwise(i.cast("string"))))
    head = F.concat(F.lit(f"[meta]\nformat = {FORMAT}\nname = \""), "name", F.lit(f'"\n\n[palette]\nref = "{palette_ref}"\n\n[palette.map]\n'), F.array_join(entry, "\n"), F.lit("\n"))
    return body.join(used, "name").select("name", F.concat(head, "frames").alias("value"))
