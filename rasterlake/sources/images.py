"""PNG images as pixel relations, and back; decoded by a small codec in Arrow batches.

Reads 8-bit grey, RGB, palette and RGBA images without interlace; alpha becomes 0 or 255 (from 128 up).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGN = b"\x89PNG\r\n\x1a\n"


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) bytes."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG file")
    at, body, palette, alpha, head = 8, b"", None, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + chunk) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = chunk
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or interlace:
        raise ValueError("only 8-bit images without interlace are read")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), dtype=np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros(w * channels, np.int32)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:  # filters that look to the left go pixel by pixel
            row = np.zeros(w * channels, np.int32)
            for i in range(w * channels):
                a = row[i - channels] if i >= channels else 0
                c = up[i - channels] if i >= channels else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + up[i]) // 2
                else:
                    e = a + up[i] - c
                    da, db, dc = abs(e - a), abs(e - up[i]), abs(e - c)
                    p = a if da <= db and da <= dc else up[i] if db <= dc else c
                row[i] = (line[i] + p) & 255
            out[y] = row
    px = out.reshape(h, w, channels)
    full = np.full((h, w, 1), 255, np.uint8)
    if colour == 3:
        table = np.concatenate([palette, np.full((len(palette), 1), 255, np.uint8)], axis=1)
        table[: len(alpha), 3] = np.frombuffer(alpha, np.uint8)
        rgba = table[px[:, :, 0]]
    elif colour in (0, 4):
        rgba = np.concatenate([px[:, :, :1]] * 3 + [px[:, :, 1:2] if colour == 4 else full], axis=2)
    else:
        rgba = px if colour == 6 else np.concatenate([px, full], axis=2)
    rgba = rgba.copy()
    rgba[:, :, 3] = np.where(rgba[:, :, 3] >= 128, 255, 0)
    return rgba


def encode(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)], axis=1)
    return _SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """(file, x, y, r, g, b, a); decode once and keep as Parquet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                px = decode(content)
                h, w = px.shape[:2]
                y, x = np.mgrid[0:h, 0:w]
                cols = [pa.array([file] * (h * w)), *(pa.array(v.reshape(-1).astype(np.int32)) for v in (x, y, *(px[:, :, c] for c in range(4))))]
                yield pa.RecordBatch.from_arrays(cols, names=["file", "x", "y", "r", "g", "b", "a"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, x int, y int, r int, g int, b int, a int")


def to_png(px: DataFrame, key: str = "file") -> DataFrame:
    """(key, png): each image's pixels encoded."""
    cell = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b", "a")))
    wide = px.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), cell.alias("c"))
    wide = wide.select(key, "w", "h", F.flatten(F.transform("c", lambda c: F.array(c["r"], c["g"], c["b"], c["a"]))).cast("array<int>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, v in zip(batch.column("w").to_pylist(), batch.column("h").to_pylist(), batch.column("v").to_numpy(zero_copy_only=False)):
                if len(v) != w * h * 4:
                    raise ValueError("an image has missing or repeated pixels")
                out.append(encode(np.asarray(v).astype(np.uint8).reshape(h, w, 4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[batch.schema.names[0], "png"])

    return wide.mapInArrow(run, f"{key} {dict(px.dtypes)[key]}, png binary")
