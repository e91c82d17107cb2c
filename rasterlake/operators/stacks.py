"""Kernels over whole canvases: canvases of one size are stacked and worked on together, inside one Arrow stage.

A canvas is a bounded group (the pixels of one key), so it travels as one row of arrays. Batches and
stacks are bounded, so a worker's memory grows neither with the table nor with a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW = {"int": pa.int32(), "double": pa.float64()}
_SPARK = {"int": T.IntegerType(), "double": T.DoubleType()}


#: Cells of a stack at most (one canvas at least); rows and bytes of an Arrow batch.
CELLS, BATCH_ROWS, BATCH_BYTES = 1 << 16, 2000, 4 << 20


def bounded(df: DataFrame) -> None:
    """Bound the Arrow batches that Python workers get."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parts(sizes: dict[tuple[int, int], list[int]]) -> Iterator[tuple[tuple[int, int], list[int]]]:
    """Canvases by size, in stacks of at most ``CELLS`` cells."""
    for (h, w), rows in sizes.items():
        step = max(1, CELLS // (h * w))
        for i in range(0, len(rows), step):
            yield (h, w), rows[i : i + step]


def on_stacks(px: DataFrame, work: Callable[[np.ndarray], np.ndarray], out: str, kind: str = "int", key=("asset",), value: str = "idx", none: float = -1) -> DataFrame:
    """(keys, x, y, idx, ``out``): ``work`` gets a stack (canvas, row, column) of a value and gives as large a stack.

    Null values and places without a pixel are ``none`` there.
    """
    bounded(px)
    cell = F.array_sort(F.collect_list(F.struct("y", "x", F.coalesce(F.col(value).cast("double"), F.lit(float(none))).alias("v"), F.col("idx").cast("int").alias("idx"))))
    wide = px.groupBy(*key).agg(cell.alias("c"))

    def field(name: str, as_: str):
        return F.transform("c", lambda cell: cell[name].cast(as_)).alias(f"_{name}")

    wide = wide.select(*key, *[field(f, "double" if f == "v" else "int") for f in ("x", "y", "v", "idx")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, vs = ([np.asarray(a) for a in batch.column(f"_{c}").to_numpy(zero_copy_only=False)] for c in "xyv")
            done: list = [None] * batch.num_rows
            sizes: dict[tuple[int, int], list[int]] = {}
            for i, (x, y) in enumerate(zip(xs, ys)):
                sizes.setdefault((int(y.max()) + 1, int(x.max()) + 1), []).append(i)
            for (h, w), rows in parts(sizes):
                stack = np.full((len(rows), h, w), none, dtype=np.float64)
                for j, i in enumerate(rows):
                    stack[j, ys[i], xs[i]] = vs[i]
                made = work(stack)
                for j, i in enumerate(rows):
                    done[i] = made[j, ys[i], xs[i]]
            flat = np.concatenate(done) if done else np.zeros(0)
            offsets = np.append(0, np.cumsum([len(r) for r in done])).astype(np.int32)
            values = pa.array(flat.astype(_ARROW[kind].to_pandas_dtype()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*batch.schema.names, "_out"])

    schema = T.StructType([*wide.schema.fields, T.StructField("_out", T.ArrayType(_SPARK[kind]))])
    made = wide.mapInArrow(run, schema).select(*key, F.explode(F.arrays_zip("_x", "_y", "_idx", "_out")).alias("p"))
    return made.select(*key, F.col("p._x").alias("x"), F.col("p._y").alias("y"), F.col("p._idx").alias("idx"), F.col("p._out").alias(out))


def chamfer(other: np.ndarray) -> np.ndarray:
    """Of each pixel of a stack: 3 for a straight and 4 for a diagonal step to the nearest pixel that is set; infinite without any."""
    n, h, w = other.shape
    d = np.where(other, 0.0, np.inf)
    at = 3.0 * np.arange(w)

    def sideways(row: np.ndarray) -> np.ndarray:
        row = np.minimum.accumulate(row - at, axis=1) + at
        return (np.minimum.accumulate((row + at)[:, ::-1], axis=1))[:, ::-1] - at

    for order in (range(h), range(h - 1, -1, -1)):
        last = None
        for y in order:
            if last is not None:
                near = last + 3
                near[:, 1:] = np.minimum(near[:, 1:], last[:, :-1] + 4)
                near[:, :-1] = np.minimum(near[:, :-1], last[:, 1:] + 4)
                d[:, y] = np.minimum(d[:, y], near)
            d[:, y] = last = sideways(d[:, y])
    return d


def per_canvas(px: DataFrame, work: Callable[[np.ndarray], dict[str, np.ndarray]], columns: str, key=("asset",), value: str = "idx") -> DataFrame:
    """(keys, columns): ``work`` gets a stack and gives, by column, an array (canvas, row of the result); columns: ``name type, ...``.

    Rows of a result that are NaN in the last column are left out.
    """

    def rows(stack: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        made = work(stack)
        if not made:
            return np.zeros(0, dtype=int), made
        m = next(iter(made.values())).shape[1]
        flat = {n: v.reshape(-1) for n, v in made.items()}
        keep = ~np.isnan(flat[columns.split(",")[-1].split()[0]].astype(float))
        return np.repeat(np.arange(len(stack)), m)[keep], {n: v[keep] for n, v in flat.items()}

    return rows_of(px, rows, columns, key, value)


def rows_of(px: DataFrame, work: Callable[[np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], columns: str, key=("asset",), value: str = "idx") -> DataFrame:
    """(keys, columns): ``work`` gets a stack (NaN: no value) and gives the canvas of each row of the result, and the rows by column; columns: ``name type, ...``."""
    bounded(px)
    cell = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("v"))))
    wide = px.groupBy(*key).agg(cell.alias("c"))

    def field(name: str, as_: str):
        return F.transform("c", lambda cell: cell[name].cast(as_)).alias(f"_{name}")

    wide = wide.select(*key, field("x", "int"), field("y", "int"), field("v", "double"))
    kinds = dict(c.strip().rsplit(" ", 1) for c in columns.split(","))
    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, vs = ([np.asarray(a) for a in batch.column(f"_{c}").to_numpy(zero_copy_only=False)] for c in "xyv")
            sizes: dict[tuple[int, int], list[int]] = {}
            for i, (x, y) in enumerate(zip(xs, ys)):
                sizes.setdefault((int(y.max()) + 1, int(x.max()) + 1), []).append(i)
            for (h, w), rows in parts(sizes):
                stack = np.full((len(rows), h, w), np.nan)
                for j, i in enumerate(rows):
                    stack[j, ys[i], xs[i]] = vs[i]
                of, made = work(stack)
                if not len(of):
                    continue
                keys = [batch.column(k).take(pa.array(np.array(rows)[of])) for k in key]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(made[n].astype(arrow[t].to_pandas_dtype()), arrow[t]) for n, t in kinds.items())], names=[*key, *kinds])

    schema = T.StructType([*(wide.schema[k] for k in key), *T._parse_datatype_string(columns).fields])
    return wide.mapInArrow(run, schema)
