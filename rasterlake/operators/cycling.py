"""Frames made from one by a wave: along a ramp, by moving, or by growing and shrinking.

Noise comes from a mixing of 64 bits that is the same on every engine: sums and products wrap, in numpy for
whole batches; ``plus`` and ``times`` do so by columns, in limbs of 16 bits, so that none overflows a long.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rasterlake.operators import color

#: The published constants of SplitMix64.
STEP, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_LIMB = 0xFFFF


def _limb(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(_LIMB))


def _joined(limbs: list[Column]) -> Column:
    """A long of four sums of limbs, with carries; what is beyond 64 bits is lost."""
    out, carry = None, F.lit(0)
    for i, c in enumerate(limbs):
        total = c + carry
        low = F.shiftleft(total.bitwiseAND(F.lit(_LIMB)), 16 * i)
        out, carry = low if out is None else out.bitwiseOR(low), F.shiftrightunsigned(total, 16)
    return out


def plus(x: Column, y: Column) -> Column:
    """x + y modulo 2 ** 64."""
    return _joined([_limb(x, i) + _limb(y, i) for i in range(4)])


def times(x: Column, by: int) -> Column:
    """x * by modulo 2 ** 64."""
    return _joined([reduce(lambda a, b: a + b, (_limb(x, i) * F.lit(by >> 16 * (k - i) & _LIMB) for i in range(k + 1))) for k in range(4)])


@F.arrow_udf(LongType())
def _mix(seed: pa.Array, k: pa.Array) -> pa.Array:
    none = pc.or_(seed.is_null(), k.is_null()).to_numpy(zero_copy_only=False)
    x, y = (np.asarray(v.fill_null(0)).astype(np.int64).view(np.uint64) for v in (seed, k))
    z = x + y * np.uint64(STEP) + np.uint64(STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
    return pa.array((z ^ (z >> np.uint64(31))).view(np.int64), pa.int64(), mask=none)


def mixed(seed: Column, k: Column) -> Column:
    """64 mixed bits (as a long) for a seed and a place."""
    return _mix(seed.cast("long"), k.cast("long"))


def wave(kind: str, k: Column, n: int, phase: float = 0.0, seed: Column | None = None) -> Column:
    """A value in -1..1 at frame k of n, repeating after n: sine, square, noise or random-blink (both by seed)."""
    if kind in ("sine", "square"):
        turn = k / F.lit(float(max(n, 1))) + phase
        return F.sin(2 * F.pi() * turn) if kind == "sine" else F.when(turn - F.floor(turn) < 0.5, 1.0).otherwise(-1.0)
    at = F.pmod(k + F.floor(F.lit(phase * n + 0.5)), F.lit(max(n, 1)))
    bits = mixed(seed if seed is not None else F.lit(0), at)
    if kind == "noise":
        return F.shiftrightunsigned(bits, 40).cast("double") / float(1 << 24) * 2 - 1
    if kind == "random-blink":
        return F.when(bits.bitwiseAND(F.lit(1)) == 0, -1.0).otherwise(1.0)
    raise ValueError(f"no wave {kind!r}")


def steps(canvases: DataFrame, kind: str, n: int, amplitude: float, phase: float = 0.0, seed: str | None = None, key=("asset",)) -> DataFrame:
    """(keys, frame, value, step): for each canvas the wave at n frames, and its whole steps (halves away from 0)."""
    if n < 2:
        raise ValueError("a cycle has two frames or more")
    f = canvases.select(*key, *([seed] if seed and seed not in key else [])).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    value = wave(kind, F.col("frame"), n, phase, F.col(seed) if seed else None)
    by = F.col("value") * amplitude
    return f.withColumn("value", value).select(*key, "frame", "value", (F.signum(by) * F.floor(F.abs(by) + 0.5)).cast("int").alias("step"))


def _grown(px: DataFrame, up: bool, key) -> DataFrame:
    """One step: clear pixels take the first opaque neighbour (right, left, below, above), or opaque ones beside a clear place or the edge clear."""
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate([(-1, 0), (1, 0), (0, -1), (0, 1)])]))
    beside = px.where("idx <> 0").select(*key, "x", "y", "idx", sides.alias("s")).select(*key, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.struct("s.i", "idx").alias("v"))
    near = beside.groupBy(*key, "x", "y").agg(F.min("v").alias("v"), F.count("*").alias("n"))
    j = px.join(near, [*key, "x", "y"], "left")
    new = F.when((F.col("idx") == 0) & F.col("v").isNotNull(), F.col("v.idx")) if up else F.when((F.col("idx") != 0) & (F.coalesce("n", F.lit(0)) < 4), F.lit(0))
    return j.withColumn("idx", F.coalesce(new, F.col("idx")).cast("int")).drop("v", "n")


def grow(px: DataFrame, step: str, most: int, key=("asset",)) -> DataFrame:
    """Canvases grown (step above 0) or shrunk as often as their column ``step`` says, ``most`` times at most."""
    for i in range(most):
        parts = [px.where(F.abs(F.coalesce(F.col(step), F.lit(0))) <= i), _grown(px.where(F.col(step) > i), True, key), _grown(px.where(F.col(step) < -i), False, key)]
        columns = px.columns
        px = parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))
    return px


def cycle(px: DataFrame, told: DataFrame, target: str, most: int, ramp: list[int] | None = None, direction: tuple[int, int] = (1, 0), key=("asset",)) -> DataFrame:
    """(keys, frame, x, y, idx): each canvas at each frame of ``told`` (from ``steps``), moved on a ramp ("ramp"), by a direction ("offset") or grown ("mask").

    most: bound of the steps (the amplitude). Pixels that come from beyond the canvas are clear.
    """
    j = px.join(told.select(*key, "frame", "step"), list(key))
    own = (*key, "frame")
    if target == "ramp":
        if not ramp or len(ramp) < 2:
            raise ValueError("a ramp has two entries or more")
        out = None
        for d in range(-most, most + 1):
            part = color.ramp_step(j.where(F.col("step") == d), ramp, d)
            out = part if out is None else out.unionByName(part)
        return out.select(*own, "x", "y", "idx")
    if target == "offset":
        at = [(F.col(c) + F.col("step") * d).alias(c) for c, d in zip("xy", direction)]
        moved = j.select(*own, *at, F.col("idx").alias("_v"))
        return j.select(*own, "x", "y").join(moved, [*own, "x", "y"], "left").select(*own, "x", "y", F.coalesce("_v", F.lit(0)).alias("idx"))
    if target == "mask":
        return grow(j, "step", most, own).select(*own, "x", "y", "idx")
    raise ValueError(f"no target {target!r}")
