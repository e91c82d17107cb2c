"""Shading of flat shapes: normals of whole masks, lamps, hollows, ramps of lit, bounced and shadowed surfaces; directions shaded again.

Distances are above 0 inside, so normals point inward; the outward ones are their opposites.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.lineage import cut
from rasterlake.operators import canvas, compose, geometry


class Lamp(NamedTuple):
    """directional: the way that light goes (x, y); point: its place (x, y); segment: its ends ((x, y), (x, y)); area: a box (x, y, w, h); ambient: none."""

    kind: str
    at: tuple = ()
    intensity: float = 1.0


class Model(NamedTuple):
    """Ramps (palette indexes from dark to light) of lit, shadowed and bounced surfaces, and the entry of hidden ones."""

    key: list[int]
    shadow: list[int]
    bounce: list[int]
    occlusion: int


def normal_field(px: DataFrame, w: int, h: int, passes: int = 1, radius: int = 2, key=("asset",)) -> DataFrame:
    """(keys, x, y, nx, ny): unit gradients of the signed distance. On ridges those of the distance blurred up to ``passes``
    times count, else those of the nearest place that has one (ring by ring up to ``radius``, each from the upper left); null elsewhere.
    """
    d = geometry.signed_distance(px, w, h, key)
    out = geometry.normal_and_curvature(d, key).select(*key, "x", "y", F.when(F.col("nx").isNotNull(), F.struct("nx", "ny")).alias("n"))
    for i in range(passes):
        d = compose.box_blur(d, w, h, key=key)
        more = geometry.normal_and_curvature(d, key).select(*key, "x", "y", F.when(F.col("nx").isNotNull(), F.struct("nx", "ny")).alias("m"))
        out = out.join(more, [*key, "x", "y"]).select(*key, "x", "y", F.coalesce("n", "m").alias("n"))
    out = cut(out)
    ring = [(r, dy, dx) for r in range(1, radius + 1) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if max(abs(dx), abs(dy)) == r]
    if ring:
        offset = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (_, dy, dx) in enumerate(ring)]))
        lost = out.where("n is null").select(*key, F.col("x").alias("ox"), F.col("y").alias("oy"), offset.alias("o"))
        lost = lost.select(*key, "ox", "oy", "o.i", (F.col("ox") + F.col("o.dx")).alias("x"), (F.col("oy") + F.col("o.dy")).alias("y"))
        near = lost.join(out.where("n is not null"), [*key, "x", "y"]).groupBy(*key, F.col("ox").alias("x"), F.col("oy").alias("y")).agg(F.min_by("n", "i").alias("m"))
        out = out.join(near, [*key, "x", "y"], "left").select(*key, "x", "y", F.coalesce("n", "m").alias("n"))
    return out.select(*key, "x", "y", "n.nx", "n.ny")


def segment_light(x: Column, y: Column, nx: Column, ny: Column, a: tuple[float, float], b: tuple[float, float], intensity: float = 1.0) -> Column:
    """Illuminance at a place with an outward normal from a lamp along the segment a to b: the sines' difference of the angles under which its ends are seen, each held at the horizon (so a lamp behind with an end beyond each horizon counts from one to the other)."""
    def angle(p: tuple[float, float]) -> Column:
        dx, dy = p[0] - x, p[1] - y
        size = F.sqrt(dx * dx + dy * dy)
        seen = F.atan2(dy * nx - dx * ny, dx * nx + dy * ny)
        half = F.pi() / 2
        return F.when(size > 1e-6, F.greatest(-half, F.least(half, seen)))

    s, t = angle(a), angle(b)
    light = F.abs(F.sin(t) - F.sin(s)) * intensity
    return F.coalesce(light, F.lit(0.0))


def lit(px: DataFrame, normals: DataFrame, lamps: list[tuple[tuple[float, float], tuple[float, float], float]], steps: int, key=("asset",)) -> DataFrame:
    """(keys, x, y, light, step): of each opaque pixel the light of all lamps at its middle, and its place on a ramp; dark (step 0) where it has no normal."""
    j = px.where("idx <> 0").select(*key, "x", "y").join(normals, [*key, "x", "y"])
    at = (F.col("x") + 0.5, F.col("y") + 0.5, -F.col("nx"), -F.col("ny"))
    light = sum((segment_light(*at, a, b, i) for a, b, i in lamps), F.lit(0.0))
    light = F.coalesce(F.when(F.col("nx").isNotNull(), F.round(light, 9)), F.lit(0.0))
    return j.select(*key, "x", "y", light.alias("light")).withColumn("step", compose.ramp_index(F.least(F.col("light"), F.lit(1.0)), steps).cast("int"))


def hollows(px: DataFrame, w: int, h: int, passes: int = 2, key=("asset",)) -> DataFrame:
    """(keys, x, y, curvature): curvature of the blurred distance of the mask with its edge carried on by ``passes`` + 1 pixels, so that the canvas's edge makes no hollow. Below 0: a hollow."""
    m = passes + 1

    def spread(c: str, n: int) -> str:
        return f"explode(sequence({c} - CASE WHEN {c} = 0 THEN {m} ELSE 0 END, {c} + CASE WHEN {c} = {n - 1} THEN {m} ELSE 0 END)) AS p{c}"

    wide = px.selectExpr(*key, "idx", "y", spread("x", w)).selectExpr(*key, "idx", "px", spread("y", h))
    padded = wide.select(*key, (F.col("px") + m).alias("x"), (F.col("py") + m).alias("y"), "idx")
    d = geometry.signed_distance(padded, w + 2 * m, h + 2 * m, key)
    for _ in range(passes):
        d = compose.box_blur(d, w + 2 * m, h + 2 * m, key=key)
    k = geometry.normal_and_curvature(d, key).withColumns({"x": F.col("x") - m, "y": F.col("y") - m})
    return k.where((F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h)).select(*key, "x", "y", "curvature")


def incidence(lamp: Lamp, x: Column, y: Column, nx: Column, ny: Column) -> tuple[Column, Column]:
    """(cosine between an outward normal and the way to the lamp, illuminance); null for ambient light and at the lamp's own place."""
    none = F.lit(None).cast("double")
    if lamp.kind == "ambient":
        return none, none
    if lamp.kind == "directional":
        size = (lamp.at[0] ** 2 + lamp.at[1] ** 2) ** 0.5
        cos = F.round(nx * (-lamp.at[0] / size) + ny * (-lamp.at[1] / size), 9) if size else none
        return cos, cos
    if lamp.kind == "point":
        middle = lamp.at
    elif lamp.kind == "segment":
        middle = tuple((p + q) / 2 for p, q in zip(*lamp.at))
    elif lamp.kind == "area":
        middle = (lamp.at[0] + lamp.at[2] / 2, lamp.at[1] + lamp.at[3] / 2)
    else:
        raise ValueError(f"no lamp of kind {lamp.kind}")
    dx, dy = middle[0] - x, middle[1] - y
    square = dx * dx + dy * dy
    cos = F.when(square > 1e-12, F.round((nx * dx + ny * dy) / F.sqrt(square), 9))
    if lamp.kind == "point":
        return cos, F.when(cos > 0, F.lit(lamp.intensity) / square).otherwise(0.0)
    edges = [lamp.at]
    if lamp.kind == "area":
        x0, y0, w, h = lamp.at
        edges = [((x0, y0 + d), (x0 + w, y0 + d)) for d in (0, h)]
    light = [segment_light(x, y, nx, ny, a, b, lamp.intensity) for a, b in edges]
    return cos, light[0] if len(light) == 1 else F.greatest(*light)


def _entry(ramp: list[int], t: Column, none: int) -> Column:
    """A ramp's entry at t (0 to 1); the last one only at its end."""
    if not ramp:
        return F.lit(none)
    at = F.when(t >= 1 - 1e-5, F.lit(len(ramp) - 1)).otherwise(F.floor(F.round(t * (len(ramp) - 1), 9)).cast("int"))
    return F.element_at(F.array(*map(F.lit, ramp)), F.greatest(F.least(at, F.lit(len(ramp) - 1)), F.lit(0)).cast("int") + 1)


def shaded(px: DataFrame, w: int, h: int, lamp: Lamp, model: Model, reach: int = 2, passes: int = 1, radius: int = 2, hollow: float | None = None, hollow_passes: int = 3, clear: int = 0, key=("asset",)) -> DataFrame:
    """(keys, x, y, idx): each canvas's mask shaded; places outside it are ``clear``.

    Turned to the lamp: the lit ramp, by cosine (directional) or illuminance. Turned away: the bounced ramp within ``reach``
    pixels above the mask's lower edge, the nearer the lighter, else the shadowed one, lighter towards the light's edge.
    Ambient light gives the shadowed ramp's middle. Places without a normal, and hollows bent more than ``hollow``
    (None: not looked for), take the hidden entry.
    """
    at = [*key, "x", "y"]
    n = normal_field(px, w, h, passes, radius, key).select(*at, (-F.col("nx")).alias("nx"), (-F.col("ny")).alias("ny"))
    j = px.where("idx <> 0").select(*at).join(n, at)
    if reach:
        j = j.join(compose.bounce_distance(px, reach, key), at)
    else:
        j = j.withColumn("bounce", F.lit(None).cast("int"))
    cos, light = incidence(lamp, F.col("x") + 0.5, F.col("y") + 0.5, F.col("nx"), F.col("ny"))
    j = j.withColumns({"cos": cos, "light": light})
    lit_, bounced = F.least(F.col("light"), F.lit(1.0)), 1 - F.col("bounce") / max(reach, 1)
    dark = _entry(model.shadow, F.when(F.col("cos").isNull(), 0.5).otherwise(1 + F.col("cos")), model.occlusion)
    made = F.when(F.col("nx").isNull(), F.lit(model.occlusion)).when(F.col("cos") > 0, _entry(model.key, lit_, model.occlusion))
    made = made.when(F.col("cos").isNotNull() & F.col("bounce").isNotNull(), _entry(model.bounce, bounced, model.occlusion)).otherwise(dark)
    j = j.select(*at, made.cast("int").alias("made"))
    if hollow is not None:
        deep = hollows(px, w, h, hollow_passes, key).where(F.col("curvature") < -hollow).select(*at, F.lit(True).alias("deep"))
        j = j.join(deep, at, "left").select(*at, F.when(F.col("deep"), F.lit(model.occlusion)).otherwise(F.col("made")).alias("made"))
    return px.select(*at).join(j, at, "left").select(*at, F.coalesce("made", F.lit(clear)).cast("int").alias("idx"))


def reshaded(px: DataFrame, w: int, h: int, lamp: Lamp, model: Model, key=("asset",), **more) -> DataFrame:
    """(keys, x, y, idx): canvases mirrored left to right and shaded again under the lamp, which isn't mirrored; more: ``shaded``'s."""
    return shaded(canvas.mirror(px, w), w, h, lamp, model, key=key, **more)


def reshaded_share(px: DataFrame, made: DataFrame, w: int, before: DataFrame, after: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, share): opaque pixels of mirrored canvases whose colours the shading changed; before, after: palettes (idx, r, g, b) of ``px`` and ``made``."""
    at = [*key, "x", "y"]
    colour = lambda df, pal, name: df.join(F.broadcast(pal), "idx", "left").select(*at, F.struct("r", "g", "b").alias(name))  # noqa: E731  256 rows
    old = colour(canvas.mirror(px, w).where("idx <> 0"), before, "old")
    return old.join(colour(made, after, "new"), at).groupBy(*key).agg(F.avg((F.col("old") != F.col("new")).cast("int")).alias("share"))


def expanded(px: DataFrame, w: int, key=("asset",)) -> DataFrame:
    """(keys, direction, x, y, idx, source): drawn directions (source null) and those that mirroring a drawn one adds; none that was drawn is replaced."""
    pair = F.create_map(*[F.lit(v) for kv in compose.MIRRORED.items() for v in kv])
    drawn = px.select(*key, "direction").distinct()
    lack = drawn.select(*key, F.element_at(pair, F.col("direction")).alias("target"), F.col("direction").alias("source")).where("target is not null")
    lack = lack.join(drawn.withColumnRenamed("direction", "target"), [*key, "target"], "left_anti")
    made = px.withColumnRenamed("direction", "source").join(lack, [*key, "source"])
    made = canvas.mirror(made, w).select(*key, F.col("target").alias("direction"), "x", "y", "idx", "source")
    return px.select(*key, "direction", "x", "y", "idx", F.lit(None).cast("string").alias("source")).unionByName(made)


def mirror_is_checkable(lamp: Lamp, least: float = 0.55) -> bool:
    """Whether a mirrored picture's shading can be told from one under the lamp: a directional lamp far enough from the vertical for an agreement below ``least``."""
    if lamp.kind != "directional" or not any(lamp.at):
        return False
    return lamp.at[0] ** 2 / (lamp.at[0] ** 2 + lamp.at[1] ** 2) > (1 - least) / 2
