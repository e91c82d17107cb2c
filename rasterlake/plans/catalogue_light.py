"""Queries of normal fields, light from segments, and hollows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake import views
from rasterlake.operators import lighting
from rasterlake.registry import query
from rasterlake.views import canvases, palette

S = views.SQL
LAMPS = [((-4.0, -6.0), (12.0, -6.0), 0.7), ((-5.0, 2.0), (-5.0, 4.0), 0.4)]
RADIUS = 2


def _signless(df: DataFrame, *columns: str) -> DataFrame:
    """Zeros without a sign, which sums in another order may give."""
    return df.withColumns({c: F.when(F.abs(c) < 1e-9, 0.0).otherwise(F.col(c)) for c in columns})


def _zero(c: str) -> str:
    return f"CASE WHEN abs({c}) < 1e-9 THEN 0 ELSE {c} END AS {c}"


def _blur(t: str, n: int) -> str:
    return f"SELECT c.asset, c.x, c.y, sum(s.d) / 9 AS d FROM {t} c, (VALUES (-1), (0), (1)) p(dx), (VALUES (-1), (0), (1)) q(dy), {t} s WHERE s.asset = c.asset AND s.x = least(greatest(c.x + dx, 0), {n - 1}) AND s.y = least(greatest(c.y + dy, 0), {n - 1}) GROUP BY ALL"


def _slope(t: str) -> str:
    side = ", ".join(f"coalesce({f}(d) OVER {w}, d) AS {n}" for f, w, n in (("lag", "r", "lf"), ("lead", "r", "rt"), ("lag", "c", "up"), ("lead", "c", "dn")))
    return f"SELECT asset, x, y, CASE WHEN n > 1e-6 THEN gx / n END AS nx, CASE WHEN n > 1e-6 THEN gy / n END AS ny, curvature FROM (SELECT *, sqrt(gx * gx + gy * gy) AS n FROM (SELECT asset, x, y, (rt - lf) / 2 AS gx, (dn - up) / 2 AS gy, 4 * d - lf - rt - up - dn AS curvature FROM (SELECT asset, x, y, d, {side} FROM {t} WINDOW r AS (PARTITION BY asset, y ORDER BY x), c AS (PARTITION BY asset, x ORDER BY y))))"


S["soft"] = _blur("signed", 8)
S["slopes"], S["soft_slopes"] = _slope("signed"), _slope("soft")
S["settled"] = "SELECT a.asset, a.x, a.y, CASE WHEN a.nx IS NULL THEN b.nx ELSE a.nx END AS nx, CASE WHEN a.nx IS NULL THEN b.ny ELSE a.ny END AS ny FROM slopes a JOIN soft_slopes b USING (asset, x, y)"
_RING = f"SELECT a.asset, a.x, a.y, b.nx, b.ny FROM settled a JOIN settled b ON b.asset = a.asset AND b.nx IS NOT NULL AND abs(b.x - a.x) <= {RADIUS} AND abs(b.y - a.y) <= {RADIUS} WHERE a.nx IS NULL QUALIFY row_number() OVER (PARTITION BY a.asset, a.x, a.y ORDER BY greatest(abs(b.x - a.x), abs(b.y - a.y)), b.y, b.x) = 1"
S["normals"] = f"SELECT s.asset, s.x, s.y, coalesce(s.nx, r.nx) AS nx, coalesce(s.ny, r.ny) AS ny FROM settled s LEFT JOIN ({_RING}) r USING (asset, x, y)"
_NORMALS = "canvases signed soft slopes soft_slopes settled normals"


@query("normal_field", "asset:long x:long y:long nx:double ny:double", f"SELECT asset, x, y, {_zero('nx')}, {_zero('ny')} FROM normals", _NORMALS)
def _(s, d):
    return _signless(lighting.normal_field(canvases(s, d), 8, 8, 1, RADIUS), "nx", "ny")


def _seen(p: tuple[float, float]) -> str:
    dx, dy = f"({p[0]} - x - 0.5)", f"({p[1]} - y - 0.5)"
    return f"greatest(-pi() / 2, least(pi() / 2, atan2({dy} * -nx - {dx} * -ny, {dx} * -nx + {dy} * -ny)))"


_LIGHT = " + ".join(f"{i} * abs(sin({_seen(b)}) - sin({_seen(a)}))" for a, b, i in LAMPS)
S["lights"] = f"SELECT asset, x, y, coalesce(round({_LIGHT}, 9), 0) AS light FROM canvases JOIN normals USING (asset, x, y) WHERE idx <> 0"


@query("lamp_light", "asset:long x:long y:long light:double step:long", "SELECT *, least(floor(least(light, 1) * 4 + 1e-9), 4) AS step FROM lights", f"{_NORMALS} lights")
def _(s, d):
    px = canvases(s, d)
    return lighting.lit(px, lighting.normal_field(px, 8, 8, 1, RADIUS), LAMPS, 5)


S["padded"] = "SELECT c.asset, p.x AS x, q.y AS y, c.idx FROM canvases c, range(14) p(x), range(14) q(y) WHERE c.x = least(greatest(p.x - 3, 0), 7) AND c.y = least(greatest(q.y - 3, 0), 7)"
S["far"] = "SELECT m.asset, m.x, m.y, (CASE WHEN m.idx <> 0 THEN 1 ELSE -1 END) * least(coalesce(min(3 * greatest(abs(m.x - o.x), abs(m.y - o.y)) + least(abs(m.x - o.x), abs(m.y - o.y))), 99), 3 * least(m.x + 1, m.y + 1, 14 - m.x, 14 - m.y)) / 3.0 AS d FROM padded m LEFT JOIN padded o ON o.asset = m.asset AND (o.idx <> 0) <> (m.idx <> 0) GROUP BY m.asset, m.x, m.y, m.idx"
S["far_soft"], S["far_softer"] = _blur("far", 14), _blur("far_soft", 14)
_HOLLOW = f"SELECT asset, x - 3 AS x, y - 3 AS y, {_zero('curvature')} FROM ({_slope('far_softer')}) WHERE x BETWEEN 3 AND 10 AND y BETWEEN 3 AND 10"


@query("hollows", "asset:long x:long y:long curvature:double", _HOLLOW, "canvases padded far far_soft far_softer")
def _(s, d):
    return _signless(lighting.hollows(canvases(s, d), 8, 8, 2), "curvature")


# Shading -------------------------------------------------------------------------------------------
MODEL = lighting.Model([9, 10, 7], [1, 5, 13, 12], [2, 4], 3)
SUN, POINT, BOX = lighting.Lamp("directional", (0.6, 0.8)), lighting.Lamp("point", (3.0, -2.0), 12.0), lighting.Lamp("area", (-4.0, -6.0, 16.0, 2.0), 0.6)
HOLLOW = 0.25
_PX, _PY = "(x + 0.5)", "(y + 0.5)"


def _ramp(ramp: list[int], t: str) -> str:
    return f"{ramp}[1 + CASE WHEN {t} >= 1 - 1e-5 THEN {len(ramp) - 1} ELSE greatest(0, least(CAST(floor(round(({t}) * {len(ramp) - 1}, 9)) AS INTEGER), {len(ramp) - 1})) END]"


def _shaded(cos: str, light: str, hollow: str = "", p: str = "") -> str:
    below = f"SELECT m.asset, m.x, m.y, min(k) - 1 AS bounce FROM {p}canvases m, (VALUES (1), (2)) t(k) WHERE m.idx <> 0 AND NOT EXISTS (SELECT 1 FROM {p}canvases b WHERE b.asset = m.asset AND b.x = m.x AND b.y = m.y + k AND b.idx <> 0) GROUP BY ALL"
    made = f"CASE WHEN nx IS NULL THEN {MODEL.occlusion} {hollow} WHEN cos > 0 THEN {_ramp(MODEL.key, 'least(light, 1)')} WHEN cos IS NOT NULL AND bounce IS NOT NULL THEN {_ramp(MODEL.bounce, '1 - bounce / 2')} ELSE {_ramp(MODEL.shadow, 'coalesce(1 + cos, 0.5)')} END"
    bent = f"LEFT JOIN ({_HOLLOW}) h USING (asset, x, y)" if hollow else ""
    return f"SELECT asset, x, y, CASE WHEN idx = 0 THEN 0 ELSE {made} END AS idx FROM (SELECT *, {light} AS light FROM (SELECT *, {cos} AS cos FROM {p}canvases JOIN {p}normals USING (asset, x, y))) LEFT JOIN ({below}) b USING (asset, x, y) {bent}"


_SUN = f"round(nx * {SUN.at[0]} + ny * {SUN.at[1]}, 9)"


def _way(x: float, y: float) -> str:
    return f"round(-(nx * ({x} - {_PX}) + ny * ({y} - {_PY})) / sqrt(({x} - {_PX}) * ({x} - {_PX}) + ({y} - {_PY}) * ({y} - {_PY})), 9)"


@query("shaded_sun", "asset:long x:long y:long idx:long", _shaded(_SUN, "cos", f"WHEN curvature < -{HOLLOW} THEN {MODEL.occlusion}"), f"{_NORMALS} padded far far_soft far_softer")
def _(s, d):
    return lighting.shaded(canvases(s, d), 8, 8, SUN, MODEL, hollow=HOLLOW, hollow_passes=2)


_FALL = f"CASE WHEN cos > 0 THEN {POINT.intensity} / (({POINT.at[0]} - {_PX}) ** 2 + ({POINT.at[1]} - {_PY}) ** 2) ELSE 0 END"


@query("shaded_point", "asset:long x:long y:long idx:long", _shaded(_way(*POINT.at), _FALL), _NORMALS)
def _(s, d):
    return lighting.shaded(canvases(s, d), 8, 8, POINT, MODEL)


_EDGES = ", ".join(f"coalesce({BOX.intensity} * abs(sin({_seen((BOX.at[0] + BOX.at[2], y))}) - sin({_seen((BOX.at[0], y))})), 0)" for y in (BOX.at[1], BOX.at[1] + BOX.at[3]))


@query("shaded_area", "asset:long x:long y:long idx:long", _shaded(_way(BOX.at[0] + BOX.at[2] / 2, BOX.at[1] + BOX.at[3] / 2), f"greatest({_EDGES})"), _NORMALS)
def _(s, d):
    return lighting.shaded(canvases(s, d), 8, 8, BOX, MODEL)


@query("shaded_ambient", "asset:long x:long y:long idx:long", _shaded("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"), _NORMALS)
def _(s, d):
    return lighting.shaded(canvases(s, d), 8, 8, lighting.Lamp("ambient"), MODEL)


# Directions ----------------------------------------------------------------------------------------
_CHAIN = _NORMALS.split()[1:]
S["m_canvases"] = "SELECT asset, 7 - x AS x, y, idx FROM canvases"
for _v in _CHAIN:
    S[f"m_{_v}"] = re.sub(rf"\b({'|'.join(['canvases', *_CHAIN])})\b", r"m_\1", S[_v])
_MIRRORED = " ".join(["canvases", "m_canvases", *(f"m_{v}" for v in _CHAIN)])
S["again"] = _shaded(_SUN, "cos", p="m_")


@query("reshaded", "asset:long x:long y:long idx:long", "SELECT * FROM again", f"{_MIRRORED} again")
def _(s, d):
    return lighting.reshaded(canvases(s, d), 8, 8, SUN, MODEL)


@query("reshaded_share", "asset:long share:double", "SELECT asset, avg(CAST(a.idx <> m.idx AS INTEGER)) AS share FROM m_canvases m JOIN again a USING (asset, x, y) WHERE m.idx <> 0 GROUP BY asset", f"{_MIRRORED} again")
def _(s, d):
    px, pal = canvases(s, d), palette(s)
    return lighting.reshaded_share(px, lighting.reshaded(px, 8, 8, SUN, MODEL), 8, pal, pal)


#: Three canvases make an actor; each one's number stands for the direction it was drawn in.
S["drawn"] = "SELECT asset // 3 AS actor, ['n', 'ne', 'e', 'se', 's', 'sw', 'w', 'nw'][1 + asset * 5 % 8] AS direction, x, y, idx FROM canvases"
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in lighting.compose.MIRRORED.items())


@query("expanded_directions", "actor:long direction:string x:long y:long idx:long source:string", f"SELECT *, NULL AS source FROM drawn UNION ALL SELECT actor, m.b AS direction, 7 - x, y, idx, m.a FROM drawn d JOIN (VALUES {_PAIRS}) m(a, b) ON m.a = d.direction WHERE NOT EXISTS (SELECT 1 FROM drawn o WHERE o.actor = d.actor AND o.direction = m.b)", "canvases drawn")
def _(s, d):
    names = F.array(*map(F.lit, lighting.compose.DIRECTIONS))
    px = canvases(s, d).select(F.expr("asset div 3").alias("actor"), F.element_at(names, (F.col("asset") * 5 % 8 + 1).cast("int")).alias("direction"), "x", "y", "idx")
    return lighting.expanded(px, 8, ("actor",))
