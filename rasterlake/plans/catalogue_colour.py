"""Queries that measure pictures by their colours: candidates of cell sizes, gates, estimates, conformed pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake import views
from rasterlake.operators import color, colour_grid, new_palette
from rasterlake.registry import query
from rasterlake.views import enlarged, tinted

GATES = colour_grid.Gates(largest=6)
_G = GATES
S = views.SQL
S["psize"] = "SELECT asset, max(x) + 1 AS w, max(y) + 1 AS h, (sum(r * r + g * g + b * b) / count(*) - pow(sum(r) / count(*), 2) - pow(sum(g) / count(*), 2) - pow(sum(b) / count(*), 2)) / 65025 AS iv FROM enlarged GROUP BY 1"
_VAR = "(sum(r * r + g * g + b * b) / count(*) - pow(sum(r) / count(*), 2) - pow(sum(g) / count(*), 2) - pow(sum(b) / count(*), 2)) / 65025"
S["gcells"] = (
    f"SELECT asset, s, dx, dy, dx + s * ((x - dx) // s) AS cx, dy + s * ((y - dy) // s) AS cy, greatest({_VAR}, 0) AS v FROM enlarged, range(2, {_G.largest + 1}) a(s), range({_G.largest}) b(dx), range({_G.largest}) c(dy) "
    "WHERE dx < s AND dy < s AND x >= dx AND y >= dy GROUP BY ALL HAVING count(*) = s * s"
)
S["gphase"] = "SELECT asset, s, dx, dy, round(avg(v), 9) AS v FROM gcells GROUP BY ALL"
S["gbest"] = "SELECT asset, s, dx, dy, v FROM (SELECT *, row_number() OVER (PARTITION BY asset, s ORDER BY v, dy, dx) AS k FROM gphase) WHERE k = 1"


def _line(axis: str, other: str, side: str) -> str:
    """Phase curves of the bands along an axis, through the best phase of the other."""
    return (
        f"SELECT asset, s, n, band, p, round(avg(v), 9) AS v FROM (SELECT c.asset, c.s, m.n, d.band, c.d{axis} AS p, c.v FROM gcells c JOIN gbest g ON g.asset = c.asset AND g.s = c.s AND g.d{other} = c.d{other} JOIN psize z ON z.asset = c.asset, (SELECT unnest([2, 3, 4]) AS n) m, range(4) d(band) "
        f"WHERE band < n AND c.c{axis} >= z.{side} * band // n AND c.c{axis} + c.s <= z.{side} * (band + 1) // n) GROUP BY ALL"
    )


S["bandsx"], S["bandsy"] = _line("x", "y", "w"), _line("y", "x", "h")
_COUNT = "SELECT asset, s, n FROM {b} GROUP BY ALL HAVING count(DISTINCT band) = n"
S["bandn"] = (
    f"SELECT asset, s, max(n) AS n FROM gbest JOIN psize USING (asset) JOIN ({_COUNT.format(b='bandsx')}) USING (asset, s) JOIN ({_COUNT.format(b='bandsy')}) USING (asset, s, n) WHERE (w - dx) // s >= {_G.cells} * n AND (h - dy) // s >= {_G.cells} * n GROUP BY ALL"
)


def _axis(b: str) -> str:
    bottom = f"SELECT asset, s, band, min(p) AS p FROM (SELECT *, min(v) OVER (PARTITION BY asset, s, band) AS m FROM {b} JOIN bandn USING (asset, s, n)) WHERE v = m GROUP BY ALL"
    far = f"SELECT a.asset, a.s, max(least(abs(a.p - b.p), a.s - abs(a.p - b.p))) AS drift FROM ({bottom}) a JOIN ({bottom}) b USING (asset, s) GROUP BY ALL"
    whole = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY asset, s, band) AS c FROM {b} JOIN bandn USING (asset, s, n)) WHERE c = s"
    apart = f"SELECT asset, s, sum(m) AS apart, count(*) AS bands FROM (SELECT asset, s, band, min(v) AS m FROM ({whole}) GROUP BY ALL) GROUP BY ALL"
    loss = f"SELECT asset, s, CASE WHEN bands >= 2 AND level - apart > 1.1920929e-07 THEN (joint - apart) / (level - apart) END AS loss FROM (SELECT asset, s, min(v) AS joint, avg(v) AS level FROM (SELECT asset, s, p, sum(v) AS v FROM ({whole}) GROUP BY ALL) GROUP BY ALL) JOIN ({apart}) USING (asset, s)"
    return f"SELECT asset, s, drift, loss FROM ({far}) LEFT JOIN ({loss}) USING (asset, s)"


S["axisx"], S["axisy"] = _axis("bandsx"), _axis("bandsy")
_RATIO = "CASE WHEN g.v > 1.1920929e-07 THEN {o}.v / g.v WHEN {o}.v > 1.1920929e-07 THEN 1e6 ELSE 1.0 END"
S["gates"] = (
    f"SELECT g.asset, g.s, g.dx, g.dy, g.v, greatest(ax.drift, ay.drift) AS drift, CASE WHEN ax.loss IS NULL THEN ay.loss WHEN ay.loss IS NULL THEN ax.loss ELSE (ax.loss + ay.loss) / 2 END AS loss, ({_RATIO.format(o='ox')} + {_RATIO.format(o='oy')}) / 2 AS contrast FROM gbest g LEFT JOIN axisx ax USING (asset, s) LEFT JOIN axisy ay USING (asset, s) "
    "JOIN gphase ox ON ox.asset = g.asset AND ox.s = g.s AND ox.dy = g.dy AND ox.dx = (g.dx + g.s // 2) % g.s JOIN gphase oy ON oy.asset = g.asset AND oy.s = g.s AND oy.dx = g.dx AND oy.dy = (g.dy + g.s // 2) % g.s"
)
_SIDES = "(SELECT asset, 0 AS axis, x AS i, y AS j, r, g, b FROM enlarged UNION ALL SELECT asset, 1, y, x, r, g, b FROM enlarged)"
_E2 = " + ".join(f"abs(lead({c}) OVER w - 2 * {c} + lag({c}) OVER w)" for c in "rgb")
S["bends"] = f"SELECT asset, axis, i, sum(e) AS e FROM (SELECT asset, axis, i, {_E2} AS e FROM {_SIDES} WINDOW w AS (PARTITION BY asset, axis, j ORDER BY i)) WHERE e IS NOT NULL GROUP BY ALL"
S["crests"] = (
    f"SELECT a.asset, a.axis, s, a.i, a.i + coalesce(CASE WHEN l.e - 2 * a.e + r.e < 0 THEN greatest(-0.5, least(0.5, 0.5 * (l.e - r.e) / (l.e - 2 * a.e + r.e))) END, 0) AS place FROM (SELECT *, avg(e) OVER (PARTITION BY asset, axis) AS mean FROM bends) a LEFT JOIN bends l ON l.asset = a.asset AND l.axis = a.axis AND l.i = a.i - 1 LEFT JOIN bends r ON r.asset = a.asset AND r.axis = a.axis AND r.i = a.i + 1, range(2, {_G.largest + 1}) z(s) "
    f"WHERE a.e > {_G.floor} * mean AND NOT EXISTS (SELECT 1 FROM bends o WHERE o.asset = a.asset AND o.axis = a.axis AND o.i <> a.i AND abs(o.i - a.i) <= greatest(1, floor(s * {_G.suppression} + 0.5)) AND (o.e > a.e OR (o.e = a.e AND o.i < a.i)))"
)
S["lines"] = (
    "SELECT asset, axis, s, count(*) AS n, regr_slope(place, k) AS spacing, sqrt(greatest(regr_syy(place, k) - regr_sxy(place, k) * regr_sxy(place, k) / regr_sxx(place, k), 0) / count(*)) AS rms FROM (SELECT *, sum(st) OVER (PARTITION BY asset, axis, s ORDER BY place ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, coalesce(greatest(1, floor((place - lag(place) OVER (PARTITION BY asset, axis, s ORDER BY place)) / s + 0.5)), 0) AS st FROM crests)) GROUP BY ALL HAVING count(*) >= 3"
)
S["fits"] = f"SELECT asset, s FROM lines WHERE n >= {_G.peaks} AND abs(spacing / s - 1) <= {_G.slope} AND rms / s <= {_G.residual} GROUP BY ALL HAVING count(*) = 2"
S["steady"] = f"SELECT * FROM gates JOIN psize USING (asset) WHERE v <= {_G.epsilon} * iv AND loss <= {_G.agreement} AND contrast >= {_G.contrast} AND (drift <= {_G.drift} * s OR (asset, s) IN (SELECT (asset, s) FROM fits))"
S["gpix"] = "SELECT *, round(avg(r) OVER c) AS mr, round(avg(g) OVER c) AS mg, round(avg(b) OVER c) AS mb FROM (SELECT asset, s, r, g, b, floor((x - dx) / s) AS cx, floor((y - dy) / s) AS cy, w, h, dx, dy FROM enlarged JOIN steady USING (asset)) WHERE cx >= 0 AND cy >= 0 AND dx + (cx + 1) * s <= w AND dy + (cy + 1) * s <= h WINDOW c AS (PARTITION BY asset, s, cx, cy)"
S["gtone"] = color.oklab_sql("(SELECT r, g, b FROM enlarged UNION SELECT mr, mg, mb FROM gpix)")
S["grate"] = f"SELECT asset, s, avg(CAST(sqrt(pow(p.l - m.l, 2) + pow(p.a_ - m.a_, 2) + pow(p.b_ - m.b_, 2)) > {_G.delta} AS INTEGER)) AS rate FROM gpix x JOIN gtone p ON p.r = x.r AND p.g = x.g AND p.b = x.b JOIN gtone m ON m.r = mr AND m.g = mg AND m.b = mb GROUP BY ALL"
S["judged"] = f"SELECT a.*, rate, coalesce(rate <= {_G.tau}, false) AS accepted FROM gates a LEFT JOIN grate USING (asset, s)"
_E1 = " + ".join(f"coalesce(abs({c} - lag({c}) OVER w), 0)" for c in "rgb")
S["steps"] = f"SELECT asset, axis, i, e - avg(e) OVER (PARTITION BY asset, axis) AS c FROM (SELECT asset, axis, i, sum(e) AS e FROM (SELECT asset, axis, i, {_E1} AS e FROM {_SIDES} WINDOW w AS (PARTITION BY asset, axis, j ORDER BY i)) GROUP BY ALL)"
S["echoes"] = (
    f"SELECT asset, k FROM (SELECT a.asset, a.axis, a.i - b.i AS k, sum(a.c * b.c) / any_value(n) AS v FROM steps a JOIN steps b ON b.asset = a.asset AND b.axis = a.axis AND a.i - b.i BETWEEN 2 AND {_G.largest} JOIN (SELECT asset, axis, sum(c * c) AS n FROM steps GROUP BY ALL HAVING sum(c * c) > 2.3e-16) z ON z.asset = a.asset AND z.axis = a.axis GROUP BY ALL) GROUP BY ALL HAVING round(sum(v), 9) > 0"
)
S["sizes"] = f"SELECT DISTINCT asset, s FROM psize JOIN (SELECT asset, s FROM echoes, range(2, {_G.largest + 1}) z(s) WHERE k % s = 0 UNION SELECT asset, s FROM psize, range(2, {_G.largest + 1}) z(s) WHERE asset NOT IN (SELECT asset FROM echoes)) USING (asset)"
_HAT = "SELECT h.*, (SELECT min(v) FROM {of} o WHERE o.asset = h.asset AND o.s > h.s AND o.s % h.s <> 0) AS rest FROM (SELECT * FROM {of} WHERE accepted QUALIFY row_number() OVER (PARTITION BY asset ORDER BY s DESC) = 1) h"
S["firstly"] = "SELECT * FROM judged JOIN sizes USING (asset, s)"
S["gest"] = (
    f"SELECT z.asset, s, dx, dy, v, confidence, CASE WHEN s IS NULL THEN 'not_found' WHEN confidence >= {_G.confidence} / s THEN 'ok' ELSE 'low_confidence' END AS verdict FROM psize z LEFT JOIN (SELECT e.asset, s, dx, dy, v, round(coalesce(greatest(0, least(1, (rest - v) / nullif(iv, 0))), 0), 9) AS confidence FROM "
    f"(SELECT * FROM ({_HAT.format(of='firstly')}) WHERE rest IS NOT NULL UNION ALL SELECT * FROM ({_HAT.format(of='judged')}) WHERE asset NOT IN (SELECT asset FROM ({_HAT.format(of='firstly')}) WHERE rest IS NOT NULL)) e JOIN psize USING (asset)) USING (asset)"
)
_GATES = "pal canvases enlarged psize gcells gphase gbest bandsx bandsy bandn axisx axisy gates"
_JUDGED = f"{_GATES} bends crests lines fits steady gpix gtone grate judged"
_ALL = f"{_JUDGED} steps echoes sizes firstly gest"


@query("grid_gates", "asset:long s:long dx:long dy:long v:double drift:double loss:double contrast:double", "SELECT * FROM gates", _GATES)
def _(s, d):
    return colour_grid.candidates(enlarged(s, d), GATES)


@query("grid_candidates", "asset:long s:long rate:double accepted:boolean", "SELECT * FROM judged", _JUDGED)
def _(s, d):
    return colour_grid.candidates(enlarged(s, d), GATES)


@query("grid_sizes_tried", "asset:long s:long", "SELECT * FROM sizes", "pal canvases enlarged psize steps echoes sizes")
def _(s, d):
    return colour_grid.candidate_sizes(enlarged(s, d), GATES.largest).select("asset", F.explode("sizes").alias("s"))


@query("edge_lines", "asset:long axis:long s:long n:long spacing:double rms:double", "SELECT * FROM lines", "pal canvases enlarged bends crests lines")
def _(s, d):
    px = enlarged(s, d)
    return colour_grid.edge_fit(px, px.select("asset").distinct().withColumn("s", F.explode(F.sequence(F.lit(2), F.lit(GATES.largest)))), GATES)


@query("grid_estimates", "asset:long s:long dx:long dy:long v:double confidence:double verdict:string", "SELECT * FROM gest", _ALL)
def _(s, d):
    return colour_grid.estimate(enlarged(s, d), GATES)


_MODAL = "SELECT asset, cx AS x, cy AS y, r, g, b FROM (SELECT e.asset, floor((x - dx) / s) AS cx, floor((y - dy) / s) AS cy, r, g, b, count(*) AS n FROM enlarged e JOIN gest t ON t.asset = e.asset JOIN psize z ON z.asset = e.asset WHERE verdict = 'ok' AND x >= dx AND y >= dy AND dx + (floor((x - dx) / s) + 1) * s <= w AND dy + (floor((y - dy) / s) + 1) * s <= h GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY asset, cx, cy ORDER BY n DESC, r DESC, g DESC, b DESC) = 1"


@query("conformed", "asset:long x:long y:long r:long g:long b:long", _MODAL, _ALL)
def _(s, d):
    px = enlarged(s, d)
    return colour_grid.conform(px, colour_grid.estimate(px, GATES))


# Palettes made for pictures --------------------------------------------------------------------------
@query("tinted_colours", "asset:long colours:long pixels:long", "SELECT asset, count(DISTINCT (r, g, b)) AS colours, count(*) AS pixels FROM tinted GROUP BY 1", "tinted")
def _(s, d):
    return new_palette.colours(tinted(s, d)).groupBy("asset").agg(F.count("*").alias("colours"), F.sum("n").alias("pixels"))


@query("quantised_boxes", "asset:long idx:long r:long g:long b:long")
def _(s, d):
    return new_palette.quantise(tinted(s, d), 8, refine=False)


@query("quantised", "asset:long idx:long r:long g:long b:long")
def _(s, d):
    return new_palette.quantise(tinted(s, d), 8)


@query("quantised_pixels", "asset:long x:long y:long idx:long")
def _(s, d):
    px = tinted(s, d)
    return new_palette.applied(px, new_palette.quantise(px, 8))


@query("quantised_error", "asset:long pixels:long used:long error:double")
def _(s, d):
    px = tinted(s, d)
    return new_palette.error(px, new_palette.quantise(px, 8))
