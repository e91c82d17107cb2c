"""Queries of the measures by which cell sizes are judged, of verdicts, and of enlarged canvases brought back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake import views
from rasterlake.operators import grid
from rasterlake.plans.catalogue import _BEST, _CELLS, _votes_sql
from rasterlake.registry import query
from rasterlake.views import canvases, dense

views.SQL["cells"] = _CELLS
views.SQL["best"] = _BEST
_AT = "SELECT * FROM (SELECT c.*, b.s, b.dx, b.dy, floor((c.x - b.dx) / b.s) AS cx, floor((c.y - b.dy) / b.s) AS cy, count(*) OVER (PARTITION BY c.asset, b.s, floor((c.x - b.dx) / b.s), floor((c.y - b.dy) / b.s)) AS n FROM canvases c JOIN best b ON b.asset = c.asset) WHERE n = s * s"
views.SQL["placed"] = _AT
views.SQL["recons"] = "SELECT asset, s, avg(CAST(round(off, 9) > 0.5 AS INTEGER)) AS rate FROM (SELECT *, abs(idx - avg(idx) OVER (PARTITION BY asset, s, cx, cy)) AS off FROM placed) GROUP BY 1, 2"
_RATIO = "CASE WHEN round(b.v, 12) > 0 THEN {w}.v / b.v WHEN round({w}.v, 12) > 0 THEN 1e6 ELSE 1.0 END"
views.SQL["contrasts"] = f"SELECT b.asset, b.s, ({_RATIO.format(w='wx')} + {_RATIO.format(w='wy')}) / 2 AS contrast FROM best b LEFT JOIN cells wx ON wx.asset = b.asset AND wx.s = b.s AND wx.dx = (b.dx + b.s // 2) % b.s AND wx.dy = b.dy LEFT JOIN cells wy ON wy.asset = b.asset AND wy.s = b.s AND wy.dx = b.dx AND wy.dy = (b.dy + b.s // 2) % b.s"


def _best(c):
    return grid.best_phase(grid.cell_variance(c, 4))


@query("recon_rates", "asset:long s:long rate:double", "SELECT * FROM recons", "canvases best placed recons")
def _(s, d):
    c = canvases(s, d)
    return grid.recon(c, _best(c), 0.5)


@query("phase_contrast", "asset:long s:long contrast:double", "SELECT * FROM contrasts", "canvases cells best contrasts")
def _(s, d):
    v = grid.cell_variance(canvases(s, d), 4)
    return grid.contrast(v, grid.best_phase(v))


@query("split_gain", "asset:long s:long gain:double", "SELECT asset, s, CASE WHEN round(sum(a * a), 9) > 0 THEN 1 - sum(b * b) / sum(a * a) ELSE 0 END AS gain FROM (SELECT asset, s, idx - avg(idx) OVER (PARTITION BY asset, s, cx, cy) AS a, idx - avg(idx) OVER (PARTITION BY asset, s, cx, cy, floor((x - dx) / (s / 2)), floor((y - dy) / (s / 2))) AS b FROM placed WHERE s % 2 = 0) GROUP BY 1, 2", "canvases best placed")
def _(s, d):
    c = canvases(s, d)
    return grid.split_gain(c, _best(c))


_BANDS = "SELECT asset, band, dx, v FROM (SELECT *, row_number() OVER (PARTITION BY asset, band ORDER BY round(v, 9), dx) AS k FROM (SELECT asset, band, dx, avg(b / n - (a / n) * (a / n)) AS v FROM (SELECT asset, y // 8 AS band, dx, count(*) AS n, sum(idx) AS a, sum(idx * idx) AS b FROM dense, (SELECT unnest(range(0, 4)) AS dx) p GROUP BY asset, y // 8, dx, floor((x - dx) / 4), y // 4) WHERE n = 16 GROUP BY 1, 2, 3)) WHERE k = 1"


@query("band_phases", "asset:long band:long dx:long v:double", _BANDS, "dense")
def _(s, d):
    return grid.bands(dense(s, d), 4, 8)


@query("phase_drift", "asset:long bands:long drift:long", f"WITH b AS ({_BANDS}) SELECT p.asset, count(DISTINCT p.band) AS bands, max(least(abs(p.dx - q.dx), 4 - abs(p.dx - q.dx))) AS drift FROM b p JOIN b q ON p.asset = q.asset GROUP BY 1", "dense")
def _(s, d):
    return grid.drift(grid.bands(dense(s, d), 4, 8), 4)


def _energy(order: int) -> str:
    diff = "abs(idx - lag(idx) OVER w)" if order == 1 else "abs(idx - 2 * lag(idx) OVER w + lag(idx, 2) OVER w)"
    return f"SELECT asset, x, sum(e) AS e FROM (SELECT asset, x, {diff} AS e FROM dense WINDOW w AS (PARTITION BY asset, y ORDER BY x)) WHERE e IS NOT NULL GROUP BY 1, 2"


@query("edge_energy", "asset:long x:long e:long", _energy(1), "dense")
def _(s, d):
    return grid.energy(dense(s, d))


@query("edge_energy_second", "asset:long x:long e:long", _energy(2), "dense")
def _(s, d):
    return grid.energy(dense(s, d), 2)


@query("folded_energy", "asset:long phase:long e:long", f"SELECT asset, x % 4 AS phase, sum(e) AS e FROM ({_energy(1)}) GROUP BY 1, 2", "dense")
def _(s, d):
    return grid.folded(grid.energy(dense(s, d)), 4)


@query("energy_relief", "asset:long relief:double", f"SELECT asset, stddev_pop(e) / avg(e) AS relief FROM (SELECT asset, x % 4 AS phase, sum(e) AS e FROM ({_energy(1)}) GROUP BY 1, 2) GROUP BY 1", "dense")
def _(s, d):
    return grid.relief(grid.folded(grid.energy(dense(s, d)), 4))


# Edges of a canvas are sharper where its columns were made so.
_SHARP = "SELECT asset, x, CASE WHEN x % 4 = asset % 4 THEN e * 3 + x % 5 ELSE e END AS e FROM ({e})".format(e=_energy(1))
_PEAKS = f"SELECT asset, x, x + coalesce(CASE WHEN a - 2 * e + b < 0 THEN (a - b) / (2 * (a - 2 * e + b)) END, 0) AS place FROM (SELECT *, avg(e) OVER (PARTITION BY asset) AS m, max(e) OVER (PARTITION BY asset ORDER BY x RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l, max(e) OVER (PARTITION BY asset ORDER BY x RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r, lag(e) OVER (PARTITION BY asset ORDER BY x) AS a, lead(e) OVER (PARTITION BY asset ORDER BY x) AS b FROM ({_SHARP})) WHERE e > 1.5 * m AND e > coalesce(l, -1) AND e >= coalesce(r, -1)"


def _sharp(s, d):
    e = grid.energy(dense(s, d))
    return e.withColumn("e", F.when(F.col("x") % 4 == F.col("asset") % 4, F.col("e") * 3 + F.col("x") % 5).otherwise(F.col("e")))


@query("energy_peaks", "asset:long x:long place:double", _PEAKS, "dense")
def _(s, d):
    return grid.peaks(_sharp(s, d), 4)


@query("edge_spacing", "asset:long n:long spacing:double rms:double", f"SELECT asset, count(*) AS n, regr_slope(place, k) AS spacing, sqrt(greatest(regr_syy(place, k) - regr_sxy(place, k) * regr_sxy(place, k) / regr_sxx(place, k), 0) / count(*)) AS rms FROM (SELECT asset, place, sum(st) OVER (PARTITION BY asset ORDER BY place ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT asset, place, coalesce(greatest(1, floor((place - lag(place) OVER (PARTITION BY asset ORDER BY place)) / 4 + 0.5)), 0) AS st FROM ({_PEAKS}))) GROUP BY 1 HAVING count(*) >= 3", "dense")
def _(s, d):
    return grid.spacing(grid.peaks(_sharp(s, d), 4), 4)


_EDGE = "SELECT asset, {x} AS x, sum(e) AS e FROM (SELECT asset, {x}, abs(idx - lag(idx) OVER (PARTITION BY asset, {y} ORDER BY {x})) AS e FROM dense) WHERE e IS NOT NULL GROUP BY 1, 2"


def _lag(x: str, y: str) -> str:
    c = f"SELECT asset, x, e - avg(e) OVER (PARTITION BY asset) AS c FROM ({_EDGE.format(x=x, y=y)})"
    r = f"SELECT a.asset, k, round(sum(a.c * b.c) / any_value(v.v), 9) AS r FROM ({c}) a JOIN ({c}) b ON a.asset = b.asset JOIN (SELECT asset, sum(c * c) AS v FROM ({c}) GROUP BY 1) v ON v.asset = a.asset, (SELECT unnest(range(2, 9)) AS k) z WHERE a.x = b.x + k AND v.v > 0 GROUP BY 1, 2"
    return f"SELECT asset, k FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY r DESC, k) AS n FROM ({r})) WHERE n = 1"


@query("edge_period", "asset:long px_:long py_:long period:long", f"SELECT a.asset, a.k AS px_, b.k AS py_, CASE WHEN abs(a.k - b.k) <= 1 OR greatest(a.k, b.k) % least(a.k, b.k) = 0 THEN least(a.k, b.k) END AS period FROM ({_lag('x', 'y')}) a JOIN ({_lag('y', 'x')}) b ON a.asset = b.asset", "dense")
def _(s, d):
    return grid.period(dense(s, d), 8)


@query("block_sizes", "asset:long k:long", "SELECT asset, CASE WHEN NOT flat THEN 2 * k END AS k FROM (SELECT f.asset, flat, k FROM (SELECT asset, min(idx) = max(idx) AS flat FROM canvases GROUP BY 1) f JOIN (SELECT asset, max(k) AS k FROM (" + " UNION ALL ".join(f"SELECT asset, {k} AS k FROM (SELECT asset, min(idx) = max(idx) AS one FROM canvases GROUP BY asset, x // {k}, y // {k}) GROUP BY 1 HAVING bool_and(one)" for k in (1, 2, 4, 8)) + ") GROUP BY 1) b ON b.asset = f.asset)", "canvases")
def _(s, d):
    return grid.block_size(grid.upscale(canvases(s, d), 2), 16, 16)


@query("downscale_mean", "asset:long x:long y:long idx:long", "SELECT asset, x // 4 AS x, y // 4 AS y, sum(idx) // count(*) AS idx FROM dense GROUP BY 1, 2, 3 HAVING count(*) = 16", "dense")
def _(s, d):
    return grid.downscale_mean(dense(s, d), 4)


@query("upscale_and_back", "asset:long x:long y:long idx:long", "SELECT * FROM canvases", "canvases")
def _(s, d):
    from rasterlake.operators import tiles

    return tiles.downscale_modal(grid.upscale(canvases(s, d), 3), 3)


@query("local_sizes", "asset:long wx:long wy:long hat:long confidence:double", "WITH w AS (SELECT asset * 4 + (x // 4) + 2 * (y // 4) AS asset, x % 4 AS x, y % 4 AS y, idx FROM canvases), best AS (SELECT asset, s, v FROM (SELECT *, row_number() OVER (PARTITION BY asset, s ORDER BY v, dy, dx) AS k FROM (SELECT asset, s, dx, dy, round(avg(b / n - (a / n) * (a / n)), 9) AS v FROM (SELECT asset, s, dx, dy, count(*) AS n, sum(idx) AS a, sum(idx * idx) AS b FROM w, (SELECT unnest([2, 3]) AS s) z, (SELECT unnest(range(0, 3)) AS dx) p, (SELECT unnest(range(0, 3)) AS dy) q WHERE dx < s AND dy < s GROUP BY asset, s, dx, dy, floor((x - dx) / s), floor((y - dy) / s)) WHERE n = s * s GROUP BY 1, 2, 3, 4)) WHERE k = 1), iv AS (SELECT asset, var_pop(idx) AS iv FROM w GROUP BY 1), hat AS (SELECT asset, max(s) AS hat, max_by(v, s) AS hv, any_value(iv) AS iv FROM best JOIN iv USING (asset) WHERE v <= 0.83 * iv GROUP BY 1), r AS (SELECT h.asset, min(v) AS rival FROM hat h JOIN best b ON b.asset = h.asset AND b.s > h.hat AND b.s % h.hat <> 0 GROUP BY 1) SELECT asset // 4 AS asset, asset % 2 AS wx, asset % 4 // 2 AS wy, hat, least(greatest(coalesce((rival - hv) / iv, 0.0), 0.0), 1.0) AS confidence FROM hat LEFT JOIN r USING (asset)", "canvases")
def _(s, d):
    k = ("asset", "wx", "wy")
    w = canvases(s, d).selectExpr("asset", "cast(x div 4 as int) AS wx", "cast(y div 4 as int) AS wy", "cast(x % 4 as int) AS x", "cast(y % 4 as int) AS y", "idx")
    return grid.confidence(grid.best_phase(grid.cell_variance(w, 3, k), k), grid.image_variance(w, k), 0.83, k)
