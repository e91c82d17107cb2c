"""Queries of autotile pieces imported from sheets that canvases make."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake import views
from rasterlake.operators import autotile_import as imports
from rasterlake.registry import query
from rasterlake.views import canvases

_STATES = str(list(imports.ORDER))
_QUADS = "(VALUES ('nw', 0, FALSE, FALSE), ('ne', 1, TRUE, FALSE), ('sw', 2, FALSE, TRUE), ('se', 3, TRUE, TRUE)) q(quadrant, nth, fx, fy)"
#: Corners of canvases as pieces; sets that lack a canvas have no art.
views.SQL["five"] = f"SELECT asset // 5 AS sheet, quadrant, {_STATES}[1 + asset % 5] AS state, CASE WHEN fx THEN 3 - x ELSE x END AS x, CASE WHEN fy THEN 3 - y ELSE y END AS y, idx FROM canvases, {_QUADS} WHERE x < 4 AND y < 4 AND asset // 5 IN (SELECT asset // 5 FROM canvases GROUP BY 1 HAVING count(DISTINCT asset) = 5)"


def _sheets(s, d, n: int, size: int):
    px = canvases(s, d).where(f"x < {size} AND y < {size}")
    return px.selectExpr(f"asset div {n} AS sheet", f"cast(asset % {n} AS int) AS piece", "x", "y", "idx")


@query("autotile_import_5", "sheet:long quadrant:string state:string x:long y:long idx:long", "SELECT * FROM five", "canvases five")
def _(s, d):
    return imports.import_quadrants(_sheets(s, d, 5, 4), "quadrants-5", 8, ("sheet",))[0]


@query("autotile_import_20", "sheet:long quadrant:string state:string x:long y:long idx:long", f"SELECT asset // 20 AS sheet, quadrant, {_STATES}[1 + asset % 5] AS state, x, y, idx FROM canvases JOIN {_QUADS} ON nth = asset % 20 // 5 WHERE x < 4 AND y < 4 AND asset // 20 IN (SELECT asset // 20 FROM canvases GROUP BY 1 HAVING count(DISTINCT asset) = 20)", "canvases")
def _(s, d):
    return imports.import_quadrants(_sheets(s, d, 20, 4), "quadrants-20", 8, ("sheet",))[0]


_CUT = "SELECT asset // 47 AS sheet, quadrant, state, x % 4 AS qx, y % 4 AS qy, min(idx) <> max(idx) AS differ, count(*) AS met FROM canvases JOIN plan ON tile = asset % 47 AND quadrant = CASE WHEN y < 4 THEN 'n' ELSE 's' END || CASE WHEN x < 4 THEN 'w' ELSE 'e' END GROUP BY ALL"
_CHECKS = f"SELECT sheet, sum(again) AS cross_checked, count(*) FILTER (WHERE differ) AS conflicts FROM (SELECT sheet, quadrant, state, bool_or(differ) AS differ, max(met) - 1 AS again FROM ({_CUT}) GROUP BY ALL) GROUP BY 1"


@query("autotile_import_47", "sheet:long pieces:long mirrored:boolean cross_checked:long conflicts:long problem:string", f"SELECT *, FALSE AS mirrored, CASE WHEN pieces < 47 THEN 'count' WHEN conflicts > 0 THEN 'conflict' END AS problem FROM (SELECT asset // 47 AS sheet, count(DISTINCT asset) AS pieces FROM canvases GROUP BY 1) JOIN ({_CHECKS}) USING (sheet)", "canvases masks plan")
def _(s, d):
    return imports.import_quadrants(_sheets(s, d, 47, 8), "blob-47", 8, ("sheet",))[1]


@query("autotile_round_trip", "sheet:long quadrant:string state:string x:long y:long idx:long", "SELECT * FROM five", "canvases five")
def _(s, d):
    # Five pieces become 47 tiles, and these the 20 pieces again.
    art = imports.import_quadrants(_sheets(s, d, 5, 4), "quadrants-5", 8, ("sheet",))[0]
    return imports.import_quadrants(imports.assembled(art, 8, ("sheet",)).withColumnRenamed("tile", "piece"), "blob-47", 8, ("sheet",))[0]


#: Six canvases make a sheet: one state with all quadrants, one with some, one without any, as the sheet's number says.
_NAMED = "CASE WHEN sheet % 3 = 0 THEN NULL WHEN sheet % 3 = 1 THEN ['nw', 'ne', 'sw', 'se', 'nw', 'ne'][1 + piece] WHEN piece < 4 THEN ['nw', 'ne', 'sw', 'se'][1 + piece] END"
views.SQL["named"] = f"SELECT *, {_NAMED} AS quadrant, CASE WHEN sheet % 3 = 1 AND piece >= 4 THEN 'edge_h' WHEN sheet % 5 = 0 THEN 'other' ELSE 'convex' END AS state FROM (SELECT asset // 6 AS sheet, asset % 6 AS piece, x, y, idx FROM canvases WHERE x < 4 AND y < 4)"


def _named(s, d):
    names = F.array(*map(F.lit, ("nw", "ne", "sw", "se", "nw", "ne")))
    kind, piece = F.col("sheet") % 3, F.col("piece")
    quadrant = F.when((kind == 1) | ((kind == 2) & (piece < 4)), F.element_at(names, piece + 1))
    state = F.when((kind == 1) & (piece >= 4), "edge_h").when(F.col("sheet") % 5 == 0, "other").otherwise("convex")
    return _sheets(s, d, 6, 4).withColumns({"quadrant": quadrant, "state": state})


_STATUS = "SELECT sheet, state, named = 0 AS mirrored, CASE WHEN state = 'other' THEN 'state' WHEN named > 0 AND bare > 0 THEN 'mixed' WHEN bare = 0 AND known < 4 THEN 'missing' END AS problem FROM (SELECT sheet, state, count(quadrant) AS named, count(*) FILTER (WHERE quadrant IS NULL) AS bare, count(DISTINCT quadrant) AS known FROM named GROUP BY ALL)"


@query("autotile_resolved_states", "sheet:long state:string mirrored:boolean problem:string", _STATUS, "canvases named")
def _(s, d):
    return imports.resolved(_named(s, d), 4, ("sheet",))[1]


_FIRST = "SELECT * FROM named QUALIFY piece = min(piece) OVER (PARTITION BY sheet, state, quadrant)"


@query("autotile_resolved", "sheet:long quadrant:string state:string x:long y:long idx:long", f"SELECT n.sheet, q.quadrant, n.state, CASE WHEN n.quadrant IS NULL AND fx THEN 3 - x ELSE x END AS x, CASE WHEN n.quadrant IS NULL AND fy THEN 3 - y ELSE y END AS y, idx FROM ({_FIRST}) n JOIN {_QUADS} ON n.quadrant IS NULL OR n.quadrant = q.quadrant JOIN ({_STATUS}) t ON t.sheet = n.sheet AND t.state = n.state AND t.problem IS NULL", "canvases named")
def _(s, d):
    return imports.resolved(_named(s, d), 4, ("sheet",))[0]
