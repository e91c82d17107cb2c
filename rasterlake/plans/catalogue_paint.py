"""Queries of drawing, inks and patches, of palettes forced on images, ramps and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import canvas, color, points, quantize
from rasterlake.plans.catalogue import _WINDOWS, OKLAB, SMALL
from rasterlake.registry import query
from rasterlake.views import canvases, dense, palette

_SEED = "c.x = c.asset % 8 AND c.y = c.asset // 8 % 8"


def _places(s, d):
    """One place in each canvas; one in nine lies outside."""
    return canvases(s, d).select("asset").distinct().selectExpr("asset", "cast(asset % 9 as int) AS x", "cast(asset div 9 % 8 as int) AS y")


@query("pixel_lookup", "asset:long x:long y:long idx:long", "SELECT p.asset, p.x, p.y, c.idx FROM (SELECT DISTINCT asset, asset % 9 AS x, asset // 9 % 8 AS y FROM canvases) p LEFT JOIN canvases c ON c.asset = p.asset AND c.x = p.x AND c.y = p.y", "canvases")
def _(s, d):
    return points.look(canvases(s, d), _places(s, d))


@query("pixel_write", "asset:long x:long y:long idx:long", "SELECT c.asset, c.x, c.y, CASE WHEN c.x = c.asset % 9 AND c.y = c.asset // 9 % 8 THEN 7 ELSE c.idx END AS idx FROM canvases c", "canvases")
def _(s, d):
    p = _places(s, d)
    cells = p.withColumns({"idx": F.lit(6), "seq": F.lit(0)}).unionByName(p.withColumns({"idx": F.lit(7), "seq": F.lit(1)}))
    return points.put(canvases(s, d), cells)


@query("mask_first", "asset:long n:long x:long y:long", "SELECT asset, count(*) AS n, arg_min(x, y * 8 + x) AS x, min(y) AS y FROM canvases WHERE idx <> 0 GROUP BY 1", "canvases")
def _(s, d):
    return points.first_set(canvases(s, d))


@query("distances", "asset:long x:long y:long l1:long linf:long", "SELECT asset, x, y, abs(x - asset % 8) + abs(y - 3) AS l1, greatest(abs(x - asset % 8), abs(y - 3)) AS linf FROM canvases", "canvases")
def _(s, d):
    at = (F.col("x"), F.col("y"), F.col("asset") % 8, F.lit(3))
    return canvases(s, d).withColumns({"l1": points.manhattan(*at), "linf": points.chebyshev(*at)})


_R = "SELECT asset, asset % 5 AS ax, asset % 3 AS ay, asset % 4 AS aw, 3 AS ah, asset % 7 AS bx, 1 AS b_y, 4 AS bw, asset % 6 AS bh FROM (SELECT DISTINCT asset FROM canvases)"


@query("rectangles", "asset:long inside:boolean ux:long uy:long uw:long uh:long cx:long cy:long cw:long ch:long", f"SELECT asset, 2 >= ax AND 2 >= ay AND 2 < ax + aw AND 2 < ay + ah AS inside, CASE WHEN aw <= 0 OR ah <= 0 THEN bx WHEN bw <= 0 OR bh <= 0 THEN ax ELSE least(ax, bx) END AS ux, CASE WHEN aw <= 0 OR ah <= 0 THEN b_y WHEN bw <= 0 OR bh <= 0 THEN ay ELSE least(ay, b_y) END AS uy, CASE WHEN aw <= 0 OR ah <= 0 THEN bw WHEN bw <= 0 OR bh <= 0 THEN aw ELSE greatest(ax + aw, bx + bw) - least(ax, bx) END AS uw, CASE WHEN aw <= 0 OR ah <= 0 THEN bh WHEN bw <= 0 OR bh <= 0 THEN ah ELSE greatest(ay + ah, b_y + bh) - least(ay, b_y) END AS uh, CASE WHEN c THEN greatest(ax, bx) END AS cx, CASE WHEN c THEN greatest(ay, b_y) END AS cy, CASE WHEN c THEN least(ax + aw, bx + bw) - greatest(ax, bx) END AS cw, CASE WHEN c THEN least(ay + ah, b_y + bh) - greatest(ay, b_y) END AS ch FROM (SELECT *, least(ax + aw, bx + bw) > greatest(ax, bx) AND least(ay + ah, b_y + bh) > greatest(ay, b_y) AS c FROM ({_R}))", "canvases")
def _(s, d):
    r = canvases(s, d).select("asset").distinct()
    box = lambda *e: F.struct(*(F.expr(x).cast("long").alias(n) for x, n in zip(e, "xywh")))
    r = r.withColumns({"a": box("asset % 5", "asset % 3", "asset % 4", "3"), "b": box("asset % 7", "1", "4", "asset % 6")})
    r = r.withColumns({"u": points.rect_union(F.col("a"), F.col("b")), "c": points.rect_clip(F.col("a"), F.col("b")), "inside": points.contains(F.lit(2), F.lit(2), F.col("a"))})
    return r.select("asset", "inside", *(F.col(f"{p}.{n}").alias(f"{p}{n}") for p in "uc" for n in "xywh"))


_ENDS = "SELECT DISTINCT asset, asset % 5 AS x0, asset % 7 AS y0, asset * 3 % 11 AS x1, asset * 5 % 13 AS y1 FROM canvases"


def _ends(s, d):
    return canvases(s, d).select("asset").distinct().selectExpr("asset", "cast(asset % 5 as int) AS x0", "cast(asset % 7 as int) AS y0", "cast(asset * 3 % 11 as int) AS x1", "cast(asset * 5 % 13 as int) AS y1")


@query("lines", "asset:long seq:long x:long y:long", f"SELECT asset, seq, x0 + CASE WHEN n > 0 THEN sign(x1 - x0) * floor((2 * abs(x1 - x0) * seq + n) / (2 * n)) ELSE 0 END AS x, y0 + CASE WHEN n > 0 THEN sign(y1 - y0) * floor((2 * abs(y1 - y0) * seq + n) / (2 * n)) ELSE 0 END AS y FROM (SELECT *, unnest(range(0, n + 1)) AS seq FROM (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM ({_ENDS})))", "canvases")
def _(s, d):
    return points.line(_ends(s, d))


_PATH = "SELECT a AS asset, i AS seq, CASE WHEN a % 3 = 0 THEN i // 2 WHEN a % 3 = 1 THEN (i + 1) // 2 ELSE i END AS x, CASE WHEN a % 3 = 0 THEN (i + 1) // 2 WHEN a % 3 = 1 THEN (i + a) // 5 ELSE i // 3 END AS y FROM (SELECT unnest(range(0, 12)) AS a), (SELECT unnest(range(0, 30)) AS i) z"


@query("pixel_perfect", "asset:long seq:long x:long y:long", f"WITH RECURSIVE p AS ({_PATH}), r(asset, seq, kx, ky, kept) AS (SELECT asset, seq, x, y, true FROM p WHERE seq = 0 UNION ALL SELECT asset, seq, CASE WHEN corner THEN kx ELSE x END, CASE WHEN corner THEN ky ELSE y END, NOT corner FROM (SELECT p.*, r.kx, r.ky, coalesce(abs(r.kx - p.x) + abs(r.ky - p.y) = 1 AND abs(p.x - q.x) + abs(p.y - q.y) = 1 AND r.kx <> q.x AND r.ky <> q.y, false) AS corner FROM r JOIN p ON p.asset = r.asset AND p.seq = r.seq + 1 LEFT JOIN p q ON q.asset = p.asset AND q.seq = p.seq + 1)) SELECT p.* FROM r JOIN p USING (asset, seq) WHERE kept")
def _(s, d):
    g = s.range(12).select(F.col("id").alias("a")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29))))
    p = g.selectExpr("a AS asset", "i AS seq", "CASE WHEN a % 3 = 0 THEN i div 2 WHEN a % 3 = 1 THEN (i + 1) div 2 ELSE i END AS x", "CASE WHEN a % 3 = 0 THEN (i + 1) div 2 WHEN a % 3 = 1 THEN (i + a) div 5 ELSE i div 3 END AS y")
    return points.pixel_perfect(p)


@query("bayer_ranks", "x:long y:long rank:long")
def _(s, d):
    return quantize.bayer_table(s, 8)


def _bayer_sql(x: str, y: str) -> str:
    """Rank in the 4 x 4 matrix, by its definition."""
    q = lambda a, b: f"(CASE WHEN {a} AND {b} THEN 1 WHEN {a} THEN 2 WHEN {b} THEN 3 ELSE 0 END)"
    return f"(4 * {q(f'{x} % 2 >= 1', f'{y} % 2 >= 1')} + {q(f'{x} % 4 >= 2', f'{y} % 4 >= 2')})"


@query("ink_patterns", "asset:long x:long y:long checker:boolean bayer:boolean custom:boolean", f"SELECT asset, x, y, (x // 2 + y // 2) % 2 = 0 AS checker, {_bayer_sql('x', 'y')} >= 6 AS bayer, substr(['110', '011'][y % 2 + 1], x % 3 + 1, 1) = '1' AS custom FROM canvases", "canvases")
def _(s, d):
    x, y = F.col("x"), F.col("y")
    return canvases(s, d).withColumns({"checker": points.checker(x, y, 2), "bayer": points.bayer(x, y, 4) >= 6, "custom": points.custom(x, y, ["110", "011"])})


_FILL = f"fill AS (SELECT l.asset, l.x, l.y FROM labels l JOIN (SELECT c.asset, c.root FROM labels c WHERE {_SEED}) z ON z.asset = l.asset AND z.root = l.root)"


def _seeds(s, d):
    return canvases(s, d).select("asset").distinct().selectExpr("asset", "cast(asset % 8 as int) AS x", "cast(asset div 8 % 8 as int) AS y")


@query("flood_patch", "asset:long x:long y:long before:long after:long", f"WITH {_FILL} SELECT c.asset, c.x, c.y, c.idx AS before, CASE WHEN (c.x + c.y) % 2 = 0 THEN 9 ELSE 8 END AS after FROM canvases c JOIN fill f ON f.asset = c.asset AND f.x = c.x AND f.y = c.y", "canvases reach labels")
def _(s, d):
    c = canvases(s, d)
    return points.paint(c, points.fill(c, _seeds(s, d)), F.when(points.checker(F.col("x"), F.col("y")), 9).otherwise(8))


@query("flood_global", "asset:long n:long", f"SELECT c.asset, count(*) AS n FROM canvases c JOIN (SELECT asset, idx FROM canvases c WHERE {_SEED}) z ON z.asset = c.asset AND z.idx = c.idx GROUP BY 1", "canvases")
def _(s, d):
    return points.fill(canvases(s, d), _seeds(s, d), contiguous=False).groupBy("asset").agg(F.count("*").alias("n"))


@query("patch_applied", "asset:long x:long y:long idx:long", "SELECT asset, 7 - x AS x, y, idx FROM canvases", "canvases")
def _(s, d):
    c = canvases(s, d)
    return points.apply(c, canvas.diff(c, canvas.mirror(c, 8)))


@query("patch_reverted", "asset:long x:long y:long idx:long", "SELECT * FROM canvases", "canvases")
def _(s, d):
    c = canvases(s, d)
    patch = canvas.diff(c, canvas.mirror(c, 8))
    return points.apply(points.apply(c, patch), patch, back=True)


@query("brush_squares", "asset:long n:long", "SELECT asset, count(*) AS n FROM (SELECT DISTINCT asset, x + dx AS x, y + dy AS y FROM canvases, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE idx = 4) GROUP BY 1", "canvases")
def _(s, d):
    return points.brush(canvases(s, d).where("idx = 4"), 3).groupBy("asset").agg(F.count("*").alias("n"))


# Palettes ------------------------------------------------------------------------------------------
_SPREAD = f"(SELECT (max(l) - min(l)) / (count(*) - 1) AS spread FROM ({OKLAB}) WHERE idx <> 0)"
_PIXELS = "SELECT asset, x, y, idx * 36 AS r, (x * 8) % 256 AS g, (y * 8) % 256 AS b FROM dense"


def _pixels(s, d):
    return dense(s, d).selectExpr("asset", "x", "y", "idx * 36 AS r", "(x * 8) % 256 AS g", "(y * 8) % 256 AS b")


def _direct_sql(offset: str) -> str:
    lab = color.oklab_sql(f"(SELECT *, 0 AS idx FROM (SELECT DISTINCT r, g, b, {_bayer_sql('x', 'y') if offset else '0'} AS t FROM ({_PIXELS})))")
    best = f"SELECT r, g, b, t, idx FROM (SELECT c.r, c.g, c.b, c.t, p.idx, row_number() OVER (PARTITION BY c.r, c.g, c.b, c.t ORDER BY round(pow(c.l {offset} - p.l, 2) + pow(c.a_ - p.a_, 2) + pow(c.b_ - p.b_, 2), 12), p.idx) AS k FROM ({lab}) c, {_SPREAD} z, ({OKLAB}) p WHERE p.idx <> 0) WHERE k = 1"
    return f"SELECT q.asset, q.x, q.y, n.idx FROM (SELECT *, {_bayer_sql('x', 'y') if offset else '0'} AS t FROM ({_PIXELS})) q JOIN ({best}) n ON n.r = q.r AND n.g = q.g AND n.b = q.b AND n.t = q.t"


@query("palette_applied", "asset:long x:long y:long idx:long", _direct_sql(""), "dense pal")
def _(s, d):
    return quantize.direct(_pixels(s, d), palette(s))


@query("palette_dithered", "asset:long x:long y:long idx:long", _direct_sql("+ (c.t / 16.0 - 0.5) * z.spread * 0.8"), "dense pal")
def _(s, d):
    return quantize.direct(_pixels(s, d), palette(s), 4, 0.8)


@query("palette_spread", "spread:double", f"SELECT spread FROM {_SPREAD}", "pal")
def _(s, d):
    return quantize.spread(palette(s))


_LIN = ["+4.0767416621 * l3 - 3.3077115913 * m3 + 0.2309699292 * s3", "-1.2684380046 * l3 + 2.6097574011 * m3 - 0.3413193965 * s3", "-0.0041960863 * l3 - 0.7034186147 * m3 + 1.7076147010 * s3"]


def _rgb_sql(source: str, keep: str) -> str:
    roots = f"SELECT {keep}, pow(l + 0.3963377774 * a_ + 0.2158037573 * b_, 3) AS l3, pow(l - 0.1055613458 * a_ - 0.0638541728 * b_, 3) AS m3, pow(l - 0.0894841775 * a_ - 1.2914855480 * b_, 3) AS s3 FROM {source}"
    lin = f"SELECT {keep}, " + ", ".join(f"({e}) AS {c}l" for e, c in zip(_LIN, "rgb")) + f" FROM ({roots})"
    channel = lambda c: f"CAST(floor(least(greatest(CASE WHEN {c}l <= 0.0031308 THEN 12.92 * {c}l ELSE 1.055 * pow(greatest({c}l, 0), 1 / 2.4) - 0.055 END, 0), 1) * 255 + 0.5) AS INTEGER) AS {c}"
    return f"SELECT {keep}, " + ", ".join(map(channel, "rgb")) + f" FROM ({lin})"


@query("oklab_round_trip", "idx:long r:long g:long b:long", "SELECT * FROM pal", "pal")
def _(s, d):
    p = color.with_oklab(palette(s))
    return p.select("idx", *(c.alias(n) for c, n in zip(quantize.to_rgb(F.col("l"), F.col("a_"), F.col("b_")), "rgb")))


@query("oklab_to_rgb", "idx:long r:long g:long b:long", _rgb_sql(f"(SELECT idx, l * 1.1 AS l, a_ * 1.4 AS a_, b_ * 0.7 AS b_ FROM ({OKLAB}))", "idx"), "pal")
def _(s, d):
    p = color.with_oklab(palette(s))
    return p.select("idx", *(c.alias(n) for c, n in zip(quantize.to_rgb(F.col("l") * 1.1, F.col("a_") * 1.4, F.col("b_") * 0.7), "rgb")))


@query("nearest_other", "idx:long other:long distance:double", f"SELECT idx, other, sqrt(dd) AS distance FROM (SELECT x.idx, y.idx AS other, round(pow(x.l - y.l, 2) + pow(x.a_ - y.a_, 2) + pow(x.b_ - y.b_, 2), 12) AS dd, row_number() OVER (PARTITION BY x.idx ORDER BY round(pow(x.l - y.l, 2) + pow(x.a_ - y.a_, 2) + pow(x.b_ - y.b_, 2), 12), y.idx) AS k FROM lab_pal x JOIN lab_pal y ON x.idx <> y.idx WHERE x.idx <> 0 AND y.idx <> 0) WHERE k = 1", "pal lab_pal")
def _(s, d):
    return quantize.nearest_other(palette(s))


@query("merge_small", "asset:long x:long y:long idx:long", "WITH m AS (SELECT asset, idx, other FROM (SELECT x.asset, x.idx, y.idx AS other, row_number() OVER (PARTITION BY x.asset, x.idx ORDER BY round((x.l - y.l) * (x.l - y.l) + (x.a_ - y.a_) * (x.a_ - y.a_) + (x.b_ - y.b_) * (x.b_ - y.b_), 12), y.idx) AS k FROM lab_areas x JOIN lab_areas y ON x.asset = y.asset WHERE x.area < 6 AND y.area >= 6) WHERE k = 1) SELECT c.asset, c.x, c.y, coalesce(m.other, c.idx) AS idx FROM canvases c LEFT JOIN m ON m.asset = c.asset AND m.idx = c.idx", "canvases areas pal lab_pal lab_areas")
def _(s, d):
    return quantize.merge_small(canvases(s, d), palette(s), 6)


@query("ramps", "idx:long step:long r:long g:long b:long")
def _(s, d):
    return quantize.ramp(palette(s).where("idx <> 0"), 5)


@query("denormalised", "asset:long x:long y:long idx:long", "SELECT * FROM canvases", "canvases")
def _(s, d):
    table = color.normalised(palette(s)).drop("l")
    forward = canvases(s, d).join(F.broadcast(table), "idx").select("asset", "x", "y", F.col("new_idx").alias("idx"))
    return quantize.denormalised(forward, table)


@query("palette_entry", "idx:long r:long g:long b:long", "SELECT * FROM pal WHERE idx NOT IN (3) UNION ALL SELECT 3, 10, 20, 30 UNION ALL SELECT 16, 1, 2, 3", "pal")
def _(s, d):
    return quantize.with_entry(quantize.with_entry(palette(s), 3, 10, 20, 30), 16, 1, 2, 3)


@query("ramp_neighbours", "a:long b:long", "SELECT DISTINCT least(idx, n) AS a, greatest(idx, n) AS b FROM (SELECT i * 7 % 16 AS idx, lead(i * 7 % 16) OVER (PARTITION BY i // 4 ORDER BY i) AS n FROM (SELECT unnest(range(0, 16)) AS i)) WHERE n IS NOT NULL")
def _(s, d):
    return quantize.ramp_neighbours(s.range(16).selectExpr("cast(id div 4 as int) AS ramp", "cast(id % 4 as int) AS pos", "cast(id * 7 % 16 as int) AS idx"))


@query("colour_report", "asset:long idx:long area:long regions:long largest:long share:double l:double", "SELECT s.*, area / sum(area) OVER (PARTITION BY asset) AS share, l FROM (SELECT asset, idx, sum(area) AS area, count(*) AS regions, max(area) AS largest FROM region_stats WHERE idx <> 0 GROUP BY 1, 2) s JOIN lab_pal USING (idx)", "canvases reach labels region_stats pal lab_pal")
def _(s, d):
    return quantize.colour_report(canvases(s, d), palette(s))


# Cleaning ------------------------------------------------------------------------------------------
_TOUCH = "SELECT asset, root, idx AS other FROM (SELECT asset, root, idx, row_number() OVER (PARTITION BY asset, root ORDER BY n DESC, idx) AS k FROM (SELECT a.asset, a.root, b.idx, count(*) AS n FROM labels a JOIN labels b ON a.asset = b.asset AND a.root <> b.root AND abs(a.x - b.x) + abs(a.y - b.y) = 1 JOIN region_stats t ON t.asset = a.asset AND t.root = a.root WHERE t.area < 3 AND t.idx <> 0 GROUP BY 1, 2, 3)) WHERE k = 1"


@query("remove_isolated", "asset:long x:long y:long idx:long", f"SELECT l.asset, l.x, l.y, coalesce(t.other, l.idx) AS idx FROM labels l LEFT JOIN ({_TOUCH}) t ON t.asset = l.asset AND t.root = l.root", "canvases reach labels region_stats")
def _(s, d):
    return quantize.remove_isolated(canvases(s, d), 3)


@query("remove_between", "asset:long x:long y:long idx:long", "WITH m AS (SELECT asset, idx, other FROM (SELECT *, row_number() OVER (PARTITION BY asset, idx ORDER BY d, xi, yi) AS k FROM (SELECT c.asset, c.idx, x.idx AS xi, y.idx AS yi, round(sqrt(pow(c.l - (x.l + y.l) / 2, 2) + pow(c.a_ - (x.a_ + y.a_) / 2, 2) + pow(c.b_ - (x.b_ + y.b_) / 2, 2)), 9) AS d, CASE WHEN round(pow(c.l - x.l, 2) + pow(c.a_ - x.a_, 2) + pow(c.b_ - x.b_, 2), 12) <= round(pow(c.l - y.l, 2) + pow(c.a_ - y.a_, 2) + pow(c.b_ - y.b_, 2), 12) THEN x.idx ELSE y.idx END AS other FROM lab_areas c JOIN lab_areas x ON x.asset = c.asset AND x.area > c.area JOIN lab_areas y ON y.asset = c.asset AND y.area > c.area AND x.idx < y.idx WHERE c.area <= 16) WHERE d <= 0.3) WHERE k = 1) SELECT c.asset, c.x, c.y, coalesce(m.other, c.idx) AS idx FROM canvases c LEFT JOIN m ON m.asset = c.asset AND m.idx = c.idx", "canvases areas pal lab_pal lab_areas")
def _(s, d):
    return quantize.remove_between(canvases(s, d), palette(s), 0.3, 16)


def _hits_sql() -> str:
    out = []
    for ox, oy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        x, y = f"(x + {ox})", f"(y + {oy})"
        for set_ in (f"({x} + {y}) % 2 = 0", f"({x} // 2 + {y} // 2) % 2 = 0", *(f"{_bayer_sql(x, y)} >= {n}" for n in (4, 8, 12))):
            out.append(f"avg(CAST(CASE WHEN {set_} THEN a ELSE b END = idx AS INTEGER))")
    return ", ".join(out)


_MATCH = f"SELECT c.asset, c.x // 4 AS wx, c.y // 4 AS wy, any_value(a) AS a, any_value(b) AS b, greatest({_hits_sql()}) AS match, count(*) FILTER (WHERE idx = a) AS na, count(*) AS n FROM canvases c JOIN ({_WINDOWS}) w ON w.asset = c.asset AND w.wx = c.x // 4 AND w.wy = c.y // 4 WHERE idx IN (a, b) GROUP BY 1, 2, 3"


@query("dither_patterns", "asset:long wx:long wy:long a:long b:long match:double", _MATCH, "canvases")
def _(s, d):
    return quantize.pattern_match(canvases(s, d), SMALL)


@query("denoise_dither", "asset:long x:long y:long idx:long", f"SELECT c.asset, c.x, c.y, CASE WHEN idx IN (a, b) THEN CASE WHEN {_bayer_sql('c.x', 'c.y')} >= floor(na / n * 16 + 0.5) THEN a ELSE b END ELSE idx END AS idx FROM canvases c LEFT JOIN (SELECT * FROM ({_MATCH}) WHERE round(match, 9) < 0.85) m ON m.asset = c.asset AND m.wx = c.x // 4 AND m.wy = c.y // 4", "canvases")
def _(s, d):
    return quantize.denoise(canvases(s, d), SMALL)
