"""The queries: each applies an operator to the given tables' views; the SQL says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake import views
from rasterlake.operators import calibration, canvas, color, geometry, grid, lint, regions, runs, sequence, tiles
from rasterlake.registry import query
from rasterlake.views import canvases, dense, frames, palette, sweep

SMALL = {"window": 4, "dominance": 0.6, "alternation": 0.40}
REMAP = {1: 4, 4: 1, 3: 0}
OKLAB = color.oklab_sql("pal")
views.SQL["lab_pal"] = OKLAB
views.SQL["lab_areas"] = "SELECT * FROM areas JOIN lab_pal USING (idx)"
views.SQL["main"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY area DESC, idx) AS k FROM areas) JOIN lab_pal USING (idx) WHERE k <= 4"


# Canvas algebra ------------------------------------------------------------------------------------
@query("palette_report_cover", "asset:long cover50:long cover80:long cover90:long cover95:long colours:long opaque:long", "SELECT asset, count(*) FILTER (WHERE (cum - area) * 100 < total * 50) AS cover50, count(*) FILTER (WHERE (cum - area) * 100 < total * 80) AS cover80, count(*) FILTER (WHERE (cum - area) * 100 < total * 90) AS cover90, count(*) FILTER (WHERE (cum - area) * 100 < total * 95) AS cover95, count(*) AS colours, max(total) AS opaque FROM shares GROUP BY asset", "canvases areas shares")
def _(s, d):
    return color.cover_counts(canvases(s, d))


@query("palette_report_area", "asset:long idx:long area:long share:double cum:long", "SELECT asset, idx, area, area / total AS share, cum FROM shares", "canvases areas shares")
def _(s, d):
    return color.shares(canvases(s, d))


@query("used_colours", "idx:long r:long g:long b:long", "SELECT row_number() OVER (ORDER BY r, g, b) - 1 AS idx, r, g, b FROM (SELECT DISTINCT r, g, b FROM pal WHERE idx IN (SELECT idx FROM canvases WHERE idx <> 0))", "canvases pal")
def _(s, d):
    return color.used_colours(canvases(s, d), palette(s))


@query("remap", "asset:long x:long y:long idx:long", "SELECT asset, x, y, CASE idx WHEN 1 THEN 4 WHEN 4 THEN 1 WHEN 3 THEN 0 ELSE idx END AS idx FROM canvases", "canvases")
def _(s, d):
    return canvas.remap(canvases(s, d), REMAP)


@query("crop_fill", "asset:long x:long y:long idx:long", "SELECT a.asset, x.v AS x, y.v AS y, coalesce(c.idx, 9) AS idx FROM (SELECT DISTINCT asset FROM dense) a CROSS JOIN (SELECT unnest(range(0, 10)) AS v) x CROSS JOIN (SELECT unnest(range(0, 6)) AS v) y LEFT JOIN dense c ON c.asset = a.asset AND c.x = x.v + 26 AND c.y = y.v - 2", "dense")
def _(s, d):
    return canvas.crop(dense(s, d), 26, -2, 10, 6, 9)


@query("blit_skip_transparent", "asset:long x:long y:long idx:long", "SELECT b.asset, b.x, b.y, coalesce(t.idx, b.idx) AS idx FROM canvases b LEFT JOIN (SELECT asset, x + 2 AS x, y + 1 AS y, idx FROM canvases WHERE idx <> 0) t ON t.asset = b.asset AND t.x = b.x AND t.y = b.y", "canvases")
def _(s, d):
    c = canvases(s, d)
    return canvas.blit(c, c, 2, 1)


@query("opaque_bbox", "asset:long x0:long y0:long w:long h:long", "SELECT asset, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM canvases WHERE idx <> 0 GROUP BY asset", "canvases")
def _(s, d):
    return canvas.bbox(canvases(s, d))


@query("silhouette_boundary", "asset:long x:long y:long", "SELECT m.asset, m.x, m.y FROM canvases m WHERE m.idx <> 0 AND (SELECT count(*) FROM canvases o WHERE o.asset = m.asset AND o.idx <> 0 AND abs(o.x - m.x) + abs(o.y - m.y) = 1) < 4", "canvases")
def _(s, d):
    return canvas.boundary(canvases(s, d))


@query("mask_invert", "asset:long x:long y:long", "SELECT asset, x, y FROM canvases WHERE idx <> 2", "canvases")
def _(s, d):
    c = canvases(s, d)
    return canvas.inverted(c, canvas.mask_of(c, 2))


@query("diff_pixels", "asset:long x:long y:long before:long after:long", "SELECT a.asset, a.x, a.y, a.idx AS before, b.idx AS after FROM canvases a JOIN canvases b ON b.asset = a.asset AND b.x = 7 - a.x AND b.y = a.y WHERE a.idx <> b.idx", "canvases")
def _(s, d):
    c = canvases(s, d)
    return canvas.diff(c, canvas.mirror(c, 8))


@query("diff_ratio", "asset:long ratio:double x0:long y0:long x1:long y1:long", "SELECT a.asset, count(*) FILTER (WHERE a.idx <> b.idx) / 64.0 AS ratio, min(a.x) FILTER (WHERE a.idx <> b.idx) AS x0, min(a.y) FILTER (WHERE a.idx <> b.idx) AS y0, max(a.x) FILTER (WHERE a.idx <> b.idx) AS x1, max(a.y) FILTER (WHERE a.idx <> b.idx) AS y1 FROM canvases a JOIN canvases b ON b.asset = a.asset AND b.x = 7 - a.x AND b.y = a.y GROUP BY 1 HAVING count(*) FILTER (WHERE a.idx <> b.idx) > 0", "canvases")
def _(s, d):
    c = canvases(s, d)
    return canvas.diff(c, canvas.mirror(c, 8)).groupBy("asset").agg((F.count("*") / 64).alias("ratio"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


@query("mirror", "asset:long x:long y:long idx:long", "SELECT asset, 7 - x AS x, y, idx FROM canvases", "canvases")
def _(s, d):
    return canvas.mirror(canvases(s, d), 8)


@query("quarter_turn", "asset:long x:long y:long idx:long", "SELECT asset, 7 - y AS x, x AS y, idx FROM canvases", "canvases")
def _(s, d):
    return canvas.quarter_turn(canvases(s, d), 8)


@query("offset", "asset:long x:long y:long idx:long", "SELECT asset, x + 3 AS x, y - 2 AS y, idx FROM canvases WHERE x + 3 < 8 AND y - 2 >= 0", "canvases")
def _(s, d):
    return canvas.offset(canvases(s, d), 3, -2, 8, 8)


@query("affine_nearest", "asset:long x:long y:long idx:long", "SELECT a.asset, x.v AS x, y.v AS y, coalesce(c.idx, 0) AS idx FROM (SELECT DISTINCT asset FROM canvases) a CROSS JOIN (SELECT unnest(range(0, 8)) AS v) x CROSS JOIN (SELECT unnest(range(0, 8)) AS v) y LEFT JOIN canvases c ON c.asset = a.asset AND c.x = floor((3 * x.v + y.v) / 4.0) AND c.y = floor((-1 * x.v + 3 * y.v) / 4.0)", "canvases")
def _(s, d):
    return canvas.affine_nearest(canvases(s, d), 8, 8, 3, 1, -1, 3, 4)


@query("squash_box", "asset:long x:long y:long idx:long", "SELECT a.asset, x.v AS x, y.v AS y, coalesce(c.idx, 0) AS idx FROM (SELECT DISTINCT asset FROM canvases) a CROSS JOIN (SELECT unnest(range(0, 8)) AS v) x CROSS JOIN (SELECT unnest(range(0, 8)) AS v) y LEFT JOIN canvases c ON c.asset = a.asset AND c.x = x.v AND y.v >= 3 AND c.y = floor((2 * (y.v - 3) + 1) * 8 / 10.0)", "canvases")
def _(s, d):
    return canvas.squash(canvases(s, d), 8, 8, 5)


@query("wide_round_trip", "asset:long w:long h:long first:long total:long", "SELECT asset, max(x) + 1 AS w, max(y) + 1 AS h, max(idx) FILTER (WHERE x = 0 AND y = 0) AS first, sum(idx) AS total FROM canvases GROUP BY asset", "canvases")
def _(s, d):
    wide = canvas.to_pixels(canvases(s, d))
    back = canvas.from_pixels(wide)
    return wide.select("asset", "w", "h", F.element_at("pixels", 1).alias("first")).join(back.groupBy("asset").agg(F.sum("idx").alias("total")), "asset")


# Colour --------------------------------------------------------------------------------------------
@query("oklab_columns", "idx:long l:double a_:double b_:double", OKLAB, "pal")
def _(s, d):
    return color.with_oklab(palette(s))


_DENSE_RGB = "SELECT DISTINCT idx * 36 AS r, (x * 8) % 256 AS g, (y * 8) % 256 AS b FROM dense"


@query("nearest_colour", "r:long g:long b:long idx:long", f"SELECT r, g, b, idx FROM (SELECT c.r, c.g, c.b, p.idx, row_number() OVER (PARTITION BY c.r, c.g, c.b ORDER BY round((c.l - p.l) * (c.l - p.l) + (c.a_ - p.a_) * (c.a_ - p.a_) + (c.b_ - p.b_) * (c.b_ - p.b_), 12), p.idx) AS k FROM ({color.oklab_sql(f'({_DENSE_RGB})')}) c CROSS JOIN ({OKLAB}) p) WHERE k = 1", "dense pal")
def _(s, d):
    rgb = dense(s, d).selectExpr("idx * 36 AS r", "(x * 8) % 256 AS g", "(y * 8) % 256 AS b")
    return color.nearest(rgb, palette(s))


@query("contrast_pairs", "asset:long x_idx:long y_idx:long contrast:double delta_e:double", "SELECT a.asset, a.idx AS x_idx, b.idx AS y_idx, abs(a.l - b.l) AS contrast, sqrt((a.l - b.l) * (a.l - b.l) + (a.a_ - b.a_) * (a.a_ - b.a_) + (a.b_ - b.b_) * (a.b_ - b.b_)) AS delta_e FROM main a JOIN main b ON a.asset = b.asset AND a.k < b.k", "canvases areas pal lab_pal main")
def _(s, d):
    return color.contrast_pairs(canvases(s, d), palette(s))


@query("normalise_lightness", "idx:long new_idx:long l:double", f"SELECT idx, row_number() OVER (ORDER BY round(l, 9), idx) - 1 AS new_idx, l FROM ({OKLAB})", "pal")
def _(s, d):
    return color.normalised(palette(s))


@query("palette_merge", "idx:long r:long g:long b:long", "SELECT row_number() OVER (ORDER BY f) - 1 AS idx, r, g, b FROM (SELECT r, g, b, min(p * 1000 + idx) AS f FROM (SELECT 0 AS p, * FROM pal UNION ALL SELECT 1 AS p, * FROM pal_b) GROUP BY r, g, b)", "pal pal_b")
def _(s, d):
    return color.merged([palette(s), palette(s, views.PALETTE_B)])


@query("ramp_step", "asset:long x:long y:long idx:long", "SELECT asset, x, y, CASE WHEN idx = 0 THEN 0 ELSE least(idx + 2, 4) END AS idx FROM canvases", "canvases")
def _(s, d):
    return color.ramp_step(canvases(s, d), [1, 2, 3, 4], 2)


@query("intermediate_pixels", "asset:long pixels:long", "SELECT asset, sum(area) AS pixels FROM (SELECT DISTINCT c.asset, c.idx, c.area FROM lab_areas c JOIN lab_areas x ON x.asset = c.asset AND x.area > c.area JOIN lab_areas y ON y.asset = c.asset AND y.area > c.area AND x.idx < y.idx WHERE sqrt(pow(c.l - (x.l + y.l) / 2, 2) + pow(c.a_ - (x.a_ + y.a_) / 2, 2) + pow(c.b_ - (x.b_ + y.b_) / 2, 2)) <= 0.3) GROUP BY asset", "canvases areas pal lab_pal lab_areas")
def _(s, d):
    return color.intermediates(canvases(s, d), palette(s), 0.3)


# Runs ----------------------------------------------------------------------------------------------
@query("run_lengths", "asset:long y:long run:long idx:long start:long len:long", "SELECT * FROM runs", "canvases runs")
def _(s, d):
    return runs.run_lengths(canvases(s, d))


@query("run_valleys", "asset:long y:long run:long len:long", "SELECT * FROM (SELECT *, lag(len) OVER w AS p, lead(len) OVER w AS n FROM runs WINDOW w AS (PARTITION BY asset, y ORDER BY run)) WHERE p > len AND len < n", "canvases runs")
def _(s, d):
    return runs.valleys(runs.run_lengths(canvases(s, d)))


@query("sustained_valleys", "asset:long y:long run:long len:long", "SELECT * FROM (SELECT *, lag(len) OVER w AS p, lead(len) OVER w AS n, lag(len, 2) OVER w AS p2, lead(len, 2) OVER w AS n2 FROM runs WINDOW w AS (PARTITION BY asset, y ORDER BY run)) WHERE p > len AND len < n AND p2 > p AND n2 > n", "canvases runs")
def _(s, d):
    return runs.sustained_valleys(runs.run_lengths(canvases(s, d)))


@query("banding_runs", "asset:long y:long first_run:long len:long repeats:long", "SELECT asset, y, min(run) AS first_run, max(len) AS len, count(*) AS repeats FROM (SELECT *, sum(n) OVER (PARTITION BY asset, y ORDER BY run) AS i FROM (SELECT *, CASE WHEN lag(len) OVER w IS NULL OR lag(len) OVER w <> len THEN 1 ELSE 0 END AS n FROM runs WINDOW w AS (PARTITION BY asset, y ORDER BY run))) GROUP BY asset, y, i HAVING count(*) >= 3", "canvases runs")
def _(s, d):
    return runs.banding(runs.run_lengths(canvases(s, d)))


# Regions and geometry ------------------------------------------------------------------------------
@query("regions", "asset:long x:long y:long idx:long root:long", "SELECT * FROM labels", "canvases reach labels")
def _(s, d):
    return regions.label(canvases(s, d))


@query("region_stats", "asset:long rid:long idx:long area:long perimeter:long x0:long y0:long w:long h:long compactness:double excess:double", "SELECT *, dense_rank() OVER (PARTITION BY asset ORDER BY root) - 1 AS rid, perimeter * perimeter / area AS compactness, perimeter / (2 * (w + h)) AS excess FROM region_stats", "canvases reach labels region_stats")
def _(s, d):
    return regions.stats(regions.label(canvases(s, d)))


@query("region_adjacency", "asset:long a:long b:long a_idx:long b_idx:long", "SELECT * FROM adjacent", "canvases reach labels adjacent")
def _(s, d):
    return regions.adjacency(regions.label(canvases(s, d)))


@query("diagonal_same_colour", "asset:long a:long b:long a_idx:long", "SELECT * FROM diagonal WHERE a_idx = b_idx", "canvases reach labels diagonal")
def _(s, d):
    return regions.diagonal_pairs(regions.label(canvases(s, d))).where("a_idx = b_idx")


@query("corner_touching", "asset:long a:long b:long", "SELECT asset, a, b FROM diagonal EXCEPT SELECT asset, a, b FROM adjacent", "canvases reach labels adjacent diagonal")
def _(s, d):
    return regions.corner_touching(regions.label(canvases(s, d)))


_HOLES = "hole_reach(asset, x, y, root) AS (SELECT asset, x, y, y * 8 + x FROM canvases WHERE idx = 0 UNION SELECT c.asset, c.x, c.y, r.root FROM hole_reach r JOIN canvases c ON c.asset = r.asset AND c.idx = 0 AND greatest(abs(c.x - r.x), abs(c.y - r.y)) = 1)"


@query("euler", "asset:long components:long holes:long chi:long", f"WITH RECURSIVE {_HOLES}, m_reach(asset, x, y, root) AS (SELECT asset, x, y, y * 8 + x FROM canvases WHERE idx <> 0 UNION SELECT c.asset, c.x, c.y, r.root FROM m_reach r JOIN canvases c ON c.asset = r.asset AND c.idx <> 0 AND abs(c.x - r.x) + abs(c.y - r.y) = 1), p AS (SELECT asset, count(DISTINCT root) AS components FROM (SELECT asset, x, y, min(root) AS root FROM m_reach GROUP BY 1, 2, 3) GROUP BY 1), h AS (SELECT asset, count(*) AS holes FROM (SELECT asset, root FROM (SELECT asset, x, y, min(root) AS root FROM hole_reach GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING NOT bool_or(x IN (0, 7) OR y IN (0, 7))) GROUP BY 1) SELECT a.asset, coalesce(components, 0) AS components, coalesce(holes, 0) AS holes, coalesce(components, 0) - coalesce(holes, 0) AS chi FROM (SELECT DISTINCT asset FROM canvases) a LEFT JOIN p USING (asset) LEFT JOIN h USING (asset)", "canvases")
def _(s, d):
    return regions.euler(canvases(s, d))


@query("signed_distance", "asset:long x:long y:long d:double", "SELECT * FROM signed", "canvases signed")
def _(s, d):
    return geometry.signed_distance(canvases(s, d), 8, 8)


_NC = "SELECT asset, x, y, d, coalesce(lag(d) OVER r, d) AS l, coalesce(lead(d) OVER r, d) AS rr, coalesce(lag(d) OVER c, d) AS u, coalesce(lead(d) OVER c, d) AS dn FROM signed WINDOW r AS (PARTITION BY asset, y ORDER BY x), c AS (PARTITION BY asset, x ORDER BY y)"


@query("normal_curvature", "asset:long x:long y:long nx:double ny:double curvature:double", f"SELECT asset, x, y, CASE WHEN n > 1e-6 THEN gx / n END AS nx, CASE WHEN n > 1e-6 THEN gy / n END AS ny, 4 * d - l - rr - u - dn AS curvature FROM (SELECT *, (rr - l) / 2 AS gx, (dn - u) / 2 AS gy, sqrt(pow((rr - l) / 2, 2) + pow((dn - u) / 2, 2)) AS n FROM ({_NC}))", "canvases signed")
def _(s, d):
    return geometry.normal_and_curvature(geometry.signed_distance(canvases(s, d), 8, 8))


@query("ridge_mask", "asset:long x:long y:long", f"SELECT asset, x, y FROM ({_NC}) WHERE d > 0 AND sqrt(pow((rr - l) / 2, 2) + pow((dn - u) / 2, 2)) <= 1e-6", "canvases signed")
def _(s, d):
    return geometry.ridge(geometry.signed_distance(canvases(s, d), 8, 8))


# Lint ----------------------------------------------------------------------------------------------
def _lint(rule: int, inner: str) -> str:
    return f"SELECT asset, {rule} AS rule, '{lint.severity(rule)}' AS severity, '{lint.scope(rule)}' AS scope, n FROM ({inner})"


_V = "asset:long rule:long severity:string scope:string n:long"
_BIG = "(SELECT asset, root FROM region_stats WHERE area >= {n})"
_COLOURS = "SELECT DISTINCT j.asset, least(j.a_idx, j.b_idx) AS i, greatest(j.a_idx, j.b_idx) AS k FROM adjacent j JOIN {big} p ON p.asset = j.asset AND p.root = j.a JOIN {big} q ON q.asset = j.asset AND q.root = j.b WHERE j.a_idx <> 0 AND j.b_idx <> 0"
_R = "canvases reach labels region_stats adjacent diagonal pal lab_pal"
LINT = {
    1: (_lint(1, "SELECT asset, count(*) AS n FROM canvases WHERE idx NOT IN (SELECT idx FROM pal WHERE idx < 4) GROUP BY asset"), "canvases pal", lambda s, d, lab: lint.rule_1(canvases(s, d), palette(s).where("idx < 4"))),
    3: (_lint(3, "SELECT t.asset, count(*) AS n FROM region_stats t JOIN (SELECT asset, idx FROM region_stats GROUP BY 1, 2 HAVING count(*) = 1) o ON o.asset = t.asset AND o.idx = t.idx JOIN (SELECT asset, root, min(near) AS near FROM (SELECT asset, a AS root, b_idx AS near FROM adjacent UNION ALL SELECT asset, b, a_idx FROM adjacent) WHERE near <> 0 GROUP BY 1, 2 HAVING count(DISTINCT near) = 1) z ON z.asset = t.asset AND z.root = t.root JOIN lab_pal x ON x.idx = t.idx JOIN lab_pal y ON y.idx = z.near WHERE t.area < 2 AND t.idx <> 0 AND sqrt(pow(x.l - y.l, 2) + pow(x.a_ - y.a_, 2) + pow(x.b_ - y.b_, 2)) >= 0.22 GROUP BY t.asset"), _R, lambda s, d, lab: lint.rule_3(lab, palette(s))),
    6: (_lint(6, f"SELECT c.asset, count(*) AS n FROM ({_COLOURS.format(big=_BIG.format(n=1))}) c JOIN lab_pal x ON x.idx = c.i JOIN lab_pal y ON y.idx = c.k WHERE abs(x.l - y.l) >= 0.15 AND sqrt(x.a_ * x.a_ + x.b_ * x.b_) >= 0.02 AND sqrt(y.a_ * y.a_ + y.b_ * y.b_) >= 0.02 AND least(fmod(abs(degrees(atan2(x.b_, x.a_)) - degrees(atan2(y.b_, y.a_))), 360), 360 - fmod(abs(degrees(atan2(x.b_, x.a_)) - degrees(atan2(y.b_, y.a_))), 360)) < 90 GROUP BY 1"), _R, lambda s, d, lab: lint.rule_6(lab, palette(s), gap=90.0)),
    11: (_lint(11, f"SELECT c.asset, count(*) AS n FROM ({_COLOURS.format(big=_BIG.format(n=2))}) c JOIN lab_pal x ON x.idx = c.i JOIN lab_pal y ON y.idx = c.k WHERE abs(x.l - y.l) < 0.15 GROUP BY 1"), _R, lambda s, d, lab: lint.rule_11(lab, palette(s), 2, 0.15)),
    16: (_lint(16, "SELECT t.asset, count(*) AS n FROM shares t JOIN lab_pal p ON p.idx = t.idx WHERE t.area / t.total >= 0.25 AND (sqrt(p.a_ * p.a_ + p.b_ * p.b_) > 0.16 OR p.l > 0.85) GROUP BY 1"), "canvases areas shares pal lab_pal", lambda s, d, lab: lint.rule_16(canvases(s, d), palette(s))),
    20: (_lint(20, f"SELECT c.asset, count(*) AS n FROM (SELECT asset, a, b FROM diagonal WHERE a_idx <> 0 AND b_idx <> 0 EXCEPT SELECT asset, a, b FROM adjacent) c JOIN {_BIG.format(n=3)} p ON p.asset = c.asset AND p.root = c.a JOIN {_BIG.format(n=3)} q ON q.asset = c.asset AND q.root = c.b GROUP BY 1"), _R, lambda s, d, lab: lint.rule_20(lab, 3)),
    21: (_lint(21, f"SELECT c.asset, count(*) AS n FROM diagonal c JOIN {_BIG.format(n=2)} p ON p.asset = c.asset AND p.root = c.a JOIN {_BIG.format(n=2)} q ON q.asset = c.asset AND q.root = c.b WHERE c.a_idx = c.b_idx AND c.a_idx <> 0 GROUP BY 1"), _R, lambda s, d, lab: lint.rule_21(lab, 2)),
}
for _n, (_sql, _uses, _make) in LINT.items():
    query(f"lint_rule_{_n}", _V, _sql, _uses)(lambda s, d, make=_make: make(s, d, regions.label(canvases(s, d))))


@query("lint_union_report", "rule:long severity:string scope:string assets:long violations:long", "SELECT rule, severity, scope, count(*) AS assets, sum(n) AS violations FROM (" + " UNION ALL ".join(q for q, _, _ in LINT.values()) + ") GROUP BY 1, 2, 3", "canvases reach labels region_stats adjacent diagonal areas shares pal lab_pal")
def _(s, d):
    lab = regions.label(canvases(s, d))  # one relation for all rules, so that its shuffle is reused
    return lint.report([make(s, d, lab) for _, _, make in LINT.values()])


@query("lint_rule_18", "idx:long l:double", "SELECT idx, l FROM lab_pal WHERE idx <> 0 AND l <= 0.06 AND sqrt(a_ * a_ + b_ * b_) <= 0.01", "pal lab_pal")
def _(s, d):
    return lint.rule_18(palette(s))


@query("lint_rule_19", _V, f"WITH RECURSIVE m_reach(asset, x, y, root) AS (SELECT asset, x, y, y * 8 + x FROM canvases WHERE idx <> 0 UNION SELECT c.asset, c.x, c.y, r.root FROM m_reach r JOIN canvases c ON c.asset = r.asset AND c.idx <> 0 AND abs(c.x - r.x) + abs(c.y - r.y) = 1), m AS (SELECT asset, x, y, min(root) AS root FROM m_reach GROUP BY 1, 2, 3), i AS (SELECT a.asset, a.root, count(*) AS n FROM m a JOIN m b ON a.asset = b.asset AND a.root = b.root AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY 1, 2), t AS (SELECT asset, root, count(*) AS area, 2 * (max(x) - min(x) + max(y) - min(y) + 2) AS box FROM m GROUP BY 1, 2) SELECT asset, 19 AS rule, 'advisory' AS severity, 'keyframe' AS scope, count(*) AS n FROM t JOIN i USING (asset, root) WHERE area >= 8 AND (4 * area - 2 * n) / box > 1.2 GROUP BY 1", "canvases")
def _(s, d):
    return lint.rule_19(regions.label(canvases(s, d).withColumn("_m", F.when(F.col("idx") != 0, 1)), value="_m"))


_PAIRS = "SELECT asset, wx, wy, count(*) AS pairs, count(*) FILTER (WHERE u <> v) AS swaps FROM (SELECT a.asset, a.x // 4 AS wx, a.y // 4 AS wy, a.idx AS u, b.idx AS v FROM canvases a JOIN canvases b ON a.asset = b.asset AND a.x // 4 = b.x // 4 AND a.y // 4 = b.y // 4 AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))) GROUP BY 1, 2, 3"
_TOPS = "SELECT asset, wx, wy, sum(n) AS total, count(*) AS colours, max(idx) FILTER (WHERE k = 1) AS a, max(idx) FILTER (WHERE k = 2) AS b, sum(n) FILTER (WHERE k <= 2) AS two FROM (SELECT *, row_number() OVER (PARTITION BY asset, wx, wy ORDER BY n DESC, idx) AS k FROM (SELECT asset, x // 4 AS wx, y // 4 AS wy, idx, count(*) AS n FROM canvases GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3"
_WINDOWS = f"SELECT t.asset, t.wx, t.wy, a, b, total, pairs, swaps FROM ({_TOPS}) t JOIN ({_PAIRS}) p ON p.asset = t.asset AND p.wx = t.wx AND p.wy = t.wy WHERE colours >= 2 AND two >= 0.6 * total AND swaps >= 0.40 * pairs"


@query("dither_windows", "asset:long wx:long wy:long a:long b:long total:long pairs:long swaps:long", _WINDOWS, "canvases")
def _(s, d):
    return lint.dither_windows(canvases(s, d), SMALL)


@query("dither_ratio", "asset:long ratio:double", f"SELECT c.asset, coalesce(w.n, 0) / c.n AS ratio FROM (SELECT asset, count(*) AS n FROM canvases GROUP BY 1) c LEFT JOIN (SELECT asset, sum(total) AS n FROM ({_WINDOWS}) GROUP BY 1) w USING (asset)", "canvases")
def _(s, d):
    return lint.dither_ratio(canvases(s, d), SMALL)


@query("pillow_corr", "asset:long corr:double pixels:long", "SELECT s.asset, CASE WHEN count(*) > 1 AND stddev_pop(s.d) > 0 AND stddev_pop(p.l) > 0 THEN corr(s.d, p.l) END AS corr, count(*) AS pixels FROM signed s JOIN canvases c ON c.asset = s.asset AND c.x = s.x AND c.y = s.y JOIN lab_pal p ON p.idx = c.idx WHERE s.d > 0 GROUP BY 1", "canvases signed pal lab_pal")
def _(s, d):
    return lint.pillow(canvases(s, d), palette(s), 8, 8)


# Sequences -----------------------------------------------------------------------------------------
@query("ease_total", "asset:long total_ms:long n:long", "SELECT asset, sum(greatest(round(CASE WHEN frame IN (1, m) THEN 2 ELSE 1 END * 1000 / 12.0), 1)) AS total_ms, count(*) AS n FROM (SELECT DISTINCT asset, frame, max(frame) OVER (PARTITION BY asset) AS m FROM frames) GROUP BY 1", "frames")
def _(s, d):
    return sequence.ease_total(frames(s, d))


_BOX = "SELECT asset, frame, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM frames WHERE idx <> 0 GROUP BY 1, 2"


@query("lint_seq_27", "asset:long frame:long error:double", f"SELECT asset, frame, abs(w * h - pw * ph) / (pw * ph) AS error FROM (SELECT *, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM ({_BOX}) WINDOW o AS (PARTITION BY asset ORDER BY frame)) WHERE (w - pw) * (h - ph) < 0 AND abs(w * h - pw * ph) / (pw * ph) > 0.05", "frames")
def _(s, d):
    return sequence.volume_changes(frames(s, d))


@query("lint_seq_26", "asset:long frame:long changed:long", "SELECT asset, frame, count(*) AS changed FROM (SELECT *, lag(idx) OVER (PARTITION BY asset, x, y ORDER BY frame) AS was FROM frames WHERE y = 3) WHERE was <> idx GROUP BY 1, 2", "frames")
def _(s, d):
    return sequence.exclusion_changes(frames(s, d), 3)


@query("lint_seq_23", "asset:long n:long mean_area:double ratio:double", "SELECT f.asset, n, mean_area, n / mean_area AS ratio FROM (SELECT asset, count(*) AS n FROM (SELECT asset, x, y FROM (SELECT *, CASE WHEN lag(idx <> 0) OVER (PARTITION BY asset, x, y ORDER BY frame) <> (idx <> 0) THEN 1 ELSE 0 END AS flip FROM frames) GROUP BY 1, 2, 3 HAVING sum(flip) >= 2) GROUP BY 1) f JOIN (SELECT asset, avg(a) AS mean_area FROM (SELECT asset, frame, count(*) FILTER (WHERE idx <> 0) AS a FROM frames GROUP BY 1, 2) GROUP BY 1) m USING (asset) WHERE n / mean_area > 0.01", "frames")
def _(s, d):
    return sequence.wobble(frames(s, d))


_VRUN = "SELECT asset, frame, x, run, min(y) AS start, count(*) AS len FROM (SELECT *, sum(nw) OVER (PARTITION BY asset, frame, x ORDER BY y) AS run FROM (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY asset, frame, x ORDER BY y) = y - 1 THEN 0 ELSE 1 END AS nw FROM frames WHERE idx <> 0)) GROUP BY 1, 2, 3, 4"


@query("isolated_column_runs", "asset:long frame:long orphans:long", f"SELECT r.asset, r.frame, count(*) AS orphans FROM ({_VRUN}) r LEFT JOIN frames p ON p.asset = r.asset AND p.frame = r.frame - 1 AND p.x = r.x AND p.y = r.start AND p.idx <> 0 WHERE r.len < 2 AND r.frame > 1 AND p.asset IS NULL GROUP BY 1, 2", "frames")
def _(s, d):
    return sequence.orphan_columns(frames(s, d))


@query("smear_union", "asset:long frame:long area:long", "SELECT asset, frame, count(*) AS area FROM (SELECT DISTINCT f.asset, f.frame, p.x, p.y FROM (SELECT DISTINCT asset, frame FROM frames WHERE idx <> 0) f JOIN frames p ON p.asset = f.asset AND p.frame BETWEEN f.frame - 2 AND f.frame AND p.idx <> 0) GROUP BY 1, 2", "frames")
def _(s, d):
    return canvas.union_of_frames(frames(s, d), 2).groupBy("asset", "frame").agg(F.count("*").alias("area"))


@query("afterimage", "asset:long frame:long age:long pixels:long", "SELECT asset, frame, age, count(*) AS pixels FROM (SELECT f.asset, f.frame, p.x, p.y, min(f.frame - p.frame) AS age FROM (SELECT DISTINCT asset, frame FROM frames WHERE idx <> 0) f JOIN frames p ON p.asset = f.asset AND p.frame BETWEEN f.frame - 2 AND f.frame - 1 AND p.idx <> 0 LEFT JOIN frames o ON o.asset = f.asset AND o.frame = f.frame AND o.x = p.x AND o.y = p.y AND o.idx <> 0 WHERE o.asset IS NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3", "frames")
def _(s, d):
    return canvas.afterimage(frames(s, d), 2).groupBy("asset", "frame", "age").agg(F.count("*").alias("pixels"))


@query("onion_counts", "asset:long frame:long n:long pixels:long", "SELECT asset, frame, n, count(*) AS pixels FROM (SELECT *, count(*) OVER (PARTITION BY asset, x, y ORDER BY frame RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM frames WHERE idx <> 0) GROUP BY 1, 2, 3", "frames")
def _(s, d):
    return sequence.onion_counts(frames(s, d))


_FD = "SELECT m.asset, m.frame, m.x, m.y, (CASE WHEN m.idx <> 0 THEN 1 ELSE -1 END) * least(coalesce(min(3 * greatest(abs(m.x - o.x), abs(m.y - o.y)) + least(abs(m.x - o.x), abs(m.y - o.y))), 99), 3 * least(m.x + 1, m.y + 1, 8 - m.x, 8 - m.y)) / 3.0 AS d FROM frames m LEFT JOIN frames o ON o.asset = m.asset AND o.frame = m.frame AND (o.idx <> 0) <> (m.idx <> 0) GROUP BY m.asset, m.frame, m.x, m.y, m.idx"


@query("tween_mask", "asset:long frame:long area:long", f"WITH fd AS ({_FD}) SELECT a.asset, a.frame, count(*) AS area FROM fd a JOIN fd b ON b.asset = a.asset AND b.frame = a.frame + 1 AND b.x = a.x AND b.y = a.y WHERE 0.5 * a.d + 0.5 * b.d > 0 GROUP BY 1, 2", "frames")
def _(s, d):
    return sequence.tween_mask(frames(s, d), 8, 8)


@query("reverse_loop", "asset:long new_frame:long source:long", "SELECT asset, frame AS new_frame, frame AS source FROM (SELECT DISTINCT asset, frame FROM frames) UNION ALL SELECT asset, 2 * m - frame, frame FROM (SELECT DISTINCT asset, frame, max(frame) OVER (PARTITION BY asset) AS m FROM frames) WHERE frame > 1 AND frame < m", "frames")
def _(s, d):
    return sequence.reversed_loop(frames(s, d))


@query("lint_seq_22", "asset:long frame:long chi:long before:long after:long")
def _(s, d):
    return sequence.topology_breaks(frames(s, d))


# Tiles ---------------------------------------------------------------------------------------------
def _tile_sql(size: int) -> str:
    return f"SELECT asset, x // {size} AS tx, y // {size} AS ty, list(idx ORDER BY y, x) AS tile FROM dense GROUP BY 1, 2, 3 HAVING count(*) = {size * size}"


def _form_sql(size: int, f: int) -> str:
    return "[" + ", ".join(f"tile[{p + 1}]" for p in tiles._place(size, f)) + "]"


def _canon_sql(size: int, mode: str) -> str:
    forms = [_form_sql(size, f) for f in tiles.MODES[mode]]
    return forms[0] if len(forms) == 1 else f"list_min([{', '.join(forms)}])"


for _mode in tiles.MODES:
    query(f"tile_extract_{_mode.replace('-', '_')}", "asset:long tx:long ty:long tile_id:long", f"SELECT asset, tx, ty, dense_rank() OVER (PARTITION BY asset ORDER BY first) - 1 AS tile_id FROM (SELECT *, min(ty * 1000 + tx) OVER (PARTITION BY asset, canon) AS first FROM (SELECT *, {_canon_sql(2, _mode)} AS canon FROM ({_tile_sql(2)})))", "dense")(lambda s, d, m=_mode: tiles.extract(dense(s, d), 2, m))


@query("tile_rebuild", "asset:long x:long y:long idx:long", "SELECT * FROM dense WHERE (asset, x // 4, y // 4) IN (SELECT (asset, x // 4, y // 4) FROM dense GROUP BY asset, x // 4, y // 4 HAVING count(*) = 16)", "dense")
def _(s, d):
    return tiles.rebuild(tiles.extract(dense(s, d), 4, "flip-rotate"), 4, "flip-rotate")


@query("mirror_reliant", "asset:long reliant:long canonical:long", f"SELECT asset, sum(f - 1) AS reliant, count(*) AS canonical FROM (SELECT asset, canon, count(DISTINCT tile) AS f FROM (SELECT *, {_canon_sql(2, 'flip-rotate')} AS canon FROM ({_tile_sql(2)})) GROUP BY 1, 2) GROUP BY 1", "dense")
def _(s, d):
    return tiles.mirror_reliant(dense(s, d), 2)


@query("colours_per_tile", "asset:long tx:long ty:long colours:long", "SELECT asset, x // 8 AS tx, y // 8 AS ty, count(DISTINCT idx) AS colours FROM dense WHERE idx <> 0 GROUP BY 1, 2, 3 HAVING count(DISTINCT idx) > 4", "dense")
def _(s, d):
    return tiles.colours_per_tile(dense(s, d), 8, 4)


_PROFILES = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {v[0] or 'NULL'}, {v[1]}, {v[2]}, {v[3]}, {v[4]}, {1000.0 / v[5]!r})" for n, v in tiles.PROFILES.items()) + ") AS t(profile, most, per_tile, tile, mw, mh, period)"
_VALID = (
    f"WITH p AS ({_PROFILES}), z AS (SELECT asset, max(x) + 1 AS w, max(y) + 1 AS h FROM dense GROUP BY 1) SELECT asset, profile, 'tile_size' AS constraint_name, 1 AS n FROM z, p WHERE w % tile <> 0 OR h % tile <> 0 UNION ALL SELECT asset, profile, 'size', 1 FROM z, p WHERE w > mw OR h > mh "
    "UNION ALL SELECT asset, profile, 'colours', 1 FROM z, p WHERE (SELECT count(*) FROM pal) > most UNION ALL SELECT asset, profile, 'tile_colours', count(*) FROM (SELECT asset, profile FROM dense, p GROUP BY asset, profile, x // tile, y // tile, per_tile HAVING count(DISTINCT idx) > per_tile) GROUP BY 1, 2"
)


@query("validate_profiles", "asset:long profile:string constraint_name:string n:long", _VALID, "dense pal")
def _(s, d):
    return tiles.validate(dense(s, d), palette(s)).withColumnRenamed("constraint", "constraint_name")


@query("validate_timing", "asset:long profile:string constraint_name:string n:long", f"SELECT user_id AS asset, profile, 'frame_ms' AS constraint_name, count(*) AS n FROM (SELECT user_id, CAST(floor(abs(value)) AS BIGINT) AS ms FROM events) e, ({_PROFILES}) p WHERE ms > 0 AND round(abs(ms - greatest(round(ms / period), 1) * period), 9) > 1 GROUP BY 1, 2")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("asset"), F.floor(F.abs("value")).cast("long").alias("ms"))
    return tiles.check_timing(e).withColumnRenamed("constraint", "constraint_name")


@query("downscale_modal", "asset:long x:long y:long idx:long", "SELECT asset, x, y, idx FROM (SELECT *, row_number() OVER (PARTITION BY asset, x, y ORDER BY n DESC, idx DESC) AS k, sum(n) OVER (PARTITION BY asset, x, y) AS cells FROM (SELECT asset, x // 4 AS x, y // 4 AS y, idx, count(*) AS n FROM dense GROUP BY 1, 2, 3, 4)) WHERE k = 1 AND cells = 16", "dense")
def _(s, d):
    return tiles.downscale_modal(dense(s, d), 4)


def _votes_sql(source: str, window: int, ks: list[int]) -> str:
    blocks = " UNION ALL ".join(f"SELECT asset, wx, wy, {k} AS k FROM (SELECT asset, x // {window} AS wx, y // {window} AS wy, min(idx) = max(idx) AS one FROM {source} GROUP BY asset, x // {window}, y // {window}, x // {k}, y // {k}) GROUP BY 1, 2, 3 HAVING bool_and(one)" for k in ks)
    return f"SELECT f.asset, f.wx, f.wy, CASE WHEN NOT flat THEN k END AS k FROM (SELECT asset, x // {window} AS wx, y // {window} AS wy, min(idx) = max(idx) AS flat FROM {source} GROUP BY 1, 2, 3) f JOIN (SELECT asset, wx, wy, max(k) AS k FROM ({blocks}) GROUP BY 1, 2, 3) b ON b.asset = f.asset AND b.wx = f.wx AND b.wy = f.wy"


@query("mixel_votes", "asset:long wx:long wy:long k:long", _votes_sql("canvases", 4, [1, 2, 4]), "canvases")
def _(s, d):
    return tiles.mixel_votes(canvases(s, d), 4, 4)


@query("uniformity", "asset:long scale:long share:double", f"SELECT asset, max_by(k, n * 100 - k) AS scale, max(n) / sum(n) AS share FROM (SELECT asset, k, count(*) AS n FROM ({_votes_sql('canvases', 2, [1, 2])}) WHERE k IS NOT NULL GROUP BY 1, 2) GROUP BY 1", "canvases")
def _(s, d):
    return grid.uniformity(tiles.mixel_votes(canvases(s, d), 2, 2))


@query("autotile_masks", "mask:long tile:long", "SELECT mask, row_number() OVER (ORDER BY mask) - 1 AS tile FROM (SELECT DISTINCT (raw & 15) + CASE WHEN raw & 3 = 3 THEN raw & 16 ELSE 0 END + CASE WHEN raw & 6 = 6 THEN raw & 32 ELSE 0 END + CASE WHEN raw & 12 = 12 THEN raw & 64 ELSE 0 END + CASE WHEN raw & 9 = 9 THEN raw & 128 ELSE 0 END AS mask FROM (SELECT unnest(range(0, 256)) AS raw))")
def _(s, d):
    return tiles.autotile_masks(s)


@query("sheet_pack", "asset:long px:long py:long cw:long ch:long", "SELECT asset, n % 16 * (cw + 1) AS px, n // 16 * (ch + 1) AS py, cw, ch FROM (SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS n, max(w) OVER () AS cw, max(h) OVER () AS ch FROM (SELECT asset, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM canvases WHERE idx <> 0 GROUP BY 1))", "canvases")
def _(s, d):
    return tiles.sheet_pack(canvas.bbox(canvases(s, d)), 16)


@query("tiled_gid", "asset:long x:long y:long gid:long", "SELECT asset, x, y, (idx + 1) | (CASE WHEN x % 2 = 0 THEN 2147483648 ELSE 0 END) | (CASE WHEN y % 2 = 0 THEN 1073741824 ELSE 0 END) | (CASE WHEN x > y THEN 536870912 ELSE 0 END) AS gid FROM canvases", "canvases")
def _(s, d):
    return canvases(s, d).withColumn("gid", tiles.gid(F.col("idx"), F.col("x") % 2 == 0, F.col("y") % 2 == 0, F.col("x") > F.col("y")))


# Grid ----------------------------------------------------------------------------------------------
_CELLS = "SELECT asset, s, dx, dy, avg(b / n - (a / n) * (a / n)) AS v FROM (SELECT asset, s, dx, dy, count(*) AS n, sum(idx) AS a, sum(idx * idx) AS b FROM canvases, (SELECT unnest(range(2, 5)) AS s) z, (SELECT unnest(range(0, 4)) AS dx) p, (SELECT unnest(range(0, 4)) AS dy) q WHERE dx < s AND dy < s GROUP BY asset, s, dx, dy, floor((x - dx) / s), floor((y - dy) / s)) WHERE n = s * s GROUP BY 1, 2, 3, 4"
_BEST = f"SELECT asset, s, dx, dy, v FROM (SELECT *, row_number() OVER (PARTITION BY asset, s ORDER BY round(v, 9), dy, dx) AS k FROM ({_CELLS})) WHERE k = 1"


@query("cell_variance", "asset:long s:long dx:long dy:long v:double", _CELLS, "canvases")
def _(s, d):
    return grid.cell_variance(canvases(s, d), 4)


@query("best_phase", "asset:long s:long dx:long dy:long v:double", _BEST, "canvases")
def _(s, d):
    return grid.best_phase(grid.cell_variance(canvases(s, d), 4))


@query("grid_confidence", "asset:long hat:long confidence:double", f"WITH best AS ({_BEST}), iv AS (SELECT asset, var_pop(idx) AS iv FROM canvases GROUP BY 1), hat AS (SELECT asset, max(s) AS hat, max_by(v, s) AS hv, any_value(iv) AS iv FROM best JOIN iv USING (asset) WHERE v <= 0.9 * iv GROUP BY 1), r AS (SELECT h.asset, min(v) AS rival FROM hat h JOIN best b ON b.asset = h.asset AND b.s > h.hat AND b.s % h.hat <> 0 GROUP BY 1) SELECT asset, hat, least(greatest(coalesce((rival - hv) / iv, 0.0), 0.0), 1.0) AS confidence FROM hat LEFT JOIN r USING (asset)", "canvases")
def _(s, d):
    c = canvases(s, d)
    return grid.confidence(grid.best_phase(grid.cell_variance(c, 4)), grid.image_variance(c))


_EDGE = "SELECT asset, x, sum(e) AS e FROM (SELECT asset, x, abs(idx - lag(idx) OVER (PARTITION BY asset, y ORDER BY x)) AS e FROM dense) WHERE e IS NOT NULL GROUP BY 1, 2"


@query("autocorr_scales", "asset:long k:long r:double", f"WITH c AS (SELECT asset, x, e - avg(e) OVER (PARTITION BY asset) AS c FROM ({_EDGE})) SELECT n.asset, k, n / den AS r FROM (SELECT a.asset, k, sum(a.c * b.c) AS n FROM c b, (SELECT unnest(range(1, 9)) AS k) z JOIN c a ON TRUE WHERE a.asset = b.asset AND a.x = b.x + k GROUP BY 1, 2) n JOIN (SELECT asset, sum(c * c) AS den FROM c GROUP BY 1) d ON d.asset = n.asset", "dense")
def _(s, d):
    return grid.autocorrelation(dense(s, d), 8)


# Calibration ---------------------------------------------------------------------------------------
_OUT = f"SELECT *, {calibration.outcome_sql(0.03)} AS o, {calibration.outcome_sql()} AS raw FROM sweep"


@query("calib_summary", "param_id:long n:long correct_rate:double grid_n:long exact_rate:double scale_rate:double false_reject_rate:double reject_rate:double macro_rate:double", f"SELECT *, (exact_rate + reject_rate) / 2 AS macro_rate FROM (SELECT param_id, count(*) AS n, avg(CAST(o IN ('exact', 'correct_rejection') AS INTEGER)) AS correct_rate, count(*) FILTER (WHERE has_grid) AS grid_n, avg(CAST(o = 'exact' AS INTEGER)) FILTER (WHERE has_grid) AS exact_rate, avg(CAST(o IN ('exact', 'scale_only') AS INTEGER)) FILTER (WHERE has_grid) AS scale_rate, avg(CAST(o = 'rejected' AS INTEGER)) FILTER (WHERE has_grid) AS false_reject_rate, avg(CAST(o = 'correct_rejection' AS INTEGER)) FILTER (WHERE NOT has_grid) AS reject_rate FROM ({_OUT}) GROUP BY 1)", "sweep")
def _(s, d):
    return calibration.summary(sweep(s, d), 0.03)


@query("ece", "param_id:long ece:double", f"SELECT param_id, sum(abs(ok - c / 10.0)) / sum(n) AS ece FROM (SELECT param_id, least(conf_bin, 9) AS b, count(*) AS n, count(*) FILTER (WHERE raw IN ('exact', 'correct_rejection')) AS ok, sum(conf_bin) AS c FROM ({_OUT}) WHERE found GROUP BY 1, 2) GROUP BY 1", "sweep")
def _(s, d):
    return calibration.ece(sweep(s, d))


_CURVE = f"SELECT param_id, step, count(*) FILTER (WHERE found AND conf_bin * 10 >= step) AS covered, count(*) FILTER (WHERE found AND conf_bin * 10 >= step) / count(*) AS coverage, CASE WHEN count(*) FILTER (WHERE found AND conf_bin * 10 >= step) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE found AND conf_bin * 10 >= step AND raw <> 'exact') / count(*) FILTER (WHERE found AND conf_bin * 10 >= step) END AS risk FROM ({_OUT}), (SELECT unnest(range(0, 101)) AS step) t GROUP BY 1, 2"


@query("risk_coverage", "param_id:long step:long covered:long coverage:double risk:double", _CURVE, "sweep")
def _(s, d):
    return calibration.risk_coverage(sweep(s, d))


@query("operating_point", "param_id:long step:long coverage:double risk:double", f"SELECT param_id, min(step) AS step, min_by(coverage, step) AS coverage, min_by(risk, step) AS risk FROM ({_CURVE}) WHERE covered > 0 AND round(risk, 9) <= 0.98 GROUP BY 1", "sweep")
def _(s, d):
    return calibration.operating_point(calibration.risk_coverage(sweep(s, d)), 0.02)


@query("tiers_rollup", "split:string tier:string n:long exact:long", f"SELECT split, tier, count(*) AS n, count(*) FILTER (WHERE raw = 'exact') AS exact FROM (SELECT *, CASE WHEN filter = 'nearest' THEN 'A' WHEN filter IN ('bilinear', 'bicubic') THEN 'B' ELSE 'C' END AS tier FROM ({_OUT}) WHERE has_grid) GROUP BY ROLLUP (split, tier)", "sweep")
def _(s, d):
    return calibration.tiers(sweep(s, d))


@query("best_threshold", "param_id:long conf_bin:long score:double", f"SELECT param_id, conf_bin, score FROM (SELECT *, row_number() OVER (PARTITION BY param_id ORDER BY score DESC, conf_bin) AS k FROM (SELECT param_id, conf_bin, round(((sum(p) OVER w - coalesce(sum(p) OVER u, 0)) / sum(p) OVER w + coalesce(sum(q) OVER u, 0) / sum(q) OVER w) / 2, 9) AS score, sum(p) OVER w AS tp, sum(q) OVER w AS tq FROM (SELECT param_id, conf_bin, count(*) FILTER (WHERE raw = 'exact') AS p, count(*) FILTER (WHERE raw <> 'exact') AS q FROM ({_OUT}) WHERE found GROUP BY 1, 2) WINDOW w AS (PARTITION BY param_id), u AS (PARTITION BY param_id ORDER BY conf_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE tp > 0 AND tq > 0) WHERE k = 1", "sweep")
def _(s, d):
    return calibration.best_threshold(sweep(s, d))


@query("quartiles_nearest_rank", "filter:string q1:long median:long q3:long n:long", "SELECT filter, l[CAST(floor((len(l) - 1) * 0.25 + 0.5) AS INTEGER) + 1] AS q1, l[CAST(floor((len(l) - 1) * 0.5 + 0.5) AS INTEGER) + 1] AS median, l[CAST(floor((len(l) - 1) * 0.75 + 0.5) AS INTEGER) + 1] AS q3, len(l) AS n FROM (SELECT filter, list(conf_bin ORDER BY conf_bin) AS l FROM sweep WHERE found GROUP BY 1)", "sweep")
def _(s, d):
    return calibration.quartiles(sweep(s, d).where("found"), "conf_bin", ("filter",))


@query("factorial_dataset", "item_id:long scale:long filter:string resize:string compression:string split:string has_grid:boolean", "SELECT i AS item_id, [2, 3, 4, 6, 8, 12][i % 6 + 1] AS scale, ['nearest', 'bilinear', 'bicubic', 'lanczos'][i // 6 % 4 + 1] AS filter, ['keep', 'x0.9', 'x1.1'][i // 24 % 3 + 1] AS resize, ['none', 'q90', 'q75', 'q50'][i // 72 % 4 + 1] AS compression, CASE WHEN i % 5 < 3 THEN 'validation' ELSE 'test' END AS split, i // 24 % 3 = 0 AS has_grid FROM (SELECT unnest(range(0, 500)) AS i)")
def _(s, d):
    return calibration.factorial(s)


@query("param_grid", "param_id:long epsilon:double delta:double tau:double", "SELECT e.k * 6 + f.k * 2 + t.k AS param_id, epsilon, delta, tau FROM (VALUES (0, 0.1), (1, 0.15), (2, 0.2)) e(k, epsilon), (VALUES (0, 0.1), (1, 0.15), (2, 0.3)) f(k, delta), (VALUES (0, 0.05), (1, 0.1)) t(k, tau)")
def _(s, d):
    return calibration.param_grid(s, {"epsilon": [0.1, 0.15, 0.2], "delta": [0.1, 0.15, 0.3], "tau": [0.05, 0.1]})


# Recipes, streams, kernels and files ---------------------------------------------------------------
from rasterlake.operators import kernels  # noqa: E402
from rasterlake.plans import recipe  # noqa: E402
from rasterlake.sources import palettes  # noqa: E402
from rasterlake.streaming import watch  # noqa: E402


@query("debounce_sessions", "user_id:long start:string last:string n:long", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events)) GROUP BY user_id, g")
def _(s, d):
    b = watch.bursts(s.read.parquet(f"{d}/events.parquet"), "6 hours")
    return b.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


@query("event_windows", "start:string event_type:string n:long total:double", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return watch.windows(s.read.parquet(f"{d}/events.parquet")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


_EDGES = "SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || n_nationkey, 's' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT 'r' || r_regionkey, 's' || s_suppkey FROM region JOIN supplier ON s_suppkey % 5 = r_regionkey"


def _edges(s, d):
    r, n, u = (s.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).select(name("r", "r_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    b = n.join(u, F.col("s_nationkey") == F.col("n_nationkey")).select(name("n", "n_nationkey").alias("src"), name("s", "s_suppkey").alias("dst"))
    c = r.join(u, F.col("s_suppkey") % 5 == F.col("r_regionkey")).select(name("r", "r_regionkey").alias("src"), name("s", "s_suppkey").alias("dst"))
    return a.unionByName(b).unionByName(c)


@query("dag_levels", "step:string level:long", f"WITH RECURSIVE e AS ({_EDGES}), w(step, level) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.step) SELECT step, max(level) AS level FROM w GROUP BY 1")
def _(s, d):
    from rasterlake.plans import relations

    return relations.levels(_edges(s, d))


@query("dag_sinks", "step:string", f"WITH e AS ({_EDGES}) SELECT DISTINCT dst AS step FROM e WHERE dst NOT IN (SELECT src FROM e)")
def _(s, d):
    e = _edges(s, d)
    return e.select(F.col("dst").alias("step")).distinct().join(e.select(F.col("src").alias("step")), "step", "left_anti")


@query("dag_ancestry", "step:string ancestor:string", f"WITH RECURSIVE e AS ({_EDGES}), w(step, ancestor) AS (SELECT dst, src FROM e UNION SELECT e.dst, w.ancestor FROM w JOIN e ON e.src = w.step) SELECT step, ancestor FROM w")
def _(s, d):
    from rasterlake.plans import relations

    return relations.ancestry(_edges(s, d))


@query("recipe_expression", "asset:long x:long y:long v:string", "SELECT asset, x, y, CASE WHEN idx > 2 THEN 'high' || CAST(idx * 2 AS VARCHAR) ELSE 'low' || CAST(x % 3 - 3 AS VARCHAR) END AS v FROM canvases", "canvases")
def _(s, d):
    e = recipe.parse("idx > 2 ? 'high' + idx * 2 : 'low' + (x % 3 + -7 / 2)")
    return canvases(s, d).withColumn("v", recipe.to_column(e, {"idx": "int", "x": "int"}))


@query("hex_lines", "idx:long value:string", "SELECT idx, printf('%02x%02x%02x', r, g, b) AS value FROM pal", "pal")
def _(s, d):
    return palettes.hex_lines(palette(s))


@query("contour_trace", "asset:long contour:long hole:boolean seq:long x:long y:long")
def _(s, d):
    return kernels.contours(canvases(s, d))


@query("error_diffusion", "asset:long x:long y:long idx:long")
def _(s, d):
    return kernels.diffuse(canvases(s, d).withColumn("v", F.col("idx") / 4.0), [0.0, 0.5, 1.0])


# Composition, shading and air ----------------------------------------------------------------------
from rasterlake.operators import compose  # noqa: E402

_LAYERS = "SELECT asset // 4 AS asset, CAST(asset % 4 AS INTEGER) AS layer, x, y, idx FROM canvases"


def _layers(s, d):
    return canvases(s, d).selectExpr("asset div 4 AS asset", "cast(asset % 4 as int) AS layer", "x", "y", "idx")


@query("compose_stack", "asset:long x:long y:long idx:long", f"SELECT asset, x, y, max_by(idx, layer) AS idx FROM (SELECT asset, layer, x - layer AS x, y - layer AS y, idx FROM ({_LAYERS}) WHERE idx <> 0) WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY 1, 2, 3", "canvases")
def _(s, d):
    l = _layers(s, d)  # noqa: E741
    anchors = l.select("asset", "layer").distinct().withColumn("ax", F.col("layer") + 2).withColumn("ay", F.col("layer") + 1)
    return compose.stack(l, anchors, 8, 8)


_HAVE = "SELECT DISTINCT c_custkey // 3 AS asset, ['n', 'ne', 'e', 'se', 's', 'sw', 'w', 'nw'][CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 8 AS INTEGER) + 1] AS direction FROM customer"


@query("missing_directions", "asset:long direction:string source:string", f"WITH have AS ({_HAVE}), m(direction, source) AS (VALUES ('ne', 'nw'), ('e', 'w'), ('se', 'sw'), ('nw', 'ne'), ('w', 'e'), ('sw', 'se'), ('n', NULL), ('s', NULL)) SELECT a.asset, m.direction, h.direction AS source FROM (SELECT DISTINCT asset FROM have) a CROSS JOIN m LEFT JOIN have h ON h.asset = a.asset AND h.direction = m.source WHERE NOT EXISTS (SELECT 1 FROM have x WHERE x.asset = a.asset AND x.direction = m.direction)")
def _(s, d):
    # Three customers make an asset; each one's balance stands for a drawn direction.
    c = s.read.parquet(f"{d}/customer.parquet")
    n = F.floor(F.abs("c_acctbal")).cast("long") % 8
    names = F.array(*map(F.lit, compose.DIRECTIONS))
    return compose.missing_directions(c.select(F.expr("c_custkey div 3").alias("asset"), F.element_at(names, (n + 1).cast("int")).alias("direction")).distinct())


@query("box_blur", "asset:long x:long y:long d:double", "SELECT c.asset, c.x, c.y, sum(s.d) / 9 AS d FROM canvases c, (SELECT unnest([-1, 0, 1]) AS dx) p, (SELECT unnest([-1, 0, 1]) AS dy) q, signed s WHERE s.asset = c.asset AND s.x = least(greatest(c.x + dx, 0), 7) AND s.y = least(greatest(c.y + dy, 0), 7) GROUP BY 1, 2, 3", "canvases signed")
def _(s, d):
    return compose.box_blur(geometry.signed_distance(canvases(s, d), 8, 8), 8, 8)


@query("bounce_distance", "asset:long x:long y:long bounce:long", "SELECT m.asset, m.x, m.y, min(k) FILTER (WHERE b.asset IS NULL) - 1 AS bounce FROM (SELECT * FROM canvases WHERE idx <> 0) m CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) t LEFT JOIN (SELECT * FROM canvases WHERE idx <> 0) b ON b.asset = m.asset AND b.x = m.x AND b.y = m.y + k GROUP BY 1, 2, 3", "canvases")
def _(s, d):
    return compose.bounce_distance(canvases(s, d), 3)


@query("outline", "asset:long x:long y:long idx:long", "SELECT asset, x, y, CASE WHEN idx = 0 AND EXISTS (SELECT 1 FROM canvases o WHERE o.asset = c.asset AND o.idx <> 0 AND abs(o.x - c.x) + abs(o.y - c.y) = 1) THEN 9 ELSE idx END AS idx FROM canvases c", "canvases")
def _(s, d):
    return compose.outline(canvases(s, d), 9, 8, 8)


@query("atmosphere", "idx:long to_idx:long", "WITH m AS (SELECT p.idx, p.l * 0.6 + s.l * 0.4 AS l, p.a_ * 0.6 + s.a_ * 0.4 AS a_, p.b_ * 0.6 + s.b_ * 0.4 AS b_ FROM lab_pal p, lab_pal s WHERE s.idx = 12) SELECT idx, to_idx FROM (SELECT m.idx, p.idx AS to_idx, row_number() OVER (PARTITION BY m.idx ORDER BY round((m.l - p.l) * (m.l - p.l) + (m.a_ - p.a_) * (m.a_ - p.a_) + (m.b_ - p.b_) * (m.b_ - p.b_), 12), p.idx) AS k FROM m, lab_pal p) WHERE k = 1", "pal lab_pal")
def _(s, d):
    return compose.atmosphere(palette(s), 12, 0.4)


@query("dimetric_wall", "asset:long x:long y:long idx:long", "SELECT asset, x, y + x // 2 AS y, idx FROM canvases", "canvases")
def _(s, d):
    return compose.dimetric(canvases(s, d), 8, 8)


@query("hold_last", "asset:long frame:long x:long y:long held:long", "SELECT asset, frame, x, y, last_value(CASE WHEN idx <> 0 THEN idx END IGNORE NULLS) OVER (PARTITION BY asset, x, y ORDER BY frame ROWS UNBOUNDED PRECEDING) AS held FROM frames", "frames")
def _(s, d):
    return compose.hold_last(frames(s, d))


@query("shade_index", "asset:long x:long y:long step:long", f"SELECT asset, x, y, least(floor(t * 3 + 1e-9), 3) AS step FROM (SELECT asset, x, y, CASE WHEN n > 1e-6 THEN greatest(gx / n * 0.6 + gy / n * 0.8, 0.0) END AS t FROM (SELECT *, (rr - l) / 2 AS gx, (dn - u) / 2 AS gy, sqrt(pow((rr - l) / 2, 2) + pow((dn - u) / 2, 2)) AS n FROM ({_NC}))) WHERE t IS NOT NULL", "canvases signed")
def _(s, d):
    n = geometry.normal_and_curvature(geometry.signed_distance(canvases(s, d), 8, 8)).where("nx is not null")
    return n.withColumn("step", compose.ramp_index(compose.incidence(F.col("nx"), F.col("ny"), 0.6, 0.8), 4))


from rasterlake.plans import catalogue_rules, catalogue_replay, catalogue_paint, catalogue_grid, catalogue_place, catalogue_colour, catalogue_motion, catalogue_report, catalogue_light, catalogue_smooth, catalogue_autotile, catalogue_haze  # noqa: E402, F401  register further queries
