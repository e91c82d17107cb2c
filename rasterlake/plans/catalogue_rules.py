"""Queries of the rules that look at outlines, shading, runs, dither and motion, and of what they report."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake import views
from rasterlake.operators import grid, kernels, lint, regions, sequence, tiles
from rasterlake.plans.catalogue import _BEST, _WINDOWS, LINT, SMALL, _lint, _V, _votes_sql
from rasterlake.registry import query
from rasterlake.views import canvases, dense, frames, palette

views.SQL["near"] = "SELECT c.*, l.idx AS l, r.idx AS r, u.idx AS u, d.idx AS d FROM canvases c LEFT JOIN canvases l ON l.asset = c.asset AND l.x = c.x - 1 AND l.y = c.y LEFT JOIN canvases r ON r.asset = c.asset AND r.x = c.x + 1 AND r.y = c.y LEFT JOIN canvases u ON u.asset = c.asset AND u.x = c.x AND u.y = c.y - 1 LEFT JOIN canvases d ON d.asset = c.asset AND d.x = c.x AND d.y = c.y + 1"
_OUTLINE = "SELECT asset, idx AS outline, area FROM (SELECT *, sum(ring) OVER (PARTITION BY asset) AS total, row_number() OVER (PARTITION BY asset ORDER BY ring DESC, idx) AS k FROM (SELECT asset, idx, count(*) FILTER (WHERE l = 0 OR r = 0 OR u = 0 OR d = 0) AS ring, count(*) FILTER (WHERE l = idx AND r = idx AND u = idx AND d = idx) AS interior, count(*) AS area FROM near WHERE idx <> 0 GROUP BY 1, 2) WHERE ring > 0) WHERE k = 1 AND ring >= {share} * total AND interior <= 0.3 * area"


@query("outline_index", "asset:long outline:long area:long", _OUTLINE.format(share=0.3), "canvases near")
def _(s, d):
    return lint.outline_index(lint.around(canvases(s, d)), 0.3, 0.3)


_SQUARES = f"WITH o AS ({_OUTLINE.format(share=0.2)}), p AS (SELECT n.*, o.area FROM near n JOIN o ON o.asset = n.asset AND o.outline = n.idx), q AS (SELECT p.asset, p.x - i AS sx, p.y - j AS sy, max(area) AS area FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) GROUP BY 1, 2, 3 HAVING count(*) = 4 AND bool_or(coalesce(l = 0, false) OR coalesce(r = 0, false) OR coalesce(u = 0, false) OR coalesce(d = 0, false)) AND NOT (bool_or(coalesce(l = 0, false)) AND bool_or(coalesce(r = 0, false))) AND NOT (bool_or(coalesce(u = 0, false)) AND bool_or(coalesce(d = 0, false))))"


@query("lint_rule_4", _V, _lint(4, f"{_SQUARES} SELECT asset, count(DISTINCT (sx, sy)) AS n FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) GROUP BY 1 HAVING count(DISTINCT (sx + i, sy + j)) / max(area) BETWEEN 0.06 AND 0.7"), "canvases near")
def _(s, d):
    return lint.rule_4(canvases(s, d), 0.2, 0.3, 1)


_RAMPS = "(SELECT i // 4 AS ramp, i % 4 AS pos, (i * 7) % 16 AS idx FROM (SELECT unnest(range(0, 16)) AS i))"


@query("lint_rule_5", "ramp:long rising:boolean", f"SELECT ramp, bool_and(coalesce(up >= 0, true)) AS rising FROM (SELECT *, c - lag(c) OVER (PARTITION BY ramp ORDER BY pos) AS up FROM (SELECT r.*, round(sqrt(a_ * a_ + b_ * b_), 9) AS c FROM {_RAMPS} r JOIN lab_pal USING (idx))) GROUP BY 1 HAVING count(*) >= 3 AND (bool_and(coalesce(up >= 0, true)) OR bool_and(coalesce(up <= 0, true)))", "pal lab_pal")
def _(s, d):
    r = s.range(16).selectExpr("cast(id div 4 as int) AS ramp", "cast(id % 4 as int) AS pos", "cast(id * 7 % 16 as int) AS idx")
    return lint.rule_5(r, palette(s))


_LIGHT = (0.6, -0.8)
views.SQL["dense_light"] = "SELECT d.asset, d.x, d.y, p.l AS light FROM dense d JOIN lab_pal p ON p.idx = d.idx WHERE d.idx <> 0"
_SHADING = "SELECT asset, samples, CASE WHEN round(sqrt(sx * sx + sy * sy), 12) > 0 THEN sx / sqrt(sx * sx + sy * sy) END AS gx, CASE WHEN round(sqrt(sx * sx + sy * sy), 12) > 0 THEN sy / sqrt(sx * sx + sy * sy) END AS gy FROM (SELECT c.asset, count(*) AS samples, sum((r.light - l.light) / 2) AS sx, sum((d.light - u.light) / 2) AS sy FROM dense_light c JOIN dense_light l ON l.asset = c.asset AND l.x = c.x - 1 AND l.y = c.y JOIN dense_light r ON r.asset = c.asset AND r.x = c.x + 1 AND r.y = c.y JOIN dense_light u ON u.asset = c.asset AND u.x = c.x AND u.y = c.y - 1 JOIN dense_light d ON d.asset = c.asset AND d.x = c.x AND d.y = c.y + 1 GROUP BY 1)"


@query("shading_direction", "asset:long samples:long gx:double gy:double", _SHADING, "dense pal lab_pal dense_light")
def _(s, d):
    return lint.shading(dense(s, d), palette(s))


@query("lint_rule_7", _V, _lint(7, f"SELECT asset, 1 AS n FROM ({_SHADING}) WHERE samples >= 64 AND gx * 0.6 + gy * -0.8 < 0.55"), "dense pal lab_pal dense_light")
def _(s, d):
    return lint.rule_7(dense(s, d), palette(s), _LIGHT)


@query("lint_rule_8", _V)
def _(s, d):
    return lint.rule_8(kernels.colour_runs(canvases(s, d)))


@query("jaggy_report", "asset:long chains:long runs:long jaggies:long fixable:long rate:double")
def _(s, d):
    return lint.jaggy_report(kernels.colour_runs(canvases(s, d)))


_VOTES = _votes_sql("canvases", 4, [1, 2, 4])


@query("lint_rule_9", _V, _lint(9, f"SELECT asset, count(DISTINCT k) AS n FROM ({_VOTES}) WHERE k IS NOT NULL GROUP BY 1 HAVING count(DISTINCT k) >= 2 AND min(k) = 1"), "canvases")
def _(s, d):
    return lint.rule_9(tiles.mixel_votes(canvases(s, d), 4, 4))


@query("mixel_coverage", "asset:long windows:long pinned:long flat:long judged:boolean", f"SELECT asset, count(*) AS windows, count(k) AS pinned, count(*) - count(k) AS flat, count(k) >= 2 AS judged FROM ({_VOTES}) GROUP BY 1", "canvases")
def _(s, d):
    return lint.mixel_coverage(tiles.mixel_votes(canvases(s, d), 4, 4))


_CLUMPS = f"WITH RECURSIVE w AS ({_WINDOWS}), c AS (SELECT c.* FROM canvases c JOIN w ON w.asset = c.asset AND w.wx = c.x // 4 AND w.wy = c.y // 4), g(asset, x, y, idx, root) AS (SELECT asset, x, y, idx, y * 8 + x FROM c UNION SELECT c.asset, c.x, c.y, c.idx, g.root FROM g JOIN c ON c.asset = g.asset AND c.idx = g.idx AND c.x // 4 = g.x // 4 AND c.y // 4 = g.y // 4 AND abs(c.x - g.x) + abs(c.y - g.y) = 1), m AS (SELECT asset, x, y, min(root) AS root FROM g GROUP BY 1, 2, 3)"


@query("lint_rule_10", _V, _lint(10, f"{_CLUMPS} SELECT asset, count(*) AS n FROM (SELECT DISTINCT asset, wx, wy FROM (SELECT asset, x // 4 AS wx, y // 4 AS wy, root FROM m GROUP BY 1, 2, 3, 4 HAVING count(*) > 1 AND greatest(max(x) - min(x), max(y) - min(y)) + 1 > 2)) GROUP BY 1"), "canvases")
def _(s, d):
    return lint.rule_10(canvases(s, d), SMALL, 2)


@query("lint_rule_12", _V)
def _(s, d):
    return lint.rule_12(kernels.colour_runs(canvases(s, d)), 3, 3)


_CORR = "SELECT s.asset, CASE WHEN count(*) > 1 AND stddev_pop(s.d) > 0 AND stddev_pop(p.l) > 0 THEN corr(s.d, p.l) END AS corr, count(*) AS pixels FROM signed s JOIN canvases c ON c.asset = s.asset AND c.x = s.x AND c.y = s.y JOIN lab_pal p ON p.idx = c.idx WHERE s.d > 0 GROUP BY 1"


@query("lint_rule_13", _V, _lint(13, f"SELECT asset, 1 AS n FROM ({_CORR}) WHERE pixels >= 16 AND corr > 0.2"), "canvases signed pal lab_pal")
def _(s, d):
    return lint.rule_13(canvases(s, d), palette(s), 8, 8, 0.2, 16)


_BETWEEN = "SELECT asset, sum(area) AS pixels FROM (SELECT DISTINCT c.asset, c.idx, c.area FROM lab_areas c JOIN lab_areas x ON x.asset = c.asset AND x.area > c.area JOIN lab_areas y ON y.asset = c.asset AND y.area > c.area AND x.idx < y.idx WHERE sqrt(pow(c.l - (x.l + y.l) / 2, 2) + pow(c.a_ - (x.a_ + y.a_) / 2, 2) + pow(c.b_ - (x.b_ + y.b_) / 2, 2)) <= 0.3) GROUP BY asset"


@query("lint_rule_14", _V, _lint(14, f"SELECT asset, pixels AS n FROM ({_BETWEEN}) JOIN (SELECT asset, sum(area) AS a FROM areas GROUP BY 1) USING (asset) WHERE pixels > 0.2 * a"), "canvases areas pal lab_pal lab_areas")
def _(s, d):
    return lint.rule_14(canvases(s, d), palette(s), 0.2, 0.3)


_RATIO = f"SELECT c.asset, coalesce(w.n, 0) / c.n AS ratio FROM (SELECT asset, count(*) AS n FROM canvases GROUP BY 1) c LEFT JOIN (SELECT asset, sum(total) AS n FROM ({_WINDOWS}) GROUP BY 1) w USING (asset)"


@query("lint_rule_15", _V, _lint(15, f"SELECT asset, 1 AS n FROM ({_RATIO}) WHERE ratio > 0.35"), "canvases")
def _(s, d):
    return lint.rule_15(canvases(s, d), SMALL)


@query("lint_rule_17", _V, _lint(17, f"SELECT w.asset, count(*) AS n FROM ({_WINDOWS}) w JOIN lab_pal x ON x.idx = w.a JOIN lab_pal y ON y.idx = w.b WHERE abs(x.l - y.l) > 0.35 GROUP BY 1"), "canvases pal lab_pal")
def _(s, d):
    return lint.rule_17(canvases(s, d), palette(s), SMALL)


_CONF = f"SELECT asset, hat, least(greatest(coalesce((rival - hv) / iv, 0.0), 0.0), 1.0) AS confidence FROM hat LEFT JOIN r USING (asset)"
_GRID = f"WITH best AS ({_BEST}), iv AS (SELECT asset, var_pop(idx) AS iv FROM canvases GROUP BY 1), hat AS (SELECT asset, max(s) AS hat, max_by(v, s) AS hv, any_value(iv) AS iv FROM best JOIN iv USING (asset) WHERE v <= 0.9 * iv GROUP BY 1), r AS (SELECT h.asset, min(v) AS rival FROM hat h JOIN best b ON b.asset = h.asset AND b.s > h.hat AND b.s % h.hat <> 0 GROUP BY 1)"


@query("lint_rule_2", _V, _lint(2, f"{_GRID} SELECT asset, 1 AS n FROM (SELECT DISTINCT asset FROM best JOIN iv USING (asset) WHERE v <= 0.8 * iv) WHERE asset NOT IN (SELECT asset FROM ({_CONF}) WHERE confidence >= 0.01)"), "canvases")
def _(s, d):
    c = canvases(s, d)
    best, image = grid.best_phase(grid.cell_variance(c, 4)), grid.image_variance(c)
    return lint.rule_2(best, image, grid.confidence(best, image), 0.8, 0.01)


# Motion --------------------------------------------------------------------------------------------
views.SQL["centres"] = "SELECT asset, frame, CAST(floor(sum(x) / count(*) + 0.5) AS INTEGER) AS cx, CAST(floor(sum(y) / count(*) + 0.5) AS INTEGER) AS cy, max(x) - min(x) AS w, max(y) - min(y) AS h FROM frames WHERE idx <> 0 GROUP BY 1, 2"
_FW = "SELECT asset, frame, wx, wy FROM (SELECT asset, frame, x // 4 AS wx, y // 4 AS wy, idx, count(*) AS n FROM frames GROUP BY ALL) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND list_sum(list_reverse_sort(list(n))[1:2]) >= 0.6 * sum(n)"
_FP = "SELECT asset, frame, wx, wy FROM (SELECT a.asset, a.frame, a.x // 4 AS wx, a.y // 4 AS wy, a.idx <> b.idx AS sw FROM frames a JOIN frames b ON a.asset = b.asset AND a.frame = b.frame AND a.x // 4 = b.x // 4 AND a.y // 4 = b.y // 4 AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))) GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (WHERE sw) >= 0.40 * count(*)"


@query("lint_seq_24", "asset:long frame:long checked:long differs:long", f"WITH m AS (SELECT a.asset, a.frame, a.cx - b.cx AS dx, a.cy - b.cy AS dy FROM centres a JOIN centres b ON b.asset = a.asset AND b.frame = a.frame - 1 WHERE (a.cx <> b.cx OR a.cy <> b.cy) AND abs(a.w - b.w) <= 1 AND abs(a.h - b.h) <= 1), d AS ({_FW} INTERSECT {_FP}) SELECT p.asset, p.frame, count(*) AS checked, count(*) FILTER (WHERE p.idx <> q.idx) AS differs FROM m JOIN frames p ON p.asset = m.asset AND p.frame = m.frame JOIN d ON d.asset = p.asset AND d.frame = p.frame AND d.wx = p.x // 4 AND d.wy = p.y // 4 JOIN frames q ON q.asset = p.asset AND q.frame = p.frame - 1 AND q.x = p.x - m.dx AND q.y = p.y - m.dy WHERE p.idx <> 0 AND q.idx <> 0 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE p.idx <> q.idx) > 0.1 * count(*)", "canvases frames centres")
def _(s, d):
    return sequence.dither_in_motion(frames(s, d), SMALL, slack=1)


@query("lint_seq_25", "asset:long frame:long orphans:long", "WITH a AS (SELECT f.asset, f.frame, f.x - c.cx AS x, f.y - c.cy AS y FROM frames f JOIN centres c ON c.asset = f.asset AND c.frame = f.frame WHERE f.idx <> 0), n AS (SELECT a.* FROM a JOIN centres c ON c.asset = a.asset AND c.frame = a.frame - 1 JOIN centres e ON e.asset = a.asset AND e.frame = a.frame AND e.w = c.w AND e.h = c.h LEFT JOIN a b ON b.asset = a.asset AND b.frame = a.frame - 1 AND b.x = a.x AND b.y = a.y WHERE b.asset IS NULL), g AS (SELECT asset, frame, x, y - row_number() OVER (PARTITION BY asset, frame, x ORDER BY y) AS g FROM n) SELECT asset, frame, count(*) AS orphans FROM (SELECT asset, frame, x, g FROM g GROUP BY ALL HAVING count(*) < 2) GROUP BY 1, 2", "canvases frames centres")
def _(s, d):
    return sequence.new_columns(frames(s, d))


@query("sequence_coverage", "asset:long frames:long inbetweens:long squash_pairs:long unchecked:string", "SELECT asset, count(*) AS frames, greatest(count(*) - 2, 0) AS inbetweens, count(*) FILTER (WHERE sq) AS squash_pairs, concat_ws(',', CASE WHEN count(*) <= 2 THEN '22' END, '26', CASE WHEN count(*) FILTER (WHERE sq) = 0 THEN '27' END) AS unchecked FROM (SELECT asset, frame, coalesce((w - lag(w) OVER o) * (h - lag(h) OVER o) < 0, false) AS sq FROM centres WINDOW o AS (PARTITION BY asset ORDER BY frame)) GROUP BY 1", "canvases frames centres")
def _(s, d):
    return sequence.coverage(frames(s, d))


# Reports -------------------------------------------------------------------------------------------
_ALL = "canvases reach labels region_stats adjacent diagonal areas shares pal lab_pal"
_UNION = " UNION ALL ".join(q for q, _, _ in LINT.values())


def _violations(s, d):
    lab = regions.label(canvases(s, d))
    parts = [make(s, d, lab) for _, _, make in LINT.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("lint_in_scope", "asset:long rule:long n:long", f"SELECT asset, rule, n FROM ({_UNION}) WHERE scope <> 'keyframe' OR asset % 3 < 2", _ALL)
def _(s, d):
    kinds = canvases(s, d).select("asset").distinct().withColumn("kind", F.element_at(F.array(F.lit("key"), F.lit("breakdown"), F.lit("inbetween")), (F.col("asset") % 3 + 1).cast("int")))
    return lint.in_scope(_violations(s, d), kinds)


@query("lint_hints", "asset:long hint:string", f"SELECT asset, string_agg('rule ' || rule || ': ' || n, chr(10) ORDER BY rule) AS hint FROM ({_UNION}) WHERE severity = 'blocking' GROUP BY 1", _ALL)
def _(s, d):
    return lint.hints(_violations(s, d))


@query("lint_by_rule", "rule:long images:long violations:long", f"SELECT rule, count(DISTINCT asset) AS images, sum(n) AS violations FROM ({_UNION}) GROUP BY 1", _ALL)
def _(s, d):
    return _violations(s, d).groupBy("rule").agg(F.count_distinct("asset").alias("images"), F.sum("n").alias("violations"))
