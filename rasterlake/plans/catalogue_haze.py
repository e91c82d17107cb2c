"""Queries of air perspective: canvases at three depths under one sky."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake import views
from rasterlake.operators import color, haze
from rasterlake.registry import query
from rasterlake.views import canvases, palette

SKY, AMOUNTS, TOLERANCE = (255, 241, 232), (0.2, 0.45, 0.8), 0.12
S = views.SQL
_OF = "CASE asset % 3 WHEN 0 THEN 'foreground' WHEN 1 THEN 'midground' ELSE 'background' END AS depth"
S["sky"] = color.oklab_sql("(SELECT 0 AS idx, {} AS r, {} AS g, {} AS b)".format(*SKY))
_D = "round(sqrt(({0}.l - {1}.l) * ({0}.l - {1}.l) + ({0}.a_ - {1}.a_) * ({0}.a_ - {1}.a_) + ({0}.b_ - {1}.b_) * ({0}.b_ - {1}.b_)), 9)"
_DEPTHS = ", ".join(f"('{d}', {a})" for d, a in zip(haze.DEPTHS, AMOUNTS))
S["mixes"] = f"SELECT depth, x.idx, x.l AS from_l, {_D.format('x', 's')} AS span, x.l * (1 - amount) + s.l * amount AS l, x.a_ * (1 - amount) + s.a_ * amount AS a_, x.b_ * (1 - amount) + s.b_ * amount AS b_ FROM lab_pal x, sky s, (VALUES {_DEPTHS}) d(depth, amount) WHERE x.idx <> 0"
S["nearer"] = f"SELECT t.depth, t.idx, p.idx AS to_idx, p.l AS to_l, {_D.format('p', 't')} AS off FROM mixes t JOIN lab_pal x ON x.idx = t.idx, lab_pal p, sky s WHERE p.idx <> 0 AND p.idx <> t.idx AND t.span > 0 AND {_D.format('p', 's')} < t.span AND round({_D.format('p', 'x')} + {_D.format('p', 's')} - t.span, 9) <= {TOLERANCE}"
S["haze"] = "SELECT m.depth, m.idx, n.to_idx, m.from_l AS l, coalesce(n.to_l, m.from_l) AS to_l FROM mixes m LEFT JOIN (SELECT * FROM nearer QUALIFY row_number() OVER (PARTITION BY depth, idx ORDER BY off, to_idx) = 1) n ON n.depth = m.depth AND n.idx = m.idx"
S["layers"] = f"SELECT asset, {_OF}, x, y, idx FROM canvases"
_USES = "pal lab_pal sky mixes nearer haze canvases layers"


def _layers(s, d):
    return canvases(s, d).withColumn("depth", F.element_at(F.array(*map(F.lit, haze.DEPTHS)), (F.col("asset") % 3 + 1).cast("int")))


@query("haze_pixels", "asset:long depth:string x:long y:long idx:long", "SELECT l.asset, l.depth, x, y, coalesce(h.to_idx, l.idx) AS idx FROM layers l LEFT JOIN haze h ON h.depth = l.depth AND h.idx = l.idx", _USES)
def _(s, d):
    return haze.hazed(_layers(s, d), haze.steps(palette(s), SKY, AMOUNTS, TOLERANCE))


@query("haze_report", "asset:long depth:string colours:long moved:long no_step:long collapsed:long pixels:long before:double after:double", "SELECT asset, depth, count(*) AS colours, count(to_idx) AS moved, count(*) - count(to_idx) AS no_step, count(*) - count(DISTINCT coalesce(to_idx, idx)) AS collapsed, coalesce(sum(n) FILTER (WHERE to_idx IS NOT NULL), 0) AS pixels, max(l) - min(l) AS before, max(to_l) - min(to_l) AS after FROM (SELECT asset, depth, idx, count(*) AS n FROM layers GROUP BY ALL) JOIN haze USING (depth, idx) GROUP BY 1, 2", _USES)
def _(s, d):
    return haze.report(_layers(s, d), haze.steps(palette(s), SKY, AMOUNTS, TOLERANCE))
