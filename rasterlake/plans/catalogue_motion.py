"""Queries of palettes shared by parts, of frames cycled by waves, and of intermediate colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake import lineage, views
from rasterlake.operators import antialias, color, cycling, outlines, quantize, shared_palettes
from rasterlake.registry import query
from rasterlake.views import GREYS, PALETTE_B, canvases, palette

S = views.SQL

# One palette for many parts: four canvases a stack, of which every other one has the second palette.
_GROUP, _PART = ("stack",), ("stack", "asset")
S["parts"] = "SELECT asset // 4 AS stack, asset, x, y, idx FROM canvases"
S["part_palettes"] = "SELECT DISTINCT stack, asset, p.idx, r, g, b FROM parts JOIN (SELECT 0 AS o, * FROM pal UNION ALL SELECT 1, * FROM pal_b) p ON o = asset % 2"
S["part_uses"] = "SELECT DISTINCT stack, asset, idx, r, g, b FROM parts JOIN part_palettes USING (stack, asset, idx) WHERE idx <> 0"
S["unified"] = "SELECT stack, row_number() OVER (PARTITION BY stack ORDER BY r, g, b) AS idx, r, g, b FROM (SELECT DISTINCT stack, r, g, b FROM part_uses)"
S["part_maps"] = "SELECT u.stack, asset, u.idx, n.idx AS new_idx FROM part_uses u JOIN unified n ON n.stack = u.stack AND n.r = u.r AND n.g = u.g AND n.b = u.b"
_UNI = "canvases pal pal_b parts part_palettes part_uses unified"


def _parts(s, d):
    px = canvases(s, d).select(F.expr("asset div 4").alias("stack"), "asset", "x", "y", "idx")
    pals = palette(s).withColumn("o", F.lit(0)).unionByName(palette(s, PALETTE_B).withColumn("o", F.lit(1)))
    own = px.select(*_PART).distinct().withColumn("o", F.expr("cast(asset % 2 as int)")).join(F.broadcast(pals), "o").drop("o")
    return px, own


def _unified(s, d):
    px, own = _parts(s, d)
    uses = shared_palettes.used(px, own, _PART)
    pal = shared_palettes.unified(uses, _GROUP)
    return px, uses, pal, shared_palettes.maps(uses, pal, _GROUP, _PART)


@query("unified_palettes", "stack:long idx:long r:long g:long b:long", "SELECT * FROM unified", _UNI)
def _(s, d):
    return _unified(s, d)[2]


@query("unified_maps", "stack:long asset:long idx:long new_idx:long", "SELECT * FROM part_maps", f"{_UNI} part_maps")
def _(s, d):
    return _unified(s, d)[3]


@query("unified_pixels", "asset:long x:long y:long idx:long r:long g:long b:long", "SELECT p.asset, p.x, p.y, coalesce(m.new_idx, 0) AS idx, coalesce(q.r, 0) AS r, coalesce(q.g, 0) AS g, coalesce(q.b, 0) AS b FROM parts p LEFT JOIN part_maps m USING (stack, asset, idx) LEFT JOIN part_uses q USING (stack, asset, idx)", f"{_UNI} part_maps")
def _(s, d):
    px, _, pal, maps = _unified(s, d)
    new = shared_palettes.remapped(px, maps, _PART).join(pal, ["stack", "idx"], "left")
    return new.select("asset", "x", "y", "idx", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"])


S["own_tones"] = "SELECT u.*, l, a_, b_ FROM part_uses u JOIN (" + color.oklab_sql("(SELECT DISTINCT r, g, b FROM part_uses)") + ") t ON t.r = u.r AND t.g = u.g AND t.b = u.b"
_ENDS = "SELECT stack, asset, e, r, g, b, l, a_, b_ FROM (SELECT *, 0 AS e FROM own_tones QUALIFY row_number() OVER (PARTITION BY stack, asset ORDER BY l, r, g, b) = 1 UNION ALL SELECT *, 1 FROM own_tones QUALIFY row_number() OVER (PARTITION BY stack, asset ORDER BY l DESC, r DESC, g DESC, b DESC) = 1) WHERE (stack, asset) IN (SELECT (stack, asset) FROM own_tones GROUP BY stack, asset HAVING count(*) > 1)"
S["own_ends"] = f"SELECT stack, row_number() OVER (PARTITION BY stack ORDER BY asset, e) AS n, {{'r': r, 'g': g, 'b': b, 'l': l, 'a_': a_, 'b_': b_}} AS c FROM ({_ENDS})"
_FAR = "sqrt(pow(k.l - {c}.l, 2) + pow(k.a_ - {c}.a_, 2) + pow(k.b_ - {c}.b_, 2)) <= 0.2"
S["kept_ends"] = f"SELECT stack, n, [c] AS kept FROM own_ends WHERE n = 1 UNION ALL SELECT e.stack, e.n, CASE WHEN len(list_filter(kept, lambda k: {_FAR.format(c='e.c')})) > 0 THEN kept ELSE list_append(kept, e.c) END FROM kept_ends k JOIN own_ends e ON e.stack = k.stack AND e.n = k.n + 1"
S["all_kept"] = "SELECT stack, arg_max(kept, n) AS kept FROM kept_ends GROUP BY 1"
S["new_tones"] = f"SELECT t.stack, asset, idx, coalesce(CASE WHEN EXISTS (SELECT 1 FROM own_ends e WHERE e.stack = t.stack AND e.c.r = t.r AND e.c.g = t.g AND e.c.b = t.b) THEN list_filter(kept, lambda k: NOT (k.r = t.r AND k.g = t.g AND k.b = t.b) AND {_FAR.format(c='t')})[1] END, {{'r': r, 'g': g, 'b': b, 'l': l, 'a_': a_, 'b_': b_}}) AS c FROM own_tones t LEFT JOIN all_kept USING (stack)"
_MERGED = "SELECT stack, row_number() OVER (PARTITION BY stack ORDER BY o) - 1 AS idx, r, g, b FROM (SELECT stack, c.r AS r, c.g AS g, c.b AS b, min(asset * 256 + idx) AS o FROM new_tones GROUP BY ALL)"


@query("merged_ends", "stack:long idx:long r:long g:long b:long", _MERGED, "canvases pal pal_b parts part_palettes part_uses own_tones own_ends kept_ends all_kept new_tones")
def _(s, d):
    px, own = _parts(s, d)
    pals = shared_palettes.used(px, own, _PART).withColumnRenamed("asset", "p")
    return shared_palettes.merged(pals, share=True, threshold=0.2, group=_GROUP)


# Waves -----------------------------------------------------------------------------------------------
_N, _PHASE = 8, 0.3
_SHIFT = int(_PHASE * _N + 0.5)


def _mix(seed: str, k: str) -> str:
    two = "18446744073709551616::UHUGEINT"
    z = f"(({seed})::UHUGEINT + (({k} + 1)::UHUGEINT * {cycling.STEP}::UHUGEINT) % {two}) % {two}"
    for shift, by in ((30, cycling.MIX1), (27, cycling.MIX2)):
        z = f"(SELECT (xor(z, z >> {shift})::UHUGEINT * {by}::UHUGEINT) % {two} FROM (SELECT ({z})::UBIGINT AS z))"
    return f"(SELECT xor(z, z >> 31) FROM (SELECT ({z})::UBIGINT AS z))"


S["seeds"] = f"SELECT vec_id AS asset, k AS frame, {_mix('vec_id', f'((k + {_SHIFT}) % {_N})')} AS bits FROM embeddings, range({_N}) t(k)"
_WAVES = {
    "sine": f"sin(2 * pi() * (frame / {_N}.0 + {_PHASE}))",
    "square": f"CASE WHEN (frame / {_N}.0::DOUBLE + {_PHASE}) - floor(frame / {_N}.0::DOUBLE + {_PHASE}) < 0.5 THEN 1.0 ELSE -1.0 END",
    "noise": "(bits >> 40)::DOUBLE / 16777216 * 2 - 1",
    "random-blink": "CASE WHEN bits % 2 = 0 THEN -1.0 ELSE 1.0 END",
}
S["waves"] = "SELECT *, CAST(sign(value * 2) * floor(abs(value * 2) + 0.5) AS BIGINT) AS step FROM (" + " UNION ALL ".join(f"SELECT asset, '{k}' AS kind, frame, CAST({v} AS DOUBLE) AS value FROM seeds" for k, v in _WAVES.items()) + ")"


def _steps(s, d, kind: str, amplitude: float = 2.0):
    return cycling.steps(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("asset")), kind, _N, amplitude, _PHASE, "asset")


@query("wave_steps", "asset:long kind:string frame:long value:double step:long", "SELECT * FROM waves", "seeds waves")
def _(s, d):
    out = None
    for kind in _WAVES:
        one = _steps(s, d, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("wave_still", "asset:long kind:string still:boolean", "SELECT asset, kind, bool_and(step = 0) AS still FROM waves GROUP BY 1, 2", "seeds waves")
def _(s, d):
    out = None
    for kind in _WAVES:
        one = _steps(s, d, kind).groupBy("asset").agg(F.every(F.col("step") == 0).alias("still")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


S["sums"] = "SELECT asset, frame, sum(idx * (x + 1) * (y + 3)) AS mark, count(*) FILTER (WHERE idx <> 0) AS opaque FROM moved GROUP BY 1, 2"


def _marks(px):
    """A sum by which pixels' places and indices tell, for each frame."""
    return px.groupBy("asset", "frame").agg(F.sum(F.col("idx") * (F.col("x") + 1) * (F.col("y") + 3)).alias("mark"), F.count_if(F.col("idx") != 0).alias("opaque"))


_RAMPED = "SELECT asset, frame, x, y, CASE WHEN idx = 0 THEN 0 ELSE greatest(1, least(4, idx + step)) END AS idx FROM canvases JOIN waves USING (asset) WHERE kind = 'sine'"
_OFFSET = "SELECT c.asset, w.frame, c.x, c.y, coalesce(o.idx, 0) AS idx FROM canvases c JOIN waves w ON w.asset = c.asset AND kind = 'noise' LEFT JOIN canvases o ON o.asset = c.asset AND o.x = c.x - step AND o.y = c.y + step"
_SIDE = "SELECT asset, x, y, idx, n, arg_min(v, i) AS v, count(v) AS near FROM (SELECT c.asset, c.x, c.y, c.idx, o.idx AS v, i, 0 AS n FROM canvases c, (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) t(i, dx, dy) LEFT JOIN canvases o ON o.asset = c.asset AND o.x = c.x + dx AND o.y = c.y + dy AND o.idx <> 0) GROUP BY ALL"
_MASK = f"SELECT asset, frame, x, y, CASE WHEN value > 0 AND idx = 0 THEN coalesce(v, 0) WHEN value < 0 AND near < 4 THEN 0 ELSE idx END AS idx FROM ({_SIDE}) JOIN waves USING (asset) WHERE kind = 'random-blink'"


def _cycled(name: str, moved: str, kind: str, make):
    @query(name, "asset:long frame:long mark:long opaque:long", f"WITH moved AS ({moved}) {S['sums']}", "canvases seeds waves")
    def _(s, d):
        return _marks(make(canvases(s, d), lambda amplitude: _steps(s, d, kind, amplitude)))


_cycled("cycled_ramp", _RAMPED, "sine", lambda px, told: cycling.cycle(px, told(2.0), "ramp", 2, ramp=[1, 2, 3, 4]))
_cycled("cycled_offset", _OFFSET, "noise", lambda px, told: cycling.cycle(px, told(2.0), "offset", 2, direction=(1, -1)))
_cycled("cycled_mask", _MASK, "random-blink", lambda px, told: cycling.cycle(px, told(1.0), "mask", 1))

# Colours between others ------------------------------------------------------------------------------
S["tones"] = color.oklab_sql("(SELECT * FROM greys WHERE idx <> 0)")
_D = "sqrt(pow({a}.l - {b}.l, 2) + pow({a}.a_ - {b}.a_, 2) + pow({a}.b_ - {b}.b_, 2))"
S["ways"] = f"SELECT m.idx AS m, x.idx AS x, y.idx AS y, round({_D.format(a='m', b='x')}, 12) AS dx, round({_D.format(a='m', b='y')}, 12) AS dy, {_D.format(a='x', b='y')} AS span, m.l, m.a_, m.b_ FROM tones x JOIN tones y ON x.idx < y.idx JOIN tones m ON m.idx <> x.idx AND m.idx <> y.idx WHERE round({_D.format(a='m', b='x')}, 12) < {_D.format(a='x', b='y')} AND round({_D.format(a='m', b='y')}, 12) < {_D.format(a='x', b='y')} AND {_D.format(a='m', b='x')} + {_D.format(a='m', b='y')} - {_D.format(a='x', b='y')} <= 0.05"
S["pairs_met"] = "SELECT DISTINCT a.idx AS x, b.idx AS y, (1 + a.asset % 7) / 8.0 AS t FROM canvases a JOIN canvases b ON b.asset = a.asset AND b.y = a.y AND b.x = a.x + 1 WHERE a.idx <> b.idx AND a.idx <> 0 AND b.idx <> 0"
_NEAREST = "SELECT x, y, t, (SELECT arg_min(m, [round(pow(w.l - (p.l + (q.l - p.l) * t), 2) + pow(w.a_ - (p.a_ + (q.a_ - p.a_) * t), 2) + pow(w.b_ - (p.b_ + (q.b_ - p.b_) * t), 2), 12), m]) FROM ways w WHERE w.x = least(z.x, z.y) AND w.y = greatest(z.x, z.y)) AS idx FROM pairs_met z JOIN tones p ON p.idx = z.x JOIN tones q ON q.idx = z.y"


@query("nearest_between", "x:long y:long t:double idx:long", _NEAREST, "canvases greys tones ways pairs_met")
def _(s, d):
    c = canvases(s, d).where("idx <> 0")
    right = c.select("asset", (F.col("x") - 1).alias("x"), "y", F.col("idx").alias("b"))
    met = c.join(right, ["asset", "x", "y"]).where("idx <> b").select(F.col("idx").alias("x"), F.col("b").alias("y"), ((1 + F.col("asset") % 7) / 8.0).alias("t")).distinct()
    return antialias.nearest_between(met, palette(s, GREYS))


S["eight"] = "SELECT c.asset, c.x, c.y, c.idx AS m, o.idx AS v, min((o.y - c.y + 1) * 3 + o.x - c.x + 1) AS i, count(*) FILTER (WHERE abs(o.x - c.x) + abs(o.y - c.y) = 1) AS n FROM canvases c JOIN canvases o ON o.asset = c.asset AND abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1 AND o.idx NOT IN (0, c.idx) WHERE c.idx <> 0 GROUP BY ALL"
_STRIPPED = "SELECT c.asset, c.x, c.y, coalesce(z.t, c.idx) AS idx, z.t IS NOT NULL AS placed FROM canvases c LEFT JOIN (SELECT a.asset, a.x, a.y, CASE WHEN a.n > b.n OR (a.n = b.n AND dx <= dy) THEN a.v ELSE b.v END AS t FROM eight a JOIN eight b ON b.asset = a.asset AND b.x = a.x AND b.y = a.y AND a.v < b.v JOIN ways w ON w.m = a.m AND w.x = a.v AND w.y = b.v QUALIFY row_number() OVER (PARTITION BY a.asset, a.x, a.y ORDER BY least(dx, dy), a.i, b.i) = 1) z ON z.asset = c.asset AND z.x = c.x AND z.y = c.y"


@query("stripped", "asset:long x:long y:long idx:long placed:boolean", _STRIPPED, "canvases greys tones ways eight")
def _(s, d):
    return antialias.stripped(canvases(s, d), palette(s, GREYS))


@query("antialias_wanted", "asset:long x:long y:long a:long b:long t:double")
def _(s, d):
    base = lineage.cut(antialias.stripped(canvases(s, d), palette(s, GREYS)))
    return antialias.wanted(base, base.where("placed"), palette(s, GREYS))


@query("antialiased", "asset:long x:long y:long idx:long")
def _(s, d):
    return antialias.added(canvases(s, d), palette(s, GREYS))[0]


# Outlines --------------------------------------------------------------------------------------------
_SHUT = "(SELECT count(*) FROM canvases o WHERE o.asset = c.asset AND o.idx <> 0 AND o.x = c.x + ({dx}) AND o.y = c.y + ({dy}))"
_OPEN = {(dx, dy): "(1 - " + _SHUT.format(dx=dx, dy=dy) + ")" for dx, dy in outlines.SIDES}
S["edges"] = f"SELECT *, e - w AS ox, s - n AS oy, e + w + s + n AS open FROM (SELECT asset, x, y, idx, {_OPEN[1, 0]} AS e, {_OPEN[-1, 0]} AS w, {_OPEN[0, 1]} AS s, {_OPEN[0, -1]} AS n FROM canvases c WHERE idx <> 0)"
S["inners"] = "SELECT asset, x, y, idx, ox, oy, (SELECT arg_min(q.idx, i) FROM edges q, (VALUES (0, 1, 1), (1, 1, 0), (2, 0, 1)) t(i, sx, sy) WHERE q.asset = g.asset AND q.open = 0 AND (sx * sign(g.ox) <> 0 OR sy * sign(g.oy) <> 0) AND q.x = g.x - sx * sign(g.ox) AND q.y = g.y - sy * sign(g.oy)) AS inner_ FROM edges g WHERE open > 0"


def _rgb(source: str) -> str:
    roots = [f"pow({x} * l + {y} * a_ + {z} * b_, 3)" for x, y, z in quantize.TO_ROOTS]
    lin = [" + ".join(f"{m} * {c}" for m, c in zip(row, roots)) for row in quantize.TO_LINEAR]
    chan = [f"CAST(floor(least(greatest(CASE WHEN {c} <= 0.0031308 THEN 12.92 * ({c}) ELSE 1.055 * pow(greatest({c}, 0), 1 / 2.4) - 0.055 END, 0), 1) * 255 + 0.5) AS INTEGER)" for c in lin]
    return "SELECT *, " + ", ".join(f"{c} AS {n}" for c, n in zip(chan, "rgb")) + f" FROM ({source})"


_COS = "coalesce((ox * 0.6 - oy * 0.8) / nullif(sqrt(ox * ox + oy * oy), 0), 0)"


def _wants(k: str, where: str = "true") -> str:
    q = {c: f"(round(p.{c} / 0.12) * 0.12)" for c in ("l", "a_", "b_")}
    return f"SELECT asset, x, y, greatest({q['l']} * ({k}), 0.02) AS l, {q['a_']} * greatest({k}, 0.5) AS a_, {q['b_']} * greatest({k}, 0.5) AS b_ FROM inners JOIN lab_pal p ON p.idx = inner_ WHERE {where}"


S["tints"] = _rgb(_wants("0.45"))
S["shade_all"] = _rgb("SELECT u.asset, qx AS x, qy AS y, l, a_, b_, u.y AS py, u.x AS px, i FROM (SELECT w.*, w.x + dx AS qx, w.y + dy AS qy, i FROM (" + _wants(f"0.45 + 0.275 * greatest(0, least(1, {_COS}))", f"{_COS} <= 0") + ") w, (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) t(i, dx, dy)) u JOIN canvases c ON c.asset = u.asset AND c.x = qx AND c.y = qy AND c.idx = 0")
S["shades"] = "SELECT asset, x, y, r, g, b FROM shade_all QUALIFY row_number() OVER (PARTITION BY asset, x, y ORDER BY py DESC, px DESC, i DESC) = 1"
_TOP = "SELECT asset, k, r, g, b, tl, ta, tb FROM (" + _rgb("SELECT asset, l, a_, b_, l AS tl, a_ AS ta, b_ AS tb, row_number() OVER (PARTITION BY asset ORDER BY n DESC, l, a_, b_) AS k FROM (SELECT asset, round(l, 4) AS l, round(a_, 4) AS a_, round(b_, 4) AS b_, count(*) AS n FROM {wants} GROUP BY ALL)") + ") WHERE k <= 2 AND NOT EXISTS (SELECT 1 FROM lab_pal p WHERE idx <> 0 AND sqrt(pow(tl - p.l, 2) + pow(ta - p.a_, 2) + pow(tb - p.b_, 2)) <= 0.03)"


def _outline_views(name: str, wants: str, counted: str) -> None:
    S[f"{name}_top"] = "SELECT z.*, t.l, t.a_, t.b_ FROM (" + _TOP.format(wants=counted) + ") z JOIN (" + color.oklab_sql("(SELECT DISTINCT r, g, b FROM (" + _TOP.format(wants=counted) + "))") + ") t ON t.r = z.r AND t.g = z.g AND t.b = z.b"
    S[f"{name}_new"] = f"SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY k) + 15 AS idx, r, g, b, l, a_, b_ FROM {name}_top z WHERE NOT EXISTS (SELECT 1 FROM {name}_top o WHERE o.asset = z.asset AND o.k < z.k AND sqrt(pow(o.l - z.tl, 2) + pow(o.a_ - z.ta, 2) + pow(o.b_ - z.tb, 2)) <= 0.03)"
    S[f"{name}_px"] = (
        f"SELECT c.asset, c.x, c.y, coalesce(n.idx, c.idx) AS idx FROM canvases c LEFT JOIN {wants} w USING (asset, x, y) LEFT JOIN (SELECT asset, r, g, b, arg_min(idx, [d, idx]) AS idx FROM (SELECT t.asset, t.r, t.g, t.b, p.idx, round(pow(t.l - p.l, 2) + pow(t.a_ - p.a_, 2) + pow(t.b_ - p.b_, 2), 12) AS d FROM "
        f"(SELECT u.asset, v.* FROM (SELECT DISTINCT asset, r, g, b FROM {wants}) u JOIN (" + color.oklab_sql(f"(SELECT DISTINCT r, g, b FROM {wants})") + f") v ON v.r = u.r AND v.g = u.g AND v.b = u.b) t JOIN (SELECT NULL AS asset, idx, l, a_, b_ FROM lab_pal WHERE idx <> 0 UNION ALL SELECT asset, idx, l, a_, b_ FROM {name}_new) p ON p.asset IS NULL OR p.asset = t.asset) GROUP BY ALL) n ON n.asset = w.asset AND n.r = w.r AND n.g = w.g AND n.b = w.b"
    )


_outline_views("tint", "tints", "tints")
_outline_views("shade", "shades", "shade_all")
_EDGES = "canvases pal lab_pal edges inners"


@query("outline_inward", "asset:long x:long y:long ox:long oy:long inner_:long", "SELECT asset, x, y, ox, oy, inner_ FROM inners", _EDGES)
def _(s, d):
    return outlines.inward(canvases(s, d)).withColumnRenamed("inner", "inner_")


@query("outline_removed", "asset:long x:long y:long idx:long", "SELECT c.asset, c.x, c.y, coalesce(inner_, c.idx) AS idx FROM canvases c LEFT JOIN inners USING (asset, x, y)", _EDGES)
def _(s, d):
    return outlines.outlined(canvases(s, d), palette(s), "none")[0]


@query("outline_tinted", "asset:long x:long y:long idx:long", "SELECT * FROM tint_px", f"{_EDGES} tints tint_top tint_new tint_px")
def _(s, d):
    return outlines.outlined(canvases(s, d), palette(s), "tinted", most=2)[0]


@query("outline_colours", "asset:long idx:long r:long g:long b:long", "SELECT asset, idx, r, g, b FROM tint_new", f"{_EDGES} tints tint_top tint_new")
def _(s, d):
    return outlines.outlined(canvases(s, d), palette(s), "tinted", most=2)[1]


@query("outline_shaded", "asset:long x:long y:long idx:long", "SELECT * FROM shade_px", f"{_EDGES} shade_all shades shade_top shade_new shade_px")
def _(s, d):
    return outlines.outlined(canvases(s, d), palette(s), "shaded", outer=True, selective=True, most=2)[0]
