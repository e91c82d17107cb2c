"""Queries of decisions over stored sweeps, and of calibration summaries over the operators' own results."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake import views
from rasterlake.operators import canvas, color, compose, kernels, lint, regions, replay, sequence, tiles
from rasterlake.plans.catalogue import _tile_sql, _canon_sql, _FD
from rasterlake.registry import query
from rasterlake.views import canvases, dense, frames, palette

_PARAMS = [(p, e, t, c, m, p % 2 == 1, p >= 2) for p, (e, t, c, m) in enumerate([(0.6, 0.05, 2.0, 0.05), (0.9, 0.06, 1.0, 0.2), (1.2, 0.08, 5.0, 0.1), (0.8, 0.04, 0.0, 0.3)])]
views.SQL["cands"] = "SELECT l_orderkey AS item_id, CAST(l_linenumber + 1 AS INTEGER) AS scale, min(round(l_discount * 10, 3)) AS v, max(l_tax) AS recon, CASE WHEN min(l_suppkey) % 7 > 0 THEN min(l_suppkey) % 3 > 0 END AS drift_ok, CASE WHEN min(l_suppkey) % 7 > 0 THEN min(l_partkey) % 4 > 0 END AS curve_ok, min(l_quantity) AS contrast, CAST(min(l_partkey) % 3 AS INTEGER) AS phase FROM lineitem GROUP BY 1, 2"
views.SQL["cases"] = "SELECT o_orderkey AS item_id, 0.2 + CAST(floor(o_totalprice) AS BIGINT) % 9 / 10.0 AS image_var, o_orderkey % 3 > 0 AS has_grid, CAST(o_custkey % 6 + 2 AS INTEGER) AS truth_scale, CAST(o_custkey % 3 AS INTEGER) AS truth_phase, CASE o_custkey % 4 WHEN 0 THEN 'nearest' WHEN 1 THEN 'bilinear' WHEN 2 THEN 'bicubic' ELSE 'lanczos' END AS filter FROM orders"
views.SQL["params"] = "SELECT * FROM (VALUES " + ", ".join(f"({p}, {e}, {t}, {c}, {m}, {str(s).lower()}, {str(a).lower()})" for p, e, t, c, m, s, a in _PARAMS) + ") AS t(param_id, epsilon, tau, min_contrast, min_confidence, per_scale, any_phase)"
views.SQL["gated"] = "SELECT *, len(failed) = 0 AS passes FROM (SELECT *, list_filter([CASE WHEN NOT v <= epsilon * image_var THEN 'epsilon' END, CASE WHEN NOT recon <= tau THEN 'recon' END, CASE WHEN NOT coalesce(CASE WHEN any_phase THEN drift_ok OR curve_ok ELSE drift_ok AND curve_ok END, true) THEN 'phase' END, CASE WHEN NOT contrast >= min_contrast THEN 'contrast' END], lambda x: x IS NOT NULL) AS failed FROM cands JOIN cases USING (item_id), params)"
views.SQL["hats"] = "SELECT param_id, item_id, max(scale) AS hat, arg_max(phase, scale) AS hat_phase, arg_max(v, scale) AS hv, any_value(image_var) AS iv, arg_max(CASE WHEN per_scale THEN min_confidence / scale ELSE min_confidence END, scale) AS floor FROM gated WHERE passes GROUP BY 1, 2"
views.SQL["decided"] = "SELECT *, rival IS NOT NULL AND round(confidence, 9) >= round(floor, 9) AS accepted FROM (SELECT h.param_id, h.item_id, hat, hat_phase, rival, floor, CASE WHEN iv > 0 AND rival IS NOT NULL THEN least(greatest((rival - hv) / iv, 0.0), 1.0) ELSE 0.0 END AS confidence FROM hats h LEFT JOIN (SELECT g.param_id, g.item_id, min(v) AS rival FROM gated g JOIN hats h ON h.param_id = g.param_id AND h.item_id = g.item_id WHERE g.scale > h.hat AND g.scale % h.hat <> 0 GROUP BY 1, 2) r ON r.param_id = h.param_id AND r.item_id = h.item_id)"
views.SQL["outcomes"] = (
    "SELECT param_id, item_id, has_grid, CASE WHEN has_grid THEN CASE WHEN filter = 'nearest' THEN 'A' WHEN filter IN ('bilinear', 'bicubic') THEN 'B' ELSE 'C' END END AS tier, CASE WHEN ok THEN hat END AS hat, "
    "CASE WHEN NOT ok AND has_grid THEN 'rejected' WHEN NOT ok THEN 'correct_rejection' WHEN NOT has_grid OR hat <> truth_scale THEN 'wrong' WHEN hat_phase = truth_phase THEN 'exact' ELSE 'scale_only' END AS outcome, "
    "CASE WHEN has_grid AND truth_passes THEN CASE WHEN NOT ok THEN 'confidence' WHEN hat <> truth_scale THEN 'choice' WHEN hat_phase <> truth_phase THEN 'phase' END END AS missed "
    "FROM (SELECT c.*, d.hat, d.hat_phase, coalesce(d.accepted, false) AS ok FROM (SELECT param_id, item_id, any_value(has_grid) AS has_grid, any_value(truth_scale) AS truth_scale, any_value(truth_phase) AS truth_phase, any_value(filter) AS filter, coalesce(bool_or(passes) FILTER (WHERE scale = truth_scale), false) AS truth_passes FROM gated GROUP BY 1, 2) c LEFT JOIN decided d ON d.param_id = c.param_id AND d.item_id = c.item_id)"
)
_ALL = "cands cases params gated hats decided outcomes"


def _rows(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    sure = F.min("l_suppkey") % 7 > 0
    cands = li.groupBy(F.col("l_orderkey").alias("item_id"), (F.col("l_linenumber") + 1).cast("int").alias("scale")).agg(F.min(F.round(F.col("l_discount") * 10, 3)).alias("v"), F.max("l_tax").alias("recon"), F.when(sure, F.min("l_suppkey") % 3 > 0).alias("drift_ok"), F.when(sure, F.min("l_partkey") % 4 > 0).alias("curve_ok"), F.min("l_quantity").alias("contrast"), (F.min("l_partkey") % 3).cast("int").alias("phase"))
    names = F.array(*map(F.lit, ("nearest", "bilinear", "bicubic", "lanczos")))
    cases = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("item_id"), (0.2 + F.floor("o_totalprice").cast("long") % 9 / 10.0).alias("image_var"), (F.col("o_orderkey") % 3 > 0).alias("has_grid"), (F.col("o_custkey") % 6 + 2).cast("int").alias("truth_scale"), (F.col("o_custkey") % 3).cast("int").alias("truth_phase"), F.element_at(names, (F.col("o_custkey") % 4 + 1).cast("int")).alias("filter"))
    return cands, cases, replay.settings(s, _PARAMS)


def _gated(s, d):
    return replay.gated(*_rows(s, d))


def _settled(s, d):
    return replay.settled(*_rows(s, d))


@query("replay_gates", "param_id:long item_id:long scale:long failed:string passes:boolean", "SELECT param_id, item_id, scale, array_to_string(failed, '+') AS failed, passes FROM gated", "cands cases params gated")
def _(s, d):
    return _gated(s, d).withColumn("failed", F.array_join("failed", "+"))


@query("replay_decisions", "param_id:long item_id:long hat:long rival:double confidence:double floor:double accepted:boolean", "SELECT * FROM decided", "cands cases params gated hats decided")
def _(s, d):
    return replay.decided(_settled(s, d))


@query("replay_outcomes", "param_id:long item_id:long tier:string hat:long outcome:string missed:string", "SELECT * FROM outcomes", _ALL)
def _(s, d):
    return replay.outcomes(_settled(s, d))


@query("replay_missed", "param_id:long missed:string n:long", "SELECT param_id, missed, count(*) AS n FROM outcomes WHERE missed IS NOT NULL GROUP BY 1, 2", _ALL)
def _(s, d):
    return replay.outcomes(_settled(s, d)).where("missed is not null").groupBy("param_id", "missed").agg(F.count("*").alias("n"))


_TIERS = ", ".join(f"count(*) FILTER (WHERE tier = '{t}' AND outcome = 'exact') AS {t.lower()}_exact, count(*) FILTER (WHERE tier = '{t}') AS {t.lower()}_n" for t in "ABC")


@query("replay_score", "param_id:long grid_n:long nogrid_n:long exact:long scale_only:long rejected:long correct_rejection:long wrong:long a_exact:long a_n:long b_exact:long b_n:long c_exact:long c_n:long macro_rate:double", f"SELECT *, (exact / greatest(grid_n, 1) + correct_rejection / greatest(nogrid_n, 1)) / 2 AS macro_rate FROM (SELECT param_id, count(*) FILTER (WHERE has_grid) AS grid_n, count(*) FILTER (WHERE NOT has_grid) AS nogrid_n, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("exact", "scale_only", "rejected", "correct_rejection", "wrong")) + f", {_TIERS} FROM outcomes GROUP BY 1)", _ALL)
def _(s, d):
    return replay.score(replay.outcomes(_settled(s, d)))


@query("diagnose_fallout", "param_id:long gates:string n:long", "SELECT param_id, array_to_string(failed, '+') AS gates, count(*) AS n FROM gated WHERE has_grid AND scale = truth_scale AND NOT passes GROUP BY 1, 2", "cands cases params gated")
def _(s, d):
    return replay.fallout(_gated(s, d))


_KIND = "CASE WHEN scale = truth_scale THEN 'truth' WHEN scale > truth_scale AND scale % truth_scale = 0 THEN 'multiple' WHEN scale < truth_scale AND truth_scale % scale = 0 THEN 'divisor' ELSE 'other' END"


@query("recon_kinship", "kind:string n:long recon:double share:double", f"SELECT {_KIND} AS kind, count(*) AS n, avg(recon) AS recon, avg(v / image_var) AS share FROM gated WHERE has_grid GROUP BY 1", "cands cases params gated")
def _(s, d):
    return replay.kinship(_gated(s, d))


@query("recon_separation", "param_id:long threshold:double score:double", "SELECT param_id, threshold, score FROM (SELECT *, row_number() OVER (PARTITION BY param_id ORDER BY score DESC, threshold) AS k FROM (SELECT param_id, threshold, round((sum(p) OVER u / sum(p) OVER w + (sum(q) OVER w - sum(q) OVER u) / sum(q) OVER w) / 2, 9) AS score, sum(p) OVER w AS tp, sum(q) OVER w AS tq FROM (SELECT param_id, recon AS threshold, count(*) FILTER (WHERE scale = truth_scale) AS p, count(*) FILTER (WHERE scale <> truth_scale) AS q FROM gated WHERE has_grid GROUP BY 1, 2) WINDOW w AS (PARTITION BY param_id), u AS (PARTITION BY param_id ORDER BY threshold ROWS UNBOUNDED PRECEDING)) WHERE tp > 0 AND tq > 0) WHERE k = 1", "cands cases params gated")
def _(s, d):
    return replay.separation(_gated(s, d).where("has_grid"), "recon", F.col("scale") == F.col("truth_scale"), ("param_id",))


@query("confidence_by_outcome", "param_id:long outcome:string n:long least:double q05:double median:double q95:double most:double", "SELECT param_id, outcome, len(l) AS n, l[1] AS least, l[CAST(floor((len(l) - 1) * 0.05 + 0.5) AS INTEGER) + 1] AS q05, l[CAST(floor((len(l) - 1) * 0.5 + 0.5) AS INTEGER) + 1] AS median, l[CAST(floor((len(l) - 1) * 0.95 + 0.5) AS INTEGER) + 1] AS q95, l[len(l)] AS most FROM (SELECT o.param_id, outcome, list(round(confidence, 9) ORDER BY round(confidence, 9)) AS l FROM outcomes o JOIN decided d ON d.param_id = o.param_id AND d.item_id = o.item_id GROUP BY 1, 2)", _ALL)
def _(s, d):
    both = replay.outcomes(_settled(s, d).where("hat is not null"), "confidence").withColumn("confidence", F.round("confidence", 9))
    return replay.distribution(both, "confidence", ("param_id", "outcome"))


@query("bands_trend", "filter:string bands:long spread:double relative:double slope:double", "SELECT filter, count(*) AS bands, max(m) - min(m) AS spread, (max(m) - min(m)) / avg(m) AS relative, regr_slope(m, truth_scale) AS slope FROM (SELECT filter, truth_scale, avg(recon) AS m FROM gated GROUP BY 1, 2) GROUP BY 1", "cands cases params gated")
def _(s, d):
    return replay.band_trend(_gated(s, d), "recon", "truth_scale", ("filter",))


# Summaries of the operators' own results -------------------------------------------------------------
_TH = [0.9, 1.0, 1.1, 1.2, 1.4]


@query("shape_sweep", "threshold:double bad_fired:long bad_n:long good_fired:long good_n:long", "SELECT threshold, count(*) FILTER (WHERE asset % 2 = 1 AND e > threshold) AS bad_fired, count(*) FILTER (WHERE asset % 2 = 1) AS bad_n, count(*) FILTER (WHERE asset % 2 = 0 AND e > threshold) AS good_fired, count(*) FILTER (WHERE asset % 2 = 0) AS good_n FROM (SELECT asset, round(perimeter / (2 * (w + h)), 9) AS e FROM region_stats WHERE idx <> 0 AND area >= 4), (SELECT unnest([0.9, 1.0, 1.1, 1.2, 1.4]) AS threshold) t GROUP BY 1", "canvases reach labels region_stats")
def _(s, d):
    r = regions.stats(regions.label(canvases(s, d))).where("idx <> 0 AND area >= 4").withColumn("excess", F.round("excess", 9))
    return replay.fired_at(r, "excess", F.col("asset") % 2 == 1, _TH)


@query("shape_quantiles", "idx:long n:long least:double q05:double median:double q95:double most:double", "SELECT idx, len(l) AS n, l[1] AS least, l[CAST(floor((len(l) - 1) * 0.05 + 0.5) AS INTEGER) + 1] AS q05, l[CAST(floor((len(l) - 1) * 0.5 + 0.5) AS INTEGER) + 1] AS median, l[CAST(floor((len(l) - 1) * 0.95 + 0.5) AS INTEGER) + 1] AS q95, l[len(l)] AS most FROM (SELECT idx, list(round(perimeter * perimeter / area, 9) ORDER BY round(perimeter * perimeter / area, 9)) AS l FROM region_stats GROUP BY 1)", "canvases reach labels region_stats")
def _(s, d):
    return replay.distribution(regions.stats(regions.label(canvases(s, d))).withColumn("compactness", F.round("compactness", 9)), "compactness", ("idx",))


_TILES = " UNION ALL ".join(f"SELECT {z} AS size, '{m}' AS mode, asset, count(*) AS before, count(DISTINCT {_canon_sql(z, m)}) AS after FROM ({_tile_sql(z)}) GROUP BY asset" for z in (2, 4) for m in ("exact", "flip", "flip-rotate"))


@query("tile_reduction", "size:long mode:string files:long before:long after:long reduction:double", f"SELECT size, mode, count(*) AS files, sum(before) AS before, sum(after) AS after, 1 - sum(after) / sum(before) AS reduction FROM ({_TILES}) GROUP BY GROUPING SETS ((size, mode), ())", "dense")
def _(s, d):
    parts = None
    for size in (2, 4):
        for mode in ("exact", "flip", "flip-rotate"):
            n = tiles.extract(dense(s, d), size, mode).groupBy("asset").agg(F.count("*").alias("before"), (F.max("tile_id") + 1).alias("after"))
            n = n.select(F.lit(size).alias("size"), F.lit(mode).alias("mode"), "asset", "before", "after")
            parts = n if parts is None else parts.unionByName(n)
    g = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("files"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    none = F.lit(None)
    return g(parts, "size", "mode").unionByName(g(parts).withColumn("size", none.cast("int")).withColumn("mode", none.cast("string"))).withColumn("reduction", 1 - F.col("after") / F.col("before"))


# A tween of every other frame against the frame that stands there.
@query("tween_truths", "asset:long frame:long tween_iou:double hold_iou:double beats:boolean", f"WITH fd AS ({_FD}), t AS (SELECT a.asset, a.frame + 1 AS frame, a.x, a.y, a.d + b.d > 0 AS tw, a.d > 0 AS hold FROM fd a JOIN fd b ON b.asset = a.asset AND b.frame = a.frame + 2 AND b.x = a.x AND b.y = a.y), j AS (SELECT t.asset, t.frame, count(*) FILTER (WHERE tw AND idx <> 0) / greatest(count(*) FILTER (WHERE tw OR idx <> 0), 1) AS tween_iou, count(*) FILTER (WHERE hold AND idx <> 0) / greatest(count(*) FILTER (WHERE hold OR idx <> 0), 1) AS hold_iou FROM t JOIN frames f ON f.asset = t.asset AND f.frame = t.frame AND f.x = t.x AND f.y = t.y GROUP BY 1, 2) SELECT *, round(tween_iou, 9) > round(hold_iou, 9) AS beats FROM j", "frames")
def _(s, d):
    return sequence.tween_truths(frames(s, d), 8, 8)


@query("tween_series_area", "asset:long frame:long step:long area:long", f"WITH fd AS ({_FD}) SELECT a.asset, a.frame, k AS step, count(*) AS area FROM fd a JOIN fd b ON b.asset = a.asset AND b.frame = a.frame + 1 AND b.x = a.x AND b.y = a.y, (SELECT unnest([1, 2, 3]) AS k) z WHERE round(a.d * (4 - k) + b.d * k, 9) > 0 GROUP BY 1, 2, 3", "frames")
def _(s, d):
    return sequence.tween_series(frames(s, d), 8, 8, 3).groupBy("asset", "frame", "step").agg(F.count("*").alias("area"))


@query("extrapolated_area", "asset:long frame:long area:long", f"WITH fd AS ({_FD}) SELECT a.asset, a.frame, count(*) AS area FROM fd a JOIN fd b ON b.asset = a.asset AND b.frame = a.frame + 1 AND b.x = a.x AND b.y = a.y WHERE round(b.d * 1.5 - a.d * 0.5, 9) > 0 GROUP BY 1, 2", "frames")
def _(s, d):
    return sequence.extrapolated(frames(s, d), 8, 8, 0.5).groupBy("asset", "frame").agg(F.count("*").alias("area"))


@query("centroids", "asset:long frame:long cx:long cy:long", "SELECT * FROM centres", "canvases frames centres")
def _(s, d):
    return sequence.centres(frames(s, d))


@query("displacements", "asset:long frame:long moved:double", "SELECT a.asset, a.frame, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS moved FROM centres a JOIN centres b ON b.asset = a.asset AND b.frame = a.frame - 1", "canvases frames centres")
def _(s, d):
    return sequence.moves(frames(s, d)).withColumn("moved", F.sqrt(F.pow("dx", F.lit(2)) + F.pow("dy", F.lit(2))))


@query("smear_by_shift", "back:long frames:long mean_area:double connected:long", "WITH RECURSIVE f AS (SELECT * FROM frames WHERE idx <> 0), u AS (SELECT DISTINCT k AS back, n.asset, n.frame, p.x, p.y FROM (SELECT DISTINCT asset, frame FROM f) n, (SELECT unnest([0, 1, 2]) AS k) z JOIN f p ON TRUE WHERE p.asset = n.asset AND p.frame BETWEEN n.frame - k AND n.frame), g(back, asset, frame, x, y, root) AS (SELECT back, asset, frame, x, y, y * 8 + x FROM u UNION SELECT u.back, u.asset, u.frame, u.x, u.y, g.root FROM g JOIN u ON u.back = g.back AND u.asset = g.asset AND u.frame = g.frame AND abs(u.x - g.x) + abs(u.y - g.y) = 1) SELECT back, count(*) AS frames, avg(n) AS mean_area, count(*) FILTER (WHERE parts = 1) AS connected FROM (SELECT back, asset, frame, count(*) AS n, count(DISTINCT root) AS parts FROM (SELECT back, asset, frame, x, y, min(root) AS root FROM g GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3) GROUP BY 1", "frames")
def _(s, d):
    f, out = frames(s, d), None
    for back in (0, 1, 2):
        u = canvas.union_of_frames(f, back).withColumn("idx", F.lit(1))
        n = regions.label(u, ("asset", "frame")).groupBy("asset", "frame").agg(F.count("*").alias("n"), F.count_distinct("root").alias("parts")).withColumn("back", F.lit(back))
        out = n if out is None else out.unionByName(n)
    return out.groupBy("back").agg(F.count("*").alias("frames"), F.avg("n").alias("mean_area"), F.count_if(F.col("parts") == 1).alias("connected"))


@query("afterimage_by_trail", "trail:long frames:long pixels:long", "SELECT k AS trail, count(DISTINCT (f.asset, f.frame)) AS frames, count(*) AS pixels FROM (SELECT DISTINCT k, f.asset, f.frame, p.x, p.y FROM (SELECT DISTINCT asset, frame FROM frames WHERE idx <> 0) f, (SELECT unnest([1, 2, 3]) AS k) z JOIN frames p ON TRUE WHERE p.asset = f.asset AND p.idx <> 0 AND p.frame BETWEEN f.frame - k AND f.frame - 1) f LEFT JOIN frames o ON o.asset = f.asset AND o.frame = f.frame AND o.x = f.x AND o.y = f.y AND o.idx <> 0 WHERE o.asset IS NULL GROUP BY 1", "frames")
def _(s, d):
    f, out = frames(s, d), None
    for trail in (1, 2, 3):
        n = canvas.afterimage(f, trail).agg(F.count_distinct("asset", "frame").alias("frames"), F.count("*").alias("pixels")).withColumn("trail", F.lit(trail))
        out = n if out is None else out.unionByName(n)
    return out


@query("atmosphere_levels", "amount:double exact:long levels:long", "WITH z AS (SELECT unnest([0.2, 0.4, 0.6]) AS amount), m AS (SELECT z.amount, p.idx, p.l * (1 - amount) + s.l * amount AS l, p.a_ * (1 - amount) + s.a_ * amount AS a_, p.b_ * (1 - amount) + s.b_ * amount AS b_ FROM z, lab_pal p, lab_pal s WHERE s.idx = 12) SELECT amount, count(*) FILTER (WHERE idx = to_idx) AS exact, count(DISTINCT to_idx) AS levels FROM (SELECT m.amount, m.idx, p.idx AS to_idx, row_number() OVER (PARTITION BY m.amount, m.idx ORDER BY round((m.l - p.l) * (m.l - p.l) + (m.a_ - p.a_) * (m.a_ - p.a_) + (m.b_ - p.b_) * (m.b_ - p.b_), 12), p.idx) AS k FROM m, lab_pal p) WHERE k = 1 GROUP BY 1", "pal lab_pal")
def _(s, d):
    out = None
    for amount in (0.2, 0.4, 0.6):
        n = compose.atmosphere(palette(s), 12, amount).agg(F.count_if(F.col("idx") == F.col("to_idx")).alias("exact"), F.count_distinct("to_idx").alias("levels")).withColumn("amount", F.lit(amount))
        out = n if out is None else out.unionByName(n)
    return out


@query("palette_merges", "base:long equip:long colours:long over:boolean", "SELECT b.asset AS base, e.asset AS equip, count(DISTINCT u.idx) AS colours, count(DISTINCT u.idx) > 6 AS over FROM (SELECT DISTINCT asset FROM dense) b JOIN (SELECT DISTINCT asset FROM dense) e ON b.asset < e.asset JOIN (SELECT DISTINCT asset, idx FROM dense) u ON u.asset IN (b.asset, e.asset) GROUP BY 1, 2", "dense")
def _(s, d):
    return compose.palette_merges(dense(s, d), 6)


@query("margins", "kind:string assets:long left_:double top:double", "SELECT CASE WHEN w = 8 AND h = 8 THEN 'full' ELSE 'silhouette' END AS kind, count(*) AS assets, avg(x0) AS left_, avg(y0) AS top FROM (SELECT asset, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM canvases WHERE idx <> 0 GROUP BY 1) GROUP BY 1", "canvases")
def _(s, d):
    b = canvas.bbox(canvases(s, d))
    kind = F.when((F.col("w") == 8) & (F.col("h") == 8), "full").otherwise("silhouette")
    return b.groupBy(kind.alias("kind")).agg(F.count("*").alias("assets"), F.avg("x0").alias("left_"), F.avg("y0").alias("top"))


@query("jaggy_by_colour", "idx:long canvases:long runs:long jaggies:long")
def _(s, d):
    r = kernels.colour_runs(canvases(s, d))
    j = lint.jaggies(r).groupBy("idx").agg(F.count("*").alias("jaggies"))
    return r.groupBy("idx").agg(F.count_distinct("asset").alias("canvases"), F.count("*").alias("runs")).join(j, "idx", "left").withColumn("jaggies", F.coalesce("jaggies", F.lit(0)))


@query("stairs_by_slope", "slope:string run:long n:long", "WITH p AS (SELECT 'half' AS slope, x, x // 2 AS y FROM (SELECT unnest(range(0, 64)) AS x) UNION ALL SELECT 'thirty', x, CAST(floor(x * 0.5773502691896257 + 0.5) AS BIGINT) FROM (SELECT unnest(range(0, 64)) AS x)) SELECT slope, run, count(*) AS n FROM (SELECT slope, y, count(*) AS run FROM p GROUP BY 1, 2) GROUP BY 1, 2")
def _(s, d):
    x = s.range(64).withColumnRenamed("id", "x")
    p = x.select(F.lit("half").alias("slope"), F.expr("x div 2").alias("y")).unionByName(x.select(F.lit("thirty").alias("slope"), F.floor(F.col("x") * 0.5773502691896257 + 0.5).alias("y")))
    return p.groupBy("slope", "y").agg(F.count("*").alias("run")).groupBy("slope", "run").agg(F.count("*").alias("n"))
