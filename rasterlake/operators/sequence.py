"""Frame sequences: timing, topology, volume, wobble, orphan columns, tweens, smears and periodic motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import canvas, geometry, regions, runs


def duration_ms(hold: Column, fps: float) -> Column:
    """Of a frame held for so many ticks, at least 1."""
    return F.greatest(F.round(hold * 1000 / F.lit(fps)), F.lit(1)).cast("long")


def ease_total(frames: DataFrame, fps: float = 12.0, key=("asset",)) -> DataFrame:
    """Sum of durations when every frame is held once, the first and last of a sequence twice."""
    f = frames.select(*key, "frame").distinct()
    w = Window.partitionBy(*key)
    f = f.withColumn("hold", F.when((F.col("frame") == F.min("frame").over(w)) | (F.col("frame") == F.max("frame").over(w)), 2).otherwise(1))
    return f.groupBy(*key).agg(F.sum(duration_ms(F.col("hold"), fps)).alias("total_ms"), F.count("*").alias("n"))


def topology_breaks(px: DataFrame, key=("asset",)) -> DataFrame:
    """Frames whose Euler number differs from both neighbours'."""
    chi = regions.euler(px, (*key, "frame"))
    w = Window.partitionBy(*key).orderBy("frame")
    return chi.withColumn("before", F.lag("chi").over(w)).withColumn("after", F.lead("chi").over(w)).where("chi <> before AND chi <> after").select(*key, "frame", "chi", "before", "after")


def boxes(px: DataFrame, key=("asset",)) -> DataFrame:
    k = (*key, "frame")
    return canvas.bbox(px, k).join(canvas.opaque(px).groupBy(*k).agg(F.count("*").alias("area")), list(k))


def volume_changes(px: DataFrame, limit: float = 0.05, key=("asset",)) -> DataFrame:
    """Frames whose box grows one way and shrinks the other while its area is off by more than the limit."""
    w = Window.partitionBy(*key).orderBy("frame")
    b = boxes(px, key).withColumns({"pw": F.lag("w").over(w), "ph": F.lag("h").over(w)})
    error = F.abs(F.col("w") * F.col("h") - F.col("pw") * F.col("ph")) / (F.col("pw") * F.col("ph"))
    return b.withColumn("error", error).where((F.col("w") - F.col("pw")) * (F.col("h") - F.col("ph")) < 0).where(F.col("error") > limit).select(*key, "frame", "error")


def exclusion_changes(px: DataFrame, row: int, key=("asset",)) -> DataFrame:
    """Frames in which a protected row of pixels differs from the frame before."""
    w = Window.partitionBy(*key, "x", "y").orderBy("frame")
    c = px.where(F.col("y") == row).withColumn("was", F.lag("idx").over(w)).where("was is not null AND was <> idx")
    return c.groupBy(*key, "frame").agg(F.count("*").alias("changed"))


def wobble(px: DataFrame, limit: float = 0.01, flips: int = 2, key=("asset",)) -> DataFrame:
    """Share of pixels (of the mean area) that switch between opaque and clear ``flips`` times or more."""
    w = Window.partitionBy(*key, "x", "y").orderBy("frame")
    m = px.withColumn("m", (F.col("idx") != 0).cast("int"))
    f = m.withColumn("flip", (F.lag("m").over(w) != F.col("m")).cast("int")).groupBy(*key, "x", "y").agg(F.sum("flip").alias("flips"))
    n = f.where(F.col("flips") >= flips).groupBy(*key).agg(F.count("*").alias("n"))
    area = m.groupBy(*key, "frame").agg(F.sum("m").alias("a")).groupBy(*key).agg(F.avg("a").alias("mean_area"))
    return n.join(area, list(key)).withColumn("ratio", F.col("n") / F.col("mean_area")).where(F.col("ratio") > limit)


def orphan_columns(px: DataFrame, least: int = 2, key=("asset",)) -> DataFrame:
    """Vertical runs shorter than ``least`` that the frame before does not touch."""
    k = (*key, "frame")
    r = runs.run_lengths(canvas.opaque(px).withColumn("m", F.lit(1)), k, "y", "x", "m").where(F.col("len") < least)
    cells = r.withColumn("y", F.explode(F.sequence(F.col("start"), (F.col("start") + F.col("len") - 1).cast("int"))))
    before = canvas.opaque(px).select(*key, (F.col("frame") + 1).alias("frame"), "x", "y")
    return cells.where("frame > 1").join(before, [*k, "x", "y"], "left_anti").groupBy(*k).agg(F.count("*").alias("orphans"))


def tween_mask(px: DataFrame, w: int, h: int, t: float = 0.5, key=("asset",)) -> DataFrame:
    """Between each frame and the next: the pixels whose mixed signed distance is above 0."""
    k = (*key, "frame")
    d = geometry.signed_distance(px, w, h, k)
    nxt = d.select(*key, (F.col("frame") - 1).alias("frame"), "x", "y", F.col("d").alias("e"))
    return d.join(nxt, [*k, "x", "y"]).where((1 - t) * F.col("d") + t * F.col("e") > 0).groupBy(*k).agg(F.count("*").alias("area"))


def onion_counts(px: DataFrame, back: int = 1, ahead: int = 1, key=("asset",)) -> DataFrame:
    """How many of a frame's neighbours (and itself) have each pixel."""
    m = canvas.opaque(px).select(*key, "frame", "x", "y")
    w = Window.partitionBy(*key, "x", "y").orderBy("frame").rangeBetween(-back, ahead)
    return m.withColumn("n", F.count("*").over(w)).groupBy(*key, "frame", "n").agg(F.count("*").alias("pixels"))


def reversed_loop(frames: DataFrame, key=("asset",)) -> DataFrame:
    """Frame numbers of a sequence played there and back (inner frames reversed): new number and source."""
    f = frames.select(*key, "frame").distinct()
    n = f.groupBy(*key).agg(F.max("frame").alias("n"))
    back = f.join(n, list(key)).where("frame > 1 AND frame < n").select(*key, (2 * F.col("n") - F.col("frame")).alias("new_frame"), F.col("frame").alias("source"))
    return f.select(*key, F.col("frame").alias("new_frame"), F.col("frame").alias("source")).unionByName(back)


def wave(kind: str, k: Column, n: Column, phase: float = 0.0) -> Column:
    """A periodic value in -1..1 at frame k of n."""
    turn = 2 * 3.141592653589793 * (k / n + phase)
    return F.sin(turn) if kind == "sine" else F.when(F.sin(turn) >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def centres(px: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, frame, cx, cy, w, h): the rounded centre and the box of each frame's opaque pixels."""
    near = lambda c: F.floor(F.sum(c) / F.count("*") + 0.5).cast("int")
    return canvas.opaque(px).groupBy(*key, "frame").agg(near("x").alias("cx"), near("y").alias("cy"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


def moves(px: DataFrame, key=("asset",)) -> DataFrame:
    """(keys, frame, dx, dy, dw, dh): how centre and box change from the frame before."""
    w = Window.partitionBy(*key).orderBy("frame")
    step = lambda c: F.when(F.lag("frame").over(w) == F.col("frame") - 1, F.col(c) - F.lag(c).over(w))
    return centres(px, key).select(*key, "frame", step("cx").alias("dx"), step("cy").alias("dy"), step("w").alias("dw"), step("h").alias("dh")).where("dx is not null")


def dither_in_motion(px: DataFrame, opts: dict, limit: float = 0.10, slack: int = 0, key=("asset",)) -> DataFrame:
    """Frames that move and whose dither doesn't move along: checked and differing pixels, where more than the limit differ.

    Frames whose box changes by more than ``slack`` are not judged.
    """
    from rasterlake.operators import lint

    k = (*key, "frame")
    m = moves(px, key).where((F.abs("dx") + F.abs("dy") > 0) & (F.abs("dw") <= slack) & (F.abs("dh") <= slack)).select(*k, "dx", "dy")
    s = opts["window"]
    now = px.where("idx <> 0").withColumns({"wx": F.expr(f"cast(x div {s} as int)"), "wy": F.expr(f"cast(y div {s} as int)")})
    now = now.join(lint.dither_windows(px, opts, k).select(*k, "wx", "wy"), [*k, "wx", "wy"]).join(m, list(k))
    now = now.select(*k, (F.col("x") - F.col("dx")).alias("x"), (F.col("y") - F.col("dy")).alias("y"), "idx")
    before = px.where("idx <> 0").select(*key, (F.col("frame") + 1).alias("frame"), "x", "y", F.col("idx").alias("was"))
    c = now.join(before, [*k, "x", "y"]).groupBy(*k).agg(F.count("*").alias("checked"), F.count_if(F.col("idx") != F.col("was")).alias("differs"))
    return c.where(F.col("differs") > limit * F.col("checked"))


def new_columns(px: DataFrame, least: int = 2, key=("asset",)) -> DataFrame:
    """How many vertical runs of pixels that the frame before doesn't have, centres laid on each other, are shorter than ``least``.

    Frames whose box isn't as large as the one before are not judged: there shapes stretch.
    """
    k = (*key, "frame")
    c = centres(px, key)
    own = canvas.opaque(px).join(c.select(*k, "cx", "cy"), list(k)).select(*k, (F.col("x") - F.col("cx")).alias("x"), (F.col("y") - F.col("cy")).alias("y"))
    follows = c.select(*key, (F.col("frame") + 1).alias("frame"), F.col("w").alias("_w"), F.col("h").alias("_h"))
    follows = c.join(follows, list(k)).where("w = _w AND h = _h").select(*k)
    new = own.join(follows, list(k), "left_semi").join(own.withColumn("frame", F.col("frame") + 1), [*k, "x", "y"], "left_anti")
    col = Window.partitionBy(*k, "x").orderBy("y")
    runs_ = new.withColumn("g", F.col("y") - F.row_number().over(col)).groupBy(*k, "x", "g").agg(F.count("*").alias("n")).where(F.col("n") < least)
    return runs_.groupBy(*k).agg(F.count("*").alias("orphans"))


def coverage(px: DataFrame, excluded: int = 0, key=("asset",)) -> DataFrame:
    """(keys, frames, inbetweens, squash_pairs, unchecked): what the rules for sequences had to look at, and which could not look."""
    w = Window.partitionBy(*key).orderBy("frame")
    c = centres(px, key)
    squash = F.coalesce((F.col("w") - F.lag("w").over(w)) * (F.col("h") - F.lag("h").over(w)) < 0, F.lit(False))
    n = c.withColumn("sq", squash).groupBy(*key).agg(F.count("*").alias("frames"), F.count_if("sq").alias("squash_pairs")).withColumn("inbetweens", F.greatest(F.col("frames") - 2, F.lit(0)))
    missing = F.concat_ws(",", F.when(F.col("inbetweens") == 0, "22"), F.lit("26") if not excluded else F.lit(None).cast("string"), F.when(F.col("squash_pairs") == 0, "27"))
    return n.withColumn("unchecked", missing)


def _distances(px: DataFrame, w: int, h: int, ahead: int, key) -> DataFrame:
    """Signed distances of each frame (d) and of the one ``ahead`` frames on (e)."""
    k = (*key, "frame")
    d = geometry.signed_distance(px, w, h, k)
    later = d.select(*key, (F.col("frame") - ahead).alias("frame"), "x", "y", F.col("d").alias("e"))
    return d.join(later, [*k, "x", "y"])


def tween_series(px: DataFrame, w: int, h: int, steps: int, key=("asset",)) -> DataFrame:
    """(keys, frame, step, x, y): pixels of the ``steps`` shapes between each frame and the next, evenly spaced."""
    p = _distances(px, w, h, 1, key).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return p.where(F.round(F.col("d") * (steps + 1 - F.col("step")) + F.col("e") * F.col("step"), 9) > 0).select(*key, "frame", "step", "x", "y")


def extrapolated(px: DataFrame, w: int, h: int, amount: float, key=("asset",)) -> DataFrame:
    """(keys, frame, x, y): pixels of the shape that lies beyond the next frame by a share of the step to it."""
    p = _distances(px, w, h, 1, key)
    return p.where(F.round(F.col("e") * (1 + amount) - F.col("d") * amount, 9) > 0).select(*key, "frame", "x", "y")


def tween_truths(px: DataFrame, w: int, h: int, key=("asset",)) -> DataFrame:
    """(keys, frame, tween_iou, hold_iou, beats): the tween of a frame's neighbours, and the frame before held, against the frame itself."""
    p = _distances(px, w, h, 2, key).select(*key, (F.col("frame") + 1).alias("frame"), "x", "y", (F.col("d") + F.col("e") > 0).alias("tw"), (F.col("d") > 0).alias("hold"))
    j = p.join(px.select(*key, "frame", "x", "y", (F.col("idx") != 0).alias("own")), [*key, "frame", "x", "y"])
    iou = lambda c: F.count_if(F.col(c) & F.col("own")) / F.greatest(F.count_if(F.col(c) | F.col("own")), F.lit(1))
    return j.groupBy(*key, "frame").agg(iou("tw").alias("tween_iou"), iou("hold").alias("hold_iou")).withColumn("beats", F.round("tween_iou", 9) > F.round("hold_iou", 9))
