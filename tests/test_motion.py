"""Shared palettes, waves, growing and intermediate colours on small cases, by plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake import lineage
from rasterlake.operators import antialias, cycling, shared_palettes
from rasterlake.views import GREYS, palette
from tests.test_kernels import canvas


def test_parts_keep_their_colours_and_faults_are_told(spark):
    px = spark.createDataFrame([(1, 1, 0, 0, 1), (1, 1, 1, 0, 2), (1, 2, 0, 0, 1), (1, 2, 1, 0, 0), (2, 1, 0, 0, 1)], "group int, part int, x int, y int, idx int")
    pals = spark.createDataFrame([(1, 1, 1, 9, 9, 9), (1, 1, 2, 1, 2, 3), (1, 2, 1, 9, 9, 9), (1, 2, 2, 7, 7, 7), (2, 1, 1, 5, 5, 5)], "group int, part int, idx int, r int, g int, b int")
    uses = shared_palettes.used(px, pals)
    pal = shared_palettes.unified(uses)
    assert sorted(map(tuple, pal.collect())) == [(1, 1, 1, 2, 3), (1, 2, 9, 9, 9), (2, 1, 5, 5, 5)]
    new = shared_palettes.remapped(px, shared_palettes.maps(uses, pal))
    assert sorted((r["group"], r["part"], r["x"], r["idx"]) for r in new.collect()) == [(1, 1, 0, 2), (1, 1, 1, 1), (1, 2, 0, 2), (1, 2, 1, 0), (2, 1, 0, 1)]
    with pytest.raises(Exception, match="beyond its palette"):
        shared_palettes.used(px, pals.where("idx < 2")).collect()
    many = spark.range(300).selectExpr("1 AS group", "1 AS part", "cast(id as int) AS idx", "cast(id % 256 as int) AS r", "cast(id div 256 as int) AS g", "0 AS b")
    with pytest.raises(Exception, match="more than 255"):
        shared_palettes.unified(many).collect()


def test_ends_are_shared(spark):
    rows = [(1, 0, 0, 10, 10, 10), (1, 0, 1, 128, 0, 0), (1, 0, 2, 250, 250, 250), (1, 1, 0, 12, 12, 12), (1, 1, 1, 0, 128, 0), (1, 1, 2, 248, 250, 250), (1, 2, 0, 11, 11, 11)]
    pals = spark.createDataFrame(rows, "group int, p int, idx int, r int, g int, b int")
    got = [tuple(r)[2:] for r in shared_palettes.merged(pals, True, 0.05).orderBy("idx").collect()]
    assert got == [(10, 10, 10), (128, 0, 0), (250, 250, 250), (0, 128, 0), (11, 11, 11)]  # a palette of one colour has no ends
    assert shared_palettes.merged(pals).count() == 7


def test_mixing_goes_by_batches(spark):
    """Nulls stay null, and bits are not mixed row by row in nested columns."""
    df = spark.createDataFrame([(1, None), (None, 1), (1, 1)], "s long, k long").select("k", "s", cycling.mixed(F.col("s"), F.col("k")).alias("z"))
    assert [r["z"] is None for r in df.collect()] == [True, True, False]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "ArrowEvalPython" in plan


def test_mixing_wraps_as_in_64_bits(spark):
    whole = (1 << 64) - 1

    def plain(seed, k):
        z = (seed + (k + 1) * cycling.STEP) & whole
        z = ((z ^ z >> 30) * cycling.MIX1) & whole
        z = ((z ^ z >> 27) * cycling.MIX2) & whole
        return z ^ z >> 31

    cases = [(s, k) for s in (0, 1, 7, 2**31, 2**63 - 1, -1, -(2**63)) for k in (0, 1, 5, 10**6)]
    df = spark.createDataFrame(cases, "s long, k long").select("s", "k", cycling.mixed(F.col("s"), F.col("k")).alias("z"), cycling.plus(F.col("s"), F.col("k")).alias("p"), cycling.times(F.col("s"), cycling.MIX1).alias("t"))
    for s, k, z, p, t in df.collect():
        assert (z & whole, p & whole, t & whole) == (plain(s & whole, k), (s + k) & whole, (s * cycling.MIX1) & whole)


def test_waves_repeat_and_small_ones_stand_still(spark):
    one = spark.createDataFrame([(3,)], "asset long")
    for kind in ("sine", "square", "noise", "random-blink"):
        a, b = ([r["value"] for r in cycling.steps(one, kind, 6, 2.0, p, "asset").orderBy("frame").collect()] for p in (0.0, 1.0))
        assert np.allclose(a, b) and all(-1 <= v <= 1 for v in a)
        assert all(r["step"] == 0 for r in cycling.steps(one, kind, 6, 0.4, 0.0, "asset").collect())
    assert [r["step"] for r in cycling.steps(one, "square", 4, 2.5).orderBy("frame").collect()] == [3, 3, -3, -3]
    with pytest.raises(ValueError):
        cycling.steps(one, "sine", 1, 1.0)
    with pytest.raises(ValueError):
        cycling.steps(one, "saw", 4, 1.0)


def grown(v, step):
    for _ in range(abs(step)):
        src, v = v, v.copy()
        for y in range(len(v)):
            for x in range(len(v[0])):
                near = [src[b, a] if 0 <= a < src.shape[1] and 0 <= b < src.shape[0] else 0 for a, b in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))]
                if step > 0 and src[y, x] == 0:
                    v[y, x] = next((n for n in near if n), 0)
                elif step < 0 and src[y, x] and 0 in near:
                    v[y, x] = 0
    return v


def test_growing_and_shrinking(spark):
    rng = np.random.default_rng(4)
    grids = [rng.integers(0, 3, (7, 6)) * (rng.random((7, 6)) < 0.6) for _ in range(5)]
    steps = [2, -2, 1, -1, 0]
    px = canvas(spark, *grids).withColumn("step", F.element_at(F.array(*map(F.lit, steps)), F.col("asset").cast("int") + 1))
    got = {(r["asset"], r["x"], r["y"]): r["idx"] for r in cycling.grow(px, "step", 2).collect()}
    assert got == {(a, x, y): int(v) for a, (g, s) in enumerate(zip(grids, steps)) for y, row in enumerate(grown(g, s)) for x, v in enumerate(row)}


def test_intermediate_pixels_go_and_nothing_else(spark):
    pal = palette(spark, GREYS)
    face = np.array([[1, 1, 1, 1], [1, 1, 3, 3], [3, 3, 3, 3], [3, 3, 3, 3]])
    soft = face.copy()
    soft[1, 1] = 2  # between its neighbours 1 (two of four) and 3 (two of four): the nearer one
    lone = np.array([[1, 1, 1], [1, 4, 1], [1, 1, 1]])
    got = {(r["asset"], r["x"], r["y"]): (r["idx"], r["placed"]) for r in antialias.stripped(canvas(spark, soft, face, lone), pal).collect()}
    assert [k for k, (_, placed) in got.items() if placed] == [(0, 1, 1)]
    way = {(r["m"], r["x"], r["y"]): (r["dx"], r["dy"]) for r in antialias.between(pal).collect()}
    dx, dy = way[(2, 1, 3)]
    assert got[(0, 1, 1)][0] == (1 if dx <= dy else 3)
    assert {k[0] for k in way} == {2, 3} and all(x < m < y for m, x, y in way)
    want = spark.createDataFrame([(1, 4, 0.3), (4, 1, 0.3), (1, 2, 0.5)], "x int, y int, t double")
    assert {(r["x"], r["y"]): r["idx"] for r in antialias.nearest_between(want, pal).collect()} == {(1, 4): 2, (4, 1): 3, (1, 2): None}


def stairs(heights):
    """Columns of 2 from above over 1: a border of steps."""
    v = np.ones((10, 4 * len(heights)), dtype=int)
    for i, h in enumerate(heights):
        v[:h, 4 * i : 4 * i + 4] = 2
    return v


def test_antialiasing_is_added_at_the_ends_of_steps_and_goes_again(spark):
    two = spark.createDataFrame([(0, 0, 0, 0), (1, 0x30, 0x34, 0x5A), (2, 0xC8, 0xCC, 0xE0)], "idx int, r int, g int, b int")
    slope, diagonal = stairs([2, 3, 4, 5]), np.tril(np.ones((12, 12), dtype=int)) + 1
    outside = np.zeros((6, 12), dtype=int)
    outside[2:, :6] = outside[3:, 6:] = 2
    outside[2, 6:] = 0
    px = canvas(spark, slope, diagonal, outside).cache()
    out, made = antialias.added(px, two)
    out = lineage.cut(out)
    new = {(r["asset"], r["x"], r["y"]): r["idx"] for r in out.collect()}
    old = {(r["asset"], r["x"], r["y"]): r["idx"] for r in px.collect()}
    changed = {k for k in old if old[k] != new[k]}
    assert changed and {a for a, *_ in changed} == {0} and all(new[k] > 2 for k in changed)
    for _, x, y in changed:  # each at the end of a step of four, at the border of the two faces
        assert x % 4 in (0, 3) and {slope[y, x], *(slope[b, a] for a, b in ((x, y - 1), (x, y + 1), (x - 1, y), (x + 1, y)) if 0 <= a < 16)} == {1, 2}
    colours = {(r["idx"]): (r["r"], r["g"], r["b"]) for r in made.collect()}
    assert set(colours) == {new[k] for k in changed} and all(0x30 < r < 0xC8 for r, _, _ in colours.values())
    whole = spark.createDataFrame([(0, 0, 0, 0), (1, 0x30, 0x34, 0x5A), (2, 0xC8, 0xCC, 0xE0), *((i, *c) for i, c in colours.items())], "idx int, r int, g int, b int")
    back = antialias.stripped(out, whole)
    assert {(r["asset"], r["x"], r["y"]): r["idx"] for r in back.collect()} == old
    assert {(r["x"], r["y"]) for r in back.where("placed").collect()} == {k[1:] for k in changed}
    again, more = antialias.added(out, whole)
    assert more.count() == 0 and {(r["asset"], r["x"], r["y"]): r["idx"] for r in again.collect()} == new


def test_outlines_of_a_square_by_hand(spark):
    from rasterlake.operators import outlines

    pal = spark.createDataFrame([(0, 0, 0, 0), (1, 0xC0, 0x70, 0x40), (2, 0xE0, 0xA0, 0x60)], "idx int, r int, g int, b int")
    v = np.zeros((7, 7), dtype=int)
    v[1:6, 1:6] = 2
    v[2:5, 2:5] = 1
    thin = np.zeros((4, 5), dtype=int)
    thin[1, 1:4] = 1
    px = canvas(spark, v, thin).cache()

    def drawn(*args, **kw):
        out, new = outlines.outlined(px, pal, *args, **kw)
        g = {0: np.zeros((7, 7), int), 1: np.zeros((4, 5), int)}
        for r in out.collect():
            g[r["asset"]][r["y"], r["x"]] = r["idx"]
        return g, {(r["asset"], r["idx"]): (r["r"], r["g"], r["b"]) for r in new.collect()}

    got, new = drawn("none")
    assert not new and (got[0][1:6, 1:6] == 1).all() and (got[1] == thin).all()  # nothing lies inside a thin line
    got, new = drawn("black")
    assert new == {(0, 3): (0, 0, 0)} and (got[0][1, 1:6] == 3).all() and (got[0][2:5, 2:5] == 1).all() and (got[1] == thin).all()
    got, new = drawn("black", most=0)
    assert not new and set(got[0][1]) == {0, 1}  # the nearest entry there is
    got, new = drawn("tinted", outer=True)
    assert (got[0][0, 1:6] == 3).all() and got[0][0, 0] == 0 and (got[0][1:6, 1:6] == v[1:6, 1:6]).all() and len(new) == 1
    got, _ = drawn("tinted", selective=True, light=(0.0, -1.0))
    assert (got[0][1, 1:6] == 2).all() and (got[0][5, 1:6] == 3).all() and got[0][3, 1] == 3
    dark, pale = (drawn("contrast", bright=b)[1][0, 3] for b in (True, False))
    assert sum(dark) < 0xC0 + 0x70 + 0x40 < sum(pale)
    assert len(drawn("shaded")[1]) > 1
    with pytest.raises(ValueError):
        outlines.outlined(px, pal, "dotted")
