"""Kernels and operators whose results SQL can't give, on small cases worked out by hand or by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import compose, kernels, lint, points, quantize, stacks, tiles
from rasterlake.plans import recipe, relations
from rasterlake.views import PALETTE, palette


def rows(v, asset=1):
    return [(asset, x, y, int(v[y][x])) for y in range(len(v)) for x in range(len(v[0]))]


def canvas(spark, *grids):
    return spark.createDataFrame([r for i, g in enumerate(grids) for r in rows(g, i)], "asset long, x int, y int, idx int")


def test_a_border_that_passes_its_start_twice():
    v = np.array([[0, 1, 0], [1, 0, 1]], dtype=bool)
    (hole, points_), = kernels.borders(v)
    assert not hole and points_ == [(1, 0), (2, 1), (1, 0), (0, 1)]
    assert kernels.borders(np.array([[1]], dtype=bool)) == [(False, [(0, 0)])]
    assert kernels.borders(np.zeros((2, 2), dtype=bool)) == []


def test_borders_of_all_parts_and_holes():
    ring = np.zeros((7, 9), dtype=bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    ring[2, 8] = True
    got = kernels.borders(ring)
    assert [hole for hole, _ in got] == [False, False, True]
    outer = set(got[0][1])
    assert outer == {(x, y) for x in range(1, 6) for y in range(1, 6) if x in (1, 5) or y in (1, 5)} and len(got[0][1]) == 16
    assert got[1][1] == [(8, 2)]
    assert set(got[2][1]) == {(3, 2), (2, 3), (4, 3), (3, 4)}


def test_chains_do_not_turn_back():
    rng = np.random.default_rng(3)
    for _ in range(40):
        v = rng.random((8, 8)) < 0.6
        for _, pts in kernels.borders(v):
            chains = kernels.monotone(pts)
            steps = sum(len(c) - 1 for c in chains)
            assert steps >= len(pts) - 1
            for c in chains:
                for axis in (0, 1):
                    s = {int(np.sign(b[axis] - a[axis])) for a, b in zip(c, c[1:])} - {0}
                    assert len(s) <= 1
                flat, runs = kernels.chain_runs(c)
                assert sum(map(len, runs)) == len(c) and all(len({p[int(flat)] for p in r}) == 1 for r in runs)


def stairs(widths, h=8):
    v = np.zeros((h, sum(widths)), dtype=int)
    x = 0
    for step, w in enumerate(widths):
        v[step + 1 :, x : x + w] = 1
        x += w
    return v


def test_jaggies_of_stairs(spark):
    px = canvas(spark, stairs([3, 3, 3, 3]), stairs([3, 3, 1, 3, 3]))
    found = {(r["asset"], r["len"], r["target"]) for r in lint.jaggies(kernels.colour_runs(px)).collect()}
    assert found == {(1, 1, 3)}
    report = {r["asset"]: r for r in lint.jaggy_report(kernels.colour_runs(px)).collect()}
    assert report[0]["jaggies"] == 0 and report[1]["jaggies"] == 1 and report[1]["fixable"] == 0


def test_stairs_side_by_side_are_banding(spark):
    v = np.zeros((16, 24), dtype=int)
    for x in range(24):
        v[x // 3 + 2 :, x] = 1
        v[x // 3 + 4 :, x] = 2
    alone = np.where(v == 1, 1, np.where(v == 2, 1, 0))
    got = {r["asset"]: r["n"] for r in lint.rule_12(kernels.colour_runs(canvas(spark, v, alone)), 3, 5).collect()}
    assert got.get(0, 0) >= 1 and 1 not in got


def test_shared_runs(spark):
    def brute(a, b):
        best = 0
        for x, y in ((a, b), (b, a)):
            for o in range(len(x)):
                n = 0
                while o + n < len(x) and n < len(y) and x[o + n] == y[n]:
                    n += 1
                best = max(best, n)
        return best

    rng = np.random.default_rng(1)
    pairs = [(rng.integers(1, 3, rng.integers(1, 9)).tolist(), rng.integers(1, 3, rng.integers(1, 9)).tolist()) for _ in range(60)]
    got = spark.createDataFrame(pairs, "a array<int>, b array<int>").select("a", "b", lint.shared_runs(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r["n"] == brute(r["a"], r["b"]) for r in got)


def test_chamfer_is_the_least_over_all_pixels():
    rng = np.random.default_rng(2)
    v = rng.random((20, 9, 11)) < 0.1
    got = stacks.chamfer(v)
    y, x = np.mgrid[:9, :11]
    for k in range(20):
        want = np.full((9, 11), np.inf)
        for oy, ox in np.argwhere(v[k]):
            dy, dx = abs(y - oy), abs(x - ox)
            want = np.minimum(want, 3 * np.maximum(dx, dy) + np.minimum(dx, dy))
        assert np.array_equal(got[k], want)


def test_ramps_can_be_shown_and_grow_lighter(spark):
    from rasterlake.operators import color

    got = quantize.ramp(palette(spark).where("idx <> 0"), 6)
    assert got.count() == 6 * (len(PALETTE) - 1) and got.where("NOT (r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255)").count() == 0
    light = {}
    for r in color.with_oklab(got).orderBy("idx", "step").collect():
        light.setdefault(r["idx"], []).append(r["l"])
    assert all(a < b for v in light.values() for a, b in zip(v, v[1:]))


def test_bayer_ranks_are_a_permutation(spark):
    for side in (2, 4, 8):
        got = [r["rank"] for r in quantize.bayer_table(spark, side).collect()]
        assert sorted(got) == list(range(side * side))


def test_patches_expect_what_they_saw(spark):
    a = canvas(spark, [[1, 2], [3, 0]])
    patch = points.paint(a, spark.createDataFrame([(0, 0, 0), (0, 5, 5)], "asset long, x int, y int"), F.lit(7))
    assert [tuple(r) for r in patch.collect()] == [(0, 0, 0, 1, 7)]
    after = points.apply(a, patch)
    assert points.apply(after, patch, back=True).exceptAll(a).count() == 0
    with pytest.raises(Exception, match="changed since"):
        points.apply(after, patch).collect()


def test_templates_and_limits(spark):
    df = spark.createDataFrame([("${a}-${b}", {"a": "1", "b": "2"})], "t string, m map<string,string>")
    assert df.select(compose.substituted(F.col("t"), F.col("m"))).first()[0] == "1-2"
    with pytest.raises(Exception, match="no value for c"):
        df.select(compose.substituted(F.lit("${c}"), F.col("m"))).collect()
    with pytest.raises(Exception, match="256 entries"):
        quantize.with_entry(palette(spark), 256, 1, 2, 3).collect()


def test_numbers_follow_the_order(spark):
    keys = [5, 1000, -7, 12, 999, 3]
    got = {r["k"]: r["n"] for r in tiles.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", buckets=3).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert tiles.numbered(spark.createDataFrame([], "k long"), "k").count() == 0


def test_isolated_pixels_that_are_shades_or_next_to_clear_ones(spark):
    v = np.full((6, 6), 2)
    far, shade, edge = v.copy(), v.copy(), v.copy()
    far[2, 2], shade[2, 2] = 7, 13
    edge[0, 0], edge[0, 1] = 7, 0
    from rasterlake.operators import color, regions

    pal = palette(spark)
    lab = {r["idx"]: np.array([r["l"], r["a_"], r["b_"]]) for r in color.with_oklab(pal).collect()}
    near = sorted(i for i in range(1, 16) if i != 2 and np.linalg.norm(lab[i] - lab[2]) < 0.22)
    shade[2, 2] = near[0]
    assert np.linalg.norm(lab[7] - lab[2]) >= 0.22
    got = {r["asset"] for r in lint.rule_3(regions.label(canvas(spark, far, shade, edge)), pal).collect()}
    assert got == {0, 2}


def test_sources_are_known_by_content(spark):
    a, b = (spark.createDataFrame([(1, v), (2, "y"), (2, "y")], "k int, v string") for v in "xz")
    assert recipe.source_digest(a) == recipe.source_digest(a.orderBy(F.desc("k")))
    assert len({recipe.source_digest(d) for d in (a, b, a.limit(1), a.withColumnRenamed("v", "w"))}) == 4


def test_deep_graphs_and_cycles(spark):
    chain = spark.createDataFrame([(f"s{i}", f"s{i + 1}") for i in range(24)], "src string, dst string")
    assert relations.levels(chain).agg(F.max("level")).first()[0] == 24
    with pytest.raises(ValueError, match="cycle"):
        relations.levels(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")).collect()
