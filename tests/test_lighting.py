"""Normals, lamps and hollows of shapes whose answer is known."""

import math

import numpy as np
from pyspark.sql import functions as F

from rasterlake.operators import lighting
from tests.test_kernels import canvas


def test_normals_of_a_disc_point_to_its_middle(spark):
    y, x = np.mgrid[:15, :15]
    disc = ((x - 7) ** 2 + (y - 7) ** 2 <= 36).astype(int)
    got = {(r["x"], r["y"]): (r["nx"], r["ny"]) for r in lighting.normal_field(canvas(spark, disc), 15, 15).collect()}
    for (a, b), (nx, ny) in got.items():
        away = math.hypot(7 - a, 7 - b)
        if disc[b, a] and away > 2:
            assert nx is not None and math.isclose(math.hypot(nx, ny), 1, rel_tol=1e-9) and (nx * (7 - a) + ny * (7 - b)) / away > 0.85
    bare = {(r["x"], r["y"]): r["nx"] for r in lighting.normal_field(canvas(spark, disc), 15, 15, passes=0, radius=0).collect()}
    assert bare[7, 7] is None and sum(v is None for v in bare.values()) >= sum(n[0] is None for n in got.values())


def test_light_of_segments(spark):
    def light(nx, ny, a, b):
        return spark.range(1).select(lighting.segment_light(F.lit(0.0), F.lit(0.0), F.lit(nx), F.lit(ny), a, b, 2.0)).first()[0]

    assert math.isclose(light(0.0, -1.0, (-1.0, -1.0), (1.0, -1.0)), 2 * math.sqrt(2))  # 45 degrees to both sides
    assert math.isclose(light(0.0, -1.0, (1.0, -1.0), (-1.0, -1.0)), 2 * math.sqrt(2))
    assert math.isclose(light(0.0, 1.0, (-1.0, -1.0), (1.0, -1.0)), 4.0)  # behind, with an end beyond each horizon
    assert light(0.0, 1.0, (0.5, -1.0), (1.0, -1.0)) < 1e-9
    assert light(0.0, -1.0, (0.0, 0.0), (1.0, -1.0)) == 0.0


def test_ramp_steps_and_dark_pixels(spark):
    solid = np.zeros((9, 9), dtype=int)
    solid[2:7, 2:7] = 1
    px = canvas(spark, solid)
    out = {(r["x"], r["y"]): (r["light"], r["step"]) for r in lighting.lit(px, lighting.normal_field(px, 9, 9), [((-60.0, -9.0), (-20.0, -9.0), 40.0)], 4).collect()}
    assert len(out) == 25 and out[4, 2][1] == 3 and out[4, 2][0] > 1 and out[4, 6] == (0.0, 0)


def test_only_hollows_are_below_zero(spark):
    full, notch = np.ones((9, 9), dtype=int), np.ones((9, 9), dtype=int)
    notch[:5, 3:6] = 0
    got = {(r["asset"], r["x"], r["y"]): r["curvature"] for r in lighting.hollows(canvas(spark, full, notch), 9, 9, 1).collect()}
    assert len(got) == 162 and min(v for (asset, _, _), v in got.items() if asset == 0) > -1e-9
    assert min(got[1, x, y] for x in range(9) for y in range(9) if notch[y, x]) < -1e-3


MODEL = lighting.Model([1, 2, 3], [4, 5, 6], [7, 8], 9)


def shades(spark, v, lamp, **more):
    v = np.asarray(v)
    return {(r["x"], r["y"]): r["idx"] for r in lighting.shaded(canvas(spark, v), v.shape[1], v.shape[0], lamp, MODEL, **more).collect()}


def test_a_disc_is_lit_from_its_lamp_and_dark_behind(spark):
    y, x = np.mgrid[:15, :15]
    disc = ((x - 7) ** 2 + (y - 7) ** 2 <= 36).astype(int)
    got = shades(spark, disc, lighting.Lamp("directional", (1.0, 1.0)))
    assert len(got) == 225 and all(got[i, j] == 0 for i in range(15) for j in range(15) if not disc[j, i])
    assert got[3, 3] == 3 and got[11, 11] in (7, 8) and got[11, 8] in (4, 5)
    lamps = [lighting.Lamp("point", (-3.0, -3.0), 90.0), lighting.Lamp("segment", ((-6.0, 0.0), (0.0, -6.0)), 2.0), lighting.Lamp("area", (-6.0, -6.0, 6.0, 2.0), 2.0)]
    for lamp in lamps:
        one = shades(spark, disc, lamp)
        assert one[3, 3] in (1, 2, 3) and one[11, 8] in (4, 5, 6) and one[11, 11] > 6
    near, far = (shades(spark, disc, lighting.Lamp("point", (-3.0, -3.0), i))[3, 3] for i in (200.0, 0.5))
    assert near == 3 and far == 1


def test_ambient_light_bounces_and_hollows(spark):
    solid = np.zeros((9, 9), dtype=int)
    solid[2:7, 2:7] = 1
    ambient = shades(spark, solid, lighting.Lamp("ambient"))
    assert {v for v in ambient.values()} == {0, 5}
    down = lighting.Lamp("directional", (0.0, 1.0))
    assert shades(spark, solid, down)[4, 6] == 8 and shades(spark, solid, down, reach=0)[4, 6] == 4
    # A mask too flat for a normal anywhere takes the hidden entry where none is near.
    assert shades(spark, np.zeros((3, 3), dtype=int), down) == {(i, j): 0 for i in range(3) for j in range(3)}
    notch = np.ones((12, 12), dtype=int)
    notch[:7, 4:8] = 0
    plain, dark = shades(spark, notch, down), shades(spark, notch, down, hollow=0.1, hollow_passes=1)
    hidden = {p for p in dark if dark[p] != plain[p]}
    assert hidden and all(dark[p] == 9 and 2 <= p[0] <= 9 for p in hidden)
    assert set(shades(spark, np.ones((8, 8), dtype=int), lighting.Lamp("ambient"), hollow=0.1).values()) == {5}


def test_empty_ramps_and_tables(spark):
    solid = canvas(spark, np.ones((5, 5), dtype=int))
    bare = lighting.Model([], [], [], 9)
    assert {r["idx"] for r in lighting.shaded(solid, 5, 5, lighting.Lamp("directional", (1.0, 0.0)), bare).collect()} == {9}
    assert lighting.shaded(solid.where("false"), 5, 5, lighting.Lamp("ambient"), MODEL, hollow=0.2).count() == 0


def test_reshading_keeps_the_side_of_the_light(spark):
    y, x = np.mgrid[:11, :11]
    v = (((x - 5) ** 2 + (y - 5) ** 2 <= 16) & ~((x > 6) & (y > 6))).astype(int)
    px = canvas(spark, v)
    lamp = lighting.Lamp("directional", (1.0, 0.4))
    first = lighting.shaded(px, 11, 11, lamp, MODEL)
    again = {(r["x"], r["y"]): r["idx"] for r in lighting.reshaded(first, 11, 11, lamp, MODEL).collect()}
    assert again == shades(spark, v[:, ::-1], lamp)
    pal = spark.createDataFrame([(i, i, i, i) for i in range(10)], "idx int, r int, g int, b int")
    share = lighting.reshaded_share(first, lighting.reshaded(first, 11, 11, lamp, MODEL), 11, pal, pal).first()["share"]
    mirrored = {(10 - r["x"], r["y"]): r["idx"] for r in first.collect() if r["idx"]}
    assert share > 0.2 and math.isclose(share, np.mean([again[p] != i for p, i in mirrored.items()]))


def test_checkable_mirrors():
    lamp = lambda dx, dy: lighting.Lamp("directional", (dx, dy))
    assert not lighting.mirror_is_checkable(lamp(0.0, 1.0)) and lighting.mirror_is_checkable(lamp(1.0, 1.0))
    edge = math.sqrt(0.225)
    assert not lighting.mirror_is_checkable(lamp(edge - 0.01, math.sqrt(1 - (edge - 0.01) ** 2)))
    assert lighting.mirror_is_checkable(lamp(edge + 0.01, math.sqrt(1 - (edge + 0.01) ** 2)))
    assert not lighting.mirror_is_checkable(lighting.Lamp("point", (9.0, 0.0)))


def test_directions_added_by_mirrors(spark):
    px = spark.createDataFrame([(1, "e", 0, 0, 5), (1, "e", 1, 0, 0), (1, "n", 0, 0, 2), (2, "e", 0, 0, 1), (2, "w", 0, 0, 2)], "asset long, direction string, x int, y int, idx int")
    made = [r for r in lighting.expanded(px, 2).collect() if r["source"]]
    assert sorted((r["asset"], r["direction"], r["x"], r["idx"]) for r in made) == [(1, "w", 0, 0), (1, "w", 1, 5)]
    assert lighting.expanded(px, 2).count() == 7
