"""Air perspective on ramps whose steps are plain."""

import pytest

from rasterlake.operators import haze

GREYS = [(0, 0, 0, 0), (1, 20, 20, 20), (2, 90, 90, 90), (3, 160, 160, 160), (4, 235, 235, 235), (5, 200, 0, 0)]


def steps(spark, amounts, **more):
    pal = spark.createDataFrame(GREYS, "idx int, r int, g int, b int")
    return haze.steps(pal, (255, 255, 255), amounts, **more)


def test_greys_step_to_a_white_sky(spark):
    to = {(r["depth"], r["idx"]): r["to_idx"] for r in steps(spark, (0.0, 0.4, 1.0)).collect()}
    assert len(to) == 15 and all(to["foreground", i] is None for i in range(1, 6))
    assert [to["background", i] for i in (1, 2, 3, 4)] == [4, 4, 4, None]
    # The lightest grey lies nearly on the red's way to white; the others lie off it.
    assert to["midground", 1] == 2 and to["midground", 5] == to["background", 5] == 4
    assert {(r["depth"], r["idx"]): r["to_idx"] for r in steps(spark, (0.0, 0.4, 1.0), tolerance=0.001).collect()}["background", 5] is None
    assert {(r["depth"], r["idx"]): r["to_idx"] for r in steps(spark, (0.0, 0.4, 1.0), tolerance=2.0).collect()}["midground", 5] == 3


def test_pixels_and_report(spark):
    px = spark.createDataFrame([(1, "background", 0, 0, 1), (1, "background", 1, 0, 2), (1, "background", 2, 0, 0), (1, "background", 3, 0, 5), (1, "foreground", 0, 0, 1), (2, "elsewhere", 0, 0, 1), (2, "background", 0, 0, None)], "asset long, depth string, x int, y int, idx int")
    s = steps(spark, (0.0, 0.4, 1.0), tolerance=0.001)
    got = sorted((r["asset"], r["depth"], r["x"], r["idx"]) for r in haze.hazed(px, s).collect() if r["idx"] is not None)
    assert got == [(1, "background", 0, 4), (1, "background", 1, 4), (1, "background", 2, 0), (1, "background", 3, 5), (1, "foreground", 0, 1), (2, "elsewhere", 0, 1)]
    rows = {(r["asset"], r["depth"]): r for r in haze.report(px, s).collect()}
    assert set(rows) == {(1, "background"), (1, "foreground")}
    r = rows[1, "background"]
    assert (r["colours"], r["moved"], r["no_step"], r["collapsed"], r["pixels"]) == (3, 2, 1, 1, 2) and r["after"] < r["before"] + 0.4
    assert haze.hazed(px.where("false"), s).count() == haze.report(px.where("false"), s).count() == 0


def test_amounts_are_checked(spark):
    for bad in ((0.5, 0.2, 0.8), (0.0, 0.5, 1.5), (-0.1, 0.0, 0.0)):
        with pytest.raises(ValueError):
            steps(spark, bad)
