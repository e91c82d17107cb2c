"""Smoothing: staircases worked out by hand, and every single move tried on small canvases."""

import numpy as np
import pytest

from rasterlake.operators import kernels, lint, smoothing
from tests.test_kernels import canvas


def staircase(widths, under=0, over=1):
    h = len(widths) + 2
    v = np.full((h + 1, sum(widths) + 2), under)
    x = 1
    for step, w in enumerate(widths):
        v[step + 1 : h + 1, x : x + w] = over
        x += w
    return v


@pytest.mark.parametrize(
    "widths, most, moved, remaining, over_limit",
    [([3, 3, 2, 3], 1, 1, 0, 0), ([4, 3, 2, 3, 4], 1, 0, 0, 0), ([3, 3, 1, 3], 1, 0, 1, 1), ([3, 3, 3, 3], 1, 0, 0, 0)],
)
def test_staircases(widths, most, moved, remaining, over_limit):
    v = staircase(widths)
    before = v.copy()
    r = smoothing.smooth(v, most)
    assert (r["moved"], r["remaining"], r["over_limit"]) == (moved, remaining, over_limit)
    assert (v != before).sum() == moved
    assert smoothing.smooth(v, most)["moved"] == 0


def test_a_deep_dip_is_mended_under_a_higher_limit():
    v = staircase([3, 3, 1, 3])
    r = smoothing.smooth(v, 2)
    assert r["moved"] > 0 and r["remaining"] == 0


def test_a_border_between_colours_is_smoothed_too():
    v = staircase([3, 3, 2, 3], 1, 2)
    before = sum(len(smoothing.dips(v == i)) for i in (1, 2))
    r = smoothing.smooth(v)
    assert r["moved"] > 0 and r["remaining"] < before


def test_a_disc_and_lines_stay():
    y, x = np.mgrid[:21, :21]
    disc = ((x - 10) ** 2 + (y - 10) ** 2 <= 64).astype(int)
    kept = disc.copy()
    assert smoothing.smooth(disc)["moved"] == 0 and (disc == kept).all()
    for slope in (0.37, 0.4, 0.22):
        line = (np.arange(24)[:, None] >= np.floor(2.5 + slope * np.arange(32))[None]).astype(int)
        kept = line.copy()
        r = smoothing.smooth(line)
        assert r["moved"] == 0 and (line == kept).all() and r["remaining"] == r["over_limit"] + r["geometric"] + r["no_move"]


def every_dip(v):
    return {i: len(smoothing.dips(v == i)) for i in np.unique(v[v > 0]).tolist()}


def test_dips_never_rise_and_none_is_left_that_a_single_move_would_mend(spark):
    rng = np.random.default_rng(5)
    for n in range(60):
        v = rng.integers(0, 3, (7, 8))
        if n % 2:
            v = np.repeat(np.repeat(rng.integers(0, 3, (4, 4)), 2, 0), 3, 1)
            v[rng.integers(0, 8, 4), rng.integers(0, 12, 4)] = 1
        before = sum(every_dip(v).values())
        out = v.copy()
        r = smoothing.smooth(out, rounds=50, losers=True)
        assert r["remaining"] == sum(every_dip(out).values()) <= before - r["moved"]
        for idx in every_dip(out):
            for points, flat, gap, line in smoothing.dips(out == idx):
                if gap > 1 or line:
                    continue
                for x, y, to in smoothing.moves(out, points, flat, idx):
                    tried = out.copy()
                    tried[y, x] = to
                    assert sum(every_dip(tried).values()) >= r["remaining"]


def test_relations(spark):
    grids = [staircase([3, 3, 2, 3]), staircase([3, 3, 1, 3]), np.zeros((3, 4), dtype=int), np.ones((1, 1), dtype=int)]
    px = canvas(spark, *grids)
    got = {}
    for r in smoothing.smoothed(px).collect():
        got.setdefault(r["asset"], {})[r["x"], r["y"]] = (r["idx"], r["smoothed"])
    for i, g in enumerate(grids):
        want = g.copy()
        smoothing.smooth(want)
        assert got[i] == {(x, y): (g[y, x], want[y, x]) for y in range(g.shape[0]) for x in range(g.shape[1])}
    report = {r["asset"]: r for r in smoothing.smooth_report(px).collect()}
    assert len(report) == 4 and report[0]["moved"] == 1 and report[1]["over_limit"] == 1
    assert report[2]["moved"] == report[2]["remaining"] == 0
    left = smoothing.smoothed(px).selectExpr("asset", "x", "y", "smoothed AS idx")
    counts = {r["asset"]: r["count"] for r in lint.jaggies(kernels.colour_runs(left)).groupBy("asset").count().collect()}
    assert counts == {k: r["remaining"] for k, r in report.items() if r["remaining"]}


def test_nulls_and_no_rows(spark):
    px = spark.createDataFrame([(None, 0, 0, 1), (None, 1, 0, None), (2, 0, 0, None)], "asset long, x int, y int, idx int")
    assert sorted(map(tuple, smoothing.smoothed(px).collect()), key=str) == sorted([(None, 0, 0, 1, 1), (None, 1, 0, None, None), (2, 0, 0, None, None)], key=str)
    assert {r["asset"]: r["moved"] for r in smoothing.smooth_report(px).collect()} == {None: 0, 2: 0}
    assert smoothing.smoothed(px.where("false")).count() == smoothing.smooth_report(px.where("false")).count() == 0
