"""Palettes of pictures against plain sums over bins, and k-means against all partitions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import new_palette as P


def pictures(spark, *images):
    rows = [(a, x, y, *(None if v[y, x].min() < 0 else int(c) for c in v[y, x])) for a, v in enumerate(images) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "asset long, x int, y int, r int, g int, b int")


def plain_boxes(place, lab, weight, k):
    """Lists of colours in place of cubes: the list of largest scatter is cut at the best of all places."""
    def scatter(own):
        m = np.average(lab[own], axis=0, weights=weight[own])
        return float((weight[own, None] * (lab[own] - m) ** 2).sum())

    parts, done = [np.arange(len(lab))], set()
    while len(parts) < k:
        order = [(round(scatter(p), 12), -i) for i, p in enumerate(parts) if i not in done]
        if not order or max(order)[0] <= 1e-9:
            break
        at = -max(order)[1]
        own, best = parts[at], None
        for axis in range(3):
            for cut in range(1, P.BINS[axis]):
                left = place[own, axis] < cut
                if left.any() and not left.all():
                    left_over = round(scatter(own[left]) + scatter(own[~left]), 9)
                    if best is None or left_over < best[0]:
                        best = left_over, own[left], own[~left]
        if best is None:
            done.add(at)
            continue
        parts[at : at + 1] = best[1:]
        done = {i if i < at else i + 1 for i in done}
    return sorted(tuple(np.average(lab[p], axis=0, weights=weight[p]).round(7)) for p in parts)


@pytest.mark.parametrize("k", [1, 2, 5, 12])
def test_boxes_by_plain_sums(spark, k):
    rng = np.random.default_rng(k)
    img = rng.integers(0, 256, (9, 9, 3)) // rng.choice([1, 16, 64]) * rng.choice([1, 3])
    px = pictures(spark, img, img[::-1] // 2)
    c = P.colours(px).withColumns({f"i{i}": P._bin(x, i) for i, x in enumerate(("l", "a_", "b_"))}).toPandas()
    got = P.wu(px, k).toPandas()
    for asset, own in c.groupby("asset"):
        want = plain_boxes(own[["i0", "i1", "i2"]].to_numpy(), own[["l", "a_", "b_"]].to_numpy(), own["n"].to_numpy(float), k)
        have = sorted(map(tuple, got[got.asset == asset][["l", "a_", "b_"]].to_numpy().round(7)))
        assert np.allclose(have, want, atol=2e-7)


def test_means_end_where_no_colour_wants_to_move():
    rng = np.random.default_rng(3)
    lab, weight = rng.random((40, 3)), rng.integers(1, 9, 40).astype(float)
    start = lab[:5]
    centres = P.means(lab, weight, start)
    near = ((lab[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    for i in range(5):
        assert np.allclose(centres[i], np.average(lab[near == i], axis=0, weights=weight[near == i]), atol=1e-8)
    two = np.array([[0.0, 0, 0], [0.1, 0, 0], [0.9, 0, 0], [1.0, 0, 0]])
    best = min((sum(((two[list(s)] - two[list(s)].mean(axis=0)) ** 2).sum() for s in (p, set(range(4)) - set(p))), p) for n in (1, 2, 3) for p in itertools.combinations(range(4), n))
    assert best[1] in ((0, 1), (2, 3)) and np.allclose(P.means(two, np.ones(4), two[[0, 3]])[:, 0], [0.05, 0.95])
    assert np.allclose(P.means(two, np.ones(4), np.array([[0.5, 0, 0], [9.0, 0, 0]])), [[0.5, 0, 0], [9.0, 0, 0]])  # no colour for the second


def test_palettes_are_sorted_small_and_near(spark):
    rng = np.random.default_rng(8)
    few = np.array([[10, 20, 30], [200, 10, 60], [250, 250, 250]])[rng.integers(0, 3, (6, 6))]
    ramp = np.stack([np.tile(np.arange(0, 256, 8), (4, 1))] * 3, axis=2)
    holes = few.copy()
    holes[0] = -1
    px = pictures(spark, few, ramp, np.full((4, 4, 3), -1), holes, np.full((3, 3, 3), 77))
    pal = P.quantise(px, 4).orderBy("asset", "idx").toPandas()
    colours = lambda a: pal[pal.asset == a][["r", "g", "b"]].to_numpy().tolist()
    assert colours(0) == colours(3) == [[10, 20, 30], [200, 10, 60], [250, 250, 250]]
    assert colours(2) == [] and colours(4) == [[77, 77, 77]]
    assert len(colours(1)) == 4 and colours(1) == sorted(colours(1))
    assert P.applied(px, P.quantise(px, 4)).where("asset = 0").count() == 36
    boxes, refined = (P.error(px, P.quantise(px, 4, refine)).where("asset = 1").first()["error"] for refine in (False, True))
    assert refined <= boxes + 1e-4 and boxes < 0.02
    assert P.quantise(px.where("false"), 4).count() == 0
    with pytest.raises(ValueError):
        P.quantise(px, 0)
    assert P.error(px, P.quantise(px, 256)).where("asset = 0").select(F.round("error", 9)).first()[0] == 0


def test_pictures_are_worked_on_together(spark):
    """A chunk of pictures of all sizes has the palettes that each has alone, and few numpy steps."""
    rng = np.random.default_rng(4)
    pics = [rng.integers(0, 256, (int(h), 5, 3)) for h in rng.integers(1, 9, 30)]
    alone, together = [], []
    for v in pics:
        lab = rng.random((len(v), 3)) * [1, 0.4, 0.4] - [0, 0.2, 0.2]
        v = np.concatenate([np.stack([np.clip((lab[:, i] - lo) / (hi - lo) * n, 0, n - 1).astype(int) for i, ((lo, hi), n) in enumerate(zip(P.RANGE, P.BINS))], axis=1), np.ones((len(v), 1)), lab, (lab**2).sum(axis=1)[:, None]], axis=1)
        together.append(v)
        cube = P.cumulative(v[:, :3].astype(int), v[:, 3:8])
        low, high, count = P.boxes_of(cube[None], np.array([P.BINS]), 4)
        m = P._inside(cube[None], np.zeros(count[0], int), low[0, : count[0]], high[0, : count[0]])
        alone.append(m[:, 1:4] / m[:, :1])
    made = P._starts(together, 4)
    assert all(np.allclose(x, y, atol=1e-12) for x, y in zip(alone, made))
    labs, weights = [v[:, 4:7] for v in together], [v[:, 3] for v in together]
    assert all(np.array_equal(x, P.means(*y)) for x, y in zip(P.means_of(labs, weights, made), zip(labs, weights, made)))
    chunks = list(P._chunks(together))
    assert len(chunks) == 1 and [len(c) for c in P._chunks(together * 5)] == [64, 64, 22]
    plan = P.error(pictures(spark, *pics), P.quantise(pictures(spark, *pics), 4))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1  # distinct colours meet entries, pixels meet nothing
