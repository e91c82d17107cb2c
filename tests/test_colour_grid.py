"""Cell sizes by colours: small pictures whose answer is known, and a plain count beside the integral images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import colour_grid
from rasterlake.views import PALETTE

COLOURS = np.array([[int(c[i : i + 2], 16) for i in (0, 2, 4)] for c in PALETTE])


def pictures(spark, *images):
    rows = [(a, x, y, *map(int, v[y, x])) for a, v in enumerate(images) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "asset long, x int, y int, r int, g int, b int")


def big(small, s):
    return np.kron(small, np.ones((s, s, 1), dtype=int))


@pytest.fixture(scope="module")
def art():
    rng = np.random.default_rng(5)
    return COLOURS[rng.integers(1, 16, (12, 12))]


def test_sizes_and_phases_come_back(spark, art):
    smooth = np.stack([np.add.outer(np.arange(40), np.arange(40)) * 3] * 3, axis=2)
    noise = np.random.default_rng(1).integers(0, 256, (36, 33, 3))
    squeezed = big(art, 5)[np.ix_((np.arange(44) * 1.37).astype(int) % 60, (np.arange(44) * 1.37).astype(int) % 60)]
    px = pictures(spark, big(art, 3), big(art, 4)[3:, 1:], big(art, 2)[1:, :], smooth, noise, squeezed, np.full((20, 20, 3), 9), art[:1], art[:2, :2])
    got = {r["asset"]: r for r in colour_grid.estimate(px).collect()}
    assert [(got[a]["s"], got[a]["dx"], got[a]["dy"], got[a]["verdict"]) for a in range(3)] == [(3, 0, 0, "ok"), (4, 3, 1, "ok"), (2, 0, 1, "ok")]
    assert all(got[a]["verdict"] in ("not_found", "low_confidence") for a in (3, 4, 5, 6, 8)) and got[7]["verdict"] == "too_small"
    back = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in colour_grid.conform(px, colour_grid.estimate(px)).where("asset = 1").collect()}
    assert back == {(x - 1, y - 1): tuple(art[y, x]) for y in range(1, 12) for x in range(1, 12)}


def test_numbering_a_palette_anew_changes_nothing(spark, art):
    rng = np.random.default_rng(9)
    idx = rng.integers(0, 16, (10, 10))
    order = rng.permutation(16)
    one = spark.createDataFrame([(0, x, y, int(v)) for y, row in enumerate(np.kron(idx, np.ones((3, 3), int))) for x, v in enumerate(row)], "asset long, x int, y int, idx int")
    pal = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(COLOURS)], "idx int, r int, g int, b int")
    moved = F.element_at(F.array(*[F.lit(int(v)) for v in order]), F.col("idx") + 1)
    two, pal2 = one.withColumn("idx", moved), pal.withColumn("idx", moved)
    a, b = (colour_grid.candidates(p.join(q, "idx").drop("idx")).orderBy("s").collect() for p, q in ((one, pal), (two, pal2)))
    assert a == b and any(r["accepted"] for r in a)


def test_integral_images_against_cells_counted_plainly(spark):
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (19, 23, 3))
    got = {r["s"]: r for r in colour_grid.curves(pictures(spark, img)).collect()}
    for s in range(2, 17):
        def cells(x0, y0, x1, y1, dx, dy):
            xs = [x for x in range(x0, x1 - s + 1) if x % s == dx]
            ys = [y for y in range(y0, y1 - s + 1) if y % s == dy]
            v = [(img[y : y + s, x : x + s].reshape(-1, 3).var(axis=0).sum()) / 65025 for y in ys for x in xs]
            return round(float(np.mean(v)), 9) if v else None

        table = {(dy, dx): cells(0, 0, 23, 19, dx, dy) for dy in range(s) for dx in range(s)}
        v, dy, dx = min((v, *k) for k, v in table.items() if v is not None)
        r = got[s]
        assert (r["dx"], r["dy"]) == (dx, dy) and abs(r["v"] - v) < 1e-8
        n = next((b for b in (4, 3, 2) if (23 - dx) // s >= 2 * b and (19 - dy) // s >= 2 * b), None)
        if n is None:
            assert r["by_x"] is None
            continue
        want = [[cells(23 * b // n, 0, 23 * (b + 1) // n, 19, p, dy) for p in range(s)] for b in range(n)]
        assert np.allclose(np.array(r["by_x"], float), np.array(want, float), atol=2e-9, equal_nan=True)
        want = [[cells(0, 19 * b // n, 23, 19 * (b + 1) // n, dx, p) for p in range(s)] for b in range(n)]
        assert np.allclose(np.array(r["by_y"], float), np.array(want, float), atol=2e-9, equal_nan=True)


def test_parabolas_drift_and_loss(spark):
    curve = lambda *v: F.array(*[F.lit(x) for x in v])
    two = F.array(curve(0.0, 1.0, 4.0, 1.0), curve(1.0, 4.0, 1.0, 0.0))
    df = spark.range(1).select(
        colour_grid.refined(curve(4.0, 1.0, 1.0, 4.0, 9.0)).alias("a"), colour_grid.refined(curve(2.0, 1.0, 2.0)).alias("b"), colour_grid.refined(curve(5.0, 0.0)).alias("c"),
        colour_grid.drift(two, F.lit(4)).alias("d"), colour_grid.axis_loss(two).alias("l"), colour_grid.axis_loss(F.array(curve(1.0, None, 2.0), curve(1.0, 2.0, 3.0))).alias("n"),
        colour_grid.half_off(F.lit(0.0), F.lit(0.5), F.lit(0.0)).alias("h"),
    ).first()
    assert (df["a"], df["b"], df["c"], df["d"]) == (1.5, 1.0, 1.0, 1)
    assert df["l"] == pytest.approx(1 / 3.0) and df["n"] is None and df["h"] == pytest.approx((1e6 + 1) / 2)


def test_enlarged_canvases_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks grow with the table, and work by canvas keeps that dealing."""
    from rasterlake import views

    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, views.enlarged(spark, d).collect()))
    monkeypatch.setattr(views, "CANVASES", 3)
    px = views.enlarged(spark, d)
    tasks = -(-spark.read.parquet(f"{d}/embeddings.parquet").count() // 3)
    assert px.rdd.getNumPartitions() >= tasks
    assert sorted(map(tuple, px.collect())) == want
