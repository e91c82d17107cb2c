"""Ties, far dates and frames that stretch: cases that larger tables brought up."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from rasterlake import registry
from rasterlake.operators import grid, lint, replay, stacks

#: Canvases of which a cell variance ties with 0.8 and 0.9 of the whole variance.
TIES = {1: "0003022211211000203000300104100200211000201111300413002113010211", 2: "2111122202010000232240011223011330033000023202030030100402102000"}


def test_variances_that_tie_with_a_share(spark):
    px = spark.createDataFrame([(a, p % 8, p // 8, int(c)) for a, t in TIES.items() for p, c in enumerate(t)], "asset long, x int, y int, idx int").orderBy(F.rand(3))
    best, image = grid.best_phase(grid.cell_variance(px, 4)), grid.image_variance(px)
    assert {r["asset"]: r["iv"] for r in image.collect()} == {1: 1.2499999999999998, 2: 1.46484375}
    assert [r["asset"] for r in lint.rule_2(best, image, grid.confidence(best, image), 0.8, 0.01).collect()] == [2]


def test_best_phase_keeps_all_digits(spark):
    v = spark.createDataFrame([(1, 2, 1, 0, 0.12345678912), (1, 2, 0, 0, 0.12345678914)], "asset long, s int, dx int, dy int, v double")
    assert tuple(grid.best_phase(v).first()) == (1, 2, 0, 0, 0.12345678914)


def test_variance_of_part_of_a_canvas(spark):
    px = spark.createDataFrame([(1, 0, 0, 1), (1, 2, 1, 4), (2, 5, 5, 3)], "asset long, x int, y int, idx int")
    assert {tuple(r) for r in grid.image_variance(px).collect()} == {(1, 2.25), (2, 0.0)}


def test_times_after_the_year_9999(spark, tmp_path):
    ids = [0, 1, 253_000, 253_402, 600_000, 5_999_999]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(registry.ORACLES["iso_times"]).fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["iso_times"](spark, str(tmp_path)).collect()) == sorted(want)
    assert max(len(iso) for _, iso in want) > 20


def test_stacks_are_bounded_and_leave_out_nothing(spark):
    """However many canvases a partition holds, a stack has few of them."""
    n = 3000
    px = spark.range(n * 64).selectExpr("id div 64 AS asset", "cast(id % 8 as int) AS x", "cast(id div 8 % 8 as int) AS y", "cast(id * 7 % 5 as int) AS idx").coalesce(1)
    most = 2 * stacks.CELLS // (2 * 64)

    def size(stack):
        return {"n": np.full((len(stack), 1), len(stack))}

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = stacks.per_canvas(px, size, "n int").agg(F.count("*"), F.countDistinct("asset"), F.max("n")).first()
    assert tuple(got[:2]) == (n, n) and got[2] <= most
    field = stacks.on_stacks(px, lambda v: np.full(v.shape, len(v)), "n").agg(F.count("*"), F.max("n")).first()
    assert field[0] == n * 64 and field[1] <= most


def test_settled_items_are_joined_and_grouped_once(spark, tmp_path):
    """Settings multiply rows only after an item's sizes lie in its row; a gate that can't be measured passes."""
    cands = spark.createDataFrame([(1, 2, 0.1, 0.01, None, None, 5.0, 0), (1, 3, 0.4, None, None, True, 5.0, 1), (1, 5, 0.9, 9.0, None, None, 5.0, 2), (2, 2, 0.1, 9.0, None, None, 5.0, 0)], "item_id long, scale int, v double, recon double, drift_ok boolean, curve_ok boolean, contrast double, phase int")
    cases = spark.createDataFrame([(1, 0.5, True, 3, 1, "nearest"), (2, 0.5, True, 2, 0, "lanczos"), (3, 0.5, True, 2, 0, "lanczos")], "item_id long, image_var double, has_grid boolean, truth_scale int, truth_phase int, filter string")
    rows = replay.settled(cands, cases, replay.settings(spark, [(7, 0.9, 0.05, 1.0, 0.2, False, True)]))
    assert [tuple(r) for r in replay.decided(rows).collect()] == [(7, 1, 3, 1, 0.9, 1.0, 0.2, True)]
    assert {tuple(r) for r in replay.outcomes(rows).collect()} == {(7, 1, True, "A", 3, "exact", None), (7, 2, True, "C", None, "rejected", None)}
    spark.range(50).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "0.1D AS l_discount", "0.1D AS l_tax", "id AS l_suppkey", "id AS l_partkey", "1D AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).selectExpr("id AS o_orderkey", "1D AS o_totalprice", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    plan = registry.QUERIES["replay_missed"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and plan.count("Join LeftOuter") == 0
