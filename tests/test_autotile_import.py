"""Sheets of autotile pieces: round trips, and sets with faults."""

import pytest

from rasterlake.operators import autotile_import as imports
from rasterlake.operators import tiles

PX = "asset long, piece int, x int, y int, idx int"


def sheet(asset, pieces, size, make):
    return [(asset, p, x, y, make(p, x, y)) for p in range(pieces) for x in range(size) for y in range(size)]


def table(df):
    return {(r["asset"], r["quadrant"], r["state"], r["x"], r["y"]): r["idx"] for r in df.collect()}


def test_twenty_pieces_through_all_tiles_and_back(spark):
    px = spark.createDataFrame(sheet(1, 20, 2, lambda p, x, y: p * 4 + x * 2 + y), PX)
    art, report = imports.import_quadrants(px, "quadrants-20", 4)
    first = table(art)
    assert len(first) == 80 and first[1, "nw", "convex", 1, 0] == 2 and first[1, "ne", "concave", 0, 1] == 37
    assert tuple(report.first()) == (1, 20, False, 0, 0, None)
    whole = imports.assembled(art, 4).withColumnRenamed("tile", "piece")
    assert whole.count() == 47 * 16
    back, report = imports.import_quadrants(whole, "blob-47", 4)
    assert table(back) == first and tuple(report.first()) == (1, 47, False, 168, 0, None)
    old, missing = tiles.autotile_build(tiles.autotile_masks(spark), art.drop("asset"), 2)
    assert missing.count() == 0 and sorted(map(tuple, old.collect())) == sorted(tuple(r)[1:] for r in whole.selectExpr("asset", "piece", "x", "y", "idx").collect())
    wrong = whole.selectExpr("asset", "piece", "x", "y", "CASE WHEN piece = 46 AND x = 0 AND y = 0 THEN -1 ELSE idx END AS idx")
    art, report = imports.import_quadrants(wrong, "blob-47", 4)
    assert art.count() == 0 and tuple(report.first())[4:] == (1, "conflict")


def test_five_pieces_are_mirrored(spark):
    px = spark.createDataFrame(sheet(1, 5, 2, lambda p, x, y: p * 4 + x * 2 + y), PX)
    art, report = imports.import_quadrants(px.unionByName(px), "quadrants-5", 4)
    got = table(art)
    assert len(got) == 80 and report.first()["mirrored"]
    assert got[1, "nw", "inner", 0, 0] == got[1, "ne", "inner", 1, 0] == got[1, "sw", "inner", 0, 1] == got[1, "se", "inner", 1, 1] == 12


def test_faults_empty_tables_and_null_keys(spark):
    fine = sheet(None, 5, 2, lambda p, x, y: None if x else p)
    short, small = sheet(2, 4, 2, lambda *_: 1), sheet(3, 5, 1, lambda *_: 1)
    twice = [(4, 0 if p == 4 else p, x, y, 1) for _, p, x, y, _ in sheet(4, 5, 2, lambda *_: 1)]
    px = spark.createDataFrame(fine + short + small + twice, PX)
    art, report = imports.import_quadrants(px, "quadrants-5", 4)
    assert {r["asset"]: r["problem"] for r in report.collect()} == {None: None, 2: "count", 3: "size", 4: "count"}
    assert {k[0] for k in table(art)} == {None} and art.count() == 80
    for df in imports.import_quadrants(px.where("false"), "blob-47", 4):
        assert df.count() == 0
    for bad in (("quadrants-6", 4), ("blob-47", 5), ("blob-47", 0)):
        with pytest.raises(ValueError):
            imports.import_quadrants(px, *bad)


def test_art_and_report_agree_on_faults_and_sets_are_dealt_out_once(spark):
    """Art goes by windows, the report by groups: both leave out the same sets, whatever is wrong."""
    sets = [sheet(a, 5, 2, lambda p, x, y: p) for a in range(9)]
    sets[1] = [(1, 9 if p == 4 else p, x, y, v) for _, p, x, y, v in sets[1]]  # a piece of no state
    sets[2] = [(2, None if p == 4 else p, x, y, v) for _, p, x, y, v in sets[2]]
    sets[3] = [(3, p, x + 1, y, v) for _, p, x, y, v in sets[3]]
    sets[4] += [(4, 5, x, y, 0) for x in range(2) for y in range(2)]
    sets[5] = [r for r in sets[5] if r[1:4] != (2, 1, 1)] + [(5, 3, 2, 2, 0)]
    sets[6] = [(6, p, x, None if (p, x, y) == (0, 0, 1) else y, v) for _, p, x, y, v in sets[6]]
    sets[7] += sets[7]
    px = spark.createDataFrame([r for s in sets for r in s], PX)
    art, report = imports.import_quadrants(px, "quadrants-5", 4)
    good = {r["asset"] for r in report.where("problem is null").collect()}
    assert good == {0, 6, 7, 8} == {r["asset"] for r in art.collect()} and art.count() == 316  # a pixel without a row is in no part
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        back = imports.import_quadrants(imports.assembled(art, 4).withColumnRenamed("tile", "piece"), "blob-47", 4)[0]
        plan = back._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning(asset") == 2  # the pixels of five pieces, not those of 47 tiles


def test_resolved_states(spark):
    def piece(asset, n, state, quadrant):
        return [(asset, n, state, quadrant, x, 0, 10 * n + x) for x in range(2)]

    rows = piece(1, 0, "inner", None) + piece(1, 1, "inner", None) + piece(1, 2, "edge_h", None) + piece(1, 3, "edge_h", "nw") + piece(1, 4, "edge_v", "nw") + piece(1, 5, "nothing", None) + piece(1, 6, None, None)
    for i, q in enumerate(("nw", "ne", "sw", "se", "nw")):
        rows += piece(2, i, "convex", q)
    px = spark.createDataFrame(rows, "asset long, piece int, state string, quadrant string, x int, y int, idx int")
    art, report = imports.resolved(px, 2)
    status = {(r["asset"], r["state"]): (r["mirrored"], r["problem"]) for r in report.collect()}
    assert status == {(1, "inner"): (True, None), (1, "edge_h"): (False, "mixed"), (1, "edge_v"): (False, "missing"), (1, "nothing"): (True, "state"), (1, None): (True, "state"), (2, "convex"): (False, None)}
    got = table(art)
    assert len(got) == 16 and got[1, "nw", "inner", 0, 0] == got[1, "ne", "inner", 1, 0] == got[1, "sw", "inner", 0, 1] == 0
    assert got[2, "nw", "convex", 1, 0] == 1 and got[2, "se", "convex", 0, 0] == 30
