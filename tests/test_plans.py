"""Recipes: expressions, products, graphs, keys and the cache; palettes, images and sprites; streams."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterlake.operators import canvas, kernels, regions, tiles
from rasterlake.plans import recipe
from rasterlake.sources import images, palettes, sprites
from rasterlake.streaming import watch


def ev(src, **env):
    return recipe.evaluate(recipe.parse(src), env, {"twice": lambda v: 2 * v})


def test_expressions():
    assert ev("1 + 2 * 3") == 7 and ev("(1 + 2) * 3") == 9 and ev("-7 / 2") == -3 and ev("-7 % 4") == -3
    assert ev("7 / 2.0") == 3.5 and ev("'a' + 1 + true") == "a1true" and ev("n > 2 ? 'x' : 'y'", n=3) == "x"
    assert ev("twice(n) == 6", n=3) is True and ev("1 == 1.0") is True
    for bad in ("a && b", "!a", "1 / 0", "unknown", "1 ? 2 : 3", "1 +", "f(1)", "'a' - 1", "1 2"):
        with pytest.raises(recipe.RecipeError):
            ev(bad)


@settings(max_examples=60, deadline=None)
@given(st.integers(-50, 50), st.integers(-9, 9).filter(bool))
def test_division_cuts_towards_zero(a, b):
    assert ev(f"({a}) / ({b})") == int(a / b)
    assert ev(f"({a}) % ({b})") == a - b * int(a / b)


RECIPE = """
format = 1
[vars]
seeds = [1, 2, 3]
[[step]]
name = "scale-${seed}"
op = "scale"
inputs = ["base"]
output = "scaled-${seed}"
params = { by = "=seed * 2" }
for_each = { seed = "seeds" }
[[step]]
name = "join"
op = "union"
inputs = ["scaled-1", "scaled-2", "scaled-3"]
output = "all"
"""


def test_recipe_runs_once(spark, tmp_path):
    ops = {"scale": lambda ins, p: ins[0].withColumn("id", F.col("id") * p["by"]), "union": lambda ins, p: ins[0].unionByName(ins[1]).unionByName(ins[2])}
    cache = recipe.Cache(spark, f"file://{tmp_path}/cache")
    out, n = recipe.run(RECIPE, ops, {"base": spark.range(4)}, cache)
    assert n == {"run": 4, "found": 0}
    assert sorted(r["id"] for r in out["all"].collect()) == sorted(i * k for i in range(4) for k in (2, 4, 6))
    again, n = recipe.run(RECIPE, ops, {"base": spark.range(4)}, cache)
    assert n == {"run": 0, "found": 4}
    changed, n = recipe.run(RECIPE.replace("[1, 2, 3]", "[1, 2, 3, 4]"), ops, {"base": spark.range(4)}, cache)
    assert n == {"run": 1, "found": 4}
    other, n = recipe.run(RECIPE, ops, {"base": spark.range(4)}, cache, {"base": "another content"})
    assert n == {"run": 4, "found": 0}
    steps = recipe.resolve(__import__("tomllib").loads(RECIPE))
    g = recipe.Graph(steps, {"base"})
    assert g.levels() == [0, 0, 0, 1] and g.sinks() == [3] and g.ancestry(3) == {0, 1, 2}
    assert cache.gc(set(recipe.keys(g, lambda _: "another content"))) == 5


def test_graph_errors():
    step = lambda n, i, o: recipe.Step(n, "x", i, o)
    for steps in ([step("a", ["b"], "a"), step("b", ["a"], "b")], [step("a", ["none"], "a")], [step("a", ["a"], "a")]):
        with pytest.raises(recipe.RecipeError):
            recipe.Graph(steps, set())
    assert recipe.expand({"name": "{a}-{b}", "params": {"k": ["{a}"]}}, [{"a": 1, "b": None}]) == [{"name": "1-", "params": {"k": ["1"]}}]


def test_palettes(spark, tmp_path):
    (tmp_path / "a.hex").write_text("# ours\nff8000\n\n00ff7F # green\n")
    (tmp_path / "a.gpl").write_text("GIMP Palette\nName: x\n#\n255 128 0 orange\n  0 255 127\n")
    (tmp_path / "a.pal").write_text("JASC-PAL\n0100\n2\n255 128 0\n0 255 127\n")
    (tmp_path / "a.act").write_bytes(bytes([255, 128, 0, 0, 255, 127]) + bytes(762))
    want = [(0, 255, 128, 0), (1, 0, 255, 127)]
    get = lambda df: sorted((r["idx"], r["r"], r["g"], r["b"]) for r in df.collect())
    for read, n in ((palettes.read_hex, "a.hex"), (palettes.read_gpl, "a.gpl"), (palettes.read_pal, "a.pal")):
        assert get(read(spark, f"file://{tmp_path}/{n}")) == want
    assert get(palettes.read_act(spark, f"file://{tmp_path}/a.act"))[:2] == want
    palettes.write_hex(palettes.read_hex(spark, f"file://{tmp_path}/a.hex"), f"file://{tmp_path}/out")
    assert get(palettes.read_hex(spark, f"file://{tmp_path}/out/*.txt")) == want
    (tmp_path / "bad.hex").write_text("zz\n")
    with pytest.raises(Exception, match="not RRGGBB"):
        palettes.read_hex(spark, f"file://{tmp_path}/bad.hex").collect()


def test_images(spark, tmp_path):
    r = np.random.default_rng(0)
    px = r.integers(0, 256, (5, 7, 4)).astype(np.uint8)
    px[:, :, 3] = np.where(px[:, :, 3] >= 128, 255, 0)
    (tmp_path / "a.png").write_bytes(images.encode(px))
    df = images.read_png(spark, f"file://{tmp_path}/a.png")
    assert df.count() == 35
    again = images.to_png(df).first()["png"]
    assert (images.decode(bytes(again)) == px).all()
    with pytest.raises(ValueError):
        images.decode(b"nothing")


SPRITE = '''[meta]
format = 1
name = "dot"
[palette]
ref = "p.hex"
[palette.map]
"." = "transparent"
"a" = 1
"b" = 2
[[frame]]
name = "f1"
duration_ms = 80
data = """
.ab
ba.
"""
[[frame]]
name = "f2"
kind = "inbetween"
data = """
aaa
bbb
"""
'''


def test_sprites(spark, tmp_path):
    (tmp_path / "dot.toml").write_text(SPRITE)
    df = sprites.read(spark, f"file://{tmp_path}/dot.toml")
    got = sorted((r["frame"], r["kind"], r["duration_ms"], r["y"], r["x"], r["idx"]) for r in df.collect())
    assert len(got) == 12 and got[0] == (1, "key", 80, 0, 0, 0) and got[-1] == (2, "inbetween", 100, 1, 2, 2)
    text = sprites.to_text(df).first()["value"]
    assert sorted((n, k, m, y, x, i) for _, _, n, k, m, x, y, i in sprites.parse(text)) == got
    for a, b in (('"a" = 1', '"aa" = 1'), ("format = 1", "format = 2"), (".ab", ".abb"), (".ab", ".az"), ('name = "f1"', 'name = "f1"\nextra = 1')):
        with pytest.raises(ValueError):
            sprites.parse(SPRITE.replace(a, b))


def test_stream_debounce(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:20"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:00:10"), (9, "2024-01-02 00:00:00"), (9, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    q = watch.watch(spark, f"file://{tmp_path}/in", "user_id long, ts timestamp", "1 minute", "1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["user_id"], r["n"]) for r in spark.table("bursts").collect())
    assert got[:3] == [(1, 1), (1, 2), (2, 1)]


def px(spark, text, asset=1):
    return spark.createDataFrame([(asset, x, y, int(c)) for y, row in enumerate(text.split()) for x, c in enumerate(row)], "asset long, x int, y int, idx int")


def test_invariants(spark):
    p = px(spark, "0120 1122 2011 0010")
    same = lambda a, b: sorted(map(tuple, a.select("asset", "x", "y", "idx").collect())) == sorted(map(tuple, b.select("asset", "x", "y", "idx").collect()))
    assert same(canvas.mirror(canvas.mirror(p, 4), 4), p)
    t = p
    for _ in range(4):
        t = canvas.quarter_turn(t, 4)
    assert same(t, p)
    for mode in tiles.MODES:
        assert same(tiles.rebuild(tiles.extract(p, 2, mode), 2, mode), p)
    assert tiles.autotile_masks(spark).count() == 47
    assert regions.stats(regions.label(p)).agg(F.sum("area")).first()[0] == 16
    with pytest.raises(Exception, match="different sizes"):
        canvas.diff(p, canvas.crop(p, 0, 0, 3, 3)).collect()
    line = canvas.stroke(spark.createDataFrame([(1, 0, 0, 0), (1, 1, 4, 2)], "asset long, seq int, x int, y int"), 0)
    assert line.count() == 5


def test_kernels():
    ring = np.ones((4, 5), dtype=bool)
    ring[1:3, 1:4] = False
    (outer, pts), (hole, inner) = kernels.borders(ring)
    assert not outer and len(pts) == 14 and set(pts) == {(x, y) for y, x in np.argwhere(ring)}
    assert hole and set(inner) <= set(pts)
    assert kernels.borders(np.zeros((2, 2), bool)) == []
    assert kernels.straight([2, 2, 3, 2, 2, 3, 2]) and not kernels.straight([1, 4, 1, 2, 5])
