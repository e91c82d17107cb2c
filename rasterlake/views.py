"""Relations that the queries run on: canvases, frames, palettes and sweep rows made of the given tables.

Each has a DataFrame form and, under the same name in ``SQL``, a form for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A well-known public palette of 16 colours; entry 0 stands for transparent pixels.
PALETTE = ["000000", "1d2b53", "7e2553", "008751", "ab5236", "5f574f", "c2c3c7", "fff1e8", "ff004d", "ffa300", "ffec27", "00e436", "29adff", "83769c", "ff77a8", "ffccaa"]
#: The palette of a second asset, with some of those colours and some of another public palette.
PALETTE_B = ["000000", "1d2b53", "222034", "45283c", "663931", "8f563b", "df7126", "ffec27", "99e550", "6abe30"]
#: A ramp of greys, each between its neighbours.
GREYS = ["000000", "202020", "606060", "a0a0a0", "e0e0e0"]
LEVELS = "CASE WHEN v < 0 THEN 0 WHEN v < 0.06 THEN 1 WHEN v < 0.12 THEN 2 WHEN v < 0.2 THEN 3 ELSE 4 END"


def _values(palette: list[str]) -> list[tuple[int, int, int, int]]:
    return [(i, int(c[:2], 16), int(c[2:4], 16), int(c[4:], 16)) for i, c in enumerate(palette)]


def palette(spark: SparkSession, colours: list[str] = PALETTE) -> DataFrame:
    """(idx, r, g, b); at most 256 rows."""
    return spark.createDataFrame(_values(colours), "idx int, r int, g int, b int")


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Canvases that one task goes through where ``dealt`` deals them out.
CANVASES = 500


def dealt(embeddings: DataFrame) -> DataFrame:
    """Dealt out by vec_id to as many tasks as the rows ask for.

    Spark joins shuffled parts by their size in files, where pixels take next to nothing, so tasks would grow with the table.
    Work by canvas that follows needs no other shuffle.
    """
    tasks = max(embeddings.sparkSession.sparkContext.defaultParallelism, -(-embeddings.count() // CANVASES))
    return embeddings.repartition(tasks, "vec_id")


def canvases(spark: SparkSession, d: str, deal: bool = False) -> DataFrame:
    """(asset, x, y, idx): an 8 x 8 canvas for each embedding; index 0 is transparent."""
    e = _read(spark, d, "embeddings").select("vec_id", "embedding")
    e = (dealt(e) if deal else e).select(F.col("vec_id").alias("asset"), F.posexplode("embedding").alias("p", "v0"))
    return e.withColumn("v", F.col("v0").cast("double")).selectExpr("asset", "cast(p % 8 as int) AS x", "cast(p div 8 as int) AS y", f"{LEVELS} AS idx")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(asset, frame, x, y, idx): the embeddings of a label in order as a sequence."""
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy("vec_id")
    n = _read(spark, d, "embeddings").select(F.col("vec_id"), F.col("label").alias("seq"), F.row_number().over(order).alias("frame"))
    return canvases(spark, d).join(n, F.col("asset") == F.col("vec_id")).select(F.col("seq").alias("asset"), "frame", "x", "y", "idx")


def dense(spark: SparkSession, d: str) -> DataFrame:
    """(asset, x, y, idx): 32 x 32 canvases without transparency."""
    li = _read(spark, d, "lineitem").selectExpr("cast(l_suppkey % 8 as int) AS asset", "cast((l_orderkey + l_linenumber) % 32 as int) AS x", "cast(l_partkey % 32 as int) AS y", "l_linenumber")
    return li.groupBy("asset", "x", "y").agg(F.max("l_linenumber").cast("int").alias("idx"))


def enlarged(spark: SparkSession, d: str) -> DataFrame:
    """(asset, x, y, r, g, b): each canvas in the palette's colours, enlarged 2 to 4 times and cropped by up to a pixel; every fifth smeared by half a pixel."""
    o = F.expr("explode(transform(sequence(0, k * k - 1), o -> struct(cast(o % k as int) AS i, cast(o div k as int) AS j))) AS o")
    big = canvases(spark, d, deal=True).withColumn("k", F.expr("cast(2 + asset % 3 as int)")).select("asset", "x", "y", "idx", "k", o)
    at = big.selectExpr("asset", "cast(x * k + o.i - asset % 2 as int) AS x", "cast(y * k + o.j - asset div 2 % 2 as int) AS y", "idx").where("x >= 0 AND y >= 0")
    px = at.join(F.broadcast(palette(spark)), "idx").select("asset", "x", "y", "r", "g", "b")
    from pyspark.sql import Window

    line = Window.partitionBy("asset", "y").orderBy("x")
    smeared = [F.when(F.col("asset") % 5 == 4, F.floor((F.col(c) + F.coalesce(F.lead(c).over(line), c)) / 2)).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb"]
    return px.select("asset", "x", "y", *smeared)


def tinted(spark: SparkSession, d: str) -> DataFrame:
    """(asset, x, y, r, g, b): an 8 x 8 picture of many colours for each embedding; three components make a pixel's colour."""
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("asset"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    tint = [f"cast(greatest(0, least(255, floor(128 + 400 * cast(embedding[(p + {k}) % 64] as double)))) as int) AS {c}" for c, k in (("r", 0), ("g", 21), ("b", 42))]
    return e.selectExpr("asset", "cast(p % 8 as int) AS x", "cast(p div 8 as int) AS y", *tint)


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Sweep rows: parameters, truth, estimate, confidence (null where nothing was found), filter and split."""
    return _read(spark, d, "lineitem").selectExpr(
        "cast(l_linenumber as int) AS param_id", "cast(l_orderkey as long) AS item_id", "cast(round(l_discount * 100) as int) AS conf_bin",
        "cast(l_suppkey % 6 as int) + 2 AS truth_scale", "cast(l_partkey % 7 as int) + 1 AS scale_hat", "l_orderkey % 3 <> 0 AS has_grid", "l_partkey % 5 <> 0 AS found",
        "l_suppkey % 4 = 0 AS phase_ok", "CASE cast(l_partkey % 4 as int) WHEN 0 THEN 'nearest' WHEN 1 THEN 'bilinear' WHEN 2 THEN 'bicubic' ELSE 'lanczos' END AS filter",
        "CASE WHEN l_orderkey % 5 < 3 THEN 'validation' ELSE 'test' END AS split",
    )


SQL = {
    "canvases": f"SELECT vec_id AS asset, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, {LEVELS} AS idx FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)",
    "dense": "SELECT CAST(l_suppkey % 8 AS INTEGER) AS asset, CAST((l_orderkey + l_linenumber) % 32 AS INTEGER) AS x, CAST(l_partkey % 32 AS INTEGER) AS y, CAST(max(l_linenumber) AS INTEGER) AS idx FROM lineitem GROUP BY 1, 2, 3",
    "sweep": "SELECT CAST(l_linenumber AS INTEGER) AS param_id, l_orderkey AS item_id, CAST(round(l_discount * 100) AS INTEGER) AS conf_bin, CAST(l_suppkey % 6 AS INTEGER) + 2 AS truth_scale, CAST(l_partkey % 7 AS INTEGER) + 1 AS scale_hat, l_orderkey % 3 <> 0 AS has_grid, l_partkey % 5 <> 0 AS found, l_suppkey % 4 = 0 AS phase_ok, CASE l_partkey % 4 WHEN 0 THEN 'nearest' WHEN 1 THEN 'bilinear' WHEN 2 THEN 'bicubic' ELSE 'lanczos' END AS filter, CASE WHEN l_orderkey % 5 < 3 THEN 'validation' ELSE 'test' END AS split FROM lineitem",
    "pal": "SELECT * FROM (VALUES " + ", ".join(map(str, _values(PALETTE))) + ") AS t(idx, r, g, b)",
    "pal_b": "SELECT * FROM (VALUES " + ", ".join(map(str, _values(PALETTE_B))) + ") AS t(idx, r, g, b)",
}
SQL["enlarged"] = (
    "SELECT asset, x, y, "
    + ", ".join(f"CASE WHEN asset % 5 = 4 THEN ({c} + coalesce(lead({c}) OVER w, {c})) // 2 ELSE {c} END AS {c}" for c in "rgb")
    + " FROM (SELECT asset, CAST(x * k + i - asset % 2 AS INTEGER) AS x, CAST(y * k + j - asset // 2 % 2 AS INTEGER) AS y, r, g, b FROM (SELECT *, 2 + asset % 3 AS k FROM canvases) JOIN pal USING (idx), range(4) a(i), range(4) b(j) WHERE i < k AND j < k) WHERE x >= 0 AND y >= 0 WINDOW w AS (PARTITION BY asset, y ORDER BY x)"
)
SQL["tinted"] = (
    "SELECT vec_id AS asset, CAST(p % 8 AS INTEGER) AS x, CAST(p // 8 AS INTEGER) AS y, "
    + ", ".join(f"CAST(greatest(0, least(255, floor(128 + 400 * CAST(embedding[(p + {k}) % 64 + 1] AS DOUBLE)))) AS INTEGER) AS {c}" for c, k in (("r", 0), ("g", 21), ("b", 42)))
    + " FROM embeddings, range(64) t(p)"
)
SQL["greys"] = "SELECT * FROM (VALUES " + ", ".join(map(str, _values(GREYS))) + ") AS t(idx, r, g, b)"
SQL["frames"] = f"SELECT n.seq AS asset, n.frame, c.x, c.y, c.idx FROM ({SQL['canvases']}) c JOIN (SELECT vec_id, label AS seq, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame FROM embeddings) n ON c.asset = n.vec_id"
SQL["reach"] = "SELECT asset, x, y, idx, y * 8 + x AS root FROM canvases UNION SELECT c.asset, c.x, c.y, c.idx, r.root FROM reach r JOIN canvases c ON c.asset = r.asset AND c.idx = r.idx AND abs(c.x - r.x) + abs(c.y - r.y) = 1"
SQL["labels"] = "SELECT asset, x, y, idx, min(root) AS root FROM reach GROUP BY 1, 2, 3, 4"
SQL["region_stats"] = (
    "SELECT s.*, 4 * s.area - 2 * coalesce(i.inner_sides, 0) AS perimeter FROM (SELECT asset, root, idx, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM labels GROUP BY 1, 2, 3) s "
    "LEFT JOIN (SELECT a.asset, a.root, count(*) AS inner_sides FROM labels a JOIN labels b ON a.asset = b.asset AND a.root = b.root AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY 1, 2) i ON i.asset = s.asset AND i.root = s.root"
)
_PAIR = "SELECT DISTINCT p.asset, least(p.root, q.root) AS a, greatest(p.root, q.root) AS b, CASE WHEN p.root < q.root THEN p.idx ELSE q.idx END AS a_idx, CASE WHEN p.root < q.root THEN q.idx ELSE p.idx END AS b_idx FROM labels p JOIN labels q ON p.asset = q.asset AND p.root <> q.root AND "
SQL["adjacent"] = _PAIR + "((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1))"
SQL["diagonal"] = _PAIR + "q.y = p.y + 1 AND abs(q.x - p.x) = 1"
SQL["areas"] = "SELECT asset, idx, count(*) AS area FROM canvases WHERE idx <> 0 GROUP BY 1, 2"
SQL["shares"] = "SELECT *, sum(area) OVER (PARTITION BY asset) AS total, sum(area) OVER (PARTITION BY asset ORDER BY area DESC, idx ROWS UNBOUNDED PRECEDING) AS cum FROM areas"
SQL["runs"] = (
    "SELECT asset, y, run, idx, min(x) AS start, count(*) AS len FROM (SELECT *, sum(is_new) OVER (PARTITION BY asset, y ORDER BY x) - 1 AS run FROM (SELECT *, CASE WHEN lag(idx) OVER w IS NULL OR lag(idx) OVER w <> idx THEN 1 ELSE 0 END AS is_new FROM canvases WINDOW w AS (PARTITION BY asset, y ORDER BY x))) GROUP BY 1, 2, 3, 4"
)
SQL["signed"] = (
    "SELECT m.asset, m.x, m.y, (CASE WHEN m.idx <> 0 THEN 1 ELSE -1 END) * least(coalesce(min(3 * greatest(abs(m.x - o.x), abs(m.y - o.y)) + least(abs(m.x - o.x), abs(m.y - o.y))), 99), 3 * least(m.x + 1, m.y + 1, 8 - m.x, 8 - m.y)) / 3.0 AS d "
    "FROM canvases m LEFT JOIN canvases o ON o.asset = m.asset AND (o.idx <> 0) <> (m.idx <> 0) GROUP BY m.asset, m.x, m.y, m.idx"
)
