"""What the operators of this subpackage share: scratch tables, size-checked joins, components.

Scratch tables are Parquet in the folder that ``spark.checkpoint.dir`` names, which
driver and executors share; they cut lineage and survive the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few longs, and one of narrow keys, is broadcast; beyond it joins shuffle.
BROADCAST_KEYS, NARROW_KEYS = 200_000, 500_000
#: How many times its file's size a scratch table may take in memory: sorted keys and equal values nearly vanish in files.
UNPACKED = 16
#: Rows and bytes in one Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Copies of a key in a salted join; rows of a key, and number of keys, from which a skewed join broadcasts keys.
SALTS, HOT_ROWS, HOT_KEYS = 16, 2000, 100_000


def ready(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and what the driver broadcasts unasked.

    Spark takes a file's size for its table's, so it would broadcast compressed tables of many times its threshold.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only where the session names none (tests), a temporary one."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='rasterlake-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to a scratch table and read again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.rasterlake_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for df in frames:
        path = df.__dict__.get("rasterlake_path")
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished queries, so that Spark removes their shuffle files."""
    spark._jvm.System.gc()


def sized(df: DataFrame, bound: int = NARROW_KEYS) -> DataFrame:
    """A stored table of narrow keys, marked for broadcast if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.count() <= bound else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def salted_join(big: DataFrame, keyed: DataFrame, key: str | list[str], spread: str, how: str = "inner") -> DataFrame:
    """Join of a table in which one key may hold any share of the rows with a stored table of one row for each key.

    The keyed side is broadcast if it is small; else every key of it is copied ``SALTS`` times and
    the big side's rows are dealt over the copies by their column ``spread``.
    """
    if keyed.count() <= BROADCAST_KEYS:
        return big.join(F.broadcast(keyed), key, how)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [*([key] if isinstance(key, str) else key), "_salt"], how).drop("_salt")


def skew_join(big: DataFrame, keyed: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join with a stored table of one row for each key that knows the big side's rows of the key (column ``rows``, dropped).

    Keys with many rows, of which there can only be ``HOT_KEYS``, are broadcast; all other keys are shuffled.
    """
    total = keyed.agg(F.sum(rows)).first()[0] or 0
    often = F.col(rows) > max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = keyed.where(often).drop(rows), keyed.where(~often).drop(rows)
    if hot.isEmpty():
        return big.join(cold, key)
    hot = F.broadcast(hot)
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(cold, key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes with an edge; the component is its smallest node. Stored.

    Each round hooks every node to its smallest neighbour, if that is smaller; follows the hooks to
    their ends, doubling the way at each step; and makes each end one node of the next round, whose
    edges join different ends. In two rounds every end left has taken in another node, so rounds grow
    with the logarithm of the nodes, whatever the shape, and none is the last by a cap. Nodes with
    any number of neighbours only meet minima and joins that are salted.
    """
    left = stored(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges")
    labels = None
    while True:
        ends = F.explode(F.array(F.struct(F.col("u").alias("node"), "u"), F.struct(F.col("v").alias("node"), "u"))).alias("e")
        up = stored(left.select(ends).groupBy("e.node").agg(F.min("e.u").alias("up")), "hooks")
        while True:
            used = up.select("up").distinct()
            on = stored(up.where("up <> node").select(F.col("node").alias("up"), F.col("up").alias("top")).join(used, "up", "left_semi"), "hooked-hooks")
            if on.isEmpty():
                discard(on)
                break
            further = stored(salted_join(up, on, "up", "node", "left").select("node", F.coalesce("top", "up").alias("up")), "hooks")
            discard(up, on)
            up = further
        own = up.select(F.col("node").alias("label"), "up")
        if labels is None:
            labels, old = stored(up.select("node", F.col("up").alias("label")), "labels"), None
        else:
            old = labels
            labels = stored(salted_join(labels, own, "label", "node", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        first = salted_join(left, up.select(F.col("node").alias("u"), F.col("up").alias("x")), "u", "v")
        both = salted_join(first, up.select(F.col("node").alias("v"), F.col("up").alias("y")), "v", "u")
        after = stored(both.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        discard(left, up, *([old] if old is not None else []))
        left = after
        if left.isEmpty():
            discard(left)
            out = labels.select("node", F.col("label").alias("component"))
            out.rasterlake_path = labels.rasterlake_path
            return out
