"""URL rules over hosts and paths, matched through hashed host-suffix and path-prefix expressions.

Each distinct (host, path), known by its SHA-256, is expanded once into the host's suffixes of the numbers of labels
that rules have, times the path's prefixes of the lengths that rules have. Expressions meet rules by an equi-join on
the first four bytes of their SHA-256; the full digests then confirm, and the longest rule
wins (equal length: the longer host; then block before allow). Joins on keys that many rows may
share (an expression, a popular url) are broadcast by size, else salted. DataFrame functions only.

Defined cases: a null url, or one without ``://``, has an empty host and path and meets no
rule; no rule met gives the default verdict; repeated pages are each judged; null page_ids
stay; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import common

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"


def parts(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url column."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return common.lower_ascii(host), path


def _hashed(df: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256)
    return df.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; rules: host, path, verdict."""
    host, path = parts(F.col("url"))
    # Urls are known by a digest, so that what joins send is as narrow for long urls as for short ones.
    own = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("url", F.when(F.col("host") != "", F.sha2(F.concat("host", F.lit("\n"), "path"), 256)))
    wanted = _hashed(rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct())
    # Lengths of rules' paths and numbers of their hosts' labels: lists no longer than the longest path and host.
    kinds = wanted.select(F.length("r_path").alias("n"), F.size(F.split("r_host", r"\.")).alias("labels")).distinct().collect()
    lengths, counts = sorted({r["n"] for r in kinds}), sorted({r["labels"] for r in kinds})
    distinct = own.where("host <> ''").groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"))
    # A host may have empty labels; a suffix starts after any dot.
    labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    suffixes = F.array_compact(F.array(*(F.when(labels >= n, F.substring_index("host", ".", -n)) for n in counts)))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = distinct.withColumn("r_host", F.explode(suffixes)).withColumn("r_path", F.explode(prefixes))
    met = common.salted_join(_hashed(expanded.drop("host", "path")), wanted.withColumnRenamed("digest", "full").drop("r_host").withColumnRenamed("r_path", "full_path"), "short", "url").where("digest = full")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = common.stored(met.groupBy("url").agg(F.max(rank).alias("best")), "judged-urls")
    return common.salted_join(own, best, "url", "page_id", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(common.table(spark, sf_dir, "pages"), rules)


_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
ORACLE = (
    "WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), "
    "p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, "
    "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u), "
    "r AS (SELECT *, CASE " + " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))) + " END AS rule FROM p) "
    "SELECT page_id, host, path, rule, CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES) + f" ELSE '{DEFAULT}' END AS verdict FROM r"
)
