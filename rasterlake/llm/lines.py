"""Removal of lines that many sites share. DataFrame functions only.

A line is judged by the 64-bit hash of its text without spaces, tabs and carriage returns at
the ends. Lines that one site alone has are let go by a plain aggregation. For the others,
HyperLogLog sketches of their sites are built per line and part, and merged per line; lines
whose estimate is near the threshold get an exact count of distinct sites. Lines on
``min_sites`` sites or more are boilerplate, and are removed wherever they stand, in every
document but copies: a document of which boilerplate makes up ``max_share`` of the characters
or more would, at that share, have a Jaccard similarity of 0.75 or more with any other that
is made of the same lines. It is for near-duplicate removal to settle, and stays as it is
(with 1 as ``max_share`` only documents that would lose everything stay; above 1, none).

Keys that many rows share only meet partial aggregations and joins that Spark can split.

Defined cases: null text stays null; a null source is no site; blank lines are never
boilerplate, nor are those shorter than ``min_chars``; rows that repeat a document are treated
alike; a document keeps its row even if lines go; an empty table gives no row; all columns
stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import common

#: A share s of common text gives a Jaccard similarity of s / (2 - s): 0.75 at 6/7.
MIN_SITES, MIN_CHARS, MAX_SHARE = 6, 1, 6 / 7
#: log2 of the registers of a sketch; its relative error is 1.04 / sqrt(2 ** LG).
LG = 8
_PARTS = 16


def _trimmed(line):
    return F.trim(line, F.lit(" \t\r"))


def _lines(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """One row for each line that is long enough: document key, place, line hash, length, site."""
    line = _trimmed(F.col("line"))
    return (
        docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.length(line) >= max(1, min_chars))
        .select("doc_id", "text_key", "pos", "site", F.length(line).alias("chars"), F.xxhash64(line).alias("h"))
    )


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h): hashes of lines on ``min_sites`` distinct sites or more."""
    error = 1.04 / 2 ** (LG / 2)
    band = max(1.0, 3 * error * min_sites)
    part = F.pmod(F.xxhash64("text_key", "pos"), F.lit(_PARTS))
    sketches = lines.where("site is not null").groupBy("h", part.alias("part")).agg(F.hll_sketch_agg("site", LG).alias("sketch"))
    estimate = common.stored(sketches.groupBy("h").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites")), "line-sites")
    sure = estimate.where(F.col("sites") > min_sites + band).select("h")
    near = common.sized(estimate.where(F.col("sites").between(min_sites - band, min_sites + band)).select("h"))
    exact = lines.join(near, "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites).select("h")
    return sure.unionByName(exact)


def removals(docs: DataFrame, site: str, min_sites: int, min_chars: int) -> DataFrame:
    """(doc_id, text_key, chars, gone, rows): the places of the boilerplate lines of each document that has any, and their characters in all its rows."""
    lines = _lines(docs, site, min_chars)
    mark = F.xxhash64("site")
    shared = lines.where("site is not null").groupBy("h").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.count("*").alias("n")).where((F.col("lo") < F.col("hi")) & (F.col("n") >= min_sites)).select("h")
    shared = common.stored(shared, "shared-lines")
    met = common.stored(lines.join(common.sized(shared), "h"), "shared-line-places")
    wide = common.stored(boilerplate(met, min_sites), "boilerplate")
    found = met.join(common.sized(wide), "h", "left_semi")
    return found.groupBy("doc_id", "text_key").agg(F.sum("chars").alias("chars"), F.sort_array(F.collect_set("pos")).alias("gone"), F.count("*").alias("rows"))


def dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, max_share: float = MAX_SHARE, count: str | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without boilerplate lines; ``count`` names a column for the number removed."""
    own_key, key, id_, chars, gone, n = (common.free_name(docs, c) for c in ("own_key", "text_key", "id", "chars", "gone", "n"))
    own = docs.withColumn(own_key, F.xxhash64("text"))
    going = removals(docs, site, min_sites, min_chars).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.expr("chars * size(gone) / rows").alias(chars), F.col("gone").alias(gone))
    both = own.join(going, own["doc_id"].eqNullSafe(F.col(id_)) & (F.col(own_key) == F.col(key)), "left")
    lines = F.split("text", "\n")
    total = F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.length(_trimmed(x)))
    goes = F.col(gone).isNotNull() & (F.col(chars) < max_share * total)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(goes, F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).otherwise(F.col("text"))
    out = both.withColumn(n, F.when(goes, F.size(gone)).otherwise(0)).withColumn("text", text)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols, *([F.col(n).alias(count)] if count else []))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup(docs, count="removed").select("doc_id", "removed", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def oracle(documents: str, columns: str) -> str:
    bare = "trim(line, ' ' || chr(9) || chr(13))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, * FROM {documents}),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
t AS (SELECT rid, source, line, pos, {bare} AS bare FROM l),
b AS (SELECT bare FROM t WHERE length(bare) >= {MIN_CHARS} AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT rid, pos, line, bare, bare IN (SELECT bare FROM b) AS gone FROM t),
s AS (SELECT rid, count(*) FILTER (WHERE gone) AS n, coalesce(sum(length(bare)) FILTER (WHERE gone), 0) < CAST({MAX_SHARE!r} AS DOUBLE) * sum(length(bare)) AS ok,
 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY rid),
o AS (SELECT d.* REPLACE (CASE WHEN n > 0 AND ok THEN kept ELSE text END AS text), CASE WHEN n > 0 AND ok THEN n ELSE 0 END AS removed FROM d LEFT JOIN s USING (rid))
SELECT {columns} FROM o"""


ORACLE = oracle("documents", "doc_id, removed, length(text) AS chars, md5(text) AS text_md5")
