"""The pipeline on a small corpus: each stage against what its rule says of its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterlake.llm import binary
from tests.llm.test_operators import brute

DATA = "/root/testdata/sf0.01"  # enough labelled rows of both classes to learn from
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], DATA)
        path = f"file://{tmp_path}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        kept.append(spark.read.parquet(path))
        if name != "packing":
            assert kept[-1].columns == docs.columns
    first, quality, cleaned, single, clean, pieces = kept
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = labels.where("quality = 1").join(first, "doc_id")
    assert good.join(quality, "doc_id").count() >= 0.98 * good.count()
    bad = labels.where("quality = 0").join(first, "doc_id")
    assert bad.join(quality, "doc_id", "left_semi").count() <= 0.2 * bad.count()
    assert cleaned.count() == quality.count()
    assert cleaned.where("n_chars <> length(text)").count() == 0
    rows = [(r["doc_id"], r["text"]) for r in cleaned.collect()]
    comp = brute(rows)
    assert {r["doc_id"] for r in single.collect()} == {i for i in comp if comp[i] == i}
    benchmark = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in single.collect() if any(b in " ".join(r["text"].split()) for b in benchmark)}
    left = {r["doc_id"] for r in clean.collect()}
    assert not leaked & left and len(left) >= single.count() - len(leaked) - 2
    done = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert done.where("n <> m").count() == 0 and {r["doc_id"] for r in done.collect()} == left


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_tokenizer_is_given():
    assert os.path.exists(binary.tokenizer_path())
