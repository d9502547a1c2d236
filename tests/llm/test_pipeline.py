"""Every stage on odd rows, and the whole over a small folder."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopygrid.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(0, 1, 0), (8, 0, None), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30))), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("which", ["edge", "none"])
def test_stage_takes_odd_rows(spark, folder, edge_docs, no_docs, k, which):
    docs = edge_docs if which == "edge" else no_docs
    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    n = out.count()
    assert n <= 2 * docs.count()
    if k < 4:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.select("doc_id", "text").distinct().join(docs.select("doc_id", "text"), ["doc_id", "text"], "left_anti").where("text is not null and doc_id is not null").isEmpty()
    else:
        assert n == docs.count()


def test_stages_decide_as_their_operators(spark):
    """On real rows: low quality goes, one document of each group of copies stays, no passage of the benchmark is left."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = stages["quality_classifier"](spark, docs, folder)
    assert kept.join(labels.where("quality = 0"), "doc_id").count() <= 3
    assert kept.join(labels.where("quality = 1"), "doc_id").count() >= labels.where("quality = 1").count() - 3
    once = stages["simhash_near_dedup"](spark, docs, folder)
    texts = once.where(F.length("text") > 0).groupBy(F.lower(F.regexp_replace("text", r"\s+", " ")).alias("t")).count()
    assert texts.where("count > 1").isEmpty()
    assert docs.join(once, "doc_id", "left_anti").count() < 0.15 * docs.count()
    leaks = QUERIES["op7_decontamination"](spark, folder).select("doc_id").distinct()
    clean = stages["benchmark_decontamination"](spark, docs, folder)
    assert clean.join(leaks, "doc_id").isEmpty() and clean.count() == docs.count() - leaks.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 24
