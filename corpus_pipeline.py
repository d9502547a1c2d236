"""From raw documents to sharded training data: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.llm import decontamination, gam
from canopygrid.llm.common import table_path
from canopygrid.llm.mixing import mixed_rows
from canopygrid.llm.sharding import sharded
from canopygrid.llm.simhash import without_near_duplicates
from canopygrid.session import shipped


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled rows among them, doesn't reject.

    A null text counts as empty; a null doc_id has no label; repeated rows share a verdict. Without labels of both kinds all score
    alike. Empty table: empty result.
    """
    shipped(spark)
    model = gam.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(gam.score_of(F.col("text"), model) >= gam.THRESHOLD)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies stays, that with the smallest doc_id, null last.

    Rows count, not ids: of repeated rows, and of copies with equal or null doc_ids, one stays. Null texts are copies of texts without
    a word. Empty table: empty result.
    """
    shipped(spark)
    return without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    A null text holds none; null ids are carried along; repeated rows go or stay together. An empty benchmark takes nothing.
    """
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes, none of those that it leaves out.

    A null source is one of its own, last; a null text has no words; repeated rows are drawn each for itself. Empty table: empty result.
    """
    return mixed_rows(docs)


def ring_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every row.

    A null text has no bytes; rows with a null doc_id are placed by their text; repeated rows get places of their own. Empty table:
    empty result.
    """
    rows = sharded(docs, shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("ring_shards", ring_shards),
]

#: Boosted tables, components of similar sets and drawn copies have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = table_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
