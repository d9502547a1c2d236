"""One thin query for each training-data operator: the operator over its whole table, and the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.llm import decontamination, gam, line_dedup, lm_score, pii, quality_rules, warc
from canopygrid.llm.common import table_path
from canopygrid.llm.lm_score import lm_scores
from canopygrid.llm.mixing import mixed
from canopygrid.llm.sharding import sharded
from canopygrid.llm.simhash import simhash_groups
from canopygrid.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 6))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.per_document(line_dedup.line_classes(table(spark, sf_dir, "documents")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), words=3, width=1, radius=3)
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.learned(docs, table(spark, sf_dir, "labels"))
    scores = docs.select("doc_id", gam.score_of(F.col("text"), model).alias("score"))
    return scores.select("doc_id", gam.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= gam.THRESHOLD).cast("int").alias("predicted"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "shared", "similarity")


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    chunks = read_warc(spark, path, data=False).where("last")
    return chunks.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.found(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_mix_sources": op6_mix_sources,
    "op7_decontamination": op7_decontamination,
    "op8_ring_shards": op8_ring_shards,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_personal_data": op10_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op1_lm_scores": lm_score.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op9_warc_round_trip": warc.ORACLE,
}
