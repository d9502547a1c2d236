"""Counts that splits are scored by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.operators.features import routed_left


def class_prior(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """``label``, ``n`` over all pixels, ignored and missing ones included; 0 for labels of the domain that don't occur."""
    counts = pixels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.select("label").distinct().join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def node_histogram(samples: DataFrame, node: list[str], label: str = "label") -> DataFrame:
    """Samples of each class in each node."""
    return samples.groupBy(*node, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def flipped(samples: DataFrame, mode: str = "both") -> DataFrame:
    """Samples with ``flipped``; with ``both`` each appears twice and stays one sample by its id."""
    if mode == "both":
        return samples.withColumn("flipped", F.explode(F.array(F.lit(False), F.lit(True))))
    return samples.withColumn("flipped", F.lit(mode == "flip"))


def bucket(value: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds are below the value; all of them for a missing one, which goes right everywhere."""
    out = F.lit(len(thresholds))
    for i in range(len(thresholds) - 1, -1, -1):
        out = F.when(value <= thresholds[i], i).otherwise(out)
    return F.when(value.isNull() | F.isnan(value), len(thresholds)).otherwise(out).cast("int")


def bucket_counts(samples: DataFrame, features: dict[str, list[float]], label: str, node: list[str] = ()) -> DataFrame:
    """Counts by ``node``, ``feature_id``, ``bucket``, ``label``; features are columns with ascending thresholds, numbered in order.

    A sample gives one row for each feature, whatever the number of thresholds; the sums are combined before the shuffle.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("feature_id"), bucket(F.col(c).cast("double"), t).alias("bucket")) for i, (c, t) in enumerate(features.items())])
    return samples.select(*node, F.col(label).alias("label"), F.explode(cells).alias("c")).groupBy(*node, "c.feature_id", "c.bucket", "label").agg(F.count(F.lit(1)).alias("n"))


def threshold_rows(spark, features: dict[str, list[float]]) -> DataFrame:
    rows = [(i, k, float(v)) for i, t in enumerate(features.values()) for k, v in enumerate(t)]
    return spark.createDataFrame(rows, "feature_id int, threshold_id int, threshold double")


def split_counters(rows: DataFrame, thresholds: DataFrame, node: list[str] = ()) -> DataFrame:
    """``n_left``, ``n_right`` by feature, threshold and label, from ``feature_id``, ``response``, ``label`` and a short table of thresholds."""
    left = routed_left(F.col("response"), F.col("value").cast("double"))
    met = rows.join(F.broadcast(thresholds), "feature_id")
    return met.groupBy(*node, "feature_id", "threshold_id", "label").agg(F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"))


def summed(*counts: DataFrame) -> DataFrame:
    """Counters of several parts as one, by all columns but the counts."""
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    by = [c for c in out.columns if c not in ("n", "n_left", "n_right")]
    return out.groupBy(*by).agg(*[F.sum(c).alias(c) for c in out.columns if c not in by])


def summary(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.mean(column).alias("mean"), F.stddev_samp(column).alias("sd"))
