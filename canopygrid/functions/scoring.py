"""Scores of splits from class counts left and right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.functions.arrays import at_most_one


def xlog2x(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)


def entropy(p: Column) -> Column:
    """-p log2 p, 0 at 0."""
    return -xlog2x(p)


def gains(counts: DataFrame, by: list[str]) -> DataFrame:
    """``gain`` and ``score`` (the normalised gain) for each group of ``by``.

    ``counts`` has ``label``, ``n_left``, ``n_right``. Both scores are sums of x log2 x of the counts, so one grouped sum gives them:
    the aggregation combines before the shuffle and needs no row for a class on the other side.
    """
    both = F.col("n_left") + F.col("n_right")
    sums = counts.groupBy(*by).agg(
        F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"), F.sum(xlog2x(F.col("n_left")) + xlog2x(F.col("n_right"))).alias("cells"), F.sum(xlog2x(both)).alias("labels")
    )
    n = F.col("n_left") + F.col("n_right")
    sides = xlog2x(F.col("n_left")) + xlog2x(F.col("n_right"))
    raw = F.when(n > 0, (F.col("cells") - F.col("labels") - sides + xlog2x(n)) / n).otherwise(0.0)
    one_sided = (F.col("n_left") == 0) | (F.col("n_right") == 0)
    out = sums.withColumn("raw", F.when(one_sided | (F.abs(raw) < 1e-12), 0.0).otherwise(raw))
    spread = (2 * xlog2x(n) - sides - F.col("labels")) / n
    score = F.when(F.col("raw") == 0, 0.0).otherwise(2 * F.col("raw") / spread)
    return out.select(*by, "n_left", "n_right", at_most_one(F.col("raw")).alias("gain"), at_most_one(score).alias("score"))


def no_op_score(counts: DataFrame, by: list[str]) -> DataFrame:
    """The cheapest score there is, the share of the left side; for measuring all but the score."""
    return counts.groupBy(*by).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")).withColumn("score", F.try_divide(F.col("n_left").cast("double"), F.col("n_left") + F.col("n_right")))


def cumulative(buckets: DataFrame, by: list[str], thresholds: DataFrame) -> DataFrame:
    """Counts for each threshold from counts for each bucket.

    ``buckets``: ``by``, ``bucket`` (how many thresholds are below the response; all of them for a missing one), ``label``, ``n``.
    ``thresholds``: ``by`` columns that it has, ``threshold_id`` ascending by value. Rows here are buckets, not samples.
    """
    on = [c for c in by if c in thresholds.columns]
    w = Window.partitionBy(*by, "label")
    running = buckets.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w), "next": F.lead("bucket").over(w.orderBy("bucket"))})
    labels = running.select(*by, "label", "total").distinct().join(thresholds, on)
    steps = running.join(thresholds, on).where("threshold_id >= bucket and (next is null or threshold_id < next)").select(*by, "threshold_id", "label", F.col("upto").alias("n_left"))
    joined = labels.join(steps, [*by, "threshold_id", "label"], "left").withColumn("n_left", F.coalesce("n_left", F.lit(0).cast("long")))
    return joined.select(*by, "threshold_id", "label", "n_left", (F.col("total") - F.col("n_left")).alias("n_right"))


def best(scored: DataFrame, node: list[str], digits: int = 12) -> DataFrame:
    """The best split of each node: the highest score, then the lowest threshold, then the lowest feature.

    Scores that differ by less than rounding count as equal, so that the order of a sum decides nothing.
    """
    key = F.struct((-F.round("score", digits)).alias("s"), F.col("threshold_id"), F.col("feature_id"))
    rest = [c for c in scored.columns if c not in (*node, "threshold_id", "feature_id")]
    packed = scored.select(*node, F.struct(key.alias("key"), *rest).alias("x"), key.alias("key"))
    return packed.groupBy(*node).agg(F.min_by("x", "key").alias("x")).select(*node, "x.key.feature_id", "x.key.threshold_id", *[f"x.{c}" for c in rest])
