"""Samples that only depend on keys and a seed, so that any partitioning draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.functions.hashing import digest, draw, unit


def reservoir(rows: DataFrame, k: int, key: list[str], by: list[str], seed: int = 4711) -> DataFrame:
    """``k`` rows of each group of ``by``, uniformly: those with the smallest hash of their key.

    Bottom-k of a group is the bottom-k of the bottom-k of its parts, so each part keeps ``k`` rows before the groups meet, and a
    group that holds most of the rows costs no task more than parts times ``k``.
    """
    if k < 1:
        raise ValueError("a reservoir must hold a row at least")
    ranked = rows.withColumn("rank_key", digest(seed, *[F.col(c) for c in key]))
    part = Window.partitionBy(*by, "part").orderBy("rank_key", *key)
    whole = Window.partitionBy(*by).orderBy("rank_key", *key)
    salted = ranked.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(64)))
    kept = salted.withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= k)
    return kept.withColumn("rn", F.row_number().over(whole)).where(F.col("rn") <= k).drop("rn", "part", "rank_key")


def class_uniform(pixels: DataFrame, per_image: int, images: int, classes: int, ignored: list[int] = (), seed: int = 4711) -> DataFrame:
    """As many pixels of each label as images times samples by labels, rounded up; ignored labels and missing depths aside."""
    k = -(-images * per_image // (classes - len(ignored)))
    frame = pixels.where("valid = 1")
    frame = frame.where(~F.col("label").isin(*ignored)) if ignored else frame
    return reservoir(frame, k, ["image_id", "x", "y"], ["label"], seed)


def pixel_uniform(spark, n: int, images: int, width: int, height: int, seed: int = 4711, attempt: int | Column = 0) -> DataFrame:
    """``draw_id``, ``image`` (from 0), ``x``, ``y``: pixels with replacement, each drawn by its number alone."""
    i = F.col("id")
    return spark.range(n).select(i.alias("draw_id"), draw(0, images - 1, seed, "image", i, attempt).alias("image"), draw(0, width - 1, seed, "x", i, attempt).cast("int").alias("x"), draw(0, height - 1, seed, "y", i, attempt).cast("int").alias("y"))


def pixel_uniform_accepted(pixels: DataFrame, images: DataFrame, n: int, width: int, height: int, ignored: list[int], seed: int = 4711, attempts: int = 16, stay: bool = False) -> DataFrame:
    """``n`` draws, the first try of each that meets a pixel whose label isn't ignored; missing depths are kept.

    ``images`` numbers the images: ``image``, ``image_id``. Each try draws an image, or with ``stay`` the first one draws it for all.
    Tries come in rounds, of ``attempts`` and then twice as many, for the draws still without a pixel, until none is left.
    """
    fit = pixels.where(~F.col("label").isin(*ignored)) if ignored else pixels
    left, first, i, a, count, out = pixels.sparkSession.range(n).select(F.col("id").alias("draw_id")), 0, F.col("draw_id"), F.col("attempt"), images.count(), None
    if stay and (empty := images.join(fit, "image_id", "left_anti").select("image_id").limit(5).collect()):
        raise ValueError(f"images without a pixel to draw: {[r.image_id for r in empty]}")
    while True:
        tries = left.select("draw_id", F.explode(F.sequence(F.lit(first), F.lit(first + attempts - 1))).alias("attempt"))
        tries = tries.select("draw_id", "attempt", draw(0, count - 1, seed, "image", i, F.lit(0) if stay else a).alias("image"), draw(0, width - 1, seed, "x", i, a).cast("int").alias("x"), draw(0, height - 1, seed, "y", i, a).cast("int").alias("y"))
        met = tries.join(images, "image").join(fit, ["image_id", "x", "y"])
        met = met.groupBy("draw_id").agg(F.min_by(F.struct("image_id", "x", "y", "label"), "attempt").alias("s")).select("draw_id", "s.*")
        out = met if out is None else out.unionByName(met)
        left = left.join(met.select("draw_id"), "draw_id", "left_anti")
        if left.isEmpty() or (not first and images.join(fit, "image_id", "left_semi").isEmpty()):
            return out
        first, attempts = first + attempts, 2 * attempts


def image_subsample(images: DataFrame, k: int, tree: int, seed: int = 4711) -> DataFrame:
    """At most ``k`` images for a tree; 0 is all."""
    return images if not k else reservoir(images.withColumn("tree_id", F.lit(tree)), k, ["tree_id", "image_id"], ["tree_id"], seed)


def split_sides(rows: DataFrame, key: str, test_ratio: float, seed: int) -> DataFrame:
    """``rows`` with ``side``: 'test' where the row's draw is below the ratio, else 'train'."""
    return rows.withColumn("side", F.when(unit(seed, F.col(key)) < test_ratio, "test").otherwise("train"))


def random_split(rows: DataFrame, key: str, test_ratio: float, seed: int, tries: int = 100) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; drawn again while a side is empty."""
    for again in range(tries):
        sides = split_sides(rows, key, test_ratio, seed + again)
        train, test = sides.where("side = 'train'").drop("side"), sides.where("side = 'test'").drop("side")
        if not train.isEmpty() and not test.isEmpty():
            return train, test
    raise ValueError("one side of the split stays empty")


def runs(rows: DataFrame, key: str, n: int, test_ratio: float, seed: int) -> DataFrame:
    """``n`` independent random splits: each row once for each ``run``, with its ``side``."""
    each = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.withColumn("side", F.when(unit(seed, F.col("run"), F.col(key)) < test_ratio, "test").otherwise("train"))


def local_order(samples: DataFrame) -> DataFrame:
    """Samples of an image side by side, nearby ones together: reads of a plane stay in cache. The order decides no result."""
    return samples.repartition("image_id").sortWithinPartitions("image_id", "label", F.floor(F.col("y") / 10), F.floor(F.col("x") / 10))
