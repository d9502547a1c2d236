"""Confusion matrices, accuracies and losses from truth and prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSSES = ("classAccuracy", "classAccuracyWithoutVoid", "pixelAccuracy", "pixelAccuracyWithoutVoid")


def confusion(rows: DataFrame, by: list[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def normalized(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """``share`` of each cell in its row of truth, 0 in a row of zeros."""
    row = F.sum("n").over(Window.partitionBy(*by, "label"))
    return counts.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), row), F.lit(0.0)))


def _void(ignored: list[int], column: str = "label") -> Column:
    return F.col(column).isin(*ignored) if ignored else F.lit(False)


def class_accuracy(counts: DataFrame, ignored: list[int] = (), include_void: bool = True, domain: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Mean share of right predictions over the labels of the domain; labels that don't occur count as 0."""
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    rows = counts.groupBy(*by, "label").agg(F.try_divide(right.cast("double"), F.sum("n")).alias("share"))
    if domain is not None:
        keys = counts.select(*by).distinct().crossJoin(F.broadcast(domain.select("label"))) if by else domain.select("label")
        rows = keys.join(rows, [*by, "label"], "left")
    rows = rows if include_void else rows.where(~_void(ignored))
    return rows.groupBy(*by).agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("class_accuracy")) if by else rows.agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("class_accuracy"))


def pixel_accuracy(rows: DataFrame, ignored: list[int] = (), include_void: bool = True, by: list[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of right predictions over all pixels, or over those whose label isn't ignored; null without any."""
    counted = F.lit(True) if include_void else ~_void(ignored, label)
    right = F.count_if(counted & (F.col(label) == F.col(prediction))).cast("double")
    share = F.try_divide(right, F.count_if(counted)).alias("pixel_accuracy")
    return rows.groupBy(*by).agg(share) if by else rows.agg(share)


def dataset_accuracy(rows: DataFrame, image: str, ignored: list[int] = (), include_void: bool = True) -> DataFrame:
    """Mean of the accuracies of the images, 0 without any; the matrix of a data set is pooled instead."""
    return pixel_accuracy(rows, ignored, include_void, [image]).agg(F.coalesce(F.avg("pixel_accuracy"), F.lit(0.0)).alias("dataset_accuracy"))


def loss(kind: Column, class_all: Column, class_void: Column, pixel_all: Column, pixel_void: Column) -> Column:
    """1 less the accuracy that ``kind`` names; an unknown name fails."""
    out = F.raise_error(F.lit("unknown type of loss function")).cast("double")
    for name, value in zip(LOSSES, (class_all, class_void, pixel_all, pixel_void)):
        out = F.when(kind == name, 1 - value).otherwise(out)
    return out


def mean_and_variance(rows: DataFrame, by: list[str], value: str = "loss") -> DataFrame:
    return rows.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.var_pop(value).alias("variance"))


def report(counts: DataFrame) -> str:
    """A matrix as text, rows of truth in shares; at most 256 x 256 cells."""
    cells = {(r.label, r.prediction): r.share for r in normalized(counts).collect()}
    labels = sorted({k for pair in cells for k in pair})
    lines = ["truth \\ prediction " + " ".join(f"{p:>7}" for p in labels)]
    return "\n".join(lines + [f"{t:>18} " + " ".join(f"{cells.get((t, p), 0.0):7.3f}" for p in labels) for t in labels])
