"""Hyper-parameter search: trials, runs, early stop, true loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.config import TrainingConfig
from canopygrid.functions.hashing import Sampler, unit
from canopygrid.functions.stats import continue_searching
from canopygrid.operators import metrics
from canopygrid.operators.sampling import random_split
from canopygrid.plans.forest import RandomForestLabeler

#: Parameters of the search with their bounds, and whether they are whole numbers.
SPACE = {
    "numTrees": (1, 10, True),
    "samplesPerImage": (10, 7500, True),
    "featureCount": (10, 7500, True),
    "minSampleCount": (1, 1000, True),
    "maxDepth": (5, 25, True),
    "boxRadius": (1, 127, True),
    "regionSize": (1, 127, True),
    "thresholds": (10, 60, True),
    "histogramBias": (0.0, 0.6, False),
}
NAMES = {"numTrees": "trees", "samplesPerImage": "samples_per_image", "featureCount": "feature_count", "minSampleCount": "min_sample_count", "maxDepth": "max_depth", "boxRadius": "box_radius", "regionSize": "region_size", "thresholds": "thresholds"}
RUNS, TEST_RATIO, TRUE_RUNS = 5, 0.2, 2


def proposals(spark: SparkSession, n: int, seed: int, space: dict = SPACE) -> DataFrame:
    """``trial_id`` and a column for each parameter, drawn by the trial's number alone."""
    cols = []
    for name, (low, high, whole) in space.items():
        u = unit(seed, F.col("id"), name) * (high - low) + low
        cols.append((F.round(u) if whole else u).cast("double").alias(name))
    return spark.range(n).select(F.col("id").alias("trial_id"), *cols)


def parameter(params: Column, name: str) -> Column:
    """A parameter of a trial, the first of its values; a missing one fails."""
    value = F.get(params[name], F.lit(0))
    return F.coalesce(value, F.raise_error(F.lit(f"no parameter {name}")).cast("double"))


def best_trial(trials: DataFrame, by: list[str] = ()) -> DataFrame:
    """The trial with the lowest loss, of each group or of all; ties go to the first."""
    rest = F.struct(*[c for c in trials.columns if c not in by])
    key = F.struct("loss", "trial_id")
    rows = trials.where("loss is not null")
    found = rows.groupBy(*by).agg(F.min_by(rest, key).alias("t")) if by else rows.agg(F.min_by(rest, key).alias("t"))
    return found.select(*by, "t.*")


def assessed(pixels: DataFrame, predicted: DataFrame, classes: int, ignored: list[int]) -> tuple[dict[str, float], list[list[float]]]:
    """The four losses of a prediction, and its confusion matrix in shares of each truth, row by row."""
    rows = predicted.join(pixels.select("image_id", "x", "y", "label"), ["image_id", "x", "y"])
    rows.persist()
    counts = metrics.confusion(rows)
    domain = pixels.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    value = lambda df: df.first()[0]
    acc = [value(metrics.class_accuracy(counts, ignored, void, domain)) for void in (True, False)] + [value(metrics.dataset_accuracy(rows, "image_id", ignored, void)) for void in (True, False)]
    matrix = [[0.0] * classes for _ in range(classes)]
    # As many rows as pairs of classes.
    for r in metrics.normalized(counts).collect():
        matrix[r.label][r.prediction] = r.share
    rows.unpersist()
    return {name: 1 - (a or 0.0) for name, a in zip(metrics.LOSSES, acc)}, matrix


def losses_of(pixels: DataFrame, predicted: DataFrame, classes: int, ignored: list[int]) -> dict[str, float]:
    """The four losses of a prediction."""
    return assessed(pixels, predicted, classes, ignored)[0]


def config_for(params: dict, base: TrainingConfig) -> TrainingConfig:
    return base.with_(**{NAMES[k]: int(v) for k, v in params.items() if k in NAMES})


def run_once(train: DataFrame, test: DataFrame, params: dict, base: TrainingConfig, classes: int, ignored: list[int], loss: str, use_prior: bool, seed: int) -> tuple[float, list[list[float]]]:
    """The loss and the confusion matrix of one run."""
    model = RandomForestLabeler(config_for(params, base).with_(random_seed=seed), ignored).fit(train, classes)
    losses, matrix = assessed(test, model.predict(test, params.get("histogramBias", 0.0), use_prior), classes, ignored)
    return losses[loss], matrix


def evaluate(pixels: DataFrame, held_out: DataFrame, params: dict, base: TrainingConfig, classes: int, best: list[float], loss: str = "classAccuracy", ignored: list[int] = (), use_prior: bool = True, runs: int = RUNS, seed: int = 4711) -> dict:
    """One trial: random splits of the images until the losses can't match the best, then the true loss on the held-out images."""
    sampler, losses, matrices = Sampler(seed, 1, 100_000), [], []
    images = pixels.select("image_id").distinct()
    for _ in range(runs):
        now = sampler.next()
        train, test = random_split(images, "image_id", TEST_RATIO, now)
        found, matrix = run_once(pixels.join(train, "image_id", "left_semi"), pixels.join(test, "image_id", "left_semi"), params, base, classes, list(ignored), loss, use_prior, now)
        losses.append(found)
        matrices.append(matrix)
        if not continue_searching(best, losses):
            break
    last = [run_once(pixels, held_out, params, base, classes, list(ignored), loss, use_prior, sampler.next()) for _ in range(TRUE_RUNS)] if len(losses) == runs else []
    true, matrices = [v for v, _ in last], [m for _, m in last] or matrices
    mixed = [[sum(m[i][j] for m in matrices) / len(matrices) for j in range(classes)] for i in range(classes)]
    spread = lambda x: sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x) if x else None
    mean = lambda x: sum(x) / len(x) if x else None
    return {"params": params, "losses": losses, "loss": mean(losses), "loss_variance": spread(losses), "true_loss": mean(true), "true_loss_variance": spread(true), "confusion": mixed, "status": "ok" if len(losses) == runs else "stopped"}


def search(pixels: DataFrame, held_out: DataFrame, trials: list[dict], base: TrainingConfig, classes: int, **how) -> list[dict]:
    """All trials in turn; each stops early against the best so far."""
    out, best = [], []
    for i, params in enumerate(trials):
        result = evaluate(pixels, held_out, params, base, classes, best, **how) | {"trial_id": i}
        out.append(result)
        if result["status"] == "ok" and (not best or result["loss"] < sum(best) / len(best)):
            best = result["losses"]
    return out


RECORD = "trial_id long, status string, params map<string,double>, losses array<double>, loss double, loss_variance double, true_loss double, true_loss_variance double, confusion array<array<double>>"


def records(spark: SparkSession, results: list[dict]) -> DataFrame:
    """Results of trials as rows of ``RECORD``; ``confusion`` is the mean matrix of the true runs, or of the others where there were none."""
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    plain = lambda r: r | {"params": {k: float(v) for k, v in r["params"].items()}}
    return spark.createDataFrame([tuple(plain(r)[c] for c in names) for r in results], RECORD)


def as_json(rows: DataFrame) -> DataFrame:
    """Each record as a line of JSON."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
