"""python -m canopygrid train | predict | tune: the commands over image folders."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from canopygrid.config import TrainingConfig, check_prediction
from canopygrid.operators import inference, labels, metrics
from canopygrid.plans import tuning
from canopygrid.plans.forest import RandomForestLabeler, shared_table
from canopygrid.sources import images, model_json


def _flag(p: argparse.ArgumentParser, name: str, default: bool) -> None:
    p.add_argument(f"--{name}", type=lambda v: str(v).lower() in ("1", "true", "yes"), nargs="?", const=True, default=default)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("canopygrid")
    sub = top.add_subparsers(dest="command", required=True)
    train, predict, tune = (sub.add_parser(c) for c in ("train", "predict", "tune"))
    for name in ("trees", "samplesPerImage", "featureCount", "minSampleCount", "maxDepth", "boxRadius", "regionSize", "numThresholds"):
        train.add_argument(f"--{name}", type=int, required=True)
    train.add_argument("--folderTraining", required=True)
    train.add_argument("--outputFolder", default="")
    for p in (train, tune):
        _flag(p, "useCIELab", True)
        _flag(p, "useDepthFilling", False)
        _flag(p, "useDepthImages", True)
        _flag(p, "horizontalFlipping", False)
        p.add_argument("--subsamplingType", default="classUniform")
        p.add_argument("--maxImages", type=int, default=0)
        p.add_argument("--imageCacheSize", type=int, default=0)
        p.add_argument("--randomSeed", type=int, default=4711)
        p.add_argument("--ignoreColor", action="append", default=[])
    predict.add_argument("--folderPrediction", default="")
    predict.add_argument("--folderTesting", required=True)
    predict.add_argument("--treeFolder", required=True)
    predict.add_argument("--histogramBias", type=float, default=0.0)
    _flag(predict, "useDepthFilling", False)
    _flag(predict, "writeProbabilityImages", False)
    _flag(predict, "useLabelsPrior", True)
    tune.add_argument("--trainingFolder", required=True)
    tune.add_argument("--testingFolder", required=True)
    tune.add_argument("--lossFunction", required=True, choices=metrics.LOSSES)
    tune.add_argument("--trials", type=int, default=10)
    _flag(tune, "useLabelsPrior", True)
    return top


def _config(a: argparse.Namespace, **more) -> TrainingConfig:
    return TrainingConfig(max_images=a.maxImages, image_cache_size=a.imageCacheSize, random_seed=a.randomSeed, subsampling_type=a.subsamplingType, use_cielab=a.useCIELab, use_depth_filling=a.useDepthFilling, use_depth_images=a.useDepthImages, horizontal_flipping=a.horizontalFlipping, ignored_colors=tuple(a.ignoreColor), **more)


def _pixels(spark, folder: str, config: TrainingConfig, colors=None):
    """Pixels as the forest sees them, as they were read, the dictionary and the ignored labels."""
    from canopygrid.functions.color import rgb_to_lab

    raw, colors = images.load_images(spark, folder, config.use_depth_images, list(config.ignored_colors), colors)
    pixels = raw
    if config.use_cielab:
        pixels = pixels.withColumns(dict(zip(("c0", "c1", "c2"), (c.cast("float") for c in rgb_to_lab(F.col("c0"), F.col("c1"), F.col("c2"))))))
    return pixels, raw, colors, [r.label for r in labels.ignored_labels(colors, list(config.ignored_colors)).collect()]


def _save(raw, found, colors, folder: str, ignored: list[int], depth: bool, probabilities: bool) -> None:
    """Each image's colours, depth, truth and prediction, and its classes' probabilities if asked for."""
    images.save_images(images.images_of(raw, ["c0", "c1", "c2"]), folder, ".png")
    if depth:
        images.save_images(images.images_of(raw, ["depth"], sixteen=True), folder, images.DEPTH)
    images.save_images(images.label_images(raw, colors), folder, images.TRUTH)
    images.save_images(images.label_images(found.withColumn("label", F.col("prediction")), colors), folder, "_prediction.png")
    if probabilities:
        images.save_images(images.probability_images(found, ignored), folder, ".png")


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("canopygrid").getOrCreate()
    if a.command == "train":
        config = _config(a, trees=a.trees, samples_per_image=a.samplesPerImage, feature_count=a.featureCount, min_sample_count=a.minSampleCount, max_depth=a.maxDepth, box_radius=a.boxRadius, region_size=a.regionSize, thresholds=a.numThresholds)
        pixels, _, colors, ignored = _pixels(spark, a.folderTraining, config)
        model = RandomForestLabeler(config, ignored).fit(pixels, colors.count())
        if a.outputFolder:
            named = {r.label: f"{r.r},{r.g},{r.b}" for r in colors.collect()}
            model_json.write_forest(spark, a.outputFolder, model.nodes, config, model.priors, named)
        return {"trees": [r.asDict() for r in inference.tree_stats(model.node_table(spark)).collect()]}
    if a.command == "predict":
        check_prediction(a.histogramBias, a.writeProbabilityImages, a.folderPrediction)
        nodes, config, priors, named = model_json.read_forest(spark, a.treeFolder)
        config = config.with_(use_depth_filling=a.useDepthFilling)
        model = RandomForestLabeler(config)
        model.nodes, model.priors, model.classes = nodes, priors, len(priors)
        # Labels are those of the training images, whatever comes first here; padding has label 0 in any case.
        known = labels.dictionary_of(spark, {0: labels.padding_color(list(config.ignored_colors))} | named)
        pixels, raw, colors, ignored = _pixels(spark, a.folderTesting, config, known)
        found = shared_table(model.predict(pixels, a.histogramBias, a.useLabelsPrior, a.writeProbabilityImages), "predicted")
        if a.folderPrediction:
            _save(raw, found, colors, a.folderPrediction, ignored, config.use_depth_images, a.writeProbabilityImages)
        losses = tuning.losses_of(pixels, found, len(priors), ignored)
        rows = found.join(pixels.select("image_id", "x", "y", "label"), ["image_id", "x", "y"])
        return {"losses": losses, "confusion": metrics.report(metrics.confusion(rows))}
    config = _config(a)
    pixels, _, colors, ignored = _pixels(spark, a.trainingFolder, config)
    held_out = _pixels(spark, a.testingFolder, config, colors)[0]
    trials = [{k: v for k, v in r.asDict().items() if k != "trial_id"} for r in tuning.proposals(spark, a.trials, config.random_seed).collect()]
    results = tuning.search(pixels, held_out, trials, config, colors.count(), loss=a.lossFunction, ignored=ignored, use_prior=a.useLabelsPrior)
    # A trial that was stopped has fewer runs behind its loss; the first one never is.
    return {"best": min((r for r in results if r["status"] == "ok"), key=lambda r: r["loss"])}


if __name__ == "__main__":
    print(json.dumps(main(), indent=1, default=str))
