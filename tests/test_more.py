"""The rest of the operators on small inputs."""

import json

import pytest
from pyspark.sql import functions as F
from test_golden import CONFIG, _pixels

from canopygrid.config import TrainingConfig
from canopygrid.functions import arrays
from canopygrid.operators import grid, inference, labels, metrics, sampling, splits
from canopygrid.plans import forest, tuning
from canopygrid.sources import images, model_json


def test_hard_labels_of_samples(spark):
    config = CONFIG.with_(trees=1)
    pixels = _pixels(spark, 6)
    model = forest.RandomForestLabeler(config).fit(pixels)
    table = forest.training_table(forest.image_packs(pixels), forest.sample_table(pixels, config, 6, 2))
    rows = inference.hard_labels(table, inference.forest_of(model.normalized_nodes(spark))[0]).collect()
    assert len(rows) == 360 and sum(r.label == r.prediction for r in rows) > 290


def test_leaf_counts_are_all_pixels(spark):
    pixels = _pixels(spark, 3)
    model = forest.RandomForestLabeler(CONFIG.with_(trees=2)).fit(pixels)
    counts = inference.leaf_counts(forest.image_packs(pixels), inference.forest_of(model.normalized_nodes(spark)))
    assert {(r.tree, r.n) for r in counts.groupBy("tree").agg(F.sum("n").alias("n")).collect()} == {(0, 432), (1, 432)}


def test_broken_trees_are_found(spark):
    model = forest.RandomForestLabeler(CONFIG.with_(trees=1)).fit(_pixels(spark, 3))
    table = model.node_table(spark)
    assert inference.structure_errors(table).isEmpty()
    for bad in (table.where("node_id <> 2"), table.withColumn("level", F.when(F.col("node_id") == 1, 9).otherwise(F.col("level"))), table.withColumn("right_id", F.when(F.col("node_id") == 0, None).otherwise(F.col("right_id")))):
        assert not inference.structure_errors(bad).isEmpty()


def test_random_split_fills_both_sides(spark):
    rows = spark.range(6)
    train, test = sampling.random_split(rows, "id", 0.2, 1)
    assert not train.isEmpty() and not test.isEmpty() and train.count() + test.count() == 6
    with pytest.raises(ValueError):
        sampling.random_split(spark.range(1), "id", 0.5, 1)


def test_padding(spark):
    assert labels.padding_color([]) == "0,0,0" and labels.padding_color(["1,2,3", "4,5,6"]) == "1,2,3"
    pixels = _pixels(spark, 1, 3)
    out = grid.padded(pixels, 5, 4, 7)
    assert out.count() == 20 and out.where("label = 7 and depth = 0 and valid = 0 and c0 is null").count() == 11
    with pytest.raises(Exception, match="larger"):
        grid.padded(pixels, 2, 4, 7).collect()


def test_padded_cells_make_features_missing(spark):
    pixels = grid.padded(_pixels(spark, 1, 3), 5, 4, 7).withColumns({c: F.coalesce(c, F.lit(float("nan")).cast("float")) for c in ("c0", "c1", "c2")})
    model = forest.RandomForestLabeler(CONFIG.with_(trees=1, max_depth=3, samples_per_image=7), [7]).fit(pixels, 8)
    assert model.predict(pixels).count() == 20


def test_depth_units(spark):
    row = spark.createDataFrame([(1.2345, 1500), (float("nan"), 0), (None, -1)], "m double, mm int")
    assert [r[0] for r in row.select(grid.millimetres(F.col("m"))).collect()] == [1234, -1, -1]
    assert [r[0] for r in row.select(grid.is_valid(F.col("mm"))).collect()] == [True, False, False]
    assert [r[0] for r in row.select(grid.in_image(F.col("mm"), F.lit(0), F.lit(10), F.lit(1))).collect()] == [False, True, False]


def test_order_of_samples_keeps_them(spark):
    samples = _pixels(spark, 2, 4)
    assert sorted(map(tuple, sampling.local_order(samples).collect())) == sorted(map(tuple, samples.collect()))


def test_losses_of_a_prediction(spark):
    pixels = _pixels(spark, 2, 4)
    right = pixels.select("image_id", "x", "y", F.col("label").alias("prediction"))
    assert set(tuning.losses_of(pixels, right, 2, []).values()) == {0.0}
    with pytest.raises(Exception, match="unknown type of loss"):
        spark.range(1).select(metrics.loss(F.lit("none"), *[F.lit(0.1)] * 4)).collect()


def test_missing_parameter_fails(spark):
    trial = spark.createDataFrame([({"a": [1.0]},)], "vals map<string,array<double>>")
    assert trial.select(tuning.parameter(F.col("vals"), "a")).first()[0] == 1.0
    with pytest.raises(Exception, match="no parameter"):
        trial.select(tuning.parameter(F.col("vals"), "b")).collect()


def test_unlike_arrays_fail(spark):
    with pytest.raises(Exception, match="unlike"):
        spark.range(1).select(arrays.added(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_votes_of_nobody(spark):
    row = spark.range(1).select(arrays.voted(F.array(F.lit(0.0), F.lit(0.0))).alias("v"), arrays.voted(F.array(F.lit(1.0), F.lit(3.0))).alias("w")).first()
    assert row.v == [0, 0] and row.w == [0.25, 0.75] and arrays is not None


def test_no_file_of_another_forest(spark, tmp_path):
    model = forest.RandomForestLabeler(CONFIG.with_(trees=1, max_depth=2)).fit(_pixels(spark, 2, 8))
    for t, config in enumerate((model.config, model.config.with_(box_radius=9))):
        nodes = [n | {"tree_id": t} for n in model.nodes]
        model_json.write_forest(spark, str(tmp_path), nodes, config, model.priors, {0: "0,0,0", 1: "1,1,1"})
    with pytest.raises(ValueError, match="another forest"):
        model_json.read_forest(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no tree"):
        model_json.read_forest(spark, "/root/testdata/sf0.001/")


def test_label_images(spark, tmp_path):
    from canopygrid.sources import png

    colors = spark.createDataFrame([(0, 0, 0, 0), (1, 9, 8, 7)], "label int, r int, g int, b int")
    cells = spark.createDataFrame([(5, x, y, (x + y) % 2) for x in range(3) for y in range(2)], "image_id long, x int, y int, label int")
    assert images.save_images(images.label_images(cells, colors), str(tmp_path / "out"), "_prediction.png") == 1
    image = png.decode((tmp_path / "out" / "5_prediction.png").read_bytes())
    assert image.shape == (2, 3, 3) and image[0, 1].tolist() == [9, 8, 7] and image[0, 0].tolist() == [0, 0, 0]


def test_flips_count_twice_but_are_one_sample(spark):
    samples = spark.createDataFrame([(1,), (2,)], "sample_id long")
    both = splits.flipped(samples)
    assert both.count() == 4 and both.select("sample_id").distinct().count() == 2
    assert splits.flipped(samples, "flip").where("flipped").count() == 2 and splits.flipped(samples, "none").where("flipped").isEmpty()


def test_results_of_trials_as_records(spark):
    from canopygrid.plans.queries import pixels

    px = pixels(spark, "/root/testdata/sf0.001").where("image_id < 12")
    train, test = px.where("image_id < 9"), px.where("image_id >= 9")
    base = TrainingConfig(trees=1, samples_per_image=8, feature_count=8, thresholds=3, max_depth=2, box_radius=2, region_size=2)
    result = tuning.evaluate(train, test, {"maxDepth": 2}, base, 4, [], runs=1) | {"trial_id": 0}
    row = tuning.records(spark, [result]).first()
    assert row.status == "ok" and row.losses == result["losses"] and len(row.confusion) == 4
    assert all(sum(r) == pytest.approx(1) or sum(r) == 0 for r in row.confusion)
    line = json.loads(tuning.as_json(tuning.records(spark, [result])).first().value)
    assert line["confusion"] == row.confusion and line["params"] == {"maxDepth": 2.0}


def test_trials_are_logged(spark, tmp_path):
    from canopygrid.streaming import trials

    folder = lambda name: str(tmp_path / name)
    spark.createDataFrame([("a", 1, {"x": 2.0}), ("a", 2, {"x": 0.0})], trials.TRIAL).coalesce(1).write.json(folder("in"))
    trials.watch(spark, folder("in"), folder("out"), folder("state"), lambda p: 1 / p["x"], once=True, log=folder("log")).awaitTermination()
    log = spark.read.schema(trials.LOG).json(folder("log")).collect()
    assert sorted((r.trial_id, r.event) for r in log) == [(1, "ok"), (1, "start"), (2, "fail"), (2, "start")]
    assert next(r for r in log if r.event == "fail").message.startswith("ZeroDivisionError")
    assert sorted((r.trial_id, r.status) for r in spark.read.schema(trials.RESULT).json(folder("out")).collect()) == [(1, "ok"), (2, "fail")]
