"""Small inputs with known results."""

import gzip
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canopygrid.config import TrainingConfig, check_prediction
from canopygrid.functions import arrays, color, hashing, scoring, stats
from canopygrid.operators import features as feat
from canopygrid.operators import grid, inference, labels, metrics, sampling, splits
from canopygrid.operators.features import Features, Packs, responses
from canopygrid.plans import forest
from canopygrid.sources import images, model_json, png


def plane(spark, rows, **more):
    cells = [(0, x, y, v) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return spark.createDataFrame(cells, "image_id long, x int, y int, c0 long")


def grid_of(df, column, w, h):
    cells = {(r.x, r.y): r[column] for r in df.collect()}
    return [[cells[x, y] for x in range(w)] for y in range(h)]


def test_prefix_sum(spark):
    done = grid.integral(plane(spark, [[5, 2, 3], [1, 5, 4], [2, 2, 1]]), ["c0"])
    assert grid_of(done, "ic0", 3, 3) == [[5, 7, 10], [6, 13, 20], [8, 17, 25]]
    assert grid_of(grid.derivative(done, ["c0"]), "dc0", 3, 3) == [[5, 2, 3], [1, 5, 4], [2, 2, 1]]


def test_depth_integral(spark):
    depth = {(0, 0): 5, (0, 1): 10, (1, 0): 35, (2, 1): 10}
    rows = [(0, x, y, depth.get((x, y), 0), int((x, y) in depth)) for y in range(2) for x in range(3)]
    done = grid.integral(spark.createDataFrame(rows, "image_id long, x int, y int, depth long, valid int"), ["depth", "valid"])
    assert grid_of(done, "idepth", 3, 2) == [[5, 40, 40], [15, 50, 60]]
    assert grid_of(done, "ivalid", 3, 2) == [[1, 2, 2], [2, 3, 4]]


def test_depth_fill(spark):
    seeds = {(20, 30): 1500, (30, 20): 2500}
    rows = [(0, x, y, seeds.get((x, y), 0)) for y in range(100) for x in range(200)]
    got = grid.depth_fill(spark.createDataFrame(rows, "image_id long, x int, y int, depth int")).collect()
    assert all(r.valid == 1 and r.depth == (2500 if r.y < 30 else 1500) for r in got)


def test_region_sum_of_constant():
    p = Packs(np.cumsum(np.cumsum(np.full((1, 3, 480, 640), 255.0), 2), 3), np.zeros((1, 480, 640), np.int64), np.zeros((1, 480, 640), np.int64))
    one = lambda v: np.array([v])
    assert p.box_color(one(0), one(320), one(240), one(10), one(8), one(0))[0] == 20 * 16 * 255


@pytest.mark.parametrize("text,good", [("0,0000,00", True), ("255,0255,255", True), ("129,64,81", True), ("-1,0,0", False), ("256,0,0", False), ("0,0,256", False), ("a,0,0", False), ("", False), (",,", False)])
def test_colors(spark, text, good):
    assert (spark.createDataFrame([(text,)], "t string").select(labels.parsed_color(F.col("t"))).first()[0] is not None) == good


@pytest.mark.parametrize("left,right,score,gain", [([9, 9], [9, 9], 0, 0), ([0, 18], [18, 0], 1, 1), ([5, 8], [3, 1], 0.080185, None), ([2, 8], [6, 1], 0.33339, None), ([56, 241, 290, 3, 18], [30, 0, 1, 0, 249], 0.491311, 0.690912), ([50, 100, 0, 0, 0], [0, 0, 50, 0, 100], 0.68533, 1.0)])
def test_split_scores(spark, left, right, score, gain):
    rows = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(zip(left, right))], "k int, label int, n_left long, n_right long")
    got = scoring.gains(rows, ["k"]).first()
    assert got.score == pytest.approx(score, abs=1e-5) and (gain is None or got.gain == pytest.approx(gain, abs=1e-5))
    assert forest.score_counts(np.array([left]), np.array([right]))[0] == pytest.approx(got.score, abs=1e-9)


def test_color_features():
    base = np.array([[[100 * c + 12 * y + x for x in range(12)] for y in range(15)] for c in range(3)], float)
    both = np.stack([base, base / 2])
    p = Packs(np.cumsum(np.cumsum(both, 2), 3), np.ones((2, 15, 12), np.int64), np.ones((2, 15, 12), np.int64))
    rows = [(2, -1, 2, 1, -3, 4, 1, 2, 0, 2), (2, -1, 2, 2, -3, 4, 1, 1, 1, 2), (-2, 1, 3, 1, 3, -4, 3, 3, 1, 0)]
    names = ["o1x", "o1y", "r1x", "r1y", "o2x", "o2y", "r2x", "r2y", "ch1", "ch2"]
    f = Features(np.arange(3), np.ones(3, bool), {n: np.array([r[i] for r in rows]) for i, n in enumerate(names)})
    image, x, y, depth, label = np.array([0, 1, 0, 1]), np.array([6, 6, 5, 3]), np.array([4, 4, 5, 4]), np.array([1000, 2000, 1500, 3100]), np.array([0, 0, 1, 1])
    got = responses(p, image, x, y, depth, f)
    expected = np.array([[-2040, 1186, np.nan], [-444, -244, 244], [-884, -484, 572], [-424, -224, 224]])
    np.testing.assert_array_equal(got, expected)
    thresholds = [(0, -500), (-300, 0), (0, 500)]
    counters = [[(2, 0, 2, 0), (1, 1, 1, 1)], [(0, 2, 1, 1), (1, 1, 2, 0)], [(0, 2, 0, 2), (1, 1, 1, 1)]]
    for k in range(3):
        for t in range(2):
            left = got[:, k] <= thresholds[k][t]
            assert tuple(int((left == side)[label == c].sum()) for c in (0, 1) for side in (True, False)) == counters[k][t]


def _one(kind, values):
    names = ["o1x", "o1y", "r1x", "r1y", "o2x", "o2y", "r2x", "r2y", "ch1", "ch2"]
    return Features(np.arange(1), np.array([kind == "color"]), {n: np.array([v]) for n, v in zip(names, values)})


@pytest.mark.parametrize("cells,expected", [({}, 0.0), ({(7, 2): 0.5}, 0.5), (None, 24.0)])
def test_simple_color(cells, expected):
    image = np.ones((20, 16)) if cells is None else np.zeros((20, 16))
    for (x, y), v in (cells or {}).items():
        image[y, x] = v
    p = Packs(np.cumsum(np.cumsum(np.stack([[image] * 3]), 2), 3), np.ones((1, 20, 16), np.int64), np.ones((1, 20, 16), np.int64))
    one = lambda v: np.array([v])
    assert responses(p, one(0), one(6), one(4), one(1000), _one("color", (3, -2, 4, 2, -3, -2, 1, 2, 0, 0)))[0, 0] == expected


@pytest.mark.parametrize("cells,expected", [({}, None), ({(7, 3): 1500, (7, 4): 1700, (8, 4): 4500, (3, 2): 3900}, (1.5 + 1.7 + 4.5) / 3 - 3.9), (None, 0.0)])
def test_simple_depth(cells, expected):
    depth = np.full((20, 16), 1000) if cells is None else np.zeros((20, 16), np.int64)
    for (x, y), v in (cells or {}).items():
        depth[y, x] = v
    total = lambda a: np.cumsum(np.cumsum(a[None], 1), 2)
    p = Packs(np.zeros((1, 3, 20, 16)), total(depth), total((depth > 0).astype(np.int64)))
    one = lambda v: np.array([v])
    got = responses(p, one(0), one(6), one(3), one(1000), _one("depth", (1, 1, 2, 2, -3, -1, 1, 1, 0, 0)))[0, 0]
    assert math.isnan(got) if expected is None else got == pytest.approx(expected)
    if expected:
        assert [i for i in range(100) if got <= (i - 50) / 10][0] == 37
    assert math.isnan(responses(p, one(0), one(6), one(3), one(0), _one("depth", (1, 1, 2, 2, -3, -1, 1, 1, 0, 0)))[0, 0])


@pytest.mark.parametrize("h,prior,bias,expected", [((850, 50, 100), (100, 100, 100), 0.0, (0.85 / 3, 0.05 / 3, 0.1 / 3)), ((50, 50, 50), (80, 10, 10), 0.0, (0.8 / 3, 0.1 / 3, 0.1 / 3)), ((50, 50, 50), (80, 10, 10), 0.5, (0, 0, 0)), ((60, 20, 20), (50, 25, 25), 0.5, (0.5, 0, 0)), ((20, 40, 40), (20, 10, 10), 0.2, (0, 0.125, 0.125))])
def test_leaf_normalisation(spark, h, prior, bias, expected):
    row = spark.createDataFrame([(list(h), list(prior))], "h array<long>, p array<long>")
    assert row.select(arrays.normalized(F.col("h"), F.col("p"), bias)).first()[0] == pytest.approx(list(expected))


def test_reservoir(spark):
    rows = spark.range(100_000).withColumn("g", F.lit(0))
    got = [r.id for r in sampling.reservoir(rows, 1000, ["id"], ["g"]).collect()]
    assert len(set(got)) == 1000 and min(got) < 1000 and max(got) > 99_000
    assert np.mean(got) == pytest.approx(50_000, rel=0.05) and np.std(got) == pytest.approx(28_800, rel=0.05)
    assert sorted(got) == sorted(r.id for r in sampling.reservoir(rows.repartition(7), 1000, ["id"], ["g"]).collect())
    with pytest.raises(ValueError):
        sampling.reservoir(rows, 0, ["id"], ["g"])


def test_losses(spark):
    rows = [(0, 0, 100), (1, 1, 50), (1, 2, 50), (2, 1, 25), (2, 2, 75)]
    counts = spark.createDataFrame(rows, "label int, prediction int, n long")
    assert 1 - metrics.class_accuracy(counts).first()[0] == pytest.approx(1 - (1 + 0.5 + 0.75) / 3)
    assert 1 - metrics.class_accuracy(counts, [0], False).first()[0] == pytest.approx(1 - (0.5 + 0.75) / 2)
    assert "0.500" in metrics.report(counts)
    none = spark.createDataFrame([(0, 0)], "label int, prediction int")
    assert metrics.pixel_accuracy(none, [0], False).first()[0] is None


BEST = [1 - a for a in (0.681, 0.686, 0.683, 0.679)]


@pytest.mark.parametrize("run,going", [([0.6293, 0.6212, 0.6210], False), ([0.20, 0.60, 0.65], True), ([0.20, 0.60, 0.65] + [0.55] * 20, False), ([0.20, 0.21, 0.215, 0.912], True), ([0.20, 0.21], True), ([0.659, 0.674, 0.672], True), ([0.659, 0.674, 0.672, 0.678], True), ([0.659, 0.674, 0.672, 0.678, 0.671], True), ([0.659, 0.674, 0.672, 0.678, 0.671, 0.673], False)])
def test_stop_rule(spark, run, going):
    losses = [1 - a for a in run]
    assert stats.continue_searching(BEST, losses) == going
    rows = spark.createDataFrame([("b", v) for v in BEST] + [("r", v) for v in losses], "g string, loss double")
    assert {r.g: r.keep_going for r in stats.keep_going(rows, "g", "b").collect()}["r"] == going


def test_stop_rule_swapped_and_empty():
    assert stats.continue_searching([1 - a for a in (0.6293, 0.6212, 0.6210)], BEST) and stats.continue_searching([], [0.5])
    assert stats.t_tail(0, 5) == pytest.approx(0.5) and stats.t_tail(2.570581836, 5) == pytest.approx(0.025, abs=1e-8)


def test_feature_distribution(spark):
    rows = feat.feature_table(spark, 4000, 127, 16, 3).toPandas()
    assert (rows.type == "color").mean() == 0.5 and set(rows.ch1) <= {0, 1, 2}
    for c in ("o1x", "o1y", "o2x", "o2y"):
        assert rows[c].min() >= -127 and rows[c].max() <= 127 and abs(rows[c].mean()) < 5 and rows[c].std() == pytest.approx(73.6, abs=3)
    for c in ("r1x", "r1y", "r2x", "r2y"):
        assert rows[c].min() == 1 and rows[c].max() == 16 and rows[c].mean() == pytest.approx(8.5, abs=0.3)
    assert not ((rows.o1x == rows.o2x) & (rows.o1y == rows.o2y)).any()
    assert rows.equals(feat.feature_table(spark, 4000, 127, 16, 3).toPandas())
    tight = feat.feature_table(spark, 200, 1, 1, 3, use_depth=False, stratified=False).toPandas()
    assert (tight.type == "color").all() and not ((tight.o1x == tight.o2x) & (tight.o1y == tight.o2y)).any()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([(np.uint8, 3), (np.uint8, 1), (np.uint16, 1)]), st.integers(0, 2**31))
def test_png_round_trip(w, h, kind, seed):
    dtype, n = kind
    image = np.random.default_rng(seed).integers(0, np.iinfo(dtype).max, (h, w, n) if n > 1 else (h, w)).astype(dtype)
    np.testing.assert_array_equal(png.decode(png.encode(image)), image)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    rows, step = rng.integers(0, 256, (4, 12)).astype(np.uint8), 3
    above = np.zeros(12, np.uint8)
    for row in rows:
        left, corner = np.r_[np.zeros(step, np.uint8), row[:-step]], np.r_[np.zeros(step, np.uint8), above[:-step]]
        a, b, c = (v.astype(int) for v in (left, above, corner))
        p = a + b - c
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = [np.zeros(12, int), a, b, (a + b) // 2, paeth][kind]
        filtered = ((row.astype(int) - guess) & 255).astype(np.uint8)
        np.testing.assert_array_equal(png._unfiltered(kind, filtered, above, step), row)
        above = row


def test_image_checks():
    with pytest.raises(ValueError):
        images.checked_color(np.zeros((2, 2), np.uint8), "a")
    for bad in (np.full((2, 2), 60_000, np.uint16), np.full((2, 2), 20_000, np.uint16), np.zeros((3, 2), np.uint16)):
        with pytest.raises(ValueError):
            images.checked_depth(bad, (2, 2), "a")


def test_folder_of_images(spark, tmp_path):
    """Colours, depths and truths of two sizes: decoded, encoded by first sight, padded."""
    rng = np.random.default_rng(1)
    for name, h, w in (("a", 4, 5), ("b", 3, 4)):
        (tmp_path / f"{name}_colors.png").write_bytes(png.encode(rng.integers(0, 256, (h, w, 3)).astype(np.uint8)))
        (tmp_path / f"{name}_depth.png").write_bytes(png.encode(np.full((h, w), 1234, np.uint16)))
        truth = np.zeros((h, w, 3), np.uint8)
        truth[:, 1:] = (10, 20, 30)
        (tmp_path / f"{name}_ground_truth.png").write_bytes(png.encode(truth))
    (tmp_path / "other.txt").write_text("no image")
    assert [r.path.rsplit("/", 1)[1] for r in images.list_images(spark, str(tmp_path)).collect()] == ["a_colors.png", "b_colors.png"]
    pixels, colors = images.load_images(spark, str(tmp_path))
    assert pixels.count() == 40 and {(r.label, r.r) for r in colors.collect()} == {(0, 0), (1, 10)}
    assert pixels.where("depth = 1234").count() == 32 and pixels.where("label = 1").count() == 4 * 4 + 3 * 3
    flat = images.read_images(spark, str(tmp_path), use_depth=False, truth=False)
    assert {r.depth for r in flat.select("depth").distinct().collect()} == {1000}


def test_dictionary_conflicts(spark):
    one = spark.createDataFrame([(0, 1, 1, 1)], "label int, r int, g int, b int")
    assert labels.merged_dictionary(one, one).count() == 1
    for other in ((1, 1, 1, 1), (0, 2, 2, 2)):
        with pytest.raises(Exception, match="conflict"):
            labels.merged_dictionary(one, spark.createDataFrame([other], one.schema)).collect()
    with pytest.raises(Exception, match="unknown label"):
        labels.decoded(spark.createDataFrame([(7,)], "label int"), one).collect()


def test_settings():
    a = TrainingConfig(trees=2, random_seed=1)
    assert a.equals(a.with_(random_seed=2), strict=False) and not a.equals(a.with_(random_seed=2)) and not a.equals(a.with_(trees=3), strict=False)
    assert TrainingConfig.from_dict(a.to_dict()) == a and "trees: 2" in str(a)
    for bad in ({"ignored_colors": ("",)}, {"max_images": 2, "image_cache_size": 5}, {"subsampling_type": "x"}, {"trees": 200}, {"max_depth": 0}):
        with pytest.raises(ValueError):
            TrainingConfig(**bad)
    for bad in ((1.0,), (-0.1,), (0.1, True, None)):
        with pytest.raises(ValueError):
            check_prediction(*bad)


def test_draws(spark):
    got = [r.v for r in spark.range(50).select(hashing.draw(-3, 9, 5, F.col("id")).alias("v")).collect()]
    assert got == [hashing.draw_of(-3, 9, 5, i) for i in range(50)] and min(got) >= -3 and max(got) <= 9
    source = hashing.RandomSource(1)
    assert source.sampler(0, 99).next() != source.sampler(0, 99).next()
    with pytest.raises(ValueError):
        hashing.Sampler(1, 3, 2)


def _pixels(spark, n=12, size=12, seed=0):
    """Images whose label is the brighter side of a pixel, so that a forest can learn it."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        c = rng.normal(100, 20, (3, size, size)) + np.where(np.arange(size) < size // 2, 0, 80)[None, None, :]
        for y in range(size):
            for x in range(size):
                rows.append((i, x, y, *(float(v) for v in c[:, y, x]), 1000, 1, int(x >= size // 2)))
    return spark.createDataFrame(rows, "image_id long, x int, y int, c0 float, c1 float, c2 float, depth int, valid int, label int")


CONFIG = TrainingConfig(trees=3, samples_per_image=60, feature_count=60, thresholds=8, max_depth=6, box_radius=4, region_size=2, min_sample_count=4)


def test_forest_learns(spark):
    train, test = _pixels(spark), _pixels(spark, 4, seed=9)
    model = forest.RandomForestLabeler(CONFIG).fit(train)
    found = model.predict(test, probabilities=True).join(test, ["image_id", "x", "y"])
    assert found.where("label = prediction").count() / found.count() > 0.8
    assert found.select(F.max(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1))).first()[0] < 1e-9
    assert inference.structure_errors(model.node_table(spark)).isEmpty()
    again = forest.RandomForestLabeler(CONFIG).fit(train.repartition(5))
    assert again.nodes == model.nodes


def test_growth_counts_are_those_of_brute_force(spark):
    """Each node's histogram is that of the samples that reach it."""
    config = CONFIG.with_(trees=1, horizontal_flipping=True, max_depth=4)
    pixels = _pixels(spark, 5)
    model = forest.RandomForestLabeler(config).fit(pixels)
    samples = forest.sample_table(pixels, config, 5, 2).collect()
    planes = {i: np.zeros((3, 12, 12)) for i in range(5)}
    for r in pixels.collect():
        planes[r.image_id][:, r.y, r.x] = r.c0, r.c1, r.c2
    one = np.ones((1, 12, 12), np.int64)
    total = lambda a: np.cumsum(np.cumsum(a, -2), -1)
    packs = {i: Packs(total(v)[None], total(one * 1000), total(one)) for i, v in planes.items()}
    by_id, counts, reached = {n["node_id"]: n for n in model.nodes}, {}, {}
    for s in samples:
        for flip in (False, True):
            at = by_id[0]
            while True:
                counts.setdefault(at["node_id"], [0, 0])[s.label] += 1
                reached.setdefault(at["node_id"], set()).add((s.image_id, s.x, s.y))
                if at["is_leaf"]:
                    break
                f = Features.of([at["feature"]])
                r = responses(packs[s.image_id], np.array([0]), np.array([s.x]), np.array([s.y]), np.array([s.depth]), f, np.array([flip]))[0, 0]
                at = by_id[at["left_id"] if r <= at["threshold"] else at["right_id"]]
    for node, n in by_id.items():
        assert n["histogram"] == counts[node]
        if not n["is_leaf"]:
            assert n["n_samples"] == len(reached[node])


def test_pixel_uniform_and_colour_only(spark):
    config = CONFIG.with_(subsampling_type="pixelUniform", use_depth_images=False, max_images=6, trees=2)
    model = forest.RandomForestLabeler(config).fit(_pixels(spark))
    assert all(n["feature"]["type"] == "color" for n in model.nodes if n["feature"]) and {n["tree_id"] for n in model.nodes} == {0, 1}


def test_model_files(spark, tmp_path):
    model = forest.RandomForestLabeler(CONFIG.with_(trees=2)).fit(_pixels(spark, 4))
    model_json.write_forest(spark, str(tmp_path / "m"), model.nodes, model.config, model.priors, {0: "0,0,0", 1: "9,9,9"}, "2024-01-01")
    nodes, config, priors, colors = model_json.read_forest(spark, str(tmp_path / "m"))
    assert config == model.config and priors == model.priors and colors == {0: "0,0,0", 1: "9,9,9"}
    assert [{k: v for k, v in n.items() if k != "feature"} for n in nodes] == [{k: v for k, v in n.items() if k != "feature"} for n in model.nodes]
    leaf = {"id": 0, "level": 1, "samples": 9, "leaf": True, "histogram": {"0,0,0 (0)": 3}}
    with pytest.raises(ValueError, match="fewer"):
        model_json.flat_nodes(leaf, 0, 2)
    with pytest.raises(ValueError, match="twice"):
        model_json.flat_nodes(leaf | {"histogram": {"0,0,0 (0)": 3, "1,0,0 (0)": 9}}, 0, 2)
    with pytest.raises(ValueError):
        model_json.feature_of({"feature": {"type": "sound"}})
    with pytest.raises(ValueError):
        model_json.pair([1, 2, 3])
    assert model_json.config_of({}).subsampling_type == "pixelUniform"


def test_no_process_holds_a_tree(spark, tmp_path, monkeypatch):
    """A tree deeper than Python may recurse, and one with all node ids at its end, in pieces of a few characters, whatever order keys have."""
    deep, wide = 1500, 7
    feature = {"feature_id": 1, "type": "depth", **{c: k for k, c in enumerate(("o1x", "o1y", "r1x", "r1y", "o2x", "o2y", "r2x", "r2y"))}, "ch1": 0, "ch2": 0}
    node = lambda t, i, level, up, left: {"tree_id": t, "node_id": i, "level": level, "parent_id": up, "left_id": left, "right_id": left and left + 1, "is_leaf": left is None, "n_samples": i, "histogram": [i, 1], "feature": left and feature, "threshold": left and i / 3, "score": left and 1e-7}
    chain = [node(0, i, (i + 1) // 2 + 1, (i - 1) // 2 * 2 if i else None, i + 1 if i % 2 == 0 and i < 2 * deep else None) for i in range(2 * deep + 1)]
    heap = [node(1, i, (i + 1).bit_length(), (i - 1) // 2 if i else None, 2 * i + 1 if i < wide // 2 else None) for i in range(wide)]
    table = spark.createDataFrame([tuple(n.values()) for n in chain + heap], model_json.NODE).repartition(3)
    monkeypatch.setattr(type(table), "collect", lambda self, f=type(table).collect: f(self) if "node_id" not in self.columns else pytest.fail("nodes on the driver"))
    model_json.write_forest(spark, str(tmp_path / "m"), table, CONFIG.with_(trees=2), [3, 4], {0: "0,0,0", 1: "9,9,9"})
    monkeypatch.setattr(model_json, "PIECE", 5)
    nodes, config, priors, colors = model_json.read_nodes(spark, str(tmp_path / "m"))
    assert (config.trees, priors, colors) == (2, [3, 4], {0: "0,0,0", 1: "9,9,9"})
    assert nodes.count() == len(chain + heap) and nodes.exceptAll(table).isEmpty()
    # The file is one JSON text, and means the same with its keys in any order, the classes after the tree.
    text = gzip.decompress(next((tmp_path / "m" / "tree1.json").glob("part-*.gz")).read_bytes())
    turned = lambda x: {k: turned(v) for k, v in reversed(x.items())} if isinstance(x, dict) else x
    for data in (text, json.dumps(turned(json.loads(text)), indent=2).encode("utf-8-sig")):
        rows = list(model_json.file_rows(data, 1))
        assert sorted(rows[:-1], key=lambda r: r["node_id"]) == heap and rows[-1]["colors"] == colors
    with pytest.raises(ValueError, match="lack children"):
        model_json.write_forest(spark, str(tmp_path / "n"), table.where("node_id <> 5"), CONFIG, [3, 4], {})
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "tree0.json").write_bytes(text[:-40])
    with pytest.raises(ValueError, match="tree0"):
        model_json.read_nodes(spark, str(tmp_path / "cut"))


def test_lab_points(spark):
    row = spark.createDataFrame([(255.0, 255.0, 255.0), (0.0, 0.0, 0.0), (255.0, 0.0, 0.0)], "r double, g double, b double")
    got = [list(r) for r in row.select(*color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert got[0] == pytest.approx([100, 0, 0], abs=0.02) and got[1] == pytest.approx([0, 0, 0], abs=0.02) and got[2] == pytest.approx([53.24, 80.09, 67.20], abs=0.05)


def test_missing_goes_right(spark):
    rows = spark.createDataFrame([(1.0,), (3.0,), (None,)], "r double")
    assert [r[0] for r in rows.select(feat.routed_left(F.col("r"), F.lit(2.0))).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(splits.bucket(F.col("r"), [0.0, 2.0])).collect()] == [1, 2, 2]


def test_command_line(spark, tmp_path):
    from canopygrid.__main__ import main

    rng = np.random.default_rng(2)
    for name in "abcdef":
        color_, truth = rng.integers(0, 90, (10, 10, 3)).astype(np.uint8), np.zeros((10, 10, 3), np.uint8)
        color_[:, 5:] += 120
        truth[:, 5:] = (1, 2, 3)
        (tmp_path / f"{name}_colors.png").write_bytes(png.encode(color_))
        (tmp_path / f"{name}_depth.png").write_bytes(png.encode(np.full((10, 10), 1000, np.uint16)))
        (tmp_path / f"{name}_ground_truth.png").write_bytes(png.encode(truth))
    sizes = {"trees": 2, "samplesPerImage": 40, "featureCount": 30, "minSampleCount": 4, "maxDepth": 4, "boxRadius": 3, "regionSize": 2, "numThresholds": 5}
    out = main(["train", "--folderTraining", str(tmp_path), "--outputFolder", str(tmp_path / "m"), *[x for k, v in sizes.items() for x in (f"--{k}", str(v))]])
    assert len(out["trees"]) == 2
    got = main(["predict", "--folderTesting", str(tmp_path), "--treeFolder", str(tmp_path / "m"), "--folderPrediction", str(tmp_path / "p")])
    assert got["losses"]["pixelAccuracy"] < 0.3 and len(list((tmp_path / "p").iterdir())) == 24
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if "a_colors" not in x.name)[:4] == ["0.png", "0_depth.png", "0_ground_truth.png", "0_prediction.png"]


def _scenes(folder, mirrored: bool, extra=None):
    """Two-coloured scenes; mirrored ones meet the other class first."""
    rng = np.random.default_rng(2)
    folder.mkdir()
    for name in "abcd":
        color_, truth = rng.integers(0, 90, (10, 10, 3)).astype(np.uint8), np.full((10, 10, 3), (9, 8, 7), np.uint8)
        color_[:, 5:, 0] += 150
        truth[:, 5:] = (1, 2, 3)
        if mirrored:
            color_, truth = color_[:, ::-1].copy(), truth[:, ::-1].copy()
        if extra and name == "c":
            truth[4, 6] = extra
        (folder / f"{name}_colors.png").write_bytes(png.encode(color_))
        (folder / f"{name}_depth.png").write_bytes(png.encode(np.full((10, 10), 1000, np.uint16)))
        (folder / f"{name}_ground_truth.png").write_bytes(png.encode(truth))
    return str(folder)


def test_labels_are_those_of_training_whatever_comes_first(spark, tmp_path):
    """Scenes in which the other class comes first: the labels, and with them losses and colours, are those of the training folder."""
    from canopygrid.__main__ import main

    train, mirrored, strange = _scenes(tmp_path / "t", False), _scenes(tmp_path / "m", True), _scenes(tmp_path / "x", False, (200, 0, 0))
    side = lambda df: {(r.left, r.label) for r in df.select((F.col("x") < 5).alias("left"), "label").distinct().collect()}
    pixels, colors = images.load_images(spark, train)
    assert side(pixels) == {(True, 1), (False, 2)} and side(images.load_images(spark, mirrored, colors=colors)[0]) == {(True, 2), (False, 1)}
    sizes = {"trees": 1, "samplesPerImage": 40, "featureCount": 20, "minSampleCount": 4, "maxDepth": 3, "boxRadius": 2, "regionSize": 2, "numThresholds": 5}
    forest_folder, out = str(tmp_path / "forest"), tmp_path / "out"
    main(["train", "--folderTraining", train, "--outputFolder", forest_folder, *[x for k, v in sizes.items() for x in (f"--{k}", str(v))]])
    assert model_json.read_forest(spark, forest_folder)[3] == {0: "0,0,0", 1: "9,8,7", 2: "1,2,3"}
    got = main(["predict", "--folderTesting", mirrored, "--treeFolder", forest_folder, "--folderPrediction", str(out), "--writeProbabilityImages"])
    truth, said, color_ = (png.decode((out / f"0{kind}.png").read_bytes()) for kind in ("_ground_truth", "_prediction", ""))
    assert (truth == png.decode((tmp_path / "m" / "a_ground_truth.png").read_bytes())).all() and (color_ == png.decode((tmp_path / "m" / "a_colors.png").read_bytes())).all()
    assert {tuple(c) for c in said.reshape(-1, 3)} <= {(9, 8, 7), (1, 2, 3)} and (out / "0_depth.png").exists() and (out / "0_label_1.png").exists()
    wrong = [(png.decode((out / f"{k}_ground_truth.png").read_bytes()) != png.decode((out / f"{k}_prediction.png").read_bytes())).any(2).mean() for k in range(4)]
    assert got["losses"]["pixelAccuracy"] == pytest.approx(sum(wrong) / 4)
    with pytest.raises(Exception, match=r"unknown colour 200,0,0 stem=\S*c x=6 y=4"):
        main(["predict", "--folderTesting", strange, "--treeFolder", forest_folder])


def test_too_few_pixels_of_a_class_fail(spark):
    rows = [(0, x, y, float(x), 0.0, 0.0, 1000, 1, int(x == 0 and y == 0)) for x in range(10) for y in range(10)]
    pixels = spark.createDataFrame(rows, "image_id long, x int, y int, c0 float, c1 float, c2 float, depth int, valid int, label int")
    with pytest.raises(ValueError, match="enough pixels"):
        forest.RandomForestLabeler(TrainingConfig(trees=1, samples_per_image=40)).fit(pixels, 2)


def test_improved_leaves_hold_all_pixels(spark):
    rows = [(i, x, y, float(x), float(y), 0.0, 1000, 1, int(x > 4)) for i in range(3) for x in range(10) for y in range(10)]
    pixels = spark.createDataFrame(rows, "image_id long, x int, y int, c0 float, c1 float, c2 float, depth int, valid int, label int")
    model = forest.RandomForestLabeler(TrainingConfig(trees=2, samples_per_image=20, feature_count=30, max_depth=3, box_radius=2, region_size=2, min_sample_count=2)).fit(pixels, 2)
    before = [list(n["histogram"]) for n in model.nodes if n["is_leaf"]]
    after = [n["histogram"] for n in model.improve(pixels).nodes if n["is_leaf"]]
    assert all((b == 0) <= (a == 0) for x, y in zip(before, after) for b, a in zip(x, y)) and 300 < sum(map(sum, after)) <= 600


@pytest.mark.parametrize("stay", [False, True])
def test_every_draw_meets_a_pixel(spark, stay):
    """One label in fifty is wanted: no draw is lost, and with ``stay`` each is in the image that it drew first."""
    from canopygrid.functions.hashing import draw_of
    from canopygrid.operators.sampling import pixel_uniform_accepted

    rows = [(i, x, y, 0 if (x, y) == (3, 4) else 1) for i in range(2) for x in range(10) for y in range(5)]
    pixels = spark.createDataFrame(rows, "image_id int, x int, y int, label int")
    images = spark.createDataFrame([(0, 0), (1, 1)], "image long, image_id int")
    got = pixel_uniform_accepted(pixels, images, 40, 10, 5, [1], **({"stay": True} if stay else {})).collect()
    assert sorted(r.draw_id for r in got) == list(range(40)) and {(r.x, r.y, r.label) for r in got} == {(3, 4, 0)}
    assert not stay or all(r.image_id == draw_of(0, 1, 4711, "image", r.draw_id, 0) for r in got)
