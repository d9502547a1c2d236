"""Canonical tables."""

PIXEL = "image_id long, x int, y int, c0 float, c1 float, c2 float, depth int, valid int, label int"
COLOR_DICT = "label int, r int, g int, b int"
SAMPLE = "tree_id int, sample_id long, image_id long, x int, y int, depth int, label int, flipped boolean"
FEATURE = "feature_id int, type string, o1x int, o1y int, r1x int, r1y int, o2x int, o2y int, r2x int, r2y int, ch1 int, ch2 int"
THRESHOLD = "feature_id int, threshold_id int, value float"
TREE_NODE = (
    "tree_id int, node_id long, level int, parent_id long, left_id long, right_id long, is_leaf boolean, n_samples long, histogram array<long>, "
    f"feature struct<{', '.join(f'{n}: {t}' for n, t in (c.split() for c in FEATURE.split(', ')))}>, threshold float, score double"
)
PREDICTION = "image_id long, x int, y int, label int, probs array<double>"
CONFUSION = "label int, prediction int, n long"
TRIAL = "exp_key string, trial_id long, params map<string,double>, losses array<double>, loss double"
