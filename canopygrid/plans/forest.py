"""Growing forests level by level, and labelling with them.

The training table has one row for each image: its integral planes and its samples, of all trees. A level is one pass over it: samples
walk the trees so far, which are small and broadcast, and those at open nodes are counted by (tree, node, feature, bucket, label), in
numpy within a batch and then by one grouped sum. Nothing but the trees is carried from level to level, so a lost executor only costs
its tasks, and no lineage grows. What shuffles is counts: bounded by open nodes, features, thresholds and labels, whatever the images.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid import schema
from canopygrid.config import TrainingConfig
from canopygrid.functions.arrays import normalized
from canopygrid.functions.hashing import digest, draw_of
from canopygrid.operators import grid
from canopygrid.operators.features import Features, Packs, feature_tables, ragged, responses, same_size
from canopygrid.operators.inference import Tree, forest_of, leaf_counts, predicted
from canopygrid.operators.sampling import class_uniform, image_subsample, pixel_uniform_accepted
from canopygrid.operators.splits import class_prior

INTEGRALS = ("ic0", "ic1", "ic2", "idepth", "ivalid")
#: Responses that are held at once, samples times features.
CELLS = 2_000_000
TIE = 1e-13
#: Samples are numbered on a ring of so many places, by a digest of their tree and pixel.
SIDS = 1 << 52


def shared_path(spark, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where that is unset one of our own will do, but only on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="canopygrid-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the table that ``shared_table`` wrote for ``df``."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def image_packs(pixels: DataFrame) -> DataFrame:
    """Packed planes, with ``label`` if the pixels have one, and their integrals."""
    extra = ["label"] if "label" in pixels.columns else []
    return grid.packed_integral(grid.packed(pixels, list(grid.PLANES), extra), list(grid.PLANES))


def sample_table(pixels: DataFrame, config: TrainingConfig, images: int, classes: int, ignored: list[int] = ()) -> DataFrame:
    """``tree_id``, ``sid`` (from 0 in each tree), ``image_id``, ``x``, ``y``, ``depth``, ``label``."""
    out = None
    for tree in range(config.trees):
        seed = config.random_seed + tree
        frame, count = pixels, images
        if config.max_images:
            chosen = image_subsample(pixels.select("image_id").distinct(), config.max_images, tree, seed).select("image_id")
            frame, count = pixels.join(chosen, "image_id", "left_semi"), min(images, config.max_images)
        if config.subsampling_type == "classUniform":
            drawn = class_uniform(frame, config.samples_per_tree, count, classes, list(ignored), seed)
        else:
            from pyspark.sql import Window

            fit = frame.where(~F.col("label").isin(*ignored)) if ignored else frame
            numbered = fit.select("image_id").distinct().withColumn("image", F.row_number().over(Window.orderBy("image_id")).cast("long") - 1)
            size = frame.agg(F.max("x"), F.max("y")).first()
            drawn = pixel_uniform_accepted(frame, numbered, count * config.samples_per_tree, size[0] + 1, size[1] + 1, list(ignored), seed, stay=True).drop("label", "draw_id").join(frame, ["image_id", "x", "y"])
        drawn = drawn.select(F.lit(tree).alias("tree_id"), "image_id", "x", "y", "depth", "label")
        out = drawn if out is None else out.unionByName(drawn)
    return out


def training_table(packs: DataFrame, samples: DataFrame) -> DataFrame:
    """One row for each image that has samples: integral planes and arrays ``stree``, ``sid``, ``sx``, ``sy``, ``sdepth``, ``slabel``. ``sid`` is a hash that all draws go by."""
    sid = F.conv(F.substring(digest("sample", F.col("tree_id"), F.col("image_id"), F.col("x"), F.col("y")), 1, 13), 16, 10).cast("long")
    lists = F.sort_array(F.collect_list(F.struct("tree_id", sid.alias("sid"), "x", "y", "depth", "label")))
    rows = samples.groupBy("image_id").agg(lists.alias("s"))
    one = lambda c, name: F.transform("s", lambda s: s[c]).alias(name)
    arrays = rows.select("image_id", one("tree_id", "stree"), one("sid", "sid"), one("x", "sx"), one("y", "sy"), one("depth", "sdepth"), one("label", "slabel"))
    return packs.select("image_id", "width", "height", *INTEGRALS).join(arrays, "image_id")


class _State:
    """What a level's tasks need: the trees so far, which nodes are open, and each tree's features and thresholds."""

    def __init__(self, trees: list[Tree], open_nodes: list[np.ndarray], features: list[Features], thresholds: list[np.ndarray] | None, classes: int, flip: str):
        self.trees, self.open, self.features, self.thresholds, self.classes, self.flip = trees, open_nodes, features, thresholds, classes, flip

    def samples(self, batch: pa.RecordBatch):
        """Per tree: the samples of a batch at open nodes."""
        packs = Packs.of(batch)
        image, (tree, sid, x, y, d, label) = ragged(batch, ["stree", "sid", "sx", "sy", "sdepth", "slabel"])
        for t, walker in enumerate(self.trees):
            s = np.flatnonzero(tree == t)
            if not len(s) or not len(self.open[t]):
                continue
            for flipped in {"none": (False,), "flip": (True,), "both": (False, True)}[self.flip]:
                mirror = np.full(len(s), flipped)
                node = walker.walk(packs, image[s], x[s], y[s], d[s], mirror)
                keep = np.isin(node, self.open[t])
                if keep.any():
                    k = s[keep]
                    yield t, packs, image[k], sid[k], x[k], y[k], d[k], label[k], mirror[keep], node[keep]


def _threshold_values(table: DataFrame, state: _State, picks: list[np.ndarray]) -> list[np.ndarray]:
    """For each tree and (feature, threshold), the unflipped response of the sample at an open node whose id follows the drawn number most closely.

    A grouped minimum, so any partitioning finds the same sample; what reaches the driver is features times thresholds.
    """
    shared = table.sparkSession.sparkContext.broadcast((state, picks))

    def run(batches):
        st, wanted = shared.value
        for whole in batches:
            for batch in same_size(whole):
                for t, packs, image, sid, x, y, d, _, mirror, _ in st.samples(batch):
                    if mirror[0] and st.flip == "both":
                        continue
                    order = np.argsort(sid)
                    at = np.searchsorted(sid[order], wanted[t])
                    who = order[at % len(order)]
                    gap = (sid[who] - wanted[t]) % SIDS
                    need = np.unique(who)
                    r = responses(packs, image[need], x[need], y[need], d[need], st.features[t])
                    value = r[np.searchsorted(need, who), np.arange(len(st.features[t]))[:, None]]
                    n = wanted[t].size
                    f, k = np.divmod(np.arange(n), wanted[t].shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(f.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(gap.ravel()), pa.array(value.ravel(), mask=np.isnan(value.ravel()))], names=["tree", "f", "k", "gap", "value"])

    near = table.mapInArrow(run, "tree int, f int, k int, gap long, value double").groupBy("tree", "f", "k").agg(F.min_by(F.struct("value"), F.struct("gap", "value")).alias("v"))
    out = [np.zeros(p.shape) for p in picks]
    for r in near.select("tree", "f", "k", "v.value").collect():
        out[r.tree][r.f, r.k] = r.value if r.value is not None else 0.0
    return [np.sort(o.astype(np.float32), 1) for o in out]


def _level_counts(table: DataFrame, state: _State) -> DataFrame:
    """``tree``, ``node``, ``f``, ``bucket``, ``label``, ``n``; with ``f`` -1, ``n`` is the node's number of samples, flipped or not."""
    shared = table.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        st = shared.value
        for whole in batches:
            for batch in same_size(whole):
                kept: dict[int, list[np.ndarray]] = {}
                for t, packs, image, sid, x, y, d, label, mirror, node in st.samples(batch):
                    kept.setdefault(t, []).append(np.column_stack([sid, node]))
                    f, edges = st.features[t], st.thresholds[t]
                    step = max(1, CELLS // max(1, len(f)))
                    for a in range(0, len(x), step):
                        c = slice(a, a + step)
                        r = responses(packs, image[c], x[c], y[c], d[c], f, mirror[c])
                        width = edges.shape[1] + 1
                        bucket = np.stack([np.searchsorted(edges[i], r[:, i], "left") for i in range(len(f))], 1)
                        key = ((node[c][:, None] * len(f) + np.arange(len(f))) * width + bucket) * st.classes + label[c][:, None]
                        key, n = np.unique(key, return_counts=True)
                        key, lab = np.divmod(key, st.classes)
                        key, b = np.divmod(key, width)
                        at, feat = np.divmod(key, len(f))
                        yield _counts(t, at, feat, b, lab, n)
                for t, parts in kept.items():
                    node, n = np.unique(np.unique(np.concatenate(parts), axis=0)[:, 1], return_counts=True)
                    none = np.zeros(len(node), np.int64)
                    yield _counts(t, node, none - 1, none, none, n)

    def _counts(t, node, f, b, label, n):
        small = lambda a: pa.array(np.asarray(a).astype(np.int32))
        return pa.RecordBatch.from_arrays([small(np.full(len(n), t)), pa.array(np.asarray(node, np.int64)), small(f), small(b), small(label), pa.array(np.asarray(n, np.int64))], names=["tree", "node", "f", "bucket", "label", "n"])

    return table.mapInArrow(run, "tree int, node long, f int, bucket int, label int, n long").groupBy("tree", "node", "f", "bucket", "label").agg(F.sum("n").alias("n"))


def score_counts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Normalised gain over the last axis, classes, of counts left and right."""
    x = lambda a: np.where(a > 0, a * np.log2(np.maximum(a, 1)), 0.0)
    n_l, n_r = left.sum(-1), right.sum(-1)
    n = n_l + n_r
    sides, labels = x(n_l) + x(n_r), x(left + right).sum(-1)
    gain = np.divide(x(left).sum(-1) + x(right).sum(-1) - labels - sides + x(n), n, out=np.zeros(n.shape), where=n > 0)
    spread = np.divide(2 * x(n) - sides - labels, n, out=np.zeros(n.shape), where=n > 0)
    real = (n_l > 0) & (n_r > 0) & (np.abs(gain) >= 1e-12)
    return np.clip(np.divide(2 * gain, spread, out=np.zeros(n.shape), where=real & (spread > 0)), 0, 1)


def _best_splits(counts: DataFrame, thresholds: int, classes: int) -> DataFrame:
    """The best threshold of each feature, then the best feature of each node, with both sides' histograms and the node's number of samples."""

    kind = pa.struct([("score", pa.float64()), ("k", pa.int32()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<score: double, k: int, left: array<long>, right: array<long>>")
    def best(f: pa.Array, cells: pa.Array) -> pa.Array:
        real = f.to_numpy(zero_copy_only=False) >= 0
        step, out = max(1, CELLS // ((thresholds + 1) * classes)), []
        for a in range(0, len(cells), step):
            part = cells.slice(a, step)
            flat = pa.Table.from_struct_array(part.flatten())
            bucket, label, n = (flat[c].to_numpy() for c in ("bucket", "label", "n"))
            row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False))
            grid_ = np.zeros((len(part), thresholds + 1, classes), np.int64)
            grid_[row, bucket, label] = n
            left = np.cumsum(grid_, 1)[:, :-1]
            right = grid_.sum(1)[:, None] - left
            score = np.round(score_counts(left, right), 12)
            k = np.argmax(score, 1)
            at = np.arange(len(part))
            lists = [pa.array(list(side[at, k]), pa.list_(pa.int64())) for side in (left, right)]
            out.append(pa.StructArray.from_arrays([pa.array(score[at, k]), pa.array(k.astype(np.int32)), *lists], fields=list(kind), mask=pa.array(~real[a : a + step])))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    rows = counts.groupBy("tree", "node", "f").agg(F.collect_list(F.struct("bucket", "label", "n")).alias("cells"), F.sum("n").alias("n"))
    scored = rows.select("tree", "node", "f", "n", best("f", "cells").alias("b"))
    key = F.when(F.col("f") >= 0, F.struct((-F.col("b.score")).alias("s"), F.col("b.k").alias("k"), F.col("f")))
    found = scored.groupBy("tree", "node").agg(F.min_by(F.struct("f", "b"), key).alias("x"), F.max(F.when(F.col("f") < 0, F.col("n"))).alias("n"))
    return found.select("tree", "node", "n", "x.f", "x.b.score", "x.b.k", "x.b.left", "x.b.right")


def renumbered(features: list) -> list[dict]:
    """Features in the order of ``features.in_order``, numbered anew: the number decides ties."""
    rows = sorted((r.asDict() for r in features), key=lambda r: (r["type"] != "depth", r["ch1"], r["ch2"], r["o1y"], r["o1x"], r["feature_id"]))
    return [r | {"feature_id": i} for i, r in enumerate(rows)]


def grow(table: DataFrame, config: TrainingConfig, classes: int) -> list[dict]:
    """All trees at once, a level at a time: rows of ``tree_node`` with ids from 0 in breadth-first order."""
    spark, flip = table.sparkSession, "both" if config.horizontal_flipping else "none"
    blank = {"parent_id": None, "left_id": None, "right_id": None, "is_leaf": True, "feature": None, "threshold": None, "score": None, "n_samples": 0}
    nodes: list[list[dict]] = [[{"tree_id": t, "node_id": 0, "level": 1, "histogram": [0] * classes} | blank] for t in range(config.trees)]
    open_ids = [[0] for _ in range(config.trees)]
    levels = range(1, config.max_depth)
    seeds = [config.random_seed + t * 1_000_003 + level for level in levels for t in range(config.trees)]
    drawn: dict[int, list] = {i: [] for i in range(len(seeds))}
    if seeds:
        for r in feature_tables(spark, config.feature_count, config.box_radius, config.region_size, seeds, config.use_depth_images).collect():
            drawn[r["table"]].append(r)
        drawn = {i: renumbered(rows) for i, rows in drawn.items()}
    for level in levels:
        if not any(open_ids):
            break
        for rows in nodes:
            for r in rows:
                r["norm_hist"] = r["histogram"]
        trees = [Tree.of(rows) for rows in nodes]
        features = [Features.of(drawn[(level - 1) * config.trees + t]) for t in range(config.trees)]
        picks = [np.array([[draw_of(0, 2**32 - 1, config.random_seed + t, level, f, k) * (SIDS >> 32) for k in range(config.thresholds)] for f in range(config.feature_count)], np.int64) for t in range(config.trees)]
        state = _State(trees, [np.array(o) for o in open_ids], features, None, classes, flip)
        state.thresholds = _threshold_values(table, state, picks)
        found = {(r.tree, r.node): r for r in _best_splits(_level_counts(table, state), config.thresholds, classes).collect()}
        for t, rows in enumerate(nodes):
            after = []
            for i in open_ids[t]:
                node, best = rows[i], found.get((t, i))
                if best is None:
                    continue
                if i == 0:
                    node["histogram"] = [a + b for a, b in zip(best.left, best.right)]
                node["n_samples"] = best.n
                small = i != 0 and (best.n < config.min_sample_count or sum(h > 0 for h in node["histogram"]) < 2)
                # A split without gain would leave a side empty or teach nothing.
                if small or best.score <= TIE:
                    continue
                node |= {"is_leaf": False, "left_id": len(rows), "right_id": len(rows) + 1, "feature": features[t].row(best.f), "threshold": float(state.thresholds[t][best.f, best.k]), "score": best.score}
                for hist in (best.left, best.right):
                    after.append(len(rows))
                    rows.append({"tree_id": t, "node_id": len(rows), "level": level + 1, "histogram": list(hist)} | blank | {"parent_id": i, "n_samples": sum(hist)})
            open_ids[t] = after
    for rows in nodes:
        for r in rows:
            r.pop("norm_hist", None)
    return [r for rows in nodes for r in rows]


class RandomForestLabeler:
    """Fit a forest on labelled pixels, label pixels with it."""

    def __init__(self, config: TrainingConfig, ignored: list[int] = ()):
        self.config, self.ignored = config, list(ignored)
        self.nodes: list[dict] = []
        self.priors: list[int] = []

    def fit(self, pixels: DataFrame, classes: int | None = None) -> RandomForestLabeler:
        """``pixels``: ``schema.PIXEL``; depths are filled first if the settings ask for it, and set to a metre if they aren't used."""
        # Decoding, filling and padding are done once: priors, samples and planes all read what is written here.
        pixels = shared_table(prepared(pixels, self.config), "prepared")
        images, top = pixels.agg(F.count_distinct("image_id"), F.max("label")).first()
        self.classes = classes or top + 1
        if not 2 <= self.classes <= 256:
            raise ValueError(f"{self.classes} classes; a label has 8 bits, and two are the least")
        domain = pixels.sparkSession.range(self.classes).select(F.col("id").cast("int").alias("label"))
        self.priors = [r.n for r in class_prior(pixels, domain).orderBy("label").collect()]
        samples = shared_table(sample_table(pixels, self.config, images, self.classes, self.ignored), "samples")
        if self.config.subsampling_type == "classUniform":
            self._check_samples(samples, min(images, self.config.max_images or images))
        table = shared_table(training_table(image_packs(pixels), samples), "training")
        self.nodes = grow(table, self.config, self.classes)
        for done in (pixels, samples, table):
            remove(done)
        return self

    def _check_samples(self, samples: DataFrame, images: int) -> None:
        """Every class that the images have must give as many samples as were asked for, or balanced sampling has failed."""
        k = -(-images * self.config.samples_per_tree // (self.classes - len(self.ignored)))
        counts = {(r.tree_id, r.label): r.n for r in samples.groupBy("tree_id", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
        wanted = [label for label, n in enumerate(self.priors) if n and label not in self.ignored]
        if few := {key: counts.get(key, 0) for key in ((t, label) for t in range(self.config.trees) for label in wanted) if counts.get(key, 0) < k}:
            raise ValueError(f"failed to sample enough pixels: {k} of each class are needed, (tree, label) have {few}")

    def improve(self, pixels: DataFrame) -> RandomForestLabeler:
        """Count all labelled pixels in the leaves that they reach, and put the counts where a leaf's histogram isn't zero."""
        by_tree = [sorted((n for n in self.nodes if n["tree_id"] == t), key=lambda n: n["node_id"]) for t in sorted({n["tree_id"] for n in self.nodes})]
        trees = [Tree.of(rows, "histogram") for rows in by_tree]
        found = {(r.tree, r.leaf, r.label): r.n for r in leaf_counts(image_packs(prepared(pixels, self.config)), trees).collect()}
        for t, rows in enumerate(by_tree):
            for i, node in enumerate(rows):
                if node["is_leaf"]:
                    node["histogram"] = [found.get((t, i, label), 0) if n else 0 for label, n in enumerate(node["histogram"])]
        return self

    def node_table(self, spark) -> DataFrame:
        names = [f.split(" ")[0] for f in ("tree_id", "node_id", "level", "parent_id", "left_id", "right_id", "is_leaf", "n_samples", "histogram", "feature", "threshold", "score")]
        return spark.createDataFrame([tuple(n[c] for c in names) for n in self.nodes], schema.TREE_NODE)

    def normalized_nodes(self, spark, bias: float = 0.0, use_prior: bool = True) -> list[dict]:
        """Nodes with ``norm_hist``; ignored labels get nothing."""
        prior = F.array(*[F.lit(p) for p in self.priors])
        rows = self.node_table(spark).withColumn("norm_hist", normalized(F.col("histogram"), prior, bias, use_prior)).collect()
        return [r.asDict() for r in rows]

    def predict(self, pixels: DataFrame, bias: float = 0.0, use_prior: bool = True, probabilities: bool = False) -> DataFrame:
        packs = image_packs(prepared(pixels, self.config))
        return predicted(packs, forest_of(self.normalized_nodes(pixels.sparkSession, bias, use_prior)), probabilities)


def prepared(pixels: DataFrame, config: TrainingConfig) -> DataFrame:
    """Pixels as training and prediction see them."""
    if not config.use_depth_images:
        return pixels.withColumns({"depth": F.lit(1000), "valid": F.lit(1)})
    return grid.depth_fill(pixels) if config.use_depth_filling else pixels
