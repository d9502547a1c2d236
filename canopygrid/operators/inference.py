"""Trees as tables, and their application.

Small trees over columns compile to one nested CASE that Catalyst generates code for; any tree over packed images walks as numpy
arrays, a batch of images at a time, with the forest broadcast: its size is bounded by trees times nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.operators.features import NUMBERS, Features, Packs, ragged, responses, same_size


def tree_expression(nodes: list[dict], column, value: str = "node_id") -> Column:
    """The leaf that a row reaches: ``nodes`` have ``node_id``, ``left_id``, ``right_id``, ``threshold``, ``feature``; ``column(feature)`` is its response. Missing goes right."""
    by_id = {n["node_id"]: n for n in nodes}

    def walk(n: dict) -> Column:
        if n.get("left_id") is None:
            return F.lit(n[value])
        return F.when(column(n["feature"]) <= n["threshold"], walk(by_id[n["left_id"]])).otherwise(walk(by_id[n["right_id"]]))

    return walk(min(nodes, key=lambda n: n["node_id"]))


def paths(nodes: DataFrame) -> DataFrame:
    """``tree_id``, ``node_id``, ``depth``, ``path``: from the root to every node."""
    nodes.createOrReplaceTempView("canopygrid_nodes")
    return nodes.sparkSession.sql("""
        WITH RECURSIVE walk(tree_id, node_id, left_id, right_id, depth, path) AS (
          SELECT tree_id, node_id, left_id, right_id, 0, CAST(node_id AS STRING) FROM canopygrid_nodes WHERE parent_id IS NULL
          UNION ALL
          SELECT n.tree_id, n.node_id, n.left_id, n.right_id, w.depth + 1, concat(w.path, '/', CAST(n.node_id AS STRING))
          FROM walk w JOIN canopygrid_nodes n ON n.tree_id = w.tree_id AND n.parent_id = w.node_id)
        SELECT tree_id, node_id, depth, path FROM walk""")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_leaf")


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Nodes, leaves, depth, and splits by type of feature, of each tree."""
    split = ~F.col("is_leaf")
    return nodes.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_leaf").alias("n_leaves"), (F.max("level") - F.min("level") + 1).alias("depth"),
        F.count_if(split & (F.col("feature.type") == "color")).alias("n_color"), F.count_if(split & (F.col("feature.type") == "depth")).alias("n_depth"),
    )


def structure_errors(nodes: DataFrame) -> DataFrame:
    """Nodes that break the form of a tree: a child that isn't there, a child with another parent, half a split, a wrong level, a histogram that doesn't sum up."""
    child = nodes.select("tree_id", F.col("node_id").alias("child"), F.col("parent_id").alias("said"), F.col("level").alias("child_level"))
    sides = nodes.select("tree_id", "node_id", "level", F.explode(F.array("left_id", "right_id")).alias("child")).where("child is not null")
    broken = sides.join(child, ["tree_id", "child"], "left").where("said is null or said <> node_id or child_level <> level + 1").select("tree_id", "node_id")
    half = nodes.where("(left_id is null) <> (right_id is null) or is_leaf <> (left_id is null)").select("tree_id", "node_id")
    return broken.unionByName(half).distinct()


@dataclass
class Tree:
    """One tree as numpy arrays: children (-1 at leaves), thresholds, features, and each leaf's distribution."""

    left: np.ndarray
    right: np.ndarray
    threshold: np.ndarray
    features: Features
    dist: np.ndarray
    hist: np.ndarray

    @classmethod
    def of(cls, rows: list[dict], dist: str = "norm_hist") -> Tree:
        rows = sorted(rows, key=lambda r: r["node_id"])
        at = {r["node_id"]: i for i, r in enumerate(rows)}
        blank = {"feature_id": 0, "type": "color"} | {c: 1 for c in NUMBERS} | {"ch1": 0, "ch2": 0}
        fs = [dict(r["feature"].asDict() if hasattr(r["feature"], "asDict") else r["feature"]) if r["feature"] else blank for r in rows]
        f = Features(np.arange(len(rows)), np.array([x["type"] == "color" for x in fs], bool), {c: np.array([x[c] for x in fs], np.int64) for c in NUMBERS})
        side = lambda k: np.array([at[r[k]] if r[k] is not None else -1 for r in rows])
        return cls(side("left_id"), side("right_id"), np.array([r["threshold"] if r["threshold"] is not None else 0.0 for r in rows]), f, np.array([r[dist] for r in rows], np.float64), np.array([r["histogram"] for r in rows], np.float64))

    def walk(self, packs: Packs, image, x, y, depth, flip=None) -> np.ndarray:
        """The row of the leaf that each sample reaches; samples at one node are taken together."""
        at = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.left[at] >= 0)
        while len(open_):
            for node in np.unique(at[open_]):
                s = open_[at[open_] == node]
                one = Features(self.features.ids[[node]], self.features.color[[node]], {c: v[[node]] for c, v in self.features.columns.items()})
                r = responses(packs, image[s], x[s], y[s], depth[s], one, flip[s] if flip is not None else None)[:, 0]
                with np.errstate(invalid="ignore"):
                    at[s] = np.where(r <= self.threshold[node], self.left[node], self.right[node])
            open_ = open_[self.left[at[open_]] >= 0]
        return at


def forest_of(rows: list[dict], dist: str = "norm_hist") -> list[Tree]:
    ids = sorted({r["tree_id"] for r in rows})
    return [Tree.of([r for r in rows if r["tree_id"] == t], dist) for t in ids]


def _all_pixels(batch: pa.RecordBatch):
    h, w, n = batch.column("height")[0].as_py(), batch.column("width")[0].as_py(), batch.num_rows
    image = np.repeat(np.arange(n), h * w)
    return image, np.tile(np.tile(np.arange(w), h), n), np.tile(np.repeat(np.arange(h), w), n), batch.column("depth").flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def predicted(packs: DataFrame, trees: list[Tree], probabilities: bool = False) -> DataFrame:
    """Every pixel's ``label``: trees' distributions summed, as shares, the first largest; label 0 and zeros where no tree has a say.

    ``packs``: packed images with ``depth`` and the integral planes. No shuffle; a batch of images is read, walked and written.
    """
    spark: SparkSession = packs.sparkSession
    shared = spark.sparkContext.broadcast(trees)

    def run(batches):
        for whole in batches:
            for batch in same_size(whole):
                p, (image, x, y, d) = Packs.of(batch), _all_pixels(batch)
                votes = sum(t.dist[t.walk(p, image, x, y, d)] for t in shared.value)
                n = votes.sum(1, keepdims=True)
                probs = np.divide(votes, n, out=np.zeros_like(votes), where=n > 0)
                ids = np.repeat(batch.column("image_id").to_numpy(zero_copy_only=False), batch.column("height")[0].as_py() * batch.column("width")[0].as_py())
                cells = [pa.array(ids), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(np.argmax(probs, 1).astype(np.int32))]
                if probabilities:
                    cells.append(pa.array(list(probs), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(cells, names=["image_id", "x", "y", "prediction", *(["probs"] if probabilities else [])])

    return packs.mapInArrow(run, "image_id long, x int, y int, prediction int" + (", probs array<double>" if probabilities else ""))


def leaf_counts(packs: DataFrame, trees: list[Tree], labels: str = "label") -> DataFrame:
    """``tree``, ``leaf`` (numbers in order), ``label``, ``n``: where every labelled pixel ends up, for better leaf distributions."""
    shared = packs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for whole in batches:
            for batch in same_size(whole):
                p, (image, x, y, d) = Packs.of(batch), _all_pixels(batch)
                label = batch.column(labels).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                for t, tree in enumerate(shared.value):
                    key, n = np.unique(tree.walk(p, image, x, y, d) * 256 + label, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key // 256), pa.array((key % 256).astype(np.int32)), pa.array(n)], names=["tree", "leaf", "label", "n"])

    return packs.mapInArrow(run, "tree int, leaf long, label int, n long").groupBy("tree", "leaf", "label").agg(F.sum("n").alias("n"))


def hard_labels(samples: DataFrame, tree: Tree) -> DataFrame:
    """``sample_id``, ``label``, ``prediction`` of samples by one tree's largest leaf class."""
    shared = samples.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for whole in batches:
            for batch in same_size(whole):
                p = Packs.of(batch)
                image, (sid, x, y, d, label) = ragged(batch, ["sid", "sx", "sy", "sdepth", "slabel"])
                leaf = shared.value.walk(p, image, x, y, d)
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(label.astype(np.int32)), pa.array(np.argmax(shared.value.hist[leaf], 1).astype(np.int32))], names=["sample_id", "label", "prediction"])

    return samples.mapInArrow(run, "sample_id long, label int, prediction int")
