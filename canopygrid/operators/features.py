"""Features: random region pairs, and their responses on samples.

A response compares two boxes around a pixel, at offsets and sizes that shrink with its depth: a difference of box sums of two colour
channels, or of mean depths. It is missing where a box leaves the image, holds no valid depth, or the pixel itself has none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid import schema
from canopygrid.functions.hashing import draw

NAMES = [c.split()[0] for c in schema.FEATURE.split(", ")]
NUMBERS = [n for n in NAMES if n not in ("feature_id", "type")]
#: Redraws of a second offset that equals the first.
REDRAWS = 8


def feature_table(spark: SparkSession, n: int, box_radius: int, region_size: int, seed: int, use_depth: bool = True, stratified: bool = True) -> DataFrame:
    """``n`` features, each drawn by its number and the seed alone.

    Stratified: the first half depth, the second colour, channels in turn over the second half. Else type and channels are drawn too.
    Without depth all are colour.
    """
    return feature_tables(spark, n, box_radius, region_size, [seed], use_depth, stratified).drop("table")


def feature_tables(spark: SparkSession, n: int, box_radius: int, region_size: int, seeds: list[int], use_depth: bool = True, stratified: bool = True) -> DataFrame:
    """A ``feature_table`` for each seed, numbered by ``table``."""
    i = F.col("id")
    seed = F.get(F.array(*map(F.lit, seeds)), F.col("table"))
    drawn = lambda low, high, name: draw(low, high, seed, i, name).cast("int")
    half = n / 2.0 if use_depth else float(n)
    if stratified:
        is_color = (i >= n // 2) if use_depth else F.lit(True)
        channel = lambda part: (F.floor(i / (half / part) * 3) % 3).cast("int")
        ch1, ch2 = channel(1), channel(3)
    else:
        is_color = (drawn(0, 1, "type") == 1) if use_depth else F.lit(True)
        ch1, ch2 = drawn(0, 2, "ch1"), drawn(0, 2, "ch2")
    around = lambda name: drawn(-box_radius, box_radius, name)
    box = lambda name: drawn(1, region_size, name)
    numbered = spark.range(n * len(seeds)).select((F.col("id") % n).alias("id"), F.floor(F.col("id") / n).cast("int").alias("table"))
    rows = numbered.select("id", "table", is_color.alias("color"), ch1.alias("ch1"), ch2.alias("ch2"), *[around(c).alias(c) for c in ("o1x", "o1y")], *[box(c).alias(c) for c in ("r1x", "r1y", "r2x", "r2y")], F.array(*[F.struct(around(f"o2x{k}").alias("x"), around(f"o2y{k}").alias("y")) for k in range(REDRAWS)]).alias("tries"))
    other = F.get(F.filter("tries", lambda t: (t["x"] != F.col("o1x")) | (t["y"] != F.col("o1y"))), F.lit(0))
    beside = F.struct(F.when(F.col("o1x") < box_radius, F.col("o1x") + 1).otherwise(F.col("o1x") - 1).cast("int").alias("x"), F.col("o1y").alias("y"))
    rows = rows.withColumn("o2", F.coalesce(other, beside))
    zero = lambda c: F.when(F.col("color"), F.col(c)).otherwise(0).cast("int").alias(c)
    return rows.select("table", F.col("id").cast("int").alias("feature_id"), F.when(F.col("color"), "color").otherwise("depth").alias("type"), "o1x", "o1y", "r1x", "r1y", F.col("o2.x").alias("o2x"), F.col("o2.y").alias("o2y"), "r2x", "r2y", zero("ch1"), zero("ch2"))


def in_order(features: DataFrame) -> DataFrame:
    """Features that read alike side by side; the new number decides ties."""
    from pyspark.sql import Window

    by = Window.orderBy(F.when(F.col("type") == "depth", 0).otherwise(1), "ch1", "ch2", "o1y", "o1x", "feature_id")
    return features.withColumn("sorted_id", F.row_number().over(by) - 1)


@dataclass
class Features:
    """A feature table as numpy columns."""

    ids: np.ndarray
    color: np.ndarray
    columns: dict[str, np.ndarray]

    @classmethod
    def of(cls, rows) -> Features:
        """From a DataFrame, rows or dicts; the table is as long as the number of features asked for."""
        rows = rows.collect() if isinstance(rows, DataFrame) else rows
        rows = sorted((r.asDict() if hasattr(r, "asDict") else r for r in rows), key=lambda r: r["feature_id"])
        return cls(np.array([r["feature_id"] for r in rows]), np.array([r["type"] == "color" for r in rows], bool), {c: np.array([r[c] for r in rows], np.int64) for c in NUMBERS})

    def row(self, i: int) -> dict:
        return {"feature_id": int(self.ids[i]), "type": "color" if self.color[i] else "depth"} | {c: int(v[i]) for c, v in self.columns.items()}

    def __len__(self) -> int:
        return len(self.ids)


@dataclass
class Packs:
    """Integral planes of images of one size: colour (image, 3, y, x), depth and valid (image, y, x)."""

    color: np.ndarray
    depth: np.ndarray
    valid: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Packs:
        h, w = batch.column("height")[0].as_py(), batch.column("width")[0].as_py()
        n = batch.num_rows
        plane = lambda c, kind: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, h, w)
        return cls(np.stack([plane(f"ic{k}", np.float64) for k in range(3)], 1), plane("idepth", np.int64), plane("ivalid", np.int64))

    def _cut(self, image, x, y, w, h):
        w, h = np.maximum(1, w), np.maximum(1, h)
        l, r, u, d = x - w, x + w, y - h, y + h
        inside = (l >= 0) & (u >= 0) & (r < self.depth.shape[2]) & (d < self.depth.shape[1])
        return np.broadcast_to(image, inside.shape)[inside], l[inside], r[inside], u[inside], d[inside], inside

    def box_color(self, image, x, y, w, h, channel):
        i, l, r, u, d, inside = self._cut(image, x, y, w, h)
        c = np.broadcast_to(channel, inside.shape)[inside]
        out = np.full(inside.shape, np.nan)
        p = self.color
        out[inside] = (p[i, c, d, r] - p[i, c, u, r]) + (p[i, c, u, l] - p[i, c, d, l])
        return out

    def box_depth(self, image, x, y, w, h):
        i, l, r, u, d, inside = self._cut(image, x, y, w, h)
        four = lambda p: (p[i, d, r] - p[i, u, r]) + (p[i, u, l] - p[i, d, l])
        n, total = four(self.valid), four(self.depth)
        out = np.full(inside.shape, np.nan)
        out[inside] = np.where(n > 0, total / 1000 / np.maximum(n, 1), np.nan)
        return out


def responses(packs: Packs, image: np.ndarray, x: np.ndarray, y: np.ndarray, depth: np.ndarray, f: Features, flip: np.ndarray | None = None) -> np.ndarray:
    """(samples, features) responses, NaN where missing. ``depth`` in millimetres; ``flip`` mirrors the offsets of a sample."""
    valid = depth > 0
    metres = np.where(valid, depth, 1).astype(np.float32)[:, None] / np.float32(1000)
    mirror = np.where(flip, -1, 1)[:, None] if flip is not None else 1
    near = lambda c, part: (f.columns[c][part][None, :].astype(np.float32) / metres).astype(np.int64)
    out = np.full((len(x), len(f)), np.nan)
    for part, is_color in ((np.flatnonzero(~f.color), False), (np.flatnonzero(f.color), True)):
        if not len(part):
            continue
        sides = []
        for k in "12":
            at_x, at_y = x[:, None] + mirror * near(f"o{k}x", part), y[:, None] + near(f"o{k}y", part)
            w, h = near(f"r{k}x", part), near(f"r{k}y", part)
            sides.append(packs.box_color(image[:, None], at_x, at_y, w, h, f.columns[f"ch{k}"][part][None, :]) if is_color else packs.box_depth(image[:, None], at_x, at_y, w, h))
        out[:, part] = sides[0] - sides[1]
    out[~valid] = np.nan
    return out


def response_rows(packs: DataFrame, features: Features, flip: bool = False) -> DataFrame:
    """``sample_id``, ``feature_id``, ``response`` (null where missing) for the samples of packed images.

    ``packs`` has the integral planes and, as arrays, the samples of each image: ``sid``, ``sx``, ``sy``, ``sdepth``. Images are
    taken a batch at a time, samples and planes together, so nothing is joined and nothing moves.
    """

    def run(batches):
        for whole in batches:
            for batch in same_size(whole):
                p = Packs.of(batch)
                image, (sid, x, y, d) = ragged(batch, ["sid", "sx", "sy", "sdepth"])
                r = responses(p, image, x, y, d, features, np.full(len(x), flip))
                flat = r.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sid, len(features))), pa.array(np.tile(features.ids, len(sid)).astype(np.int32)), pa.array(flat, mask=np.isnan(flat))], names=["sample_id", "feature_id", "response"])

    return packs.mapInArrow(run, "sample_id long, feature_id int, response double")


def same_size(batch: pa.RecordBatch):
    """Parts of a batch whose images have one size."""
    size = np.array(list(zip(batch.column("height").to_pylist(), batch.column("width").to_pylist())))
    if not len(size):
        return
    for one in np.unique(size, axis=0):
        yield batch.filter(pa.array((size == one).all(1)))


def ragged(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Image number of each element, and the elements, of array columns of equal lengths."""
    n = batch.column(columns[0]).value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), n), [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]


def routed_left(response: Column, threshold: Column) -> Column:
    """Whether a sample goes left; a missing response goes right."""
    return F.coalesce(response <= threshold, F.lit(False))


def thresholds_from(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``feature_id``, ``threshold_id``, ``value``: the responses of ``n`` random samples for each feature, missing ones passed over."""
    from canopygrid.operators.sampling import reservoir

    some = reservoir(rows.where("response is not null"), n, ["feature_id", "sample_id"], ["feature_id"], seed)
    from pyspark.sql import Window

    by = Window.partitionBy("feature_id").orderBy("response", "sample_id")
    return some.select("feature_id", (F.row_number().over(by) - 1).alias("threshold_id"), F.col("response").cast("float").alias("value"))
