"""Planes of grids in long form: a row for each cell. Every operator is one shuffle by image, or none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The depth of a pixel is in millimetres; this is what a missing one holds.
MISSING = 0
PLANES = ("c0", "c1", "c2", "depth", "valid")


def from_vectors(vectors: DataFrame, image: str, vector: str, width: int = 8) -> DataFrame:
    """``image_id``, ``x``, ``y``, ``v``: each vector as a grid, row by row."""
    cells = vectors.select(F.col(image).alias("image_id"), F.posexplode(vector).alias("p", "v"), *[c for c in vectors.columns if c not in (image, vector)])
    return cells.withColumns({"x": F.col("p") % width, "y": F.floor(F.col("p") / width).cast("int")}).drop("p")


def _rows() -> tuple[Window, Window]:
    return Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")


def integral(pixels: DataFrame, planes: list[str], prefix: str = "i") -> DataFrame:
    """Inclusive prefix sums over both axes, as ``prefix`` + plane. Sums of integers stay exact."""
    along_x, along_y = (w.rowsBetween(Window.unboundedPreceding, 0) for w in _rows())
    rows = pixels.withColumns({prefix + p: F.sum(p).over(along_x) for p in planes})
    return rows.withColumns({prefix + p: F.sum(prefix + p).over(along_y) for p in planes})


def derivative(integrals: DataFrame, planes: list[str], prefix: str = "i") -> DataFrame:
    """The inverse of ``integral``: ``d`` + plane from ``prefix`` + plane."""
    along_x, along_y = _rows()
    left = integrals.withColumns({f"_{p}": F.col(prefix + p) - F.coalesce(F.lag(prefix + p).over(along_x), F.lit(0)) for p in planes})
    return left.withColumns({f"d{p}": F.col(f"_{p}") - F.coalesce(F.lag(f"_{p}").over(along_y), F.lit(0)) for p in planes}).drop(*[f"_{p}" for p in planes])


def packed(pixels: DataFrame, planes: list[str], extra: list[str] = ()) -> DataFrame:
    """One row for each image: ``width``, ``height``, and each plane as an array, row by row. Cells must fill the grid."""
    cell = F.struct("y", "x", *planes, *extra)
    rows = pixels.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.sort_array(F.collect_list(cell)).alias("cells"))
    field = lambda name: F.transform("cells", lambda c: c[name]).alias(name)
    return rows.select("image_id", "width", "height", *map(field, (*planes, *extra)))


def packed_integral(packs: DataFrame, planes: list[str], prefix: str = "i") -> DataFrame:
    """Prefix sums of packed planes, no shuffle: a plane is summed where it lies. Integers as longs, the rest as doubles."""
    kinds = dict(packs.dtypes)
    whole = {p: "float" not in kinds[p] and "double" not in kinds[p] for p in planes}
    schema = ", ".join([f"{c} {t}" for c, t in packs.dtypes] + [f"{prefix}{p} array<{'long' if whole[p] else 'double'}>" for p in planes])
    names = [*packs.columns, *[prefix + p for p in planes]]

    def run(batches):
        for b in batches:
            shape = list(zip(b.column("height").to_pylist(), b.column("width").to_pylist()))
            out = list(b.columns)
            for p in planes:
                kind = np.int64 if whole[p] else np.float64
                sums = [np.cumsum(np.cumsum(np.asarray(v.values.to_numpy(zero_copy_only=False), kind).reshape(s), 0), 1).ravel() for v, s in zip(b.column(p), shape)]
                out.append(pa.array(sums, pa.list_(pa.int64() if whole[p] else pa.float64())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return packs.mapInArrow(run, schema)


def corners(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[list[Column], Column]:
    """Places in a packed plane of the corners of (x - w, x + w] x (y - h, y + h], w and h at least 1, with signs +, -, +, -; and whether all lie in the image."""
    w, h = F.greatest(F.lit(1), w), F.greatest(F.lit(1), h)
    left, right, up, down = x - w, x + w, y - h, y + h
    inside = (left >= 0) & (right < width) & (up >= 0) & (down < height)
    return [down * width + right, up * width + right, up * width + left, down * width + left], inside


def box_sum(plane: str, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Sum over the box from four reads of a packed integral, null when it leaves the image."""
    at, inside = corners(x, y, w, h, F.col("width"), F.col("height"))
    a, b, c, d = (F.get(plane, i.cast("int")) for i in at)
    return F.when(inside, a - b + c - d)


def box_depth_mean(x: Column, y: Column, w: Column, h: Column, depth: str = "idepth", valid: str = "ivalid") -> Column:
    """Mean depth in metres over the valid cells of the box, null without any."""
    return F.try_divide(box_sum(depth, x, y, w, h) / 1000.0, F.nullif(box_sum(valid, x, y, w, h), F.lit(0)))


def depth_fill(pixels: DataFrame, depth: str = "depth") -> DataFrame:
    """Missing depths take the next valid one to the right, then to the left, then above, then below; each pass sees the one before."""
    along_x, along_y = _rows()
    # The nearest value ahead is the last one seen when running backwards; frames that grow forwards cost a pass for each cell.
    back_x, back_y = Window.partitionBy("image_id", "y").orderBy(F.desc("x")), Window.partitionBy("image_id", "x").orderBy(F.desc("y"))
    out = pixels
    for w in (back_x, along_x, along_y, back_y):
        seen = F.last(F.nullif(depth, F.lit(MISSING)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(depth, F.coalesce(seen, F.lit(MISSING)))
    return out.withColumn("valid", (F.col(depth) > 0).cast("int"))


def padded(pixels: DataFrame, width: int, height: int, padding_label: int, colors: list[str] = ("c0", "c1", "c2")) -> DataFrame:
    """Each image on a larger canvas: colours null, depth missing, label the padding one outside. Larger images fail."""
    sizes = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    fits = F.when((F.col("mx") < width) & (F.col("my") < height), F.lit(height)).otherwise(F.raise_error(F.lit("an image is larger than its canvas")).cast("int"))
    canvas = sizes.select("image_id", F.explode(F.sequence(F.lit(0), fits - 1)).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    out = canvas.join(pixels, ["image_id", "x", "y"], "left")
    return out.withColumns({"depth": F.coalesce("depth", F.lit(MISSING)), "valid": F.coalesce("valid", F.lit(0)), "label": F.coalesce("label", F.lit(padding_label))})


def metres(depth: Column) -> Column:
    return (depth / 1000.0).cast("float")


def millimetres(depth: Column) -> Column:
    """Whole millimetres of metres, -1 for NaN and null."""
    return F.when(depth.isNull() | F.isnan(depth), -1).otherwise((depth * 1000).cast("int"))


def is_valid(depth: Column) -> Column:
    return depth > 0


def normalized_offset(value: Column, depth: Column) -> Column:
    """An offset in pixels at one metre, at the given depth in millimetres: single precision, cut towards zero."""
    return F.when(depth > 0, (value / metres(depth)).cast("float").cast("int"))


def in_image(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def depth_view(pixels: DataFrame) -> DataFrame:
    """``scaled`` (0 to 1 between the image's least and largest depth) and ``equalized`` (share of valid cells not deeper); null where missing."""
    whole = Window.partitionBy("image_id")
    d = F.when(F.col("valid") == 1, F.col("depth"))
    low, high = F.min(d).over(whole), F.max(d).over(whole)
    rank = F.cume_dist().over(Window.partitionBy("image_id", "valid").orderBy("depth"))
    return pixels.withColumns({"scaled": F.try_divide(d - low, high - low), "equalized": F.when(F.col("valid") == 1, rank)})


def dumped(pixels: DataFrame, plane: str) -> DataFrame:
    """Each row of a plane as text."""
    cells = F.sort_array(F.collect_list(F.struct("x", F.col(plane).cast("string").alias("v"))))
    return pixels.groupBy("image_id", "y").agg(F.concat_ws(" ", F.transform(cells, lambda c: c["v"])).alias("line"))
