"""Image folders: ``<name>_colors.png``, ``<name>_depth.png``, ``<name>_ground_truth.png`` as tables, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.operators import labels as lab
from canopygrid.operators.grid import padded
from canopygrid.sources import png

COLORS, DEPTH, TRUTH = "_colors.png", "_depth.png", "_ground_truth.png"
#: Depths in millimetres that a camera can give, and means of valid ones in metres that make sense.
MOST_DEPTH, MEAN_DEPTH = 50_000, (0.01, 10.0)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``stem`` of all colour images below a folder, in order of path. Nothing is read but names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*" + COLORS).load(folder)
    return files.select("path").withColumn("stem", stem(F.col("path"))).orderBy("path")


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"_(colors|depth|ground_truth)\.png$", "")


def triplet_names(path: Column) -> list[Column]:
    """Names of the colour, depth and truth images of a colour image."""
    return [path, F.regexp_replace(path, r"_colors\.png$", DEPTH), F.regexp_replace(path, r"_colors\.png$", TRUTH)]


def _files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*" + kind).load(folder)
    return files.select(stem(F.col("path")).alias("stem"), "content")


def checked_color(image: np.ndarray, name: str) -> np.ndarray:
    if image.ndim != 3 or image.shape[2] != 3:
        raise ValueError(f"{name} has not three channels")
    return image


def checked_depth(image: np.ndarray, size: tuple[int, int], name: str) -> np.ndarray:
    if image.ndim != 2 or image.shape != size:
        raise ValueError(f"the depth image of {name} is not one channel of {size}")
    if image.max(initial=0) > MOST_DEPTH:
        raise ValueError(f"{name} has a depth of {image.max()} mm")
    if (valid := image[image > 0]).size and not MEAN_DEPTH[0] <= valid.mean() / 1000 <= MEAN_DEPTH[1]:
        raise ValueError(f"the mean depth of {name} is {valid.mean() / 1000} m")
    return image


PIXELS = "stem string, x int, y int, c0 float, c1 float, c2 float, depth int, valid int, r int, g int, b int"


def read_images(spark: SparkSession, folder: str, use_depth: bool = True, truth: bool = True) -> DataFrame:
    """``PIXELS`` of all images below a folder: colours, depth (a metre if it isn't used) and the colours of the truth (null if not asked for).

    Files of one image meet by their stem, and are decoded where they meet.
    """
    files = _files(spark, folder, COLORS).withColumnRenamed("content", "colors")
    files = files.join(_files(spark, folder, DEPTH).withColumnRenamed("content", "depths"), "stem", "left") if use_depth else files.withColumn("depths", F.lit(None).cast("binary"))
    files = files.join(_files(spark, folder, TRUTH).withColumnRenamed("content", "truths"), "stem", "left") if truth else files.withColumn("truths", F.lit(None).cast("binary"))
    names = [c.split()[0] for c in PIXELS.split(", ")]

    def run(batches):
        for batch in batches:
            for name, colors, depths, truths in zip(*(batch.column(c).to_pylist() for c in ("stem", "colors", "depths", "truths"))):
                image = checked_color(png.decode(colors), name)
                h, w = image.shape[:2]
                if use_depth and depths is None or truth and truths is None:
                    raise ValueError(f"{name} lacks its depth or truth image")
                d = checked_depth(png.decode(depths), (h, w), name).astype(np.int32) if use_depth else np.full((h, w), 1000, np.int32)
                t = checked_color(png.decode(truths), name) if truth else None
                if t is not None and t.shape[:2] != (h, w):
                    raise ValueError(f"the truth image of {name} has another size")
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), w)
                flat = image.reshape(-1, 3).astype(np.float32)
                true = [pa.array(t.reshape(-1, 3)[:, k].astype(np.int32)) if t is not None else pa.nulls(h * w, pa.int32()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * (h * w)), pa.array(x), pa.array(y), *[pa.array(flat[:, k]) for k in range(3)], pa.array(d.ravel()), pa.array((d.ravel() > 0).astype(np.int32)), *true], names=names)

    return files.mapInArrow(run, PIXELS)


def load_images(spark: SparkSession, folder: str, use_depth: bool = True, ignored: list[str] = (), colors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled pixels, padded to the largest image, and the colour dictionary; the padding colour has label 0.

    ``colors``: the dictionary to go by, such as that of the training images; a truth with another colour fails with its image and pixel.
    """
    pixels = read_images(spark, folder, use_depth)
    if colors is None:
        first = tuple(map(int, lab.padding_color(list(ignored)).split(",")))
        colors = lab.color_dictionary(pixels, ["stem", "x", "y"], first)
    ids = pixels.select("stem").distinct()
    from pyspark.sql import Window

    # One row for each image.
    ids = ids.withColumn("image_id", F.row_number().over(Window.orderBy("stem")).cast("long") - 1)
    rows = lab.encoded(pixels, colors, ["stem", "x", "y"]).join(ids, "stem").select("image_id", "x", "y", "c0", "c1", "c2", "depth", "valid", "label")
    width, height = rows.agg(F.max("x") + 1, F.max("y") + 1).first()
    return padded(rows, width, height, 0), colors


def images_of(pixels: DataFrame, columns: list[str], sixteen: bool = False, name: str = "image_id") -> DataFrame:
    """``name``, ``content``: a PNG file of each image, from one column (grey) or three; nulls are 0."""
    cells = pixels.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("y", "x", *[F.coalesce(F.round(c).cast("int"), F.lit(0)).alias(f"v{i}") for i, c in enumerate(columns)]))).alias("cells"))
    kind = np.uint16 if sixteen else np.uint8

    @F.arrow_udf("binary")
    def encode(batch: pa.Array) -> pa.Array:
        out = []
        for row in batch:
            table = pa.Table.from_struct_array(row.values)
            h, w = table["y"].to_numpy().max() + 1, table["x"].to_numpy().max() + 1
            v = np.stack([table[f"v{i}"].to_numpy() for i in range(len(columns))], 1)
            image = np.clip(v, 0, np.iinfo(kind).max).astype(kind).reshape(h, w, len(columns))
            out.append(png.encode(image[:, :, 0] if len(columns) == 1 else image))
        return pa.array(out, pa.binary())

    return cells.select(name, encode("cells").alias("content"))


def label_images(labels: DataFrame, colors: DataFrame) -> DataFrame:
    """PNG files of label planes in their colours."""
    return images_of(lab.decoded(labels, colors), ["r", "g", "b"])


def whole_uri(spark: SparkSession, folder: str) -> str:
    """The folder with its store: a path without one is in the default store, as for all of Spark's readers and writers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    said = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + said.removeprefix("file:") if said.startswith("file:/") and not said.startswith("file://") else said


def save_images(images: DataFrame, folder: str, suffix: str, name: str = "image_id") -> int:
    """Write ``content`` of each row as ``<name><suffix>`` under a folder that all executors share; how many."""
    uri = whole_uri(images.sparkSession, folder)

    def run(batches):
        import pyarrow.fs as fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for n, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{root}/{n}{suffix}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return images.select(F.col(name).cast("string"), "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def probability_images(found: DataFrame, ignored: list[int] = ()) -> DataFrame:
    """``image_id`` (with ``_label_<k>``), ``content``: a grey image of 16 bits for each image and class that isn't ignored, all in one pass."""
    each = found.select("image_id", "x", "y", F.posexplode("probs").alias("k", "p"))
    each = each.where(~F.col("k").isin(*ignored)) if ignored else each
    named = F.concat(F.col("image_id").cast("string"), F.lit("_label_"), F.col("k").cast("string"))
    return images_of(each.select(named.alias("image_id"), "x", "y", F.round(F.col("p") * 65535).cast("int").alias("v")), ["v"], sixteen=True)
