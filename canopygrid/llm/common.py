"""What the training-data operators share: words, shared-folder tables, sized broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a table that may be broadcast; larger tables take a shuffled join.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """The words of a text, as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    """How many words a text has, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="canopygrid-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether shuffle files go when the statement that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here and a lost executor loses nothing.

    Nothing reads the shuffles of the write again, so their files go with it and not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the table that ``written`` made for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffled join. ``df`` should be written."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows that are equal are a mass from so many on.
MASS = 1024


def with_masses(df: DataFrame, by: list[str], most: int = MASS) -> DataFrame:
    """``df``, which should be written, with ``mass``: how many rows equal this one in ``by`` where they are over ``most``, else null.

    Counts combine before they meet, and there is at most one mass for each ``most`` rows.
    """
    masses = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.count(F.lit(1)).alias("mass")).where(F.col("mass") > most)
    masses = written(masses, "masses")
    if masses.isEmpty():
        return df.withColumn("mass", F.lit(None).cast("long"))
    same = [df[c].eqNullSafe(masses[f"__{c}"]) for c in by]
    return df.join(small(masses), same, "left").drop(*[f"__{c}" for c in by])
