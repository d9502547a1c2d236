"""Make the package importable where its Python functions run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> SparkSession:
    """``spark``, with this package sent to its executors once; they may have neither this folder nor this path."""
    context = spark.sparkContext
    if not getattr(context, "_canopygrid_shipped", False):
        top = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="canopygrid-")) / "canopygrid.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(archive))
        context._canopygrid_shipped = True
    return spark
