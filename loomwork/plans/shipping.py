"""Code of this package for the executors, which need not have it on disk."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add this package to the application once, as a zip that Spark hands to the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_loomwork_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="loomwork_"), "loomwork.zip")
    with zipfile.ZipFile(path, "w") as z:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    z.write(full, os.path.join("loomwork", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._loomwork_shipped = True
