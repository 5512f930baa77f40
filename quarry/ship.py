"""Makes the package importable in Python workers that don't share the driver's import path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package, as one small archive, to the session's executors; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    out.write(full, os.path.join("quarry", os.path.relpath(full, home)))
    sc.addPyFile(path)
    sc._quarry_shipped = True
