"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers, as a zip, unless PYTHONPATH already does."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app in _shipped or os.path.realpath(root) in paths:
        return
    base = os.path.join(tempfile.mkdtemp(prefix="quillscan-zip-"), "quillscan")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "quillscan"))
    _shipped.add(app)
