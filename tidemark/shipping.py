"""Gives the package to Python workers that don't have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip file to the application, once."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="spark-tidemark-")
        archive = shutil.make_archive(os.path.join(folder, "tidemark_package"), "zip", os.path.dirname(here), os.path.basename(here))
        spark.sparkContext.addPyFile(archive)
        atexit.register(shutil.rmtree, folder, True)  # executors fetch it from here as they start
