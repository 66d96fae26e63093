"""What a session needs to run this library's functions in its Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_code(spark: SparkSession) -> SparkSession:
    """Put the library's folder on the workers' path, where it is not installed there.

    Enough for local mode and for clusters that mount the folder; others ship the package
    with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
