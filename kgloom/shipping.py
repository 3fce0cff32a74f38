"""Makes the package importable for Python workers, wherever the driver was started."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ensure_importable(spark: SparkSession) -> None:
    """Adds the package's folder to the workers' PYTHONPATH. On a cluster whose executors don't have that folder, install the package or pass it by ``--py-files``."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
