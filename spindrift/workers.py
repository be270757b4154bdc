"""Python workers of a local session find this package where the driver did."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ensure_importable(spark: SparkSession) -> None:
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
