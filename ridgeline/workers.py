"""Python workers must find this package; a source checkout is put on their path."""

from __future__ import annotations

import os

from pyspark import SparkContext
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _with_root(paths: str) -> str:
    known = [p for p in paths.split(os.pathsep) if p]
    return paths if ROOT in known else os.pathsep.join([ROOT, *known])


def make_importable(spark: SparkSession | None = None) -> None:
    """For sessions that start later by the environment, for a running one by its context."""
    os.environ["PYTHONPATH"] = _with_root(os.environ.get("PYTHONPATH", ""))
    context = spark.sparkContext if spark else SparkContext._active_spark_context
    if context is not None:
        context.environment["PYTHONPATH"] = _with_root(context.environment.get("PYTHONPATH", ""))
