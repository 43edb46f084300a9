"""Lets Python workers import this package wherever the session was started."""

from __future__ import annotations

import os
from functools import wraps

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Put the repository on the workers' path. A cluster without it on its disks needs ``--py-files`` instead."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])


def shipped(fn):
    """A function of ``(spark, ...)`` whose workers can import this package."""

    @wraps(fn)
    def run(spark, *args):
        ship(spark)
        return fn(spark, *args)

    return run
