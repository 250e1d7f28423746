"""Sessions that can run this package's Python functions on their workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed or sent along (``--py-files``); this
    covers sessions whose workers start elsewhere than in the repository.
    """
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def local(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    return ready(
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
