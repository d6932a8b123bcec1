"""Session settings that the engine's results depend on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Bytes of an Arrow batch, where the session keeps Spark's default: rows with long texts then take little memory.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "4m", ("64MB", "64m", "67108864", "67108864b")


def prepare(spark: SparkSession) -> SparkSession:
    """UTC for all date functions, small Arrow batches, and this package importable by Python workers on this machine.

    On a cluster whose executors don't see this folder, ship the package with --py-files.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in DEFAULT_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    found = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in found.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *[found] * bool(found)])
    return spark


def local(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
