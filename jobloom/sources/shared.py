"""Intermediate tables in the folder that the driver and all executors share, and landed rows reduced to one a key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where the session doesn't set it, a local session (tests on one machine) gets a temporary one; a cluster has none.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='jobloom-')}")
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def _file_system(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared one. What the application leaves there goes when it ends in good order."""
    own = f"{shared_dir(spark)}/jobloom-{spark.sparkContext.applicationId}"
    path, fs = _file_system(spark, own)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: it cuts the lineage, and outlives executors."""
    spark = df.sparkSession
    where = fresh_dir(spark, label)
    df.write.parquet(where, compression=compression)
    out = spark.read.schema(df.schema).parquet(where)
    out._written_to = where
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what materialize wrote for tables that nothing reads any more."""
    for df in tables:
        where = getattr(df, "_written_to", None)
        if where:
            delete_folder(df.sparkSession, where)


def delete_folder(spark: SparkSession, where: str) -> None:
    path, fs = _file_system(spark, where)
    fs.delete(path, True)


def one_row(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: of several the last by landed_at, if there is such a column, else the greatest. Same columns."""
    rest = sorted(set(rows.columns) - {key}, key=lambda c: (c != "landed_at", rows.columns.index(c)))
    kept = rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row"))
    return kept.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])
