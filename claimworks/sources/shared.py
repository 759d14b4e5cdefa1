"""Tables that a query writes and reads again: several readers share one run, and lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a session on one
    machine may go without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = getattr(spark.sparkContext, "_claimworks_tables", None)
    if path is None:
        path = spark.sparkContext._claimworks_tables = "file://" + tempfile.mkdtemp(prefix="claimworks-")
    return path


def table(rows: DataFrame, name: str) -> DataFrame:
    """rows as Parquet in the shared folder, read back."""
    path = f"{folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
