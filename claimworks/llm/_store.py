"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = getattr(spark.sparkContext, "_claimworks_dir", None)
    if folder is None:
        folder = "file://" + tempfile.mkdtemp(prefix="claimworks-")
        spark.sparkContext._claimworks_dir = folder
    return folder


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there, so a
    lost executor costs nothing that was computed before, and several readers share one run."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._claimworks_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `table` has written, once nothing that is still to be computed reads them."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._claimworks_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from whatever store sf_dir names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ids(rows: DataFrame, ids: DataFrame, column: str, how: str, most: int = 1_000_000) -> DataFrame:
    """rows semi- or anti-joined with the ids (one long column of the same name), which must be
    cheap to count. Up to `most` ids (8 MB) they are broadcast; beyond that Spark shuffles."""
    small = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if small else ids, column, how)
