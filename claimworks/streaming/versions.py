"""Small tables that a stream rewrites with each micro-batch, so that a replay changes nothing.

A table lives in a folder of the store that the cluster shares. The version that batch n leads to is
the folder v=n; it is complete once Spark's marker _SUCCESS is in it. A batch reads the newest
complete version before its own number, so running it again, after a crash or a lost driver, reads
what it read the first time and writes the same version. The newest KEPT versions stay for readers
that are still at an older one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEPT = 3


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions, in order."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    numbers = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    done = lambda n: files.exists(_files(spark, f"{path}/v={n}/_SUCCESS")[0])
    return [n for n in numbers if done(n)]


def current(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest version (with `before`, of those below it); an empty table if there is none."""
    found = [n for n in versions(spark, path) if before is None or n < before]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v={found[-1]}")


def commit(table: DataFrame, path: str, batch_id: int) -> None:
    """Writes the version of a batch; nothing happens if it is complete. Older ones are cleared."""
    spark = table.sparkSession
    if batch_id in versions(spark, path):
        return
    table.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
    for n in versions(spark, path)[:-KEPT]:
        at, files = _files(spark, f"{path}/v={n}")
        files.delete(at, True)
