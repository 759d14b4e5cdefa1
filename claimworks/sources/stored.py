"""JSON inputs: labelled claims by line, and stored records as JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.functions import messages as M
from claimworks.operators import detect

LABELS = ("false", "true", "unverifiable")
RECORD = "array<struct<id: long, text: string, sample: boolean, result: struct<verdict: string>>>"


def labelled(lines: DataFrame) -> DataFrame:
    """lines(value) -> text, label of lines with one of the three labels whose text isn't TODO. Blank
    and malformed lines give no row."""
    rows = lines.select(F.from_json("value", "text string, label string").alias("x")).select("x.*")
    return rows.filter(F.col("label").isin(*LABELS) & (F.col("text") != "TODO"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return labelled(spark.read.text(path))


def records(values: DataFrame) -> DataFrame:
    """values(value: a JSON array of records) -> id, text, sample, verdict. Malformed values give no
    rows; records without a verdict are scored."""
    rows = values.select(F.explode(F.from_json("value", RECORD)).alias("x")).select("x.id", "x.text", "x.sample", "x.result.verdict")
    scored = detect.detect(rows.filter("verdict is null").withColumn("claim_id", F.col("id")))
    return rows.filter("verdict is not null").unionByName(scored.select("id", "text", "sample", "verdict"))


def with_samples(existing: DataFrame) -> DataFrame:
    """existing(text, sample, minutes: age) with the sample claims that its samples lack, 7.5 hours apart."""
    rows = [(t, True, 450 * (i + 1)) for i, t in enumerate(M.SAMPLES)]
    new = existing.sparkSession.createDataFrame(rows, "text string, sample boolean, minutes int")
    # the other way round a join would shuffle every record: only their samples among the eight texts count
    have = existing.filter(F.col("sample") & F.col("text").isin(M.SAMPLES)).select("text").distinct()
    return new.join(have, "text", "left_anti").unionByName(existing.select("text", "sample", "minutes"))
