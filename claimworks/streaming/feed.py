"""The feed of changes: claims scored as they arrive, and the views that follow it.

The views (totals, topics, averages of aspects) are incremental: Spark keeps sums and counts for each
of their rows as state, a few dozen rows in all, and each micro-batch only brings the rows that have
changed. They are put over the rows of the version before (streaming.versions), so after each batch
a view is what the batch query gives for all claims so far, and a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimworks.operators import detect
from claimworks.streaming import versions


def scored(claims: DataFrame) -> DataFrame:
    """claim_id, risk_score, language_risk, verdict of claims(claim_id, text), of a stream or a table.
    A narrow projection: no state, no shuffle."""
    return detect.detect(claims).select("claim_id", "risk_score", "language_risk", "verdict", F.col("language"))


def append(claims: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the scored claims of a stream to Parquet at path, each once; ends when all is read."""
    return scored(claims).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(claims: DataFrame) -> DataFrame:
    """view, claims, fake, risk (a sum), high_risk: one row, whole numbers only."""
    return scored(claims).groupBy(F.lit("all").alias("view")).agg(
        F.count("*").alias("claims"), F.count_if(F.col("verdict") == "likely-misleading").alias("fake"),
        F.sum(F.col("risk_score").cast("long")).alias("risk"), F.count_if(F.col("language_risk") == "high").alias("high_risk"),
    )


def topics(claims: DataFrame) -> DataFrame:
    """topic, n, first (the first claim that has it, and its place there)."""
    rows = detect.detect(claims).select("claim_id", F.posexplode("topics").alias("pos", "topic"))
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.min(F.struct("claim_id", "pos")).alias("first"))


def aspects(claims: DataFrame) -> DataFrame:
    """label, n, points: of the aspects that have scores."""
    rows = detect.aspects(detect.detect(claims)).filter("score is not null")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("score").cast("long")).alias("points"))


#: Each view's key, its rows, and the columns that are kept.
VIEWS = {
    "totals": ("view", totals, "view string, claims long, fake long, risk long, high_risk long"),
    "topics": ("topic", topics, "topic string, n long, first struct<claim_id: long, pos: int>"),
    "aspects": ("label", aspects, "label string, n long, points long"),
}


def follow(claims: DataFrame, view: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps one of VIEWS in `path` from a stream of claims; ends when all is read."""
    key, rows, schema = VIEWS[view]

    def write(changed: DataFrame, batch_id: int) -> None:
        before = versions.current(changed.sparkSession, path, schema, batch_id)
        changed = changed.select(*before.columns)
        # a view has a few dozen rows at most
        versions.commit(before.join(F.broadcast(changed.select(key)), key, "left_anti").select(*before.columns).unionByName(changed), path, batch_id)

    return rows(claims).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dashboard(spark, path: str) -> DataFrame:
    """records.totals of all claims so far, from the view of totals."""
    rows = versions.current(spark, path, VIEWS["totals"][2])
    return rows.select("claims", "fake", (F.col("claims") - F.col("fake")).alias("others"), F.round(F.col("risk") / F.col("claims"), 6).alias("avg_risk"), "high_risk")


def topic_counts(spark, path: str, most: int = 6) -> DataFrame:
    """records.topic_counts of all claims so far, from the view of topics."""
    return versions.current(spark, path, VIEWS["topics"][2]).orderBy(F.desc("n"), "first").limit(most).select("topic", "n")


def aspect_averages(spark, path: str) -> DataFrame:
    """records.aspect_averages of all claims so far, from the view of aspects."""
    rows = versions.current(spark, path, VIEWS["aspects"][2])
    return rows.select("label", F.floor(F.col("points") / F.col("n") + 0.5).cast("int").alias("score"))
