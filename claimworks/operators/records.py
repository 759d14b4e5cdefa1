"""The log of scored claims: history, dashboard, evaluation and access rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("claims"), F.count_if(F.col("verdict") == "likely-misleading").alias("fake"), F.count_if(F.col("verdict") != "likely-misleading").alias("others"),
        F.round(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 6).alias("avg_risk"), F.count_if(F.col("language_risk") == "high").alias("high_risk"),
    )


def aspect_averages(aspects: DataFrame) -> DataFrame:
    """label, score: half-up averages of the aspects that have scores."""
    return aspects.filter("score is not null").groupBy("label").agg(F.floor(F.avg("score") + 0.5).cast("int").alias("score"))


def topic_counts(scored: DataFrame, most: int = 6) -> DataFrame:
    """The commonest topics; ties in the order of their first claim."""
    rows = scored.select("claim_id", F.posexplode_outer("topics").alias("pos", "topic"))
    counts = rows.groupBy("topic").agg(F.count("*").alias("n"), F.min(F.struct("claim_id", "pos")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(most).select("topic", "n")


def search(records: DataFrame, label: str, query: str) -> DataFrame:
    """Records with the label (ALL: any) whose text holds the trimmed query, in any case."""
    rows = records if label == "ALL" else records.filter(F.col("label") == label)
    return rows.filter(F.contains(F.lower("text"), F.lit(query.strip().lower())))


def newest(records: DataFrame, first: int, last: int) -> DataFrame:
    """The records at places first to last, newest first; a sort with a limit, not a full window."""
    top = records.orderBy(F.desc("at"), F.desc("claim_id")).limit(last)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("at"), F.desc("claim_id")))).filter(F.col("place") >= first)


def confusion(rows: DataFrame, labels=("false", "true", "unverifiable")) -> DataFrame:
    """rows(actual, predicted) -> every cell of the matrix, empty ones as 0."""
    cells = rows.sparkSession.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    return F.broadcast(cells).join(rows.groupBy("actual", "predicted").agg(F.count("*").alias("n")), ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """label, precision and recall as percentages with one decimal, n/a without rows."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    percent = lambda a, b: F.when(b > 0, F.concat(F.round(100.0 * a / b, 1).cast("string"), F.lit("%"))).otherwise("n/a")
    p = matrix.groupBy(F.col("predicted").alias("label")).agg(hit.alias("tp"), F.sum("n").alias("np"))
    r = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("na"))
    return p.join(r, "label").select("label", percent(F.col("tp"), F.col("np")).alias("precision"), percent(F.col("tp"), F.col("na")).alias("recall"))


def accuracy(matrix: DataFrame) -> DataFrame:
    """Share of right predictions, and of the commonest class."""
    total = F.sum("n")
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    largest = matrix.groupBy("actual").agg(F.sum("n").alias("k")).agg(F.max("k").alias("k"))
    return matrix.agg(hit.alias("right"), total.alias("total")).crossJoin(F.broadcast(largest)).select("right", "total", F.round(F.col("right") / F.col("total"), 6).alias("accuracy"), F.round(F.col("k") / F.col("total"), 6).alias("baseline"))


def upsert(base: DataFrame, patch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """base with the columns that patches give put over the rows of the same key, in the order of the
    column `order` of patch; null means that a patch doesn't give a column. Of each column the last
    patch counts, so repeated patches lead to one row. Patches of unknown and of null keys are ignored;
    so are columns that base lacks. Without an order there is at most one patch a key, or any counts;
    patches of equal order count as one, with the largest value."""
    given = [c for c in patch.columns if c in base.columns and c not in (key, order)]
    place = F.col(order) if order else F.lit(0)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(place, F.col(c)))).alias(c) for c in given]
    name = "patch"
    while name in base.columns:
        name += "_"
    merged = patch.groupBy(key).agg(F.struct(*last).alias(name)) if given else patch.select(key).distinct().withColumn(name, F.lit(None))
    rows = base.join(merged, key, "left")
    return rows.select(*[F.coalesce(F.col(name)[c], F.col(c)).alias(c) if c in given else F.col(c) for c in base.columns])


def visible(predictions: DataFrame, submissions: DataFrame, roles: DataFrame, user: int) -> DataFrame:
    """Predictions whose submission the user owns, or all if the user is an administrator."""
    # One user's submissions: broadcast, so the predictions are neither shuffled nor sorted for them.
    mine = F.broadcast(submissions.filter(F.col("user_id") == user).select("submission_id").distinct())
    admin = roles.filter((F.col("user_id") == user) & (F.col("role") == "ADMIN")).select(F.lit(1).alias("x")).limit(1)
    own = predictions.join(mine, "submission_id", "left_semi")
    return own.unionByName(predictions.join(mine, "submission_id", "left_anti").join(F.broadcast(admin), F.lit(True), "left_semi"))
