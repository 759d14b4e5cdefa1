"""Lookups from the raw replies of services: attempts, statuses, and what the bodies hold.

calls(claim_id, attempt, code, body): attempt counts from 0, code is the HTTP code, null where no
answer came. Bodies are read by schema; one that isn't of the form is an answer that doesn't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimworks.functions import messages as M
from claimworks.operators import evidence as E
from claimworks.operators import report

REVIEW = "struct<publisher: struct<name: string, site: string>, url: string, title: string, reviewDate: string, textualRating: string>"
FACTS = f"claims array<struct<text: string, claimReview: array<{REVIEW}>>>, broken string"
NEWS = "articles array<struct<url: string, title: string, domain: string, seendate: string>>, broken string"
ENVELOPE = "choices array<struct<message: struct<content: string>>>, broken string"


def fine(code: Column) -> Column:
    return F.coalesce(code.between(200, 299), F.lit(False))


def ladder(calls: DataFrame, most: int, terminal: Column, pause_ms: int = 0) -> DataFrame:
    """The last attempt that is made for each claim, with attempts (how many were made) and waited_ms.

    Attempts are made in order until one is terminal or `most` are made; before attempt n there is a
    pause of n * pause_ms. Later rows of calls don't count, nor do those with an attempt beyond
    `most`. terminal is a condition on the columns of calls; null counts as no. Of several rows with
    one attempt number the one with the smallest code and body counts. A claim without attempts, or
    with a null number only, gives no row. A claim has `most` rows in its window at most."""
    calls = calls.filter((F.col("attempt") >= 0) & (F.col("attempt") < most))
    first = Window.partitionBy("claim_id", "attempt").orderBy(F.col("code").asc_nulls_last(), "body")
    calls = calls.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    order = Window.partitionBy("claim_id").orderBy("attempt")
    ended = F.max(F.coalesce(terminal, F.lit(False))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    calls = calls.withColumns({"ended": F.coalesce(ended, F.lit(False)), "attempts": F.row_number().over(order)}).filter("not ended")
    last = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("attempt")))
    calls = calls.withColumn("n", last).filter("n = 1").drop("n", "ended", "attempt")
    return calls.withColumn("waited_ms", (F.lit(pause_ms) * F.col("attempts") * (F.col("attempts") - 1) / 2).cast("long"))


def parsed(calls: DataFrame, schema: str) -> DataFrame:
    """calls with reply (by schema) and read: whether the body is an object of that form."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    calls = calls.withColumn("reply", F.from_json("body", schema, options))
    whole = F.startswith(F.trim(F.col("body")), F.lit("{")) & F.col("reply").isNotNull() & F.col("reply.broken").isNull()
    return calls.withColumn("read", F.coalesce(whole, F.lit(False)))


def fact_checks(calls: DataFrame) -> DataFrame:
    """claim_id, attempts, status, message, claims (as the service gave them) of fact-check calls.

    A rejected request (code below 500) ends the lookup; no answer, a server error or a body that isn't
    read is tried again once. A service
    without a key has no calls: see unconfigured."""
    rows = parsed(calls, FACTS)
    found, rejected = fine(F.col("code")) & F.col("read"), ~fine(F.col("code")) & (F.col("code") < 500)
    rows = ladder(rows, 2, found | rejected)
    status = F.when(found, "ok").otherwise("error")
    message = F.when(found, None).when(F.coalesce(rejected, F.lit(False)), M.FACTS_REJECTED).otherwise(M.FACTS_LATE)
    return rows.select("claim_id", "attempts", status.alias("status"), message.alias("message"), F.when(found, F.col("reply.claims")).alias("claims"))


def unconfigured(claims: DataFrame, message: str) -> DataFrame:
    """The lookup of every claim where a service has no key."""
    return claims.select("claim_id", F.lit("not-configured").alias("status"), F.lit(message).alias("message"))


def reviews(lookups: DataFrame) -> DataFrame:
    """claim_id, ci, text, ri, name, site, url, title, date, rating: a row for each review, with its
    place in the reply, as evidence.normalise_claims reads them. Claims of a reply without reviews, and
    lookups without claims, give a row without a review."""
    rows = lookups.select("claim_id", F.posexplode_outer("claims").alias("ci", "c"))
    rows = rows.select("claim_id", "ci", "c.text", F.posexplode_outer("c.claimReview").alias("ri", "r"))
    return rows.select("claim_id", "ci", "text", "ri", "r.publisher.name", "r.publisher.site", "r.url", "r.title", F.col("r.reviewDate").alias("date"), F.col("r.textualRating").alias("rating"))


def news(calls: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id, window_days, terms, status, message, articles (as the service gave them) of every claim.
    Claims of fewer than four key terms are skipped; one attempt is made; a claim without one timed out."""
    rows = ladder(parsed(calls, NEWS), 1, F.lit(True))
    asked = claims.select("claim_id", E.news_terms(F.col("text")).alias("terms"), E.news_window(F.col("text")).alias("window_days"))
    rows = asked.join(rows.select("claim_id", "code", "read", "reply"), "claim_id", "left")
    skipped, answered = F.size("terms") < 4, fine(F.col("code"))
    found = ~skipped & answered & F.coalesce("read", F.lit(False))
    status = F.when(skipped, "skipped").when(found, "ok").otherwise("error")
    message = F.when(skipped, M.NEWS_SHORT).when(found, None).when(answered, M.NEWS_BUSY).when(F.col("code").isNotNull(), M.NEWS_DOWN).otherwise(M.NEWS_LATE)
    return rows.select("claim_id", "window_days", "terms", status.alias("status"), message.alias("message"), F.when(found, F.col("reply.articles")).alias("articles"))


def articles(lookups: DataFrame) -> DataFrame:
    """claim_id, pos, url, title, domain, seendate: a row for each article, as evidence.rank_news reads them."""
    return lookups.select("claim_id", F.posexplode("articles").alias("pos", "a")).select("claim_id", "pos", "a.url", "a.title", "a.domain", "a.seendate")


def model_calls(calls: DataFrame) -> DataFrame:
    """claim_id, attempts, waited_ms, ok, code, content of calls of the model gateway: up to three
    attempts, 0.8 and 1.6 seconds apart, while it is busy (429), fails (500 and above) or doesn't
    answer (which counts as 503). The content of a body that isn't read is empty."""
    rows = calls.withColumn("code", F.coalesce("code", F.lit(503)))
    rows = ladder(rows, 3, fine(F.col("code")) | ~((F.col("code") == 429) | (F.col("code") >= 500)), 800)
    rows = parsed(rows, ENVELOPE)
    content = F.coalesce(F.when(F.col("read"), F.get("reply.choices", F.lit(0))["message"]["content"]), F.lit(""))
    return rows.select("claim_id", "attempts", "waited_ms", fine(F.col("code")).alias("ok"), "code", F.when(fine(F.col("code")), content).alias("content"))


def grounded(calls: DataFrame, items: DataFrame) -> DataFrame:
    """claim_id, status, message, attempts, waited_ms, verdict, confidence, reasoning, cited, reason.

    items(claim_id, id, kind) is the evidence that the model is shown, at most 21 a claim (see
    evidence.evidence_items); its answer may cite nothing else. A claim without a fact-check or an
    article is skipped, whatever its calls; a claim without calls gives no row."""
    shown = items.groupBy("claim_id").agg(F.collect_list("id").alias("allowed"), F.bool_or(F.col("kind") != "official-source").alias("enough"))
    rows = model_calls(calls).join(shown, "claim_id", "left").withColumn("enough", F.coalesce("enough", F.lit(False)))
    answers = E.parse_grounded(rows.select("claim_id", F.coalesce("content", F.lit("")).alias("raw"), F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed")))
    rows = rows.select("claim_id", "attempts", "waited_ms", "code", F.col("ok").alias("answered"), "enough").join(answers, "claim_id")
    made, good = F.col("enough"), F.col("enough") & F.col("answered") & F.col("ok")
    status = F.when(~made, "skipped").when(good, "ok").otherwise("error")
    message = F.when(~made, M.READ_SKIPPED).when(~F.col("answered"), report.gateway_message(F.col("code"))).when(~F.col("ok"), M.READ_REFUSED)
    kept = [F.when(good, F.col(c)).alias(c) for c in ("verdict", "confidence", "reasoning", "cited")]
    return rows.select("claim_id", status.alias("status"), message.alias("message"), F.when(made, F.col("attempts")).otherwise(0).alias("attempts"), F.when(made, F.col("waited_ms")).otherwise(0).alias("waited_ms"), *kept, F.when(made & F.col("answered"), F.col("reason")).alias("reason"))
