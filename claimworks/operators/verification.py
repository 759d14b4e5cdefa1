"""The verification report of a claim: its plan, what was run of it, the evidence that this gathered,
and the decision.

A check sees what was gathered before its place in the run order. Which checks run follows from the
claim's problem alone, so that is worked out for distinct problems and joined to the claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimworks.functions import lexicon as L
from claimworks.functions import messages as M
from claimworks.operators import evidence as E
from claimworks.operators import lookups, planner
from claimworks.sources import shared

EXTERNAL = L.CHECKS[8:]


def executed(distinct: DataFrame, plans: DataFrame) -> DataFrame:
    """gains, plan (array of the plan's checks in run order), executed and skipped (labels), total_cost,
    cost_if_all, checks_total, threshold, evidence, and for each external check whether it runs and
    which of the others the model comes after.

    distinct(gains, total, need), plans(gains, plan: mask). A problem has eleven checks."""
    names, labels = (F.array(*map(F.lit, x)) for x in (L.CHECKS, L.LABELS))
    rows = planner.runs(planner.order_plan(plans), distinct)
    step = F.struct("pos", F.get(names, F.col("idx")).alias("id"), F.get(labels, F.col("idx")).alias("label"), "cost", (F.col("gain") / 100).alias("gain"), F.get(names, F.col("idx")).isin(EXTERNAL).alias("estimated"), "status", "idx")
    ran = F.col("status") == "run"
    found = rows.groupBy("gains").agg(F.array_sort(F.collect_list(step)).alias("plan"), F.sum(F.when(ran, F.col("cost"))).alias("total_cost"), F.sum(F.when(ran, F.col("gain"))).alias("evidence"), F.first("need").alias("need"))
    of = lambda status: F.filter("plan", lambda s: s["status"] == status)
    label = lambda steps: F.transform(steps, lambda s: s["label"])
    outside = F.filter(labels, lambda x: ~F.array_contains(label(F.col("plan")), x))
    at = lambda check: F.array_position(F.transform(of("run"), lambda s: s["id"]), check)
    return found.select(
        "gains", "plan", label(of("run")).alias("executed"), F.concat(outside, label(of("stopped-early"))).alias("skipped"), F.coalesce("total_cost", F.lit(0)).alias("total_cost"), F.lit(sum(L.COSTS)).alias("cost_if_all"), F.lit(planner.N).alias("checks_total"),
        F.round(F.col("need") / (100 * planner.SCALE), 2).alias("threshold"), (F.coalesce("evidence", F.lit(0)) / 100).alias("evidence"), *[(at(c) > 0).alias(f"runs_{c}") for c in EXTERNAL],
        *[((at(c) > 0) & (at(c) < at("gemini"))).alias(f"sees_{c}") for c in EXTERNAL[:2]],
    )


def _lookup(run: Column, status: str, message: str, late: str, **more: Column) -> Column:
    """A lookup's part of the report; a check that isn't run is skipped by the plan."""
    found = F.coalesce(F.col(status), F.lit("error"))
    said = F.when(~run, M.PLAN_SKIPPED).when(F.col(status).isNull(), late).otherwise(F.col(message))
    return F.struct(F.when(run, found).otherwise("skipped").alias("status"), said.alias("message"), *[c.alias(n) for n, c in more.items()])


def reports(scored: DataFrame, problems: DataFrame, ran: DataFrame, claims: DataFrame, fact_calls: DataFrame, news_calls: DataFrame, model_calls: DataFrame, sources: DataFrame, outlets=tuple(L.OUTLETS)) -> DataFrame:
    """claim_id, decision, language_risk, fact_check, news, gemini, official_sources, plan: structs.

    scored(claim_id, language_risk), problems(claim_id, gains), ran: see executed; claims(claim_id,
    text); the three tables of calls: see lookups; sources(claim_id, rank, name, url). A service that
    has no call for a claim hasn't answered it. A claim's fact-checks and articles count only if the
    plan ran the lookup; the model sees those that were gathered before its place."""
    run = shared.table(problems.select("claim_id", "gains").join(ran, "gains").drop("gains"), "runs")
    sources = shared.table(sources, "sources")
    of = lambda rows, flag: rows.join(run.filter(flag).select("claim_id"), "claim_id", "left_semi")
    looked, searched = shared.table(lookups.fact_checks(fact_calls), "fact-checks"), shared.table(lookups.news(news_calls, claims), "news")
    facts = shared.table(E.normalise_claims(lookups.reviews(looked)), "facts")
    articles = shared.table(E.rank_news(lookups.articles(searched), claims, outlets), "articles")

    seen = E.evidence_items(of(facts, "sees_factcheck"), of(articles, "sees_news"), sources).select("claim_id", "id", "kind")
    asked = of(claims.select("claim_id"), "runs_gemini")
    silent = asked.join(model_calls, "claim_id", "left_anti").select("claim_id", F.lit(0).alias("attempt"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("string").alias("body"))
    read = lookups.grounded(of(model_calls, "runs_gemini").unionByName(silent), seen)
    read = read.select("claim_id", F.col("status").alias("read_status"), F.col("message").alias("read_message"), F.col("verdict").alias("opinion"), "confidence", "cited")

    # At most eight of each a claim.
    kinds = {"negative": ("false", "misleading"), "positive": ("true",), "mixed": ("mixed",)}
    gathered = of(facts, "runs_factcheck").groupBy("claim_id").agg(F.count("*").alias("records"), *[F.count_if(F.col("rating_bucket").isin(*v)).alias(k) for k, v in kinds.items()])
    told = of(articles, "runs_news").groupBy("claim_id").agg(F.count("*").alias("articles"))
    outlet = E.corroborating(of(articles, "runs_news")).select("claim_id", F.col("domains").alias("outlets"))
    listed = sources.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "url"))).alias("official_sources"))

    rows = scored.select("claim_id", "language_risk").join(run, "claim_id")
    for side in (looked.select("claim_id", F.col("status").alias("fact_status"), F.col("message").alias("fact_message")), searched.select("claim_id", "window_days", F.col("status").alias("news_status"), F.col("message").alias("news_message")), read, gathered, told, outlet, listed):
        rows = rows.join(side, "claim_id", "left")
    rows = rows.withColumn("domains", F.greatest(F.size("outlets"), F.lit(0))).na.fill(0, ["negative", "positive", "mixed", "domains", "records", "articles"])
    decision = F.struct(*[c.alias(n) for n, c in E.outcome().items()])
    plan = F.struct("plan", "executed", "skipped", "total_cost", "cost_if_all", "checks_total", "threshold", "evidence")
    return rows.select(
        "claim_id", decision.alias("decision"), "language_risk", _lookup(F.col("runs_factcheck"), "fact_status", "fact_message", M.FACTS_LATE, records=F.col("records")).alias("fact_check"),
        _lookup(F.col("runs_news"), "news_status", "news_message", M.NEWS_LATE, window_days=F.when(F.col("runs_news"), F.col("window_days")).otherwise(0), articles=F.col("articles"), outlets=F.coalesce("outlets", F.array().cast("array<string>"))).alias("news"),
        _lookup(F.col("runs_gemini"), "read_status", "read_message", M.BUSY, verdict=F.col("opinion"), confidence=F.when(F.col("opinion").isNotNull(), F.col("confidence")), cited=F.col("cited")).alias("gemini"),
        "official_sources", plan.alias("plan"),
    )
