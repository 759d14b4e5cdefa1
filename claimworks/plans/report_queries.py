"""Queries of reports, stored records, account rules and the walk along a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimworks.functions import lexicon as L
from claimworks.functions import messages as M
from claimworks.operators import access, planner, report, verification
from claimworks.operators import evidence as E
from claimworks.operators import records as R
from claimworks.plans import detect_queries as DQ
from claimworks.plans import detect_sql as S
from claimworks.plans import evidence_queries as EQ
from claimworks.plans import planner_queries as PQ
from claimworks.plans import record_queries as RQ
from claimworks.sources import services, shared, stored
from claimworks.sources.tables import CLAIMS_SQL, claims, quoted, read, sql_list
from claimworks.streaming import feed, sink

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def strings(column: str):
    return F.array_join(column, "|").alias(column)


add("notices", lambda s, d: DQ._signals(s, d).select("claim_id", report.notices().alias("notices")).select("claim_id", strings("notices")), f"{S.SIGNALS} SELECT claim_id, concat_ws('|', CASE WHEN language = 'non-english' THEN {quoted(M.NOT_ENGLISH)} END, CASE WHEN debunk THEN {quoted(M.DEBUNKS)} END) AS notices FROM d4")

_BY_WEIGHT = "list_transform(list_sort(list_transform(sensational, lambda t, i: {'w': -t.weight, 'i': i, 't': t.term}))[1:6], lambda x: x.t)"
_PRESSURE = "list_concat(urgency, list_filter(forward, lambda t: NOT list_contains(urgency, t)))"
_PLURAL = lambda c, noun: f"len({c}) || ' {noun}' || CASE WHEN len({c}) = 1 THEN '' ELSE 's' END"
_CASES = {
    "sensational": ("len(sensational) > 0", f"{_PLURAL('sensational', 'sensational term')} || {quoted(M.DETECTED)}", _BY_WEIGHT),
    "attribution": ("attribution <> ''", quoted(M.DETAILS["attribution"][0]), "string_split(attribution, '|')[1:6]"),
    "emotion": ("len(emotion) > 0", quoted(M.DETAILS["emotion"][0]), "emotion[1:6]"),
    "urgency": ("len(urgency) + len(forward) > 0", quoted(M.DETAILS["urgency"][0]), f"({_PRESSURE})[1:6]"),
    "specificity": ("len(numbers) + len(dates) > 0", f"{_PLURAL('numbers', 'figure')} || ' and ' || {_PLURAL('dates', 'date')} || {quoted(M.CHECKABLE)}", "list_concat(numbers[1:4], dates[1:2])"),
    "style": ("caps > 0.2 OR bangs > 2", quoted(M.DETAILS["style"][0]), f"[floor(caps * 100 + 0.5)::INTEGER || {quoted(M.UPPERCASE)}, bangs || {quoted(M.MARKS)}]"),
    "clickbait": ("len(clickbait) > 0", quoted(M.DETAILS["clickbait"][0]), "clickbait[1:4]"),
    "corroboration": ("false", "''", "[]"),
}
_NAMED = f"WHEN len(bodies) > 0 THEN {quoted(M.ONLY_NAMED)} "
_REPORTS = " UNION ALL ".join(f"SELECT claim_id, {quoted(a)} AS aspect, CASE WHEN {c} THEN {yes} {_NAMED if a == 'attribution' else ''}ELSE {quoted(M.DETAILS[a][1])} END AS detail, array_to_string({items}, '|') AS evidence FROM ra" for a, (c, yes, items) in _CASES.items())
add("aspect_reports", lambda s, d: report.aspect_reports(DQ._scores(s, d)).select("claim_id", "aspect", "detail", strings("evidence")), f"{S.SCORES}{S.ATTRIBUTION[len(S.SIGNALS):]}, ra AS (SELECT r.*, coalesce(att.attribution, '') AS attribution FROM r LEFT JOIN att ON att.claim_id = r.claim_id) {_REPORTS}")


def reasons(spark, d) -> DataFrame:
    """Reviews come from a claim's facts, at most eight."""
    bucket = F.col("rating_bucket")
    of = lambda kinds, name: F.array_sort(F.collect_list(F.when(bucket.isin(kinds), F.struct("n", "publisher", "rating")))).alias(name)
    f = EQ.facts(spark, d).groupBy("claim_id").agg(of(["false", "misleading"], "negative"), of(["true"], "positive"), of(["mixed"], "mixed"))
    c = E.corroborating(EQ.news(spark, d)).select("claim_id", "domains")
    g = EQ.answers(spark, d).select("claim_id", F.col("verdict").alias("opinion"))
    rows = DQ._scores(spark, d).select("claim_id", "language_risk").join(f, "claim_id", "left").join(c, "claim_id", "left").join(g, "claim_id", "left")
    return report.reasons(rows)


_LEAD, _WHOLE, _PARTLY = map(quoted, M.RATED)
_RATED = lambda kinds, end, name: f"list(publisher || {_LEAD} || rating || {end} ORDER BY n) FILTER (WHERE rating_bucket IN ({kinds})) AS {name}"
_IF = lambda c, t: f"CASE WHEN {c} THEN {t} END"
_LOUD = _IF("language_risk = 'high'", quoted(M.LOUD))
_JOIN = lambda c: f"array_to_string({c}, '|')"
_ALL = {
    "a": f"concat_ws('|', {_JOIN('negs')}, {_IF('pos > 0', quoted(M.OTHERS_TRUE))}, {_IF('op = {}'.format(quoted('supported')), quoted(M.READ_SUPPORTS))}, {_LOUD})",
    "credible": f"concat_ws('|', CASE WHEN pos > 0 THEN {_JOIN('poss')} ELSE {quoted(M.OUTLETS[0])} || dom || {quoted(M.OUTLETS[1])} || array_to_string(domains, ', ') || {quoted(M.OUTLETS[2])} END, {_IF('op = {}'.format(quoted('contradicted')), quoted(M.READ_CONFLICTS))}, {_IF('op = {}'.format(quoted('supported')), quoted(M.READ_AGREES))})",
    "f": f"concat_ws('|', {_JOIN('mixs')}, {_IF('dom = 1', f'{quoted(M.ONE_OUTLET[0])} || domains[1] || {quoted(M.ONE_OUTLET[1])}')}, {_LOUD})",
}
_STEPS = {k: quoted("|".join(v)) for k, v in M.STEPS.items()}
_HEAD = " ".join(f"WHEN {quoted(k)} THEN {quoted(t)}" for k, t in M.HEADLINES.items())
REASONS = f"""{EQ.DECIDE}{S.SCORES[len(S.SIGNALS):]},
fr AS (SELECT claim_id, {_RATED("'false', 'misleading'", _WHOLE, "negs")}, {_RATED("'true'", _WHOLE, "poss")}, {_RATED("'mixed'", _PARTLY, "mixs")} FROM fc GROUP BY claim_id),
rs AS (SELECT r.claim_id, language_risk, neg, pos, mix, dom, coalesce(opinion, '') AS op, negs, poss, mixs, domains, CASE WHEN neg > 0 THEN 'a' WHEN (pos > 0 OR dom >= 2 AND mix = 0) AND opinion IS NOT DISTINCT FROM 'contradicted' THEN 'back' WHEN pos > 0 THEN 'b' WHEN dom >= 2 AND mix = 0 THEN 'c' ELSE 'f' END AS rule
  FROM r JOIN de ON de.claim_id = r.claim_id LEFT JOIN fr ON fr.claim_id = r.claim_id LEFT JOIN co ON co.claim_id = r.claim_id)
SELECT claim_id, CASE rule {_HEAD} END AS headline, CASE WHEN rule = 'a' THEN {_ALL['a']} WHEN rule = 'f' THEN {_ALL['f']} ELSE {_ALL['credible']} END AS reasons, CASE WHEN rule = 'a' THEN {_STEPS['a']} WHEN rule IN ('b', 'c') THEN {_STEPS['credible']} ELSE {_STEPS['f']} END AS next_steps FROM rs"""
add("decide_reasons", lambda s, d: reasons(s, d).select("claim_id", "headline", strings("reasons"), strings("next_steps")), REASONS)


def agreed(spark, d) -> DataFrame:
    said = EQ.opinions(spark, d).select("claim_id", F.col("verdict").alias("said"))
    return DQ._scores(spark, d).select("claim_id", "verdict").join(said, "claim_id", "left").select("claim_id", report.agree(F.col("verdict"), F.col("said")).alias("agree"))


_AGREE = f"""{S.SCORES.replace("WITH", "WITH RECURSIVE", 1)}, {EQ.PAGES}, {EQ.SAID}, {EQ.OPINION}, ao AS (SELECT r.claim_id, r.verdict AS v, CASE WHEN code = 200 THEN op.verdict END AS o FROM r LEFT JOIN op ON op.claim_id = r.claim_id)
SELECT claim_id, CASE WHEN o IS NOT NULL THEN (v = 'likely-misleading' AND o = 'likely-false') OR (v = 'likely-credible' AND o = 'likely-true') OR (v = 'unverified' AND o = 'uncertain') END AS agree FROM ao"""
add("agree_flag", agreed, _AGREE)



def refused(spark, d) -> DataFrame:
    """What is said of each attempt that the model service didn't take."""
    code = F.coalesce("code", F.lit(503))
    rows = services.grounded_calls(spark, d).filter(~F.coalesce(F.col("code").between(200, 299), F.lit(False)))
    return rows.select("claim_id", "attempt", report.gateway_message(code).alias("message"))


_MESSAGES = " ".join(f"WHEN {k} THEN {quoted(t)}" for k, t in M.GATEWAY.items())
add("gateway_message", refused, f"WITH {EQ.PAGES}, {services.attempts_sql('grounded', 'ga')} SELECT i AS claim_id, attempt, CASE coalesce(code, 503) {_MESSAGES} ELSE {quoted(M.BUSY)} END AS message FROM ga WHERE code IS NULL OR code NOT BETWEEN 200 AND 299")


add("validate_evidence", lambda s, d: report.valid_evidence(EQ.items(s, d)), rf"{EQ.ITEMS} SELECT claim_id, bool_and(coalesce(regexp_full_match(id, '[FNS][0-9]{{1,2}}') AND kind IN ('fact-check', 'article', 'official-source') AND length(text) <= 600, false)) AND count(*) <= 30 AS valid FROM it GROUP BY claim_id")
_CLEAN = lambda c: rf"trim(regexp_replace(regexp_replace({c}, '[<>]', '', 'g'), '\s+', ' ', 'g'))"
_LINE = f"'[' || id || '] (' || kind || ') ' || {_CLEAN('text')}"
add("build_prompt", lambda s, d: report.prompts(claims(s, d), EQ.items(s, d)), f"""{EQ.ITEMS}, bl AS (SELECT claim_id, string_agg({_LINE}, chr(10) ORDER BY position(left(id, 1) IN 'FNS'), substr(id, 2)::INTEGER) AS block FROM it GROUP BY claim_id)
SELECT c.claim_id, '<claim>' || chr(10) || {_CLEAN('c.text')} || chr(10) || '</claim>' || chr(10) || chr(10) || '<evidence>' || chr(10) || coalesce(block, '(no evidence items)') || chr(10) || '</evidence>' AS prompt FROM claims c LEFT JOIN bl ON bl.claim_id = c.claim_id""")

KINDS = ["data:image/png;base64,", "data:IMAGE/WebP;base64,", "data:image/gif;base64,", "http://image/png;base64,"]
_SMALL = 1500
_IMAGE = f"""WITH im AS (SELECT page_id, {sql_list(KINDS)}[page_id % 4 + 1] || coalesce(html, '') AS u FROM pages)
SELECT page_id, CASE WHEN NOT starts_with(u, 'data:') THEN 'no-data-url' WHEN NOT list_contains({sql_list(M.IMAGES)}, lower(string_split(substr(u, 6), ';')[1])) THEN 'type' WHEN floor((length(u) - position(',' IN u)) * 0.75) > {_SMALL} THEN 'size' ELSE 'ok' END AS status FROM im"""
add("img_guard", lambda s, d: read(s, d, "pages").select("page_id", report.image_status(F.concat(EQ.pick(KINDS, F.col("page_id")), F.coalesce("html", F.lit(""))), _SMALL).alias("status")), _IMAGE)


def lines(spark, d) -> DataFrame:
    """Labelled claims as JSON lines; some blank, some cut off, some TODO."""
    i = F.col("claim_id")
    label = EQ.pick(["false", "true", "unverifiable", "other"], i)
    whole = F.to_json(F.struct(F.when(i % 10 == 0, "TODO").otherwise(F.col("text")).alias("text"), label.alias("label")))
    return claims(spark, d).select(F.when(i % 7 == 0, " ").when(i % 11 == 0, F.left(whole, F.lit(9))).otherwise(whole).alias("value"))


add("scan_eval_jsonl", lambda s, d: stored.labelled(lines(s, d)), f"WITH {CLAIMS_SQL} SELECT text, ['false', 'true', 'unverifiable', 'other'][claim_id % 4 + 1] AS label FROM claims WHERE claim_id % 7 <> 0 AND claim_id % 11 <> 0 AND claim_id % 10 <> 0 AND claim_id % 4 <> 3")


def stored_values(spark, d) -> DataFrame:
    """Each claim as a stored array of one record; a third has a verdict, some are cut off."""
    i = F.col("claim_id")
    record = F.struct(i.alias("id"), "text", (i % 9 == 0).alias("sample"), F.when(i % 3 == 0, F.struct(F.lit("checked").alias("verdict"))).alias("result"))
    value = F.to_json(F.array(record))
    return claims(spark, d).select(F.when(i % 13 == 0, F.left(value, F.lit(12))).otherwise(value).alias("value"))


add("scan_local_store", lambda s, d: stored.records(stored_values(s, d)).select(F.col("id").alias("claim_id"), "sample", "verdict"), f"{S.SCORES} SELECT claim_id, claim_id % 9 = 0 AS sample, CASE WHEN claim_id % 3 = 0 THEN 'checked' ELSE verdict END AS verdict FROM r WHERE claim_id % 13 <> 0")


def log(spark, d) -> DataFrame:
    i = F.col("claim_id")
    return claims(spark, d).select(F.when((i % 9 == 0) & (i < 30), EQ.pick(M.SAMPLES, i)).otherwise(F.col("text")).alias("text"), (i % 9 == 0).alias("sample"), (i % 1000).cast("int").alias("minutes"))


_LOG = f"lo AS (SELECT CASE WHEN claim_id % 9 = 0 AND claim_id < 30 THEN {sql_list(M.SAMPLES)}[claim_id % {len(M.SAMPLES)} + 1] ELSE text END AS text, claim_id % 9 = 0 AS sample, (claim_id % 1000)::INTEGER AS minutes FROM claims)"
add("load_samples", lambda s, d: stored.with_samples(log(s, d)), f"WITH {CLAIMS_SQL}, {_LOG}, se AS (SELECT {sql_list(M.SAMPLES)}[i] AS text, (450 * i)::INTEGER AS minutes FROM (SELECT unnest(range(1, {len(M.SAMPLES) + 1})) AS i)) SELECT text, true AS sample, minutes FROM se WHERE text NOT IN (SELECT text FROM lo WHERE sample) UNION ALL SELECT text, sample, minutes FROM lo")
add("saved_picker", lambda s, d: R.newest(RQ.records(s, d), 1, 20).select("place", F.left("text", F.lit(70)).alias("label")), f"{RQ.RECORDS} SELECT row_number() OVER (ORDER BY at_ DESC, claim_id DESC)::INTEGER AS place, left(text, 70) AS label FROM re ORDER BY place LIMIT 20")
add("record_change_feed", lambda s, d: feed.scored(claims(s, d)), f"{S.SCORES} SELECT claim_id, risk_score, language_risk, verdict, language FROM r")


def profiles(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"), (F.col("c_custkey") % 4 != 0).alias("is_active"))


def roles(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 10 == 0, "ADMIN").otherwise("USER").alias("role"))


def audit(spark, d) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("admin_id"))


ACCOUNTS = "pf AS (SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.org' AS email, c_custkey % 4 <> 0 AS is_active FROM customer), ro AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 = 0 THEN 'ADMIN' ELSE 'USER' END AS role FROM customer)"
_ADMIN = lambda u: f"EXISTS (SELECT 1 FROM ro WHERE user_id = {u} AND role = 'ADMIN')"
add("has_role", lambda s, d: access.has_role(roles(s, d), 10, "ADMIN").unionByName(access.has_role(roles(s, d), 7, "ADMIN")), f"WITH {ACCOUNTS} SELECT user_id FROM ro WHERE user_id IN (7, 10) AND role = 'ADMIN'")
for _name, _user in (("profiles_own", 7), ("profiles_admin", 10)):
    add(_name, lambda s, d, u=_user: access.own_or_admin(profiles(s, d), "id", roles(s, d), u), f"WITH {ACCOUNTS} SELECT * FROM pf WHERE id = {_user} OR {_ADMIN(_user)}")
    add(_name.replace("profiles", "roles"), lambda s, d, u=_user: access.own_or_admin(roles(s, d), "user_id", roles(s, d), u), f"WITH {ACCOUNTS} SELECT * FROM ro WHERE user_id = {_user} OR {_ADMIN(_user)}")
    add(_name.replace("profiles", "audit"), lambda s, d, u=_user: access.if_admin(audit(s, d), roles(s, d), u), f"WITH {ACCOUNTS} SELECT o_orderkey AS id, o_custkey AS admin_id FROM orders WHERE {_ADMIN(_user)}")


def predicted(spark, d) -> DataFrame:
    """Submissions with their prediction, if there is one: orders and their first lines."""
    submissions = read(spark, d, "orders").select(F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("user_id"))
    predictions = read(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("submission_id"), F.when(F.col("l_returnflag") == "R", "FAKE").otherwise("REAL").alias("label"))
    return submissions.join(predictions, "submission_id", "left")


add("submissions_predictions", predicted, "SELECT o_orderkey AS submission_id, o_custkey AS user_id, CASE WHEN l_orderkey IS NOT NULL THEN CASE WHEN l_returnflag = 'R' THEN 'FAKE' ELSE 'REAL' END END AS label FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1")


def bootstrapped(spark, d) -> DataFrame:
    p, r = access.bootstrap_user(profiles(spark, d), roles(spark, d), -1, "  ", "new.user@example.org", "admin@example.org")
    return p.join(r, F.col("id") == F.col("user_id")).select("id", "name", "email", "is_active", "role")


add("bootstrap_current_user", bootstrapped, f"WITH {ACCOUNTS} SELECT id, name, email, is_active, role FROM pf JOIN ro ON id = user_id UNION ALL SELECT -1, 'new.user', 'new.user@example.org', true, 'USER'")


def switched(spark, d) -> DataFrame:
    """An administrator deactivates user 5; user 7, who is none, can't deactivate user 6."""
    p, a = access.set_user_status(profiles(spark, d), roles(spark, d), 10, 5, False)
    p, b = access.set_user_status(p, roles(spark, d), 7, 6, False)
    return p.join(a.unionByName(b).withColumnRenamed("target_user_id", "id"), "id", "left").select("id", "is_active", "admin_id", "action")


add("admin_set_user_status", switched, f"WITH {ACCOUNTS} SELECT id, CASE WHEN id = 5 THEN false ELSE is_active END AS is_active, CASE WHEN id = 5 THEN 10 END AS admin_id, CASE WHEN id = 5 THEN 'DEACTIVATE_USER' END AS action FROM pf")


def walk(spark, d) -> DataFrame:
    """g, h and f after each check of a plan in run order, from the start (pos 0)."""
    own = PQ.distinct(spark, d)
    plans = planner.cheapest(own)
    run = planner.order_plan(plans)
    order = Window.partitionBy("gains").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    steps = run.select("gains", "pos", F.sum(F.expr("shiftleft(1, idx)")).over(order).cast("int").alias("mask"), F.col("cost_so_far").alias("g"))
    start = plans.select("gains", F.lit(0).alias("pos"), F.lit(0).alias("mask"), F.lit(0).cast("long").alias("g"))
    bound = planner.heuristic(planner.states(own)).select("gains", "mask", "evidence", "h")
    rows = PQ.text(start.unionByName(steps).join(bound, ["gains", "mask"]))
    return rows.select("gains", "pos", "mask", "g", "evidence", F.round("h", 6).alias("h"), F.round(F.col("g") + F.col("h"), 6).alias("f"))


_WALK = f"""{PQ._H}, pl AS (SELECT gains, g, mask FROM (SELECT *, row_number() OVER (PARTITION BY gains ORDER BY cost, size, rank DESC) AS k FROM sg WHERE goal) WHERE k = 1),
pc AS (SELECT gains, i - 1 AS idx, g[i] AS gain, {L.COSTS}[i] AS cost FROM (SELECT gains, g, mask, unnest(range(1, {planner.N + 1})) AS i FROM pl) WHERE (mask >> (i - 1)) & 1 = 1),
ws AS (SELECT gains, row_number() OVER ({PQ._ORDER})::INTEGER AS pos, (sum(1 << idx) OVER ({PQ._ORDER} ROWS UNBOUNDED PRECEDING))::INTEGER AS mask, sum(cost) OVER ({PQ._ORDER} ROWS UNBOUNDED PRECEDING)::BIGINT AS g FROM pc UNION ALL SELECT gains, 0, 0, 0 FROM pl)
SELECT ws.gains, ws.pos, ws.mask, ws.g, sg.evidence::INTEGER AS evidence, round(coalesce(hh.h, 'inf'::DOUBLE)::DOUBLE, 6) AS h, round((ws.g + coalesce(hh.h, 'inf'::DOUBLE))::DOUBLE, 6) AS f FROM ws JOIN sg ON sg.gains = ws.gains AND sg.mask = ws.mask JOIN hh ON hh.gains = ws.gains AND hh.mask = ws.mask"""
add("walk_ghf", walk, _WALK)

# The whole report: what the plan runs, and what follows from what it gathered.

#: A threshold that takes all three services into many plans.
_SHARE = 0.9


def reports(spark, d) -> DataFrame:
    """claim_id and the structs of verification.reports."""
    scored = planner.traits(DQ._scores(spark, d))
    scored = shared.table(scored.select("claim_id", "language_risk", planner.gains().alias("gains")), "scored")
    own = shared.table(planner.needs(scored.select("gains").distinct(), _SHARE), "problems")
    ran = verification.executed(own, planner.cheapest(own))
    return verification.reports(scored, scored, ran, claims(spark, d), services.factcheck_calls(spark, d), services.news_calls(spark, d), services.grounded_calls(spark, d), EQ.sources(spark, d), EQ.OUTLETS)


def report_rows(spark, d) -> DataFrame:
    """The same as plain columns."""
    steps = F.array_join(F.transform("plan.plan", lambda s: F.concat(s["id"], F.lit(":"), s["status"])), "|")
    return reports(spark, d).select(
        "claim_id", "decision.verdict", "decision.confidence", "decision.rule", F.col("fact_check.status").alias("fact_status"), F.col("fact_check.records").alias("records"), F.col("news.status").alias("news_status"), F.col("news.articles").alias("articles"),
        F.col("gemini.status").alias("read_status"), F.col("gemini.message").alias("read_message"), steps.alias("plan"), F.array_join("plan.executed", "|").alias("executed"), F.array_join("plan.skipped", "|").alias("skipped"),
        "plan.total_cost", "plan.cost_if_all", "plan.checks_total", "plan.threshold", "plan.evidence",
    )


_LABEL = f"{sql_list(L.LABELS)}[idx + 1]"
_RUN_PLANS = PQ.PLANS[len(S.SCORES) + 2 :].replace(f"* {round(L.TAU * planner.SCALE)} AS need", f"* {round(_SHARE * planner.SCALE)} AS need")
_SEES = lambda i: f"coalesce(min(pos) FILTER (WHERE idx = {i} AND ran) < min(pos) FILTER (WHERE idx = 10 AND ran), false)"
_RUNS = lambda i: f"coalesce(bool_or(idx = {i} AND ran), false)"
_SHOWN = EQ.GROUNDED.replace("FROM it GROUP BY", "FROM iv GROUP BY")
REPORT = f"""{EQ.with_(*EQ._ITEMS)}{S.SCORES[len(S.SIGNALS):]}, {_RUN_PLANS},
rn AS (SELECT pc.gains, idx, cost, gain, row_number() OVER ({PQ._ORDER}) AS pos, sum(gain) OVER ({PQ._ORDER} ROWS UNBOUNDED PRECEDING) - gain AS before FROM pc),
rr AS (SELECT rn.*, before * {planner.SCALE} < need AS ran FROM rn JOIN dp ON dp.gains = rn.gains),
rp AS (SELECT gains, string_agg({sql_list(L.CHECKS)}[idx + 1] || CASE WHEN ran THEN ':run' ELSE ':stopped-early' END, '|' ORDER BY pos) AS plan, string_agg({_LABEL}, '|' ORDER BY pos) FILTER (WHERE ran) AS executed, list({_LABEL} ORDER BY pos) FILTER (WHERE NOT ran) AS stopped, list(idx) AS inside,
  sum(cost) FILTER (WHERE ran) AS total_cost, sum(gain) FILTER (WHERE ran) / 100 AS evidence, {_RUNS(8)} AS runs_f, {_RUNS(9)} AS runs_n, {_RUNS(10)} AS runs_g, {_SEES(8)} AS sees_f, {_SEES(9)} AS sees_n FROM rr GROUP BY gains),
rc AS (SELECT pb.claim_id, pb.need, rp.*, list_concat(list_transform(list_filter(range(0, {planner.N}), lambda i: NOT list_contains(inside, i)), lambda i: {sql_list(L.LABELS)}[i + 1]), coalesce(stopped, [])) AS skipped FROM pb JOIN rp ON rp.gains = pb.gains),
iv AS (SELECT it.* FROM it JOIN rc ON rc.claim_id = it.claim_id WHERE kind = 'official-source' OR kind = 'fact-check' AND sees_f OR kind = 'article' AND sees_n),
{EQ.ASKED}, {_SHOWN},
rk AS (SELECT claim_id, count(*) AS records, count(*) FILTER (WHERE rating_bucket IN ('false', 'misleading')) AS neg, count(*) FILTER (WHERE rating_bucket = 'true') AS pos, count(*) FILTER (WHERE rating_bucket = 'mixed') AS mix FROM fc GROUP BY claim_id),
ra AS (SELECT claim_id, count(*) AS articles FROM nw GROUP BY claim_id),
rd AS (SELECT rc.*, r.language_risk, CASE WHEN runs_f THEN coalesce(records, 0) ELSE 0 END AS records, CASE WHEN runs_f THEN coalesce(neg, 0) ELSE 0 END AS neg, CASE WHEN runs_f THEN coalesce(rk.pos, 0) ELSE 0 END AS pos, CASE WHEN runs_f THEN coalesce(mix, 0) ELSE 0 END AS mix,
  CASE WHEN runs_n THEN coalesce(articles, 0) ELSE 0 END AS articles, CASE WHEN runs_n THEN coalesce(len(domains), 0) ELSE 0 END AS dom, coalesce(al.enough, false) AS shown, coalesce(answered, false) AS answered, coalesce(gr.code, 503) AS code, gr.claim_id IS NOT NULL AND gr.reason IS NULL AND answered AS good, gr.v,
  CASE WHEN runs_f THEN coalesce(fs.status, 'error') ELSE 'skipped' END AS fact_status, CASE WHEN runs_n THEN ns.status ELSE 'skipped' END AS news_status
  FROM rc JOIN r ON r.claim_id = rc.claim_id LEFT JOIN rk ON rk.claim_id = rc.claim_id LEFT JOIN ra ON ra.claim_id = rc.claim_id LEFT JOIN co ON co.claim_id = rc.claim_id LEFT JOIN al ON al.claim_id = rc.claim_id LEFT JOIN gr ON gr.claim_id = rc.claim_id LEFT JOIN fs ON fs.i = rc.claim_id LEFT JOIN ns ON ns.i = rc.claim_id),
re AS (SELECT *, CASE WHEN runs_g AND shown AND good THEN v END AS opinion FROM rd),
ru AS (SELECT *, {EQ._RULE} AS rule FROM re)
SELECT claim_id, {EQ._OUTCOME}, fact_status, records, news_status, articles, CASE WHEN NOT runs_g OR NOT shown THEN 'skipped' WHEN good THEN 'ok' ELSE 'error' END AS read_status,
  CASE WHEN NOT runs_g THEN {quoted(M.PLAN_SKIPPED)} WHEN NOT shown THEN {quoted(M.READ_SKIPPED)} WHEN good THEN NULL WHEN answered THEN {quoted(M.READ_REFUSED)} ELSE CASE code {_MESSAGES} ELSE {quoted(M.BUSY)} END END AS read_message,
  plan, executed, array_to_string(skipped, '|') AS skipped, total_cost::BIGINT AS total_cost, {sum(L.COSTS)} AS cost_if_all, {planner.N} AS checks_total, round(need / {100 * planner.SCALE}, 2) AS threshold, evidence FROM ru"""
add("plan_report", report_rows, REPORT)


def with_images(spark, d) -> DataFrame:
    """Stored records, every third with an image that is about as large as its text."""
    i = F.col("claim_id")
    image = F.when(i % 3 == 0, F.concat(F.lit("data:image/png;base64,"), F.col("text")))
    return RQ.records(spark, d).select(i.cast("string").alias("id"), "text", F.timestamp_seconds("at").alias("submitted_at"), F.col("label").alias("verdict"), image.alias("image"))


_QUOTA = 600_000


def kept(spark, d) -> DataFrame:
    """What the store keeps of them, and how: nothing where even bare records are too large."""
    rows, how = sink.saved(with_images(spark, d), most_bytes=_QUOTA)
    rows = with_images(spark, d).limit(0) if rows is None else rows
    return rows.select("id", F.col("image").isNotNull().alias("has_image"), F.lit(how).alias("saved"))


add("sink_fallback", kept, f"""{RQ.RECORDS}, hd AS (SELECT claim_id::VARCHAR AS id, text, label, CASE WHEN claim_id % 3 = 0 THEN 'data:image/png;base64,' || text END AS image FROM re ORDER BY at_ DESC, claim_id::VARCHAR DESC LIMIT 200),
hs AS (SELECT sum(strlen(id) + strlen(text) + strlen(label)) AS bare, sum(strlen(id) + strlen(text) + strlen(label) + coalesce(strlen(image), 0)) AS whole FROM hd)
SELECT id, image IS NOT NULL AND whole <= {_QUOTA} AS has_image, CASE WHEN whole <= {_QUOTA} THEN 'whole' ELSE 'without-images' END AS saved FROM hd, hs WHERE bare <= {_QUOTA}""")
