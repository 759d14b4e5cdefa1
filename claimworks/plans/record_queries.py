"""Queries over the log of scored claims, the rate limiter and the access rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.functions import lexicon as L
from claimworks.functions import text as X
from claimworks.operators import detect as D
from claimworks.operators import evidence as E
from claimworks.operators import records as R
from claimworks.plans import detect_queries as DQ
from claimworks.plans import detect_sql as S
from claimworks.plans import evidence_queries as EQ
from claimworks.sources.tables import quoted, read
from claimworks.streaming import rate_limit

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def records(spark, d) -> DataFrame:
    # Filters on a plain column would take the whole detection into them, once for each use in it;
    # they don't go below a generator.
    s = DQ._scores(spark, d)
    label = F.explode(F.array(F.when(F.col("verdict") == "likely-misleading", "FAKE").otherwise("UNVERIFIED")))
    return s.select("claim_id", "text", label.alias("label"), (F.col("claim_id") * 7919 % 100000).alias("at"), (F.col("claim_id") % 9 == 0).alias("sample"))


RECORDS = f"{S.SCORES}, re AS (SELECT claim_id, text, CASE WHEN verdict = 'likely-misleading' THEN 'FAKE' ELSE 'UNVERIFIED' END AS label, claim_id * 7919 % 100000 AS at_, claim_id % 9 = 0 AS sample FROM r)"
_TOTALS = "SELECT count(*) AS claims, count(*) FILTER (WHERE verdict = 'likely-misleading') AS fake, count(*) FILTER (WHERE verdict <> 'likely-misleading') AS others, round(coalesce(avg(risk_score), 0), 6) AS avg_risk, count(*) FILTER (WHERE language_risk = 'high') AS high_risk FROM r"
add("dash_totals", lambda s, d: R.totals(DQ._scores(s, d)), f"{S.SCORES} {_TOTALS}")
add("dash_sample_filter", lambda s, d: records(s, d).filter(~F.coalesce("sample", F.lit(False))).select("claim_id", "label"), f"{RECORDS} SELECT claim_id, label FROM re WHERE NOT coalesce(sample, false)")
add("dash_aspect_avg", lambda s, d: R.aspect_averages(D.aspects(DQ._scores(s, d))), f"{S.ASPECTS_SQL} SELECT label, floor(avg(score) + 0.5)::INTEGER AS score FROM asp WHERE score IS NOT NULL GROUP BY label")
add("dash_topic_counts", lambda s, d: R.topic_counts(DQ._signals(s, d)), f"{S.SIGNALS}, h AS (SELECT claim_id, unnest(hits) AS h FROM d3), g AS (SELECT claim_id, h.topic AS topic, row_number() OVER (PARTITION BY claim_id ORDER BY h.hits DESC, h.ord) AS p FROM h WHERE h.hits > 0 UNION ALL SELECT claim_id, 'general', 1 FROM d3 WHERE list_sum(list_transform(hits, lambda x: x.hits)) = 0) SELECT topic, count(*) AS n FROM g GROUP BY topic ORDER BY n DESC, min(claim_id * 100 + p) LIMIT 6")
add("hist_filter", lambda s, d: R.search(records(s, d), "FAKE", " Share ").select("claim_id"), f"{RECORDS} SELECT claim_id FROM re WHERE label = 'FAKE' AND contains(lower(text), 'share')")
add("hist_page", lambda s, d: R.newest(records(s, d), 11, 20).select("claim_id", "place"), f"{RECORDS}, pg AS (SELECT claim_id, row_number() OVER (ORDER BY at_ DESC, claim_id DESC)::INTEGER AS place FROM re) SELECT * FROM pg WHERE place BETWEEN 11 AND 20")
add("sink_local_store", lambda s, d: R.newest(records(s, d), 1, 200).select("claim_id"), f"{RECORDS} SELECT claim_id FROM re ORDER BY at_ DESC, claim_id DESC LIMIT 200")
add("get_record", lambda s, d: records(s, d).filter("claim_id = 7").select("claim_id", "label"), f"{RECORDS} SELECT claim_id, label FROM re WHERE claim_id = 7")
add("list_label", lambda s, d: records(s, d).select("claim_id", F.coalesce(F.when(F.col("sample"), None).otherwise("checked"), "label").alias("label")), f"{RECORDS} SELECT claim_id, coalesce(CASE WHEN NOT sample THEN 'checked' END, label) AS label FROM re")


def patches(spark, d) -> DataFrame:
    """Patches of records: a conversation's turns, most keys several times, some for unknown records."""
    turn = F.col("turn")
    return read(spark, d, "conversations").select(F.col("conv_id").alias("claim_id"), turn, F.when(turn % 3 != 1, F.upper("role")).alias("label"), F.when(turn % 2 == 0, turn * 10).alias("at"))


def upserted(spark, d) -> DataFrame:
    return R.upsert(records(spark, d).select("claim_id", "label", "at"), patches(spark, d), "claim_id", "turn")


add("upsert_record", upserted, f"""{RECORDS}, pt AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN upper(role) END AS label, CASE WHEN turn % 2 = 0 THEN turn * 10 END AS at_ FROM conversations),
pm AS (SELECT conv_id, (list(label ORDER BY turn DESC, label DESC) FILTER (WHERE label IS NOT NULL))[1] AS label, (list(at_ ORDER BY turn DESC, at_ DESC) FILTER (WHERE at_ IS NOT NULL))[1] AS at_ FROM pt GROUP BY conv_id)
SELECT claim_id, coalesce(pm.label, re.label) AS label, coalesce(pm.at_, re.at_) AS at FROM re LEFT JOIN pm ON conv_id = claim_id""")
add("sample_anti", lambda s, d: records(s, d).join(read(s, d, "labels").select(F.col("doc_id").alias("claim_id")), "claim_id", "left_anti").select("claim_id"), f"{RECORDS} SELECT claim_id FROM re WHERE claim_id NOT IN (SELECT doc_id FROM labels)")


def evaluated(spark, d) -> DataFrame:
    actual = read(spark, d, "labels").select(F.col("doc_id").alias("claim_id"), F.when(F.col("toxic") == 1, "false").when(F.col("quality") == 1, "unverifiable").otherwise("true").alias("actual"))
    s = DQ._scores(spark, d).select("claim_id", F.when(F.col("verdict") == "likely-misleading", "false").otherwise("unverifiable").alias("predicted"))
    return R.confusion(s.join(actual, "claim_id"))


CELLS = f"""{S.SCORES}, ev AS (SELECT CASE WHEN toxic = 1 THEN 'false' WHEN quality = 1 THEN 'unverifiable' ELSE 'true' END AS actual, CASE WHEN verdict = 'likely-misleading' THEN 'false' ELSE 'unverifiable' END AS predicted FROM r JOIN labels ON doc_id = claim_id),
lb(x) AS (VALUES ('false'), ('true'), ('unverifiable')), cm AS (SELECT a.x AS actual, p.x AS predicted, count(ev.actual) AS n FROM lb a CROSS JOIN lb p LEFT JOIN ev ON ev.actual = a.x AND ev.predicted = p.x GROUP BY a.x, p.x)"""
add("confusion_matrix", evaluated, f"{CELLS} SELECT * FROM cm")
add("per_class_metrics", lambda s, d: R.class_metrics(evaluated(s, d)), f"{CELLS}, t AS (SELECT x AS label, (SELECT sum(n) FROM cm WHERE actual = x AND predicted = x) AS tp, (SELECT sum(n) FROM cm WHERE predicted = x) AS np, (SELECT sum(n) FROM cm WHERE actual = x) AS na FROM lb) SELECT label, CASE WHEN np > 0 THEN round((100.0 * tp / np)::DOUBLE, 1)::VARCHAR || '%' ELSE 'n/a' END AS precision, CASE WHEN na > 0 THEN round((100.0 * tp / na)::DOUBLE, 1)::VARCHAR || '%' ELSE 'n/a' END AS recall FROM t")
add("accuracy_baseline", lambda s, d: R.accuracy(evaluated(s, d)), f"{CELLS} SELECT sum(n) FILTER (WHERE actual = predicted)::BIGINT AS \"right\", sum(n)::BIGINT AS total, round(sum(n) FILTER (WHERE actual = predicted)::DOUBLE / sum(n), 6) AS accuracy, round((SELECT max(k) FROM (SELECT sum(n) AS k FROM cm GROUP BY actual))::DOUBLE / sum(n), 6) AS baseline FROM cm")
_LIMIT, _WINDOW = L.LIMITS["extract"], 3600
_LIMITED = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT event_id, user_id, n, t, t + {_WINDOW}000000 AS reset, 1 AS c, true AS ok FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, e.t, CASE WHEN e.t >= w.reset THEN e.t + {_WINDOW}000000 ELSE w.reset END, CASE WHEN e.t >= w.reset THEN 1 WHEN w.c < {_LIMIT} THEN w.c + 1 ELSE w.c END, e.t >= w.reset OR w.c < {_LIMIT}
  FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT event_id, ok, CASE WHEN NOT ok THEN CAST(ceil((reset - t) / 1000000.0) AS INTEGER) END AS retry_after FROM w"""
add("rate_limit", lambda s, d: rate_limit.limited(read(s, d, "events"), _LIMIT, _WINDOW).select("event_id", "ok", "retry_after"), _LIMITED)


ACTIONS = {"view": "predict", "click": "verify", "signup": "ground", "error": "extract", "purchase": "opinion"}
_LONG = 20 * 86400


def requests(spark, d) -> DataFrame:
    """Events as requests: each type is an action."""
    names = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return read(spark, d, "events").select("event_id", "user_id", names[F.col("event_type")].alias("action"), "ts")


_AS = " ".join(f"WHEN {quoted(e)} THEN {quoted(a)}" for e, a in ACTIONS.items())
_BUDGET = " ".join(f"WHEN {quoted(e)} THEN {quoted(L.BUDGETS[a][0])}" for e, a in ACTIONS.items())
_MOST = " ".join(f"WHEN {quoted(e)} THEN {L.BUDGETS[a][1]}" for e, a in ACTIONS.items())
_BY_ACTION = f"""WITH RECURSIVE e0 AS (SELECT event_id, user_id, CASE event_type {_AS} END AS action, CASE event_type {_BUDGET} END AS budget, CASE event_type {_MOST} END AS most, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, budget ORDER BY t, event_id) AS n FROM e0 WHERE action IS NOT NULL),
w AS (SELECT event_id, user_id, action, budget, n, t, t + {_LONG}000000 AS reset, 1 AS c, true AS ok FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.action, e.budget, e.n, e.t, CASE WHEN e.t >= w.reset THEN e.t + {_LONG}000000 ELSE w.reset END, CASE WHEN e.t >= w.reset THEN 1 WHEN w.c < e.most THEN w.c + 1 ELSE w.c END, e.t >= w.reset OR w.c < e.most
  FROM w JOIN e ON e.user_id = w.user_id AND e.budget = w.budget AND e.n = w.n + 1)
SELECT event_id, action, ok, CASE WHEN NOT ok THEN CAST(ceil((reset - t) / 1000000.0) AS INTEGER) END AS retry_after FROM w"""
add("rate_limit_actions", lambda s, d: rate_limit.by_action(requests(s, d), window_s=_LONG).select("event_id", "action", "ok", "retry_after"), _BY_ACTION)


def visible(spark, d, user: int) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("user_id"))
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("submission_id"), "l_linenumber")
    roles = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 10 == 0, "ADMIN").otherwise("USER").alias("role"))
    return R.visible(lines, orders, roles, user).groupBy("submission_id").agg(F.count("*").alias("n"))


for _name, _user in (("rls_exists", 7), ("own_or_admin", 10)):
    add(_name, lambda s, d, u=_user: visible(s, d, u), f"SELECT l_orderkey AS submission_id, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = {_user}) OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = {_user} AND c_custkey % 10 = 0) GROUP BY l_orderkey")


# Registries, with how often the given tables meet each of their entries.


def fixed(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def fixed_sql(name: str, rows: list[tuple], columns: str) -> str:
    values = ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else "NULL::INTEGER" if x is None else str(x) for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {values})"


def counted(registry: DataFrame, used: DataFrame, on: list[str], name: str) -> DataFrame:
    """The registry's rows with the number of rows of `used` that have their key."""
    n = used.groupBy(*on).agg(F.count("*").alias(name))  # at most the registry's keys
    return registry.join(F.broadcast(n), on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def met(spark, d, terms) -> DataFrame:
    """term: a row for each claim that holds it."""
    return DQ._tokens(spark, d).select(F.explode(X.find_terms(F.col("j"), terms)).alias("term"))


_MET = lambda terms: f"mt AS (SELECT unnest({S.terms(terms)}) AS term FROM d2), mc AS (SELECT term, count(*) AS n FROM mt GROUP BY term)"
_SOURCES = [(i, x[0], t) for i, x in enumerate(L.SOURCES) for t in x[3]]
add("dim_sources", lambda s, d: counted(fixed(s, _SOURCES, "ord int, id string, topic string"), DQ.matches(s, d), ["id", "topic"], "claims"), f"{DQ.MATCH}, {fixed_sql('rg', _SOURCES, 'ord, id, topic')} SELECT rg.*, (SELECT count(*) FROM w WHERE w.id = rg.id AND w.topic = rg.topic) AS claims FROM rg")
_OUTLETS = list(enumerate(L.OUTLETS))


def outlet_pages(spark, d) -> DataFrame:
    """domain: a row for each page and outlet that its domain belongs to, by the domain's suffixes."""
    parts = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return EQ.registered(spark, d).select(F.explode(suffixes).alias("domain")).filter(F.col("domain").isin(L.OUTLETS))


add("dim_outlets", lambda s, d: counted(fixed(s, _OUTLETS, "ord int, domain string"), outlet_pages(s, d), ["domain"], "pages"), f"WITH {EQ.REGISTERED}, {fixed_sql('rg', _OUTLETS, 'ord, domain')} SELECT rg.*, (SELECT count(*) FROM o WHERE o.domain = rg.domain OR ends_with(o.domain, '.' || rg.domain)) AS pages FROM rg")
_RATINGS = list(L.RATINGS.items())
add("dim_ratings", lambda s, d: counted(fixed(s, _RATINGS, "name string, bucket string"), EQ.reviews(s, d).select(E.rating_norm(F.col("rating")).alias("name")), ["name"], "reviews"), f"{EQ.with_(EQ.PAGES, EQ.FOUND, EQ.REVIEWS, fixed_sql('rg', _RATINGS, 'name, bucket'))}, nr AS (SELECT {EQ.norm_sql('rating')} AS name FROM rv) SELECT rg.*, (SELECT count(*) FROM nr WHERE nr.name = rg.name) AS reviews FROM rg")
_TOPICS = [(i, t, k) for i, (t, words) in enumerate(L.TOPICS.items()) for k in words]
_KEYWORDS = list(dict.fromkeys(k for _, _, k in _TOPICS))
add("dim_topics", lambda s, d: counted(fixed(s, _TOPICS, "ord int, topic string, keyword string"), met(s, d, _KEYWORDS).withColumnRenamed("term", "keyword"), ["keyword"], "claims"), f"{S.BASE}, {_MET(_KEYWORDS)}, {fixed_sql('rg', _TOPICS, 'ord, topic, keyword')} SELECT rg.*, coalesce(n, 0) AS claims FROM rg LEFT JOIN mc ON term = keyword")
_LISTS = {"hedging": L.HEDGING, "debunk": L.DEBUNK, "emotion": L.EMOTION, "urgency": L.URGENCY, "forward": L.FORWARD, "clickbait": L.CLICKBAIT, "body": L.BODIES, "verb": L.VERBS}
_LEXICON = [("sensational", i, t, w) for i, (t, w) in enumerate(L.SENSATIONAL.items())] + [(name, i, t, None) for name, terms in _LISTS.items() for i, t in enumerate(terms)]
_TERMS = list(dict.fromkeys(t for _, _, t, _ in _LEXICON))
add("dim_lexicon", lambda s, d: counted(fixed(s, _LEXICON, "list string, ord int, term string, weight int"), met(s, d, _TERMS), ["term"], "claims"), f"{S.BASE}, {_MET(_TERMS)}, {fixed_sql('rg', _LEXICON, 'list, ord, term, weight')} SELECT rg.*, coalesce(n, 0) AS claims FROM rg LEFT JOIN mc ON mc.term = rg.term")
