"""Queries of the planner and their DuckDB SQL; gains are written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.functions import lexicon as L
from claimworks.operators import planner as P
from claimworks.plans import detect_queries as DQ
from claimworks.plans import detect_sql as S
from claimworks.sources import shared
from claimworks.sources.tables import sql_list

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def problems(spark, d) -> DataFrame:
    return P.problems(DQ._scores(spark, d))


def distinct(spark, d) -> DataFrame:
    """One run of the detection for all readers of a query."""
    return shared.table(P.distinct_problems(DQ._scores(spark, d)), "problems")


def text(df: DataFrame) -> DataFrame:
    """The gains as one text column."""
    return df.withColumn("gains", F.array_join(F.col("gains").cast("array<string>"), ","))


_LOCAL = ["s_sensational", None, "s_emotion", "s_urgency", "s_specificity", "s_style", "s_clickbait", None]
_GAINS = ", ".join(f"abs({c} - 50) * 2" if c else "0" for c in _LOCAL)
_TOPICS = " OR ".join(f"hits[{i + 1}].hits > 0" for i, t in enumerate(L.TOPICS) if t in L.FACTCHECKED)
PROBLEMS = f"""{S.SCORES},
pr AS (SELECT claim_id, list_transform([{_GAINS}, 150 + CASE WHEN {_TOPICS} THEN 100 ELSE 0 END + CASE WHEN language_risk = 'high' THEN 50 ELSE 0 END,
  (100 + CASE WHEN len(dates) > 0 OR len(bodies) > 0 THEN 100 ELSE 0 END) * CASE WHEN language = 'english' THEN 100 ELSE 50 END // 100, 60], lambda x: x::INTEGER) AS g FROM r),
pb AS (SELECT claim_id, array_to_string(g, ',') AS gains, g, list_sum(g)::BIGINT AS total, list_sum(g)::BIGINT * {round(L.TAU * P.SCALE)} AS need FROM pr),
dp AS (SELECT gains, any_value(g) AS g, any_value(total) AS total, any_value(need) AS need, count(*) AS claims FROM pb GROUP BY gains)"""
_BIT = lambda i: f"((mask >> {i}) & 1)"
STATES = f"""{PROBLEMS},
st AS (SELECT gains, g, need, mask, bit_count(mask::INTEGER) AS size, {' + '.join(f'{_BIT(i)} * {c}' for i, c in enumerate(L.COSTS))} AS cost, {' + '.join(f'{_BIT(i)} * g[{i + 1}]' for i in range(P.N))} AS evidence,
  {' + '.join(f'{_BIT(i)} * {1 << (P.N - 1 - i)}' for i in range(P.N))} AS rank FROM dp, (SELECT unnest(range(0, {P.STATES})) AS mask)),
sg AS (SELECT *, evidence * {P.SCALE} >= need AS goal FROM st)"""
CHECKS = f"""{PROBLEMS},
ck AS (SELECT gains, need, i - 1 AS idx, g[i] AS gain, {L.COSTS}[i] AS cost FROM (SELECT gains, g, need, unnest(range(1, {P.N + 1})) AS i FROM dp))"""

add("local_gain", lambda s, d: text(problems(s, d).select("claim_id", F.slice("gains", 1, 8).alias("gains"))), f"{PROBLEMS} SELECT claim_id, array_to_string(g[1:8], ',') AS gains FROM pb")
add("problem_for", lambda s, d: text(problems(s, d)), f"{PROBLEMS} SELECT claim_id, gains, total, need FROM pb")
add("problem_totals", lambda s, d: problems(s, d).select("claim_id", (F.col("total") / 100).alias("total"), (F.col("need") / (100 * P.SCALE)).alias("threshold")), f"{PROBLEMS} SELECT claim_id, total / 100 AS total, need / {100 * P.SCALE} AS threshold FROM pb")
add("distinct_problems", lambda s, d: text(distinct(s, d).select("gains", "claims")), f"{PROBLEMS} SELECT gains, claims FROM dp")
add("mask_cross", lambda s, d: text(P.states(distinct(s, d)).groupBy("gains").agg(F.count("*").alias("states"), F.count_if("goal").alias("goals"))), f"{STATES} SELECT gains, count(*) AS states, count(*) FILTER (WHERE goal) AS goals FROM sg GROUP BY gains")
add("evidence_E", lambda s, d: text(P.states(distinct(s, d)).groupBy("gains", "size").agg(F.max("evidence").alias("most"), F.sum("evidence").alias("all"))), f"{STATES} SELECT gains, size, max(evidence) AS most, sum(evidence) AS \"all\" FROM sg GROUP BY gains, size")
add("is_goal", lambda s, d: text(P.states(distinct(s, d)).groupBy("gains").agg(F.min(F.when(F.col("goal"), F.col("evidence"))).alias("least"))), f"{STATES} SELECT gains, min(evidence) AS least FROM sg WHERE goal GROUP BY gains")
add("optimal_cost", lambda s, d: text(P.optimal(distinct(s, d))), f"{STATES} SELECT gains, min(cost) AS cost FROM sg WHERE goal GROUP BY gains")
# An own threshold and own costs, by the steps that a user may choose.
_OTHER, _SHARE = {"factcheck": 1.5, "news": 2.5, "style": 0.5}, 0.65
_OTHER_COST = " + ".join(f"{_BIT(i)} * {_OTHER.get(c, L.COSTS[i])}" for i, c in enumerate(L.CHECKS))
_OTHER_STATES = f"{STATES}, so AS (SELECT gains, g, mask, size, rank, evidence, ({_OTHER_COST})::DOUBLE AS price, evidence * 20 >= total * 13 AS enough FROM sg JOIN (SELECT gains, total FROM dp) USING (gains))"


def overridden(spark, d) -> DataFrame:
    return shared.table(P.distinct_problems(DQ._scores(spark, d), _SHARE), "problems")


def other(spark, d) -> DataFrame:
    """The least cost, and what breadth-first search and hill climbing find, under the overrides."""
    own = overridden(spark, d)
    b, h = P.breadth_first(own, _OTHER).select("gains", F.col("cost").alias("breadth_cost"), "expanded"), P.hill_climb(own, _OTHER).select("gains", F.col("cost").alias("hill_cost"))
    rows = P.optimal(own, _OTHER).join(b, "gains").join(h, "gains")
    return text(rows.select("gains", *[F.col(c).cast("double").alias(c) for c in ("cost", "breadth_cost", "hill_cost")], "expanded"))


_OTHER_PRICES = [_OTHER.get(c, p) for c, p in zip(L.CHECKS, L.COSTS, strict=True)]
add("problem_overrides", other, f"""{_OTHER_STATES}, ob AS (SELECT gains, size, rank, price FROM (SELECT *, row_number() OVER (PARTITION BY gains ORDER BY size, rank DESC) AS k FROM so WHERE enough) WHERE k = 1),
oc AS (SELECT gains, total, i, g[i] AS gain, {_OTHER_PRICES}[i]::DOUBLE AS price FROM (SELECT gains, g, total, unnest(range(1, {P.N + 1})) AS i FROM dp)),
oh AS (SELECT *, sum(gain) OVER (PARTITION BY gains ORDER BY gain / price DESC, i ROWS UNBOUNDED PRECEDING) - gain AS before FROM oc WHERE gain > 0)
SELECT ob.gains, (SELECT min(price) FROM so WHERE so.gains = ob.gains AND enough) AS cost, ob.price AS breadth_cost, (SELECT sum(price) FROM oh WHERE oh.gains = ob.gains AND before * 20 < total * 13) AS hill_cost,
  (SELECT count(*) FROM so WHERE so.gains = ob.gains AND (so.size < ob.size OR so.size = ob.size AND so.rank >= ob.rank)) AS expanded FROM ob""")
add("cost_if_all", lambda s, d: problems(s, d).select("claim_id", F.lit(sum(L.COSTS)).alias("cost")), f"{PROBLEMS} SELECT claim_id, list_sum({L.COSTS})::INTEGER AS cost FROM pb")
add("bfs", lambda s, d: text(P.breadth_first(distinct(s, d))), f"{STATES}, bg AS (SELECT gains, size, rank, mask, cost FROM (SELECT *, row_number() OVER (PARTITION BY gains ORDER BY size, rank DESC) AS k FROM sg WHERE goal) WHERE k = 1) SELECT sg.gains, bg.mask AS plan, bg.cost, count(*) AS expanded FROM sg JOIN bg ON bg.gains = sg.gains AND (sg.size < bg.size OR (sg.size = bg.size AND sg.rank >= bg.rank)) GROUP BY ALL")
add("hill_climb", lambda s, d: text(P.hill_climb(distinct(s, d))), f"{CHECKS}, hc AS (SELECT *, sum(gain) OVER (PARTITION BY gains ORDER BY gain::DOUBLE / cost DESC, idx ROWS UNBOUNDED PRECEDING) - gain AS before FROM ck WHERE gain > 0) SELECT gains, sum(cost) AS cost, count(*) + 1 AS expanded, sum(gain) AS evidence FROM hc WHERE before * {P.SCALE} < need GROUP BY gains")
_H = f"""{STATES}, hx AS (SELECT gains, mask, need - evidence * {P.SCALE} AS need, i - 1 AS idx, g[i] AS gain, {L.COSTS}[i] AS cost FROM (SELECT gains, g, mask, need, evidence, unnest(range(1, {P.N + 1})) AS i FROM sg) WHERE g[i] > 0 AND (mask >> (i - 1)) & 1 = 0),
hy AS (SELECT *, (sum(gain) OVER (PARTITION BY gains, mask ORDER BY cost::DOUBLE / gain, idx ROWS UNBOUNDED PRECEDING) - gain) * {P.SCALE} AS before FROM hx),
hz AS (SELECT gains, mask, any_value(need) AS need, sum(gain) * {P.SCALE} AS have, sum(cost * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (need - before)::DOUBLE / (gain * {P.SCALE})))) AS h FROM hy GROUP BY gains, mask),
hh AS (SELECT sg.gains, sg.mask, CASE WHEN sg.goal THEN 0 WHEN hz.have IS NULL OR hz.have < hz.need THEN NULL ELSE hz.h END AS h FROM sg LEFT JOIN hz ON hz.gains = sg.gains AND hz.mask = sg.mask)"""


def bounds(spark, d) -> DataFrame:
    return text(P.heuristic(P.states(distinct(spark, d))))


add("heuristic_h", lambda s, d: bounds(s, d).withColumn("size", F.bit_count("mask")).groupBy("gains", "size").agg(F.count_if(F.col("h") == float("inf")).alias("unreachable"), F.round(F.sum(F.when(F.col("h") < float("inf"), F.col("h"))), 4).alias("sum_h")), f"{_H} SELECT gains, bit_count(mask::INTEGER) AS size, count(*) FILTER (WHERE h IS NULL) AS unreachable, round(sum(h), 4) AS sum_h FROM hh GROUP BY ALL")


def inconsistent(spark, d) -> DataFrame:
    """Edges on which the bound drops by more than the check's cost: there must be none."""
    h = bounds(spark, d).select("gains", "mask", "h")
    edges = h.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(P.N - 1)))).filter(F.getbit("mask", F.col("idx")) == 0)
    edges = edges.withColumns({"to": F.expr("mask | shiftleft(1, idx)"), "cost": F.get(F.array(*map(F.lit, L.COSTS)), F.col("idx"))})
    both = edges.join(h.select("gains", F.col("mask").alias("to"), F.col("h").alias("next")), ["gains", "to"])
    return both.agg(F.count("*").alias("edges"), F.count_if(F.col("h") > F.col("cost") + F.col("next") + 1e-9).alias("violations"))


add("heuristic_consistent", inconsistent, f"{PROBLEMS} SELECT (count(*) * {P.N} * {P.STATES // 2})::BIGINT AS edges, 0::BIGINT AS violations FROM dp")


def plans(spark, d) -> DataFrame:
    """The cheapest plan of each problem; of equal ones the first by size and order."""
    return P.cheapest(distinct(spark, d))


PLANS = f"{STATES}, pl AS (SELECT gains, g, mask FROM (SELECT *, row_number() OVER (PARTITION BY gains ORDER BY cost, size, rank DESC) AS k FROM sg WHERE goal) WHERE k = 1), pc AS (SELECT gains, i - 1 AS idx, g[i] AS gain, {L.COSTS}[i] AS cost FROM (SELECT gains, g, mask, unnest(range(1, {P.N + 1})) AS i FROM pl) WHERE (mask >> (i - 1)) & 1 = 1)"
_ORDER = "PARTITION BY gains ORDER BY CASE WHEN gain > 0 THEN cost::DOUBLE / gain ELSE 'inf'::DOUBLE END, idx"
add("order_plan", lambda s, d: text(P.order_plan(plans(s, d))).select("gains", "pos", "idx"), f"{PLANS} SELECT gains, row_number() OVER ({_ORDER})::INTEGER AS pos, idx::INTEGER AS idx FROM pc")
add("running_gain", lambda s, d: text(P.order_plan(plans(s, d))), f"{PLANS} SELECT gains, row_number() OVER ({_ORDER})::INTEGER AS pos, idx::INTEGER AS idx, cost, gain, sum(cost) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS cost_so_far, sum(gain) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS gain_so_far FROM pc")


def stops(spark, d) -> DataFrame:
    own = distinct(spark, d)
    return text(P.runs(P.order_plan(P.cheapest(own)), own)).select("gains", "idx", "status")


add("stop_early", stops, f"{PLANS} SELECT gains, idx::INTEGER AS idx, CASE WHEN (sum(gain) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) - gain) * {P.SCALE} >= (SELECT need FROM dp WHERE dp.gains = pc.gains) THEN 'stopped-early' ELSE 'run' END AS status FROM pc")
add("set_label", lambda s, d: text(plans(s, d)).select("gains", P.set_label(F.col("plan")).alias("label")), f"{PLANS}, lb AS (SELECT gains, '{{' || array_to_string(list({sql_list(L.LABELS)}[idx + 1] ORDER BY idx), ', ') || '}}' AS label FROM pc GROUP BY gains) SELECT * FROM lb")


def unplanned(spark, d) -> DataFrame:
    own = distinct(spark, d)
    run = P.order_plan(P.cheapest(own)).select("gains", "idx")
    return text(P.checks(own).join(run, ["gains", "idx"], "left_anti").select("gains", "idx"))


add("plan_skipped", unplanned, f"{PLANS}, sk AS (SELECT gains, unnest(range(0, {P.N}))::INTEGER AS idx FROM pl) SELECT gains, idx FROM sk WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.gains = sk.gains AND pc.idx = sk.idx)")


def summary(spark, d) -> DataFrame:
    own = shared.table(problems(spark, d), "own-problems")
    s = P.order_plan(P.cheapest(own.select("gains", "total", "need").distinct())).groupBy("gains").agg(F.count("*").alias("planned"), F.sum("cost").alias("cost"), F.sum("gain").alias("evidence"))
    return text(own.join(s, "gains")).select("claim_id", "planned", "cost", "evidence", (P.N - F.col("planned")).alias("skipped"))


add("plan_summary", summary, f"{PLANS}, ps AS (SELECT gains, count(*) AS planned, sum(cost) AS cost, sum(gain) AS evidence FROM pc GROUP BY gains) SELECT claim_id, planned, cost, evidence, {P.N} - planned AS skipped FROM pb JOIN ps USING (gains)")

# The tree of breadth-first search: every node from closed forms, paths by recursion.


def nodes(spark, d) -> DataFrame:
    """The tree is read several times."""
    return shared.table(P.tree(distinct(spark, d)), "tree")


_BREADTH = f"""bo AS (SELECT *, row_number() OVER (PARTITION BY gains ORDER BY size, rank DESC) AS place FROM sg),
be AS (SELECT gains, min(place) AS until FROM bo WHERE goal GROUP BY gains),
bx AS (SELECT bo.*, until, coalesce(sum({P.N} - size) OVER (PARTITION BY bo.gains ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM bo JOIN be ON be.gains = bo.gains),
bn AS (SELECT gains, mask AS source, c, mask + (1 << c) AS mask, (begun + row_number() OVER (PARTITION BY gains, mask ORDER BY c))::INTEGER AS id FROM bx, (SELECT unnest(range(0, {P.N})) AS c) WHERE place < until AND (mask >> c) & 1 = 0),
bf AS (SELECT gains, mask, min(id) AS id FROM bn GROUP BY gains, mask),
tr AS (SELECT bn.gains, bn.id, coalesce(up.id, 0)::INTEGER AS parent, bn.mask, bn.c, bx.cost AS g, bx.evidence, bx.size, CASE WHEN bf.id <> bn.id THEN 'pruned' WHEN bx.place <= bx.until THEN 'expanded' ELSE 'frontier' END AS status, bf.id = bn.id AND bx.place = bx.until AS goal
  FROM bn JOIN bf ON bf.gains = bn.gains AND bf.mask = bn.mask JOIN bx ON bx.gains = bn.gains AND bx.mask = bn.mask LEFT JOIN bf up ON up.gains = bn.gains AND up.mask = bn.source
  UNION ALL SELECT gains, 0, NULL, mask, NULL, cost, evidence, size, 'expanded', goal FROM bx WHERE mask = 0)"""
TREE = f"{STATES}, {_BREADTH}".replace("WITH", "WITH RECURSIVE", 1)
add("search_tree", lambda s, d: text(nodes(s, d)).groupBy("gains", "depth", "status").agg(F.count("*").alias("nodes"), F.sum(F.col("id").cast("long")).alias("ids"), F.sum(F.col("parent").cast("long")).alias("parents"), F.sum("g").alias("g")), f"{TREE} SELECT gains, size::INTEGER AS depth, status, count(*) AS nodes, sum(id)::BIGINT AS ids, sum(parent)::BIGINT AS parents, sum(g)::BIGINT AS g FROM tr GROUP BY gains, size, status")


def paths(spark, d) -> DataFrame:
    """The checks on the way to the goal, and to every hundredth node."""
    own = nodes(spark, d)
    found = P.path_to(own, own.filter("goal or id % 100 = 7"))
    return text(found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ",")))


_UP = "up AS (SELECT gains, id, id AS node, '' AS path FROM tr WHERE goal OR id % 100 = 7 UNION ALL SELECT up.gains, up.id, tr.parent, tr.c || CASE WHEN up.path = '' THEN '' ELSE ',' END || up.path FROM up JOIN tr ON tr.gains = up.gains AND tr.id = up.node WHERE tr.parent IS NOT NULL)"
add("path_to", paths, f"{TREE}, {_UP} SELECT gains, id, path FROM up WHERE node = 0")


def inspected(spark, d) -> DataFrame:
    """What is said of a node: its set, its parent's set, costs, evidence and number of children."""
    own = nodes(spark, d)
    children = own.groupBy("gains", F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    parents = own.select("gains", F.col("id").alias("parent"), P.set_label(F.col("mask")).alias("parent_label"))
    rows = own.filter("id % 50 = 3").join(parents, ["gains", "parent"], "left").join(children, ["gains", "id"], "left")
    return text(rows.select("gains", "id", "status", P.set_label(F.col("mask")).alias("label"), "parent_label", "g", F.round("h", 6).alias("h"), F.round(F.col("g") + F.col("h"), 6).alias("f"), "evidence", F.coalesce("children", F.lit(0)).alias("children")))


_SET = lambda m: f"'{{' || array_to_string(list_transform(list_filter(range(0, {P.N}), lambda i: ({m} >> i) & 1 = 1), lambda i: {sql_list(L.LABELS)}[i + 1]), ', ') || '}}'"
_NAMED = lambda m: f"CASE WHEN {m} = 0 THEN '{{ }}' ELSE {_SET(m)} END"
add("node_inspect", inspected, f"""{_H}, {_BREADTH} SELECT a.gains, a.id, a.status, {_NAMED('a.mask')} AS label, CASE WHEN b.mask IS NOT NULL THEN {_NAMED('b.mask')} END AS parent_label, a.g::INTEGER AS g, round(coalesce(h, 'inf'::DOUBLE), 6) AS h, round(a.g + coalesce(h, 'inf'::DOUBLE), 6) AS f, a.evidence::INTEGER AS evidence,
  (SELECT count(*) FROM tr c WHERE c.gains = a.gains AND c.parent = a.id) AS children FROM tr a LEFT JOIN tr b ON b.gains = a.gains AND b.id = a.parent JOIN hh ON hh.gains = a.gains AND hh.mask = a.mask WHERE a.id % 50 = 3""")
add("full_tree", lambda s, d: text(P.shown(nodes(s, d))).select("gains", "id", "status"), f"""{TREE}, gp AS (SELECT gains, id AS node, 0 AS z FROM tr WHERE goal UNION ALL SELECT gp.gains, tr.parent, 0 FROM gp JOIN tr ON tr.gains = gp.gains AND tr.id = gp.node WHERE tr.parent IS NOT NULL),
sh AS (SELECT tr.gains, tr.id, tr.status, row_number() OVER (PARTITION BY tr.gains ORDER BY CASE WHEN gp.node IS NOT NULL THEN 0 WHEN status = 'expanded' THEN 1 ELSE 2 END, tr.id) AS n FROM tr LEFT JOIN gp ON gp.gains = tr.gains AND gp.node = tr.id) SELECT gains, id, status FROM sh WHERE n <= 240""")
