"""Raw replies: attempts, statuses and bodies; patches; the report of a claim."""

import json

import duckdb
import pytest

from claimworks.functions import messages as M
from claimworks.operators import evidence, lookups, planner, records, verification
from claimworks.plans import catalog
from claimworks.sources.tables import claims
from conftest import SF

CALLS = "claim_id long, attempt int, code int, body string"


@pytest.mark.parametrize("name", ["src_factcheck", "src_news", "src_llm", "src_opinion", "normalise_claims", "decide_flags", "agree_flag", "gateway_message", "upsert_record", "rate_limit_actions", "plan_report", "path_to", "node_inspect", "full_tree", "search_tree", "sink_fallback", "dim_outlets", "dim_ratings", "dim_lexicon"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "events", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(catalog.SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in catalog.QUERIES[name](spark, SF).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in expected)


def body(*claims_):
    return json.dumps({"claims": list(claims_)})


def test_fact_check_replies(spark):
    review = {"publisher": {"site": "s.org"}, "url": "https://a", "textualRating": " False "}
    good = body({"text": "t", "claimReview": [review, {"url": "https://b"}, {}]}, {"text": "none"}, {"claimReview": []})
    rows = [
        (1, 0, 200, good), (2, 0, 503, "x"), (2, 1, 200, good), (3, 0, 404, "x"), (3, 1, 200, good), (4, 0, None, None), (4, 1, 500, None), (4, 2, 200, good), (5, 0, 200, good[:30]), (5, 1, 200, "[]"),
        (6, 0, 200, "{}"), (7, 0, 200, '{"claims": null}'), (8, 1, 200, good), (9, 0, 200, '{"claims": 5}'), (9, 1, 429, ""), (10, 0, 200, ""),
    ]
    got = lookups.fact_checks(spark.createDataFrame(rows, CALLS))
    status = {r["claim_id"]: (r["attempts"], r["status"], r["message"]) for r in got.collect()}
    ok, rejected, late = ("ok", None), ("error", M.FACTS_REJECTED), ("error", M.FACTS_LATE)
    assert status == {1: (1, *ok), 2: (2, *ok), 3: (1, *rejected), 4: (2, *late), 5: (2, *late), 6: (1, *ok), 7: (1, *ok), 8: (1, *ok), 9: (2, *rejected), 10: (1, *late)}
    places = [(r["ci"], r["ri"], r["url"], r["site"]) for r in lookups.reviews(got).filter("claim_id = 1").collect()]
    assert sorted(places, key=str) == [(0, 0, "https://a", "s.org"), (0, 1, "https://b", None), (0, 2, None, None), (1, None, None, None), (2, None, None, None)]
    facts = {r["id"]: r for r in evidence.normalise_claims(lookups.reviews(got)).filter("claim_id = 1").collect()}
    assert facts["F1"]["publisher"] == "s.org" and facts["F1"]["rating_bucket"] == "false" and facts["F2"]["rating"] == "No rating given" and len(facts) == 2
    assert lookups.fact_checks(spark.createDataFrame([], CALLS)).collect() == []


def test_news_replies(spark):
    texts = spark.createDataFrame([(i, "Ministry announced budget revision yesterday evening") for i in range(5)] + [(5, "too short")], "claim_id long, text string")
    found = json.dumps({"articles": [{"url": "u", "title": "t"}, {"domain": "d"}]})
    calls = [(0, 0, 200, found), (1, 0, 200, "Too many requests"), (2, 0, 500, found), (3, 0, None, None), (5, 0, 200, found)]
    got = lookups.news(spark.createDataFrame(calls, CALLS), texts)
    status = {r["claim_id"]: (r["status"], r["message"]) for r in got.collect()}
    assert status == {0: ("ok", None), 1: ("error", M.NEWS_BUSY), 2: ("error", M.NEWS_DOWN), 3: ("error", M.NEWS_LATE), 4: ("error", M.NEWS_LATE), 5: ("skipped", M.NEWS_SHORT)}
    assert sorted((r["pos"], r["url"]) for r in lookups.articles(got).collect()) == [(0, "u"), (1, None)]


def envelope(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def test_model_calls(spark):
    answer = '{"verdict":"supported","confidence":60.5,"reasoning":"r","citedEvidenceIds":["F1"]}'
    rows = [
        (1, 0, 429, ""), (1, 1, None, None), (1, 2, 200, envelope(answer)), (2, 0, 402, ""), (2, 1, 200, envelope(answer)), (3, 0, 500, ""), (3, 1, 500, ""), (3, 2, 503, ""), (3, 3, 200, envelope(answer)),
        (4, 0, 200, "cut"), (5, 0, 200, envelope(answer)), (6, 0, 200, envelope(answer)),
    ]
    calls = spark.createDataFrame(rows, CALLS)
    got = {r["claim_id"]: tuple(r)[1:] for r in lookups.model_calls(calls).collect()}
    assert got[1] == (3, 2400, True, 200, answer) and got[2] == (1, 0, False, 402, None) and got[3] == (3, 2400, False, 503, None) and got[4] == (1, 0, True, 200, "")
    items = [(i, "F1", "fact-check") for i in (1, 2, 3, 4)] + [(5, "S1", "official-source"), (6, "N1", "article")]
    read = {r["claim_id"]: (r["status"], r["message"], r["verdict"], r["reason"]) for r in lookups.grounded(calls, spark.createDataFrame(items, "claim_id long, id string, kind string")).collect()}
    assert read == {1: ("ok", None, "supported", None), 2: ("error", M.GATEWAY[402], None, None), 3: ("error", M.BUSY, None, None), 4: ("error", M.READ_REFUSED, None, "no-json"), 5: ("skipped", M.READ_SKIPPED, None, None), 6: ("error", M.READ_REFUSED, None, "unknown-ids:F1")}


def test_repeated_patches(spark):
    base = spark.createDataFrame([(1, "a", 1, "p"), (2, "b", 2, "q"), (3, "c", 3, None)], "id long, label string, n int, patch string")
    patch = spark.createDataFrame([(1, 5, "x", None, 0), (1, 7, None, 9, 0), (1, 6, "y", 8, 0), (9, 1, "z", 1, 0), (None, 1, "z", 1, 0), (2, 1, None, None, 0)], "id long, at int, label string, n int, other int")
    got = sorted(tuple(r) for r in records.upsert(base, patch, "id", "at").collect())
    assert got == [(1, "y", 9, "p"), (2, "b", 2, "q"), (3, "c", 3, None)]
    assert sorted(tuple(r) for r in records.upsert(base, patch.limit(0), "id").collect()) == [(1, "a", 1, "p"), (2, "b", 2, "q"), (3, "c", 3, None)]


GAINS = [[90, 0, 88, 34, 48, 96, 20, 0, 250, 200, 60], [0, 0, 92, 90, 48, 96, 88, 0, 150, 50, 60], [0] * 11]


def searched(gains, tau, costs):
    """Breadth-first search with a queue: nodes as (parent, mask, check, status), the goal's node."""
    need = tau * sum(gains) / 100
    enough = lambda m: sum(g for i, g in enumerate(gains) if m >> i & 1) / 100 >= need - 1e-9
    nodes, seen, queue = [[None, 0, None, "frontier"]], {0}, [0]
    for i in queue:
        nodes[i][3] = "expanded"
        if enough(nodes[i][1]):
            return nodes, i
        for c in range(11):
            if nodes[i][1] >> c & 1:
                continue
            mask = nodes[i][1] | 1 << c
            nodes.append([i, mask, c, "pruned" if mask in seen else "frontier"])
            if mask not in seen:
                seen.add(mask)
                queue.append(len(nodes) - 1)
    return nodes, None


@pytest.mark.parametrize("tau", [0.35, 0.65, 0.85])
def test_trees_overrides_and_paths(spark, tau):
    costs = {"factcheck": 1.5, "news": 0.5}
    own = planner.needs(spark.createDataFrame([(g,) for g in GAINS], "gains array<int>"), tau)
    nodes = planner.tree(own, costs)
    paths = {(tuple(r["gains"]), r["id"]): r["path"] for r in planner.path_to(nodes, nodes.filter("goal")).collect()}
    shown = planner.shown(nodes).groupBy("gains").count().collect()
    for gains in GAINS:
        expected, goal = searched(gains, tau, costs)
        got = {r["id"]: [r["parent"], r["mask"], r["check"], r["status"]] for r in nodes.filter(nodes.gains == planner.F.array(*map(planner.F.lit, gains))).collect()}
        assert got == dict(enumerate(expected))
        path, at = [], goal
        while expected[at][0] is not None:
            path.insert(0, expected[at][2])
            at = expected[at][0]
        assert paths[tuple(gains), goal] == path
    assert all(r["count"] <= 240 for r in shown)
    prices = planner.prices(costs)
    best = {tuple(r["gains"]): float(r["cost"]) for r in planner.optimal(own, costs).collect()}
    for gains in GAINS:
        least = min(sum(p for i, p in enumerate(prices) if m >> i & 1) for m in range(2048) if sum(g for i, g in enumerate(gains) if m >> i & 1) >= tau * sum(gains) - 1e-7)
        assert best[tuple(gains)] == pytest.approx(least)


def test_the_model_sees_what_was_gathered_before_it(spark):
    """A plan that runs the model first, then the fact-check: the model has official sources only."""
    text = spark.createDataFrame([(1, "Ministry announced budget revision yesterday evening")], "claim_id long, text string")
    gains = [0] * 8 + [100, 10, 500]
    own = planner.needs(spark.createDataFrame([(gains,)], "gains array<int>"), 1.0)
    ran = verification.executed(own, spark.createDataFrame([(gains, 0b111 << 8)], "gains array<int>, plan int"))
    assert [s["id"] for s in ran.first()["plan"]] == ["gemini", "factcheck", "news"]
    review = {"url": "u", "textualRating": "False", "publisher": {"name": "P"}}
    calls = lambda code, b: spark.createDataFrame([(1, 0, code, b)], CALLS)
    scored = spark.createDataFrame([(1, "low", gains)], "claim_id long, language_risk string, gains array<int>")
    sources = spark.createDataFrame([(1, 1, "N", "U")], "claim_id long, rank int, name string, url string")
    got = verification.reports(scored, scored, ran, text, calls(200, body({"claimReview": [review]})), calls(None, None), calls(200, envelope("{}")), sources).first()
    assert (got["gemini"]["status"], got["gemini"]["message"]) == ("skipped", M.READ_SKIPPED)
    assert got["fact_check"]["records"] == 1 and got["decision"]["rule"] == "a" and got["news"]["message"] == M.NEWS_LATE
    assert got["plan"]["executed"] == ["Gemini (evidence-only)", "Fact-check lookup", "News search"] and len(got["plan"]["skipped"]) == 8 and got["plan"]["evidence"] == 6.1


def test_claims_reach_every_document(spark):
    assert claims(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
