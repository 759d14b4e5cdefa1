"""The claim engine: fixed headlines, decision rules, the planner's published counts, the limiter."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from claimworks.operators import detect, evidence, planner
from claimworks.plans import catalog
from claimworks.streaming import rate_limit
from conftest import SF

# fixed values: headlines with risk, language risk, verdict, dates, attribution
HEADLINES = [
    ("Shocking secret cure doctors hate, share before it gets deleted!", 100, "high", "likely-misleading", "", ""),
    ("The Ministry of Finance announced a revised GST rate schedule on 1 April 2024.", 0, "low", "unverified", "1 april 2024", "ministry of finance announced"),
    ("Forward this to everyone: banks will be closed for ten days from tomorrow.", 56, "medium", "unverified", "", ""),
    ("According to IMD officials, heavy rainfall is expected in Kerala this week.", 0, "low", "unverified", "", "according to imd|according to officials"),
    ("You won't believe what this politician secretly did overnight.", 66, "high", "unverified", "", ""),
    ("PIB Fact Check: the claim that new 2000 rupee notes carry a GPS chip is fake news.", 2, "low", "unverified", "2000", ""),
    ("The government has quietly decided to ban all cash transactions above Rs 2000 from next month, as per the Ministry of Finance.", 8, "low", "unverified", "2000", "as per ministry of finance"),
    ("According to a statement by the Ministry of Health, drinking hot water every hour cures covid, officials confirmed on 3 March 2025.", 10, "low", "unverified", "3 march 2025", "officials confirmed"),
    ("Act now, 100% guaranteed returns from this new investment scheme!", 70, "high", "likely-misleading", "", ""),
]


def test_headlines(spark):
    claims = spark.createDataFrame([(i, h[0]) for i, h in enumerate(HEADLINES)], "claim_id long, text string")
    rows = detect.detect(claims).select("claim_id", "risk_score", "language_risk", "verdict", F.array_join("dates", "|"), F.array_join("attribution", "|")).orderBy("claim_id").collect()
    assert [tuple(r)[1:] for r in rows] == [h[1:] for h in HEADLINES]


def test_null_and_empty_claims(spark):
    rows = detect.detect(spark.createDataFrame([(1, None), (2, "")], "claim_id long, text string")).collect()
    assert {(r["language"], r["language_risk"], r["word_count"]) for r in rows} == {("non-english", "unknown", 0)}


# fixed values: published expansions and costs of two claims, breadth-first and hill-climbing
COUNTS = [
    ("URGENT: Forward this to 10 people immediately — the government is switching off all mobile SIM cards that are not linked to Aadhaar by Friday!", (174, 6), (6, 8)),
    ("The Reserve Bank of India announced in its monetary policy statement that the repo rate will remain unchanged at 6.5 percent, citing inflation data published by MoSPI.", (294, 7), (6, 6)),
]


@pytest.mark.parametrize("text,breadth,hill", COUNTS)
def test_search_counts(spark, text, breadth, hill):
    scored = detect.detect(spark.createDataFrame([(0, text)], "claim_id long, text string"))
    one = planner.distinct_problems(scored)
    b, h = planner.breadth_first(one).first(), planner.hill_climb(one).first()
    assert (b["expanded"], b["cost"]) == breadth and (h["expanded"], h["cost"]) == hill
    assert planner.optimal(one).first()["cost"] == 6


def test_decision_rules(spark):
    rows = [(1, 1, 0, 0, 0, None, "low"), (2, 1, 1, 0, 0, "supported", "low"), (3, 0, 1, 0, 0, "contradicted", "low"), (4, 0, 0, 0, 2, "supported", "low"), (5, 0, 0, 1, 2, None, "high"), (6, 0, 0, 0, 1, "supported", "low")]
    df = spark.createDataFrame(rows, "claim_id long, negative long, positive long, mixed long, domains long, opinion string, language_risk string")
    got = {r["claim_id"]: (r["verdict"], r["confidence"], r["rule"]) for r in evidence.decide(df).collect()}
    assert got == {1: ("likely-misleading", "high", "a"), 2: ("likely-misleading", "low", "a"), 3: ("unverified", "low", "f"), 4: ("likely-credible", "high", "c"), 5: ("unverified", "low", "f"), 6: ("unverified", "low", "f")}


def test_rate_limit_matches_a_loop(spark):
    t0 = datetime(2024, 1, 1)
    events = [(i, i % 3, t0 + timedelta(seconds=(i * 37) % 400)) for i in range(120)]
    expected, state = {}, {}
    for i, u, t in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        reset, n = state.get(u, (t, 0))
        if t >= reset:
            reset, n = t + timedelta(seconds=60), 0
        expected[i], state[u] = n < 5, (reset, n + (n < 5))
    got = rate_limit.limited(spark.createDataFrame(events, "event_id long, user_id long, ts timestamp"), 5).collect()
    assert {r["event_id"]: r["ok"] for r in got} == expected


@pytest.mark.parametrize("name", ["tokenize", "dates", "attribution", "aspect_scores", "source_match", "decide", "optimal_cost", "confusion_matrix", "find_terms", "sensational", "distinct_problems", "summary", "outlet_registry"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(catalog.SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in catalog.QUERIES[name](spark, SF).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
