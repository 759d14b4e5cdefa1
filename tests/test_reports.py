"""Reports, stored records, account rules and the feed of changes."""

import duckdb
import pytest
from pyspark.sql import functions as F

from claimworks.functions import messages as M
from claimworks.operators import access, report
from claimworks.plans import catalog
from claimworks.sources import stored
from claimworks.sources.tables import claims
from claimworks.streaming import feed
from conftest import SF


@pytest.mark.parametrize("name", ["notices", "aspect_reports", "decide_reasons", "build_prompt", "img_guard", "scan_local_store", "load_samples", "profiles_own", "admin_set_user_status", "walk_ghf", "problem_overrides"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "customer", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(catalog.SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in catalog.QUERIES[name](spark, SF).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in expected)


REVIEW = "array<struct<publisher: string, rating: string>>"


def test_reasons_of_every_rule(spark):
    f, t, m = [("P", "False")], [("Q", "True")], [("R", "Half true")]
    rows = [(1, f, t, None, [], "supported", "high"), (2, None, t, None, [], None, "low"), (3, None, [], [], ["a.org", "b.org"], "supported", "low"), (4, None, t, None, [], "contradicted", "low"), (5, None, None, m, ["a.org"], None, "high"), (6, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, f"claim_id long, negative {REVIEW}, positive {REVIEW}, mixed {REVIEW}, domains array<string>, opinion string, language_risk string")
    got = {r["claim_id"]: r for r in report.reasons(df).collect()}
    assert got[1]["reasons"] == ["P rated it “False”.", M.OTHERS_TRUE, M.READ_SUPPORTS, M.LOUD]
    assert got[2]["headline"] == M.HEADLINES["b"] and got[2]["next_steps"] == M.STEPS["credible"]
    assert got[3]["reasons"] == ["Reported by 2 independent reputable outlets: a.org, b.org.", M.READ_AGREES]
    assert got[4]["headline"] == M.HEADLINES["back"] and got[4]["reasons"][-1] == M.READ_CONFLICTS
    assert got[5]["reasons"] == ["R rated it “Half true” — partly true.", "Only one reputable outlet (a.org) reported it — two are needed.", M.LOUD]
    assert got[6]["reasons"] == [] and got[6]["next_steps"] == M.STEPS["f"]


def test_labelled_lines(spark, tmp_path):
    path = tmp_path / "claims.jsonl"
    path.write_text('{"text": "a", "label": "true"}\n\n{"text": "TODO", "label": "true"}\n{"text": "b", "label": "x"}\n{broken\n{"label": "false"}\n')
    assert [tuple(r) for r in stored.read_labelled(spark, str(path)).collect()] == [("a", "true")]


def test_image_sizes(spark):
    urls = ["data:image/png;base64," + "A" * n for n in (4, 5)] + ["data:image/png", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(report.image_status(F.col("u"), 3)).collect()] == ["ok", "ok", "size", "no-data-url"]


def test_accounts(spark):
    p = spark.createDataFrame([(1, "A", "a@x", True)], "id long, name string, email string, is_active boolean")
    r = spark.createDataFrame([(1, "ADMIN")], "user_id long, role string")
    again, roles = access.bootstrap_user(p, r, 1, "Z", "root@x", "root@x")
    assert again.collect() == p.collect() and roles.count() == 1
    new, roles = access.bootstrap_user(p, r, 2, None, "Root@x", "root@x")
    assert sorted(x["name"] for x in new.collect()) == ["A", "Root"] and roles.filter("user_id = 2").first()["role"] == "ADMIN"
    changed, audit = access.set_user_status(p, r, 9, 1, False)
    assert changed.first()["is_active"] and audit.count() == 0


def test_change_feed_appends_once(spark, tmp_path):
    claims(spark, SF).limit(30).write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        stream = spark.readStream.schema("claim_id long, text string").parquet(str(tmp_path / "in"))
        feed.append(stream, out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(map(str, got.collect())) == sorted(map(str, feed.scored(spark.read.parquet(str(tmp_path / "in"))).collect()))
