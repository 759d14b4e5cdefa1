"""The detection is worked out once for each claim, by expressions whose cost is that of the text."""

import __spark_entry__
from claimworks.functions import text as X
from claimworks.operators import detect as D
from pyspark.sql import functions as F

from conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_repeat_the_detection(spark):
    """the filter on the label held 247 searches by pattern."""
    found = plan(__spark_entry__.queries()["hist_filter"](spark, SF))
    assert found.count("regexp_extract_all") < 20
    assert all("regexp_extract_all" not in line for line in found.split("\n") if "Filter" in line.split("[")[0].split("(")[0])


def test_texts_are_trimmed_by_characters(spark):
    rows = spark.createDataFrame([(" ﻿a b　\n",), ("a \x85",), (" ",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.trimmed(F.col("t")).alias("t")).collect()] == ["a b", "a \x85", "", None]
    assert "x{1680}" not in plan(rows.select(X.trimmed(F.col("t"))))


def test_texts_without_keys_are_not_searched(spark):
    """Months, years and bodies are looked for in few texts; what they give is as before."""
    texts = ["nothing at all of india", "3rd may 2024 and 1999", "WHO and the ministry of finance", "who knows", "awho WHO_ xWHO", "x12 12 3,500 km"]
    rows = D.detect(spark.createDataFrame(list(enumerate(texts)), "claim_id long, text string")).orderBy("claim_id")
    assert "told" in rows.columns
    got = rows.select("dates", F.transform("bodies", lambda b: b["name"]).alias("b"), "numbers").collect()
    assert [r.dates for r in got] == [[], ["3rd may 2024", "1999"], [], [], [], []]
    assert [r.b for r in got] == [[], [], ["WHO", "ministry of finance"], [], [], []]
    assert [r.numbers for r in got] == [[], ["3", "2024", "1999"], [], [], [], ["12", "3,500 km"]]


def test_signals_read_what_stands_near_keys(spark):
    """F4 to F7, F10, F11, F13, F15 to F18: long texts are cut to what stands near keys; results are as for all tokens."""
    far = " ".join(["to the lorem of ipsum you"] * 3000)
    texts = [f"{far} according to the x x ministry of home affairs x x said {far} doctors hate {far} on 3rd may 2024 {far}", f"who said {far} hate {far} 1999", f"{far} per's", "K and İ aB'c 12 it's", ""]
    rows = D.signals(spark.createDataFrame(list(enumerate(texts)), "claim_id long, text string")).orderBy("claim_id")
    assert "near" in rows.columns
    got = rows.select(F.size("near").alias("n"), "dates", "attribution", "clickbait", "word_count", "plain", F.size("tokens").alias("all"), F.length(F.regexp_replace("raw", "[^A-Za-z]+", "")).alias("letters")).collect()
    assert got[0].n < 500 and got[0].word_count == got[0].all > 70000
    assert (got[0].dates, got[1].dates) == (["3rd may 2024"], ["1999"])
    assert (got[0].attribution, got[1].attribution) == (["ministry of home affairs said", "according to ministry of home affairs"], [])
    assert (got[0].clickbait, got[1].clickbait) == (["doctors hate"], [])
    assert all(r.plain == r.letters for r in got)
