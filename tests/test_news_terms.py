"""Terms of a long text come from its beginning where that is exact."""

from claimworks.functions import lexicon as L
from claimworks.functions.text import tokenize
from claimworks.operators import evidence as E
from pyspark.sql import functions as F


def test_terms_and_window_equal_those_of_whole_texts(spark):
    words = "alpha bravo charlie delta foxtrot golfing hotels indias"
    texts = ["", words, "x" * 598 + " alphabet", " ".join(["alpha bravo charlie delta foxtrot"] + ["alpha"] * 94 + ["golfing hotels"]), "a " * 296 + "alpha bravo", words[:50] + " y" * 400, None]
    texts += [f"{a}{w.upper()}{b}" for w in L.BREAKING for a, b in (("", ""), ("é", "."), ("x", ""), ("", "_"), ("\\n", " z"))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    kept = F.filter(tokenize(F.col("t")), lambda t: (F.length(t) >= 4) & ~t.isin(L.NEWS_STOP) & ~F.rlike(t, F.lit("^[0-9]+$")))
    old = F.rlike("t", F.lit(f"(?i)(?<![A-Za-z0-9_])({'|'.join(L.BREAKING)})(?![A-Za-z0-9_])"))
    got = rows.select("t", E.news_terms(F.col("t")).alias("a"), F.slice(F.array_distinct(kept), 1, 6).alias("b"), E.news_window(F.col("t")).alias("w"), F.when(old, 7).otherwise(90).alias("v"))
    for r in got.collect():
        assert (r.a, r.w) == (r.b, r.v), r.t
    assert all(r.a == r.b for r in rows.select(E.news_terms(F.col("t"), 7).alias("a"), F.slice(F.array_distinct(kept), 1, 6).alias("b")).collect())


def test_beginnings_are_read_first(spark):
    rows = spark.createDataFrame([(1, "t")], "i int, t string")
    assert "left(" in rows.select(E.news_terms(F.col("t")))._jdf.queryExecution().analyzed().toString()
