"""Queries of the detection operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimworks.functions import lexicon as L
from claimworks.functions import text as X
from claimworks.operators import detect as D
from claimworks.plans import detect_sql as S
from claimworks.sources.tables import claims, quoted, sql_list

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def text_of(column: Column | str) -> Column:
    return F.array_join(column, "|")


def _tokens(spark, d) -> DataFrame:
    return D.tokens_of(claims(spark, d))


def _signals(spark, d) -> DataFrame:
    return D.signals(claims(spark, d))


def _scores(spark, d) -> DataFrame:
    return D.detect(claims(spark, d))


def on(source, columns):
    """A projection of the claims; columns is called when a session is there."""
    return lambda spark, d: source(spark, d).select("claim_id", *columns())


def joined_list(column: str) -> str:
    return f"array_to_string({column}, '|')"


add("tokenize", on(_tokens, lambda: [text_of("tokens").alias("tokens")]), f"{S.BASE} SELECT claim_id, {joined_list('tokens')} AS tokens FROM d2")
add("word_count", on(_tokens, lambda: [F.size("tokens").alias("word_count")]), f"{S.BASE} SELECT claim_id, len(tokens)::INTEGER AS word_count FROM d2")
add("validate_text", lambda s, d: _tokens(s, d).filter(F.length("raw").between(20, 5000)).select("claim_id", F.length("raw").alias("n")), f"{S.BASE} SELECT claim_id, length(raw)::INTEGER AS n FROM d2 WHERE length(raw) BETWEEN 20 AND 5000")
PHRASE = ["the", "ministry", "of"]
add("phrase_indices", on(_tokens, lambda: [F.array_join(F.transform(X.phrase_indices(F.col("tokens"), PHRASE), lambda i: i.cast("string")), "|").alias("at")]), f"{S.BASE} SELECT claim_id, array_to_string(list_filter(range(0, len(tokens)), lambda i: tokens[i + 1:i + 3] = {sql_list(PHRASE)}), '|') AS at FROM d2")
add("has_phrase", on(_tokens, lambda: [X.has(F.col("j"), "reserve bank").alias("found")]), f"{S.BASE} SELECT claim_id, contains(j, ' reserve bank ') AS found FROM d2")
add("find_terms", on(_tokens, lambda: [text_of(X.find_terms(F.col("j"), L.URGENCY)).alias("terms")]), f"{S.BASE} SELECT claim_id, array_to_string({S.terms(L.URGENCY)}, '|') AS terms FROM d2")
add("upper_tokens", on(_tokens, lambda: [text_of(D.upper_tokens(F.col("raw"))).alias("upper")]), rf"{S.BASE}, u AS (SELECT claim_id, regexp_extract_all(raw, '\b[A-Z]{{2,}}\b') AS u FROM d2) SELECT claim_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), '|') AS upper FROM u")
add("lang_detect", on(_signals, lambda: ["language"]), f"{S.SIGNALS} SELECT claim_id, language FROM d4")
add("debunk", on(_signals, lambda: ["debunk"]), f"{S.SIGNALS} SELECT claim_id, debunk FROM d3")
add("sensational", on(_signals, lambda: [text_of(F.transform("sensational", lambda x: x["term"])).alias("terms"), "weight"]), f"{S.SIGNALS} SELECT claim_id, array_to_string(list_transform(sensational, lambda t: t.term), '|') AS terms, weight FROM d5")
add("dates", on(_signals, lambda: [text_of("dates").alias("dates")]), f"{S.DATES} SELECT d2.claim_id, coalesce(array_to_string(dates, '|'), '') AS dates FROM d2 LEFT JOIN da USING (claim_id)")
add("numbers", on(_signals, lambda: [text_of("numbers").alias("numbers")]), f"{S.SIGNALS} SELECT claim_id, {joined_list('numbers')} AS numbers FROM d3")
add("named_bodies", on(_signals, lambda: [text_of(F.transform("bodies", lambda b: b["name"])).alias("bodies")]), f"{S.SIGNALS} SELECT claim_id, array_to_string(list_transform(bodies, lambda b: b.name), '|') AS bodies FROM d4")
add("attribution", on(_signals, lambda: [text_of("attribution").alias("attribution")]), f"{S.ATTRIBUTION} SELECT d4.claim_id, coalesce(attribution, '') AS attribution FROM d4 LEFT JOIN att USING (claim_id)")
for _name in ("hedging", "emotion", "urgency", "forward", "clickbait"):
    add(_name, on(_signals, lambda n=_name: [text_of(n).alias("terms")]), f"{S.SIGNALS} SELECT claim_id, {joined_list(_name)} AS terms FROM d3")
add("caps_ratio", on(_signals, lambda: [F.round("caps", 9).alias("caps")]), f"{S.SIGNALS} SELECT claim_id, round(caps, 9) AS caps FROM d4")
add("bangs", on(_signals, lambda: ["bangs"]), f"{S.SIGNALS} SELECT claim_id, bangs::INTEGER AS bangs FROM d3")
_SCORES = ["s_sensational", "s_emotion", "s_urgency", "s_specificity", "s_style", "s_clickbait"]
add("aspect_scores", on(_scores, lambda: [*_SCORES]), f"{S.SCORES} SELECT claim_id, {', '.join(_SCORES)} FROM r")
add("risk_score", on(_scores, lambda: ["risk_score", "language_risk"]), f"{S.SCORES} SELECT claim_id, risk_score, language_risk FROM r")
add("engine_verdict", on(_scores, lambda: ["verdict", "strength"]), f"{S.SCORES} SELECT claim_id, verdict, CASE WHEN verdict = 'likely-misleading' THEN 'weak' ELSE 'none' END AS strength FROM r")
add("legacy_label", on(_scores, lambda: [F.when(F.col("verdict") == "likely-misleading", "FAKE").otherwise("UNVERIFIED").alias("label")]), f"{S.SCORES} SELECT claim_id, CASE WHEN verdict = 'likely-misleading' THEN 'FAKE' ELSE 'UNVERIFIED' END AS label FROM r")
add("key_terms", on(_scores, lambda: [text_of(D.key_terms()).alias("terms")]), f"{S.SCORES}, k AS (SELECT claim_id, list_concat(list_concat(list_transform(sensational, lambda t: t.term), urgency), list_concat(clickbait, emotion)) AS a FROM r) SELECT claim_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:6], '|') AS terms FROM k")
_SUMMARY = f"CASE WHEN language_risk = 'unknown' THEN {quoted(L.SUMMARIES[0])} WHEN verdict = 'likely-misleading' THEN {quoted(L.SUMMARIES[1])} ELSE {quoted(L.SUMMARIES[2])} || language_risk || {quoted(L.SUMMARIES[3])} END"
add("summary", on(_scores, lambda: [D.summary().alias("summary")]), f"{S.SCORES} SELECT claim_id, {_SUMMARY} AS summary FROM r")
add("aspects_exploded", lambda s, d: D.aspects(_scores(s, d)), f"{S.ASPECTS_SQL} SELECT * FROM asp")
add("topic_hits", lambda s, d: _signals(s, d).select("claim_id", F.explode_outer("hits").alias("h")).select("claim_id", "h.topic", "h.hits").filter("hits > 0"), f"{S.SIGNALS}, h AS (SELECT claim_id, unnest(hits) AS h FROM d3) SELECT claim_id, h.topic AS topic, h.hits::INTEGER AS hits FROM h WHERE h.hits > 0")
add("topics_ranked", on(_signals, lambda: [text_of("topics").alias("topics")]), f"{S.SIGNALS}, h AS (SELECT claim_id, unnest(hits) AS h FROM d3), g AS (SELECT claim_id, array_to_string(list(h.topic ORDER BY h.hits DESC, h.ord), '|') AS topics FROM h WHERE h.hits > 0 GROUP BY claim_id) SELECT d3.claim_id, coalesce(topics, 'general') AS topics FROM d3 LEFT JOIN g USING (claim_id)")
_DIM = ", ".join(f"({i}, {quoted(s[0])}, {quoted(t)}, {k})" for i, s in enumerate(L.SOURCES) for k, t in enumerate(s[3]))
MATCH = f"""{S.SIGNALS}, h AS (SELECT claim_id, unnest(hits) AS h FROM d3), dim(ord, id, topic, k) AS (VALUES {_DIM}),
m AS (SELECT h.claim_id, dim.ord, dim.id, sum(h.h.hits) AS relevance, arg_max(dim.topic, h.h.hits * 100 - dim.k) AS best FROM h JOIN dim ON dim.topic = h.h.topic GROUP BY ALL),
w AS (SELECT claim_id, ord, id, relevance::INTEGER AS relevance, CASE WHEN relevance > 0 THEN best ELSE 'general' END AS topic, row_number() OVER (PARTITION BY claim_id ORDER BY relevance DESC, ord)::INTEGER AS rank FROM m WHERE relevance > 0 OR ord = 0)"""


def matches(spark, d) -> DataFrame:
    rows = _signals(spark, d).select("claim_id", F.posexplode_outer(D.source_match(F.col("hits"))).alias("p", "m"))
    return rows.select("claim_id", (F.col("p") + 1).alias("rank"), "m.id", "m.topic", "m.relevance")


add("source_match", matches, f"{MATCH} SELECT claim_id, rank, id, topic, relevance FROM w")
add("source_top5", lambda s, d: matches(s, d).filter("rank <= 5"), f"{MATCH} SELECT claim_id, rank, id, topic, relevance FROM w WHERE rank <= 5")
