"""Queries of the evidence operators: lookups from raw replies (sources.services), and what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.functions import lexicon as L
from claimworks.functions import messages as M
from claimworks.operators import evidence as E
from claimworks.operators import lookups
from claimworks.plans import detect_queries as DQ
from claimworks.plans import detect_sql as S
from claimworks.sources import services
from claimworks.sources.services import pick
from claimworks.sources.tables import CLAIMS_SQL, claims, quoted, read, sql_list

QUERIES: dict = {}
SQL: dict[str, str] = {}

OUTLETS = ("example.org", "example.net")


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def with_(*parts: str) -> str:
    """A query's common tables, each part once."""
    return "WITH RECURSIVE " + ",\n".join(dict.fromkeys(parts))


# Lookups: the last attempt that is made of each claim.


def ladder_sql(service: str, p: str, most: int, final: str) -> str:
    """{p}l: what the last attempt of each claim i was, and made, the number of attempts."""
    return f"""{services.attempts_sql(service, p + 'a')},
{p}t AS (SELECT *, coalesce({final}, false) AS final FROM {p}a),
{p}g AS (SELECT *, 1 AS made FROM {p}t WHERE attempt = 0 UNION ALL SELECT t.*, g.made + 1 FROM {p}g g JOIN {p}t t ON t.i = g.i AND t.attempt = g.attempt + 1 WHERE NOT g.final AND t.attempt < {most}),
{p}l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY attempt DESC) AS z FROM {p}g) WHERE z = 1)"""


PAGES = services.PAGES_SQL
_TABLE = ", ".join(f"({quoted(n)}, {quoted(b)})" for n, b in L.RATINGS.items())
RATED = f"rt(name, bucket) AS (VALUES {_TABLE})"
FOUND = ladder_sql("factcheck", "f", 2, "code < 500 AND NOT (code BETWEEN 200 AND 299 AND broken)")
FOUND += f""",
fs AS (SELECT i, t, h, made AS attempts, CASE WHEN code BETWEEN 200 AND 299 AND NOT broken THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN code BETWEEN 200 AND 299 AND NOT broken THEN NULL WHEN code < 500 AND code NOT BETWEEN 200 AND 299 THEN {quoted(M.FACTS_REJECTED)} ELSE {quoted(M.FACTS_LATE)} END AS message FROM fl)"""
REVIEWS = services.REVIEWS_SQL


def found(spark, d) -> DataFrame:
    return lookups.fact_checks(services.factcheck_calls(spark, d))


def reviews(spark, d) -> DataFrame:
    return lookups.reviews(found(spark, d)).filter("ri is not null")


add("src_factcheck", lambda s, d: found(s, d).select("claim_id", "attempts", "status", "message", F.coalesce(F.aggregate("claims", F.lit(0), lambda a, c: a + F.greatest(F.size(c["claimReview"]), F.lit(0))), F.lit(0)).alias("reviews")), f"{with_(PAGES, FOUND, REVIEWS)} SELECT i AS claim_id, attempts::INTEGER AS attempts, status, message, (SELECT count(*) FROM rv WHERE claim_id = i)::INTEGER AS reviews FROM fs")


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[’‘]', '''', 'g'), '[^a-z0-9'' ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


_LEAD = "regexp_extract({}, " + quoted("^([^.:;!—–(,]*)") + ", 1)"
FACTS = rf"""f1 AS (SELECT *, row_number() OVER (PARTITION BY claim_id, url ORDER BY ci, ri) AS k FROM rv WHERE url <> ''),
f2 AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ci, ri) AS n, trim(coalesce(rating, '')) AS r FROM f1 WHERE k = 1),
fc AS (SELECT claim_id, n::INTEGER AS n, 'F' || n AS id, coalesce(nullif(f2.name, ''), nullif(site, ''), 'Unknown publisher') AS publisher, url, left(coalesce(title, text, ''), 300) AS title,
  CASE WHEN r = '' THEN 'No rating given' ELSE r END AS rating, CASE WHEN r = '' THEN 'unknown' ELSE coalesce(a.bucket, b.bucket, 'unknown') END AS rating_bucket, date AS reviewed_at, left(coalesce(text, ''), 300) AS claim_text
  FROM f2 LEFT JOIN rt a ON a.name = {norm_sql('r')} LEFT JOIN rt b ON b.name = {norm_sql(_LEAD.format('r'))} WHERE n <= 8)"""
_FACTS = (PAGES, FOUND, REVIEWS, RATED, FACTS)


def facts(spark, d) -> DataFrame:
    return E.normalise_claims(reviews(spark, d))


_STOP = sql_list(L.NEWS_STOP)
TERMS = f"""k0 AS (SELECT claim_id, text, list_filter({S.tokenize('text')}, lambda t: length(t) >= 4 AND NOT list_contains({_STOP}, t) AND NOT regexp_matches(t, '^[0-9]+$')) AS k FROM claims),
kt AS (SELECT claim_id, text, list_filter(k, lambda x, i: list_position(k, x) = i)[1:6] AS terms FROM k0)"""
_DAYS = rf"CASE WHEN regexp_matches(text, '(?i)\b({'|'.join(L.BREAKING)})\b') THEN 7 ELSE 90 END"
SEARCHED = f"""{services.attempts_sql('news', 'na')},
ns AS (SELECT claim_id AS i, text, terms, t, h, CASE WHEN len(terms) < 4 THEN 'skipped' WHEN code BETWEEN 200 AND 299 AND NOT broken THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN len(terms) < 4 THEN {quoted(M.NEWS_SHORT)} WHEN code BETWEEN 200 AND 299 AND NOT broken THEN NULL WHEN code BETWEEN 200 AND 299 THEN {quoted(M.NEWS_BUSY)} WHEN code IS NOT NULL THEN {quoted(M.NEWS_DOWN)} ELSE {quoted(M.NEWS_LATE)} END AS message
  FROM kt LEFT JOIN na ON na.i = claim_id)"""
_REPUTABLE = "(" + " OR ".join(f"domain = {quoted(o)} OR ends_with(domain, {quoted('.' + o)})" for o in OUTLETS) + ")"
NEWS = rf"""{services.ARTICLES_SQL},
n1 AS (SELECT *, row_number() OVER (PARTITION BY claim_id, domain ORDER BY pos) AS k FROM nf WHERE coalesce(url, '') <> '' AND coalesce(title, '') <> '' AND coalesce(domain, '') <> ''),
n2 AS (SELECT n1.*, {_REPUTABLE} AS reputable, floor(len(list_intersect(kt.terms, {S.tokenize('title')}))::DOUBLE / len(kt.terms) * 100 + 0.5) / 100 AS match_ratio FROM n1 JOIN kt ON kt.claim_id = n1.claim_id WHERE k = 1 AND len(kt.terms) >= 4),
n3 AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY reputable DESC, match_ratio DESC, pos) AS n FROM n2),
nw AS (SELECT claim_id, n::INTEGER AS n, 'N' || n AS id, left(title, 300) AS title, url, domain, try_strptime(seendate, '%Y%m%dT%H%M%SZ') AS seen_at, reputable, match_ratio FROM n3 WHERE n <= 8),
co AS (SELECT claim_id, list(domain ORDER BY n) AS domains FROM nw WHERE reputable AND match_ratio >= 0.6 GROUP BY claim_id)"""
_NEWS = (PAGES, CLAIMS_SQL, TERMS, SEARCHED, NEWS)


def searched(spark, d) -> DataFrame:
    return lookups.news(services.news_calls(spark, d), claims(spark, d))


def feed(spark, d) -> DataFrame:
    return lookups.articles(searched(spark, d))


def news(spark, d) -> DataFrame:
    return E.rank_news(feed(spark, d), claims(spark, d), OUTLETS)


add("src_news", lambda s, d: searched(s, d).select("claim_id", "window_days", F.array_join("terms", "|").alias("terms"), "status", "message", F.coalesce(F.greatest(F.size("articles"), F.lit(0)), F.lit(0)).alias("articles")), f"{with_(*_NEWS)} SELECT i AS claim_id, {_DAYS} AS window_days, array_to_string(terms, '|') AS terms, status, message, CASE WHEN status = 'ok' AND t IS NOT NULL THEN 5 ELSE 0 END AS articles FROM ns")


def sources(spark, d) -> DataFrame:
    names = F.create_map(*[F.lit(x) for s in L.SOURCES for x in (s[0], s[1])])
    urls = F.create_map(*[F.lit(x) for s in L.SOURCES for x in (s[0], s[2])])
    return DQ.matches(spark, d).filter("rank <= 5").select("claim_id", "rank", names[F.col("id")].alias("name"), urls[F.col("id")].alias("url"))


def items(spark, d) -> DataFrame:
    return E.evidence_items(facts(spark, d), news(spark, d), sources(spark, d))


_SRC = ", ".join(f"({quoted(s[0])}, {quoted(s[1])}, {quoted(s[2])})" for s in L.SOURCES)
MATCH = DQ.MATCH[len(f"WITH {CLAIMS_SQL},") :]
PIECES = f"""sd(id, name, url) AS (VALUES {_SRC}),
it AS (SELECT claim_id, id, 'fact-check' AS kind, publisher || ' rated the claim "' || coalesce(nullif(claim_text, ''), title) || '" as "' || rating || '" (' || coalesce(left(reviewed_at, 10), 'date unknown') || ').' AS text FROM fc
UNION ALL SELECT claim_id, id, 'article', domain || CASE WHEN reputable THEN ' (reputable outlet)' ELSE '' END || ', ' || coalesce(left(seen_at::VARCHAR, 10), 'date unknown') || ': "' || title || '"' FROM nw
UNION ALL SELECT w.claim_id, 'S' || rank, 'official-source', sd.name || ' — ' || sd.url FROM w JOIN sd ON sd.id = w.id WHERE rank <= 5)"""
_ITEMS = (*_NEWS, *_FACTS, MATCH, PIECES)
ITEMS = with_(*_ITEMS)

# The model's answers: to the evidence, and by its own knowledge.

_BUSY = "NOT (coalesce(code, 503) = 429 OR coalesce(code, 503) >= 500)"
ASKED = ladder_sql("grounded", "g", 3, _BUSY)
GROUNDED = rf"""al AS (SELECT claim_id, list(id) AS allowed, bool_or(kind <> 'official-source') AS enough FROM it GROUP BY claim_id),
a0 AS (SELECT i AS claim_id, made, coalesce(code, 503) AS code, CASE WHEN code BETWEEN 200 AND 299 THEN CASE WHEN broken THEN '' ELSE {services.GROUNDED_SQL} END END AS content FROM gl),
a1 AS (SELECT *, coalesce(content, '') AS raw, regexp_extract(coalesce(content, ''), '(?s)\{{.*\}}', 0) AS inner_text FROM a0),
a2 AS (SELECT *, CASE WHEN json_valid(raw) AND raw <> '' THEN raw WHEN json_valid(inner_text) AND inner_text <> '' THEN inner_text END AS js FROM a1),
a3 AS (SELECT *, json_extract_string(js, '$.verdict') AS v, TRY_CAST(json_extract_string(js, '$.confidence') AS DOUBLE) AS c, coalesce(trim(json_extract_string(js, '$.reasoning')), '') AS t,
  list_transform(json_extract_string(js, '$.citedEvidenceIds[*]'), lambda x: trim(x)) AS ids0 FROM a2),
a4 AS (SELECT a3.*, coalesce(enough, false) AS enough, list_filter(ids0, lambda x, i: list_position(ids0, x) = i) AS ids, coalesce(allowed, []) AS allowed FROM a3 LEFT JOIN al ON al.claim_id = a3.claim_id),
a5 AS (SELECT *, list_filter(ids, lambda x: NOT list_contains(allowed, x)) AS unknown FROM a4),
gr AS (SELECT *, content IS NOT NULL AS answered, CASE WHEN js IS NULL AND inner_text = '' THEN 'no-json' WHEN js IS NULL THEN 'bad-json' WHEN NOT (v IN ('supported', 'contradicted', 'unverifiable') AND c BETWEEN 0 AND 100 AND length(t) BETWEEN 1 AND 2000) THEN 'schema'
  WHEN len(unknown) > 0 THEN 'unknown-ids:' || array_to_string(unknown, ',') WHEN v <> 'unverifiable' AND len(ids) = 0 THEN 'no-citations' END AS reason FROM a5)"""
_ASKED = (*_ITEMS, ASKED, GROUNDED)


def answers(spark, d) -> DataFrame:
    """The read of the evidence: verdict where it came and stuck to the evidence."""
    return lookups.grounded(services.grounded_calls(spark, d), items(spark, d).select("claim_id", "id", "kind"))


def raw_answers(spark, d) -> DataFrame:
    """Every answer that came, whatever the evidence is, parsed."""
    shown = items(spark, d).groupBy("claim_id").agg(F.collect_list("id").alias("allowed"))  # at most 21 a claim
    rows = lookups.model_calls(services.grounded_calls(spark, d)).filter("ok").join(shown, "claim_id", "left")
    return E.parse_grounded(rows.select("claim_id", F.col("content").alias("raw"), F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed")))


_KEPT = lambda c: f"CASE WHEN ok THEN {c} END"
_MESSAGE = " ".join(f"WHEN code = {k} THEN {quoted(t)}" for k, t in M.GATEWAY.items())
add(
    "src_llm", answers,
    f"""{with_(*_ASKED)}, ax AS (SELECT *, enough AND answered AND reason IS NULL AS ok FROM gr)
SELECT claim_id, CASE WHEN NOT enough THEN 'skipped' WHEN ok THEN 'ok' ELSE 'error' END AS status, CASE WHEN NOT enough THEN {quoted(M.READ_SKIPPED)} WHEN NOT answered THEN CASE {_MESSAGE} ELSE {quoted(M.BUSY)} END WHEN NOT ok THEN {quoted(M.READ_REFUSED)} END AS message,
  CASE WHEN enough THEN made ELSE 0 END::INTEGER AS attempts, CASE WHEN enough THEN [0, 800, 2400][made] ELSE 0 END::BIGINT AS waited_ms, {_KEPT('v')} AS verdict, {_KEPT('floor(c + 0.5)::INTEGER')} AS confidence, {_KEPT('left(t, 1200)')} AS reasoning, {_KEPT("array_to_string(ids, ',')")} AS cited, CASE WHEN enough AND answered THEN reason END AS reason FROM ax""",
)
SAID = ladder_sql("opinion", "o", 3, _BUSY)
OPINION = f"""op AS (SELECT i AS claim_id, made, CASE WHEN coalesce(code, 503) NOT BETWEEN 200 AND 299 THEN coalesce(code, 503) WHEN broken THEN 502 ELSE 200 END AS code, {services.OPINION_SQL} FROM ol)"""


def opinions(spark, d) -> DataFrame:
    """claim_id, ok, code, attempts, waited_ms, verdict, confidence, reasoning; 502 for what isn't JSON."""
    rows = lookups.model_calls(services.opinion_calls(spark, d))
    said = E.parse_opinion(rows.filter("ok").select("claim_id", F.col("content").alias("raw")))
    rows = rows.join(said, "claim_id", "left").withColumn("code", F.when(F.col("ok") & F.col("verdict").isNull(), 502).otherwise(F.col("code")))
    return rows.select("claim_id", (F.col("code") == 200).alias("ok"), "code", "attempts", "waited_ms", "verdict", "confidence", "reasoning")


add("src_opinion", opinions, f"{with_(PAGES, SAID, OPINION)} SELECT claim_id, code = 200 AS ok, code::INTEGER AS code, made::INTEGER AS attempts, [0, 800, 2400][made]::BIGINT AS waited_ms, CASE WHEN code = 200 THEN verdict END AS verdict, CASE WHEN code = 200 THEN confidence END AS confidence, CASE WHEN code = 200 THEN reasoning END AS reasoning FROM op")


def decisions(spark, d) -> DataFrame:
    f = facts(spark, d).groupBy("claim_id").agg(F.count_if(F.col("rating_bucket").isin("false", "misleading")).alias("negative"), F.count_if(F.col("rating_bucket") == "true").alias("positive"), F.count_if(F.col("rating_bucket") == "mixed").alias("mixed"))
    c = E.corroborating(news(spark, d)).select("claim_id", F.size("domains").alias("domains"))
    g = answers(spark, d).select("claim_id", F.col("verdict").alias("opinion"))
    rows = DQ._scores(spark, d).select("claim_id", "language_risk").join(f, "claim_id", "left").join(c, "claim_id", "left").join(g, "claim_id", "left")
    return E.decide(rows.na.fill(0, ["negative", "positive", "mixed", "domains"]))


def on_claims(columns):
    return lambda spark, d: claims(spark, d).select("claim_id", *columns())


add("rating_lookup", lambda s, d: reviews(s, d).select("claim_id", "ci", "ri", E.rating_norm(F.col("rating")).alias("norm"), E.rating_bucket(F.col("rating")).alias("bucket")), f"{with_(PAGES, FOUND, REVIEWS, RATED)} SELECT claim_id, ci, ri, {norm_sql('rating')} AS norm, coalesce(a.bucket, b.bucket, 'unknown') AS bucket FROM rv LEFT JOIN rt a ON a.name = {norm_sql('rating')} LEFT JOIN rt b ON b.name = {norm_sql(_LEAD.format('rating'))}")
add("fc_query", on_claims(lambda: [E.fact_check_query(F.col("text")).alias("query")]), rf"WITH {CLAIMS_SQL}, q AS (SELECT claim_id, trim(regexp_replace(text, '{S.WHITE}+', ' ', 'g')) AS f FROM claims), c AS (SELECT claim_id, f, left(f, 200) AS c FROM q) SELECT claim_id, CASE WHEN length(f) <= 200 THEN f WHEN contains(c, ' ') AND length(c) - position(' ' IN reverse(c)) > 120 THEN left(c, length(c) - position(' ' IN reverse(c))) ELSE c END AS query FROM c")
add("normalise_claims", facts, f"{with_(*_FACTS)} SELECT * FROM fc")
add("dedupe_url", lambda s, d: facts(s, d).select("claim_id", "url"), f"{with_(*_FACTS)} SELECT claim_id, url FROM fc")
add("key_terms_news", on_claims(lambda: [F.array_join(E.news_terms(F.col("text")), "|").alias("terms")]), f"WITH {CLAIMS_SQL}, {TERMS} SELECT claim_id, array_to_string(terms, '|') AS terms FROM kt")
add("news_window", on_claims(lambda: [E.news_window(F.col("text")).alias("days")]), f"WITH {CLAIMS_SQL} SELECT claim_id, {_DAYS} AS days FROM claims")
add("news_skip", lambda s, d: claims(s, d).select("claim_id", F.when(F.size(E.news_terms(F.col("text"))) < 4, "skipped").otherwise("ok").alias("status")), f"WITH {CLAIMS_SQL}, {TERMS} SELECT claim_id, CASE WHEN len(terms) < 4 THEN 'skipped' ELSE 'ok' END AS status FROM kt")
add("news_top8", news, f"{with_(*_NEWS)} SELECT * FROM nw")
add("dedupe_domain", lambda s, d: news(s, d).select("claim_id", "domain"), f"{with_(*_NEWS)} SELECT claim_id, domain FROM nw")
add("title_match", lambda s, d: news(s, d).select("claim_id", "id", "match_ratio"), f"{with_(*_NEWS)} SELECT claim_id, id, match_ratio FROM nw")
add("relevant_news", lambda s, d: news(s, d).filter("match_ratio >= 0.6").select("claim_id", "id"), f"{with_(*_NEWS)} SELECT claim_id, id FROM nw WHERE match_ratio >= 0.6")
add("news_required_fields", lambda s, d: feed(s, d).filter("coalesce(url, '') <> '' and coalesce(title, '') <> '' and coalesce(domain, '') <> ''").groupBy("claim_id").agg(F.count("*").alias("n")), f"{with_(*_NEWS)} SELECT claim_id, count(*) AS n FROM n1 GROUP BY claim_id")
add("outlet_reputable", lambda s, d: news(s, d).select("claim_id", "domain", "reputable"), f"{with_(*_NEWS)} SELECT claim_id, domain, reputable FROM nw")
add("parse_seen", lambda s, d: feed(s, d).select("claim_id", "pos", E.seen_at(F.col("seendate")).alias("seen_at")), f"{with_(*_NEWS)} SELECT claim_id, pos::INTEGER AS pos, try_strptime(seendate, '%Y%m%dT%H%M%SZ') AS seen_at FROM nf")
add("corroborating", lambda s, d: E.corroborating(news(s, d)).withColumn("domains", F.array_join("domains", ",")), f"{with_(*_NEWS)} SELECT claim_id, array_to_string(domains, ',') AS domains, len(domains) >= 2 AS corroborated FROM co")
add("clean_prompt", on_claims(lambda: [E.clean_prompt(F.col("text")).alias("text")]), rf"WITH {CLAIMS_SQL} SELECT claim_id, trim(regexp_replace(regexp_replace(text, '[<>]', '', 'g'), '\s+', ' ', 'g')) AS text FROM claims")
_PARSED = "CASE WHEN reason IS NULL THEN {} END"
add("parse_grounded", raw_answers, f"{with_(*_ASKED)} SELECT claim_id, reason IS NULL AS ok, reason, {_PARSED.format('v')} AS verdict, {_PARSED.format('floor(c + 0.5)::INTEGER')} AS confidence, {_PARSED.format('left(t, 1200)')} AS reasoning, {_PARSED.format("array_to_string(ids, ',')")} AS cited FROM gr WHERE answered")
add("cited_ids_subset", lambda s, d: raw_answers(s, d).select("claim_id", (~F.coalesce(F.startswith("reason", F.lit("unknown-ids")), F.lit(False))).alias("subset")), f"{with_(*_ASKED)} SELECT claim_id, NOT coalesce(starts_with(reason, 'unknown-ids'), false) AS subset FROM gr WHERE answered")
add("parse_opinion", lambda s, d: E.parse_opinion(lookups.model_calls(services.opinion_calls(s, d)).filter("ok").select("claim_id", F.col("content").alias("raw"))), f"{with_(PAGES, SAID, OPINION)} SELECT claim_id, verdict, confidence, reasoning FROM op WHERE code = 200")
add("evidence_items", items, f"{ITEMS} SELECT * FROM it")
add("evidence_ids", lambda s, d: items(s, d).select("claim_id", "id"), f"{ITEMS} SELECT claim_id, id FROM it")
add("grounded_gate", lambda s, d: items(s, d).groupBy("claim_id").agg(F.bool_or(F.col("kind") != "official-source").alias("enough")), f"{ITEMS} SELECT claim_id, bool_or(kind <> 'official-source') AS enough FROM it GROUP BY claim_id")
DECIDE = f"""{with_(*_ASKED)},
fk AS (SELECT claim_id, count(*) FILTER (WHERE rating_bucket IN ('false', 'misleading')) AS neg, count(*) FILTER (WHERE rating_bucket = 'true') AS pos, count(*) FILTER (WHERE rating_bucket = 'mixed') AS mix FROM fc GROUP BY claim_id),
de AS (SELECT c.claim_id, coalesce(neg, 0) AS neg, coalesce(pos, 0) AS pos, coalesce(mix, 0) AS mix, coalesce(len(domains), 0) AS dom, CASE WHEN gr.enough AND gr.answered AND gr.reason IS NULL THEN gr.v END AS opinion
  FROM claims c LEFT JOIN fk ON fk.claim_id = c.claim_id LEFT JOIN co ON co.claim_id = c.claim_id LEFT JOIN gr ON gr.claim_id = c.claim_id)"""
_RULE = "CASE WHEN neg > 0 THEN 'a' WHEN coalesce(opinion, '') = 'contradicted' THEN 'f' WHEN pos > 0 THEN 'b' WHEN dom >= 2 AND mix = 0 THEN 'c' ELSE 'f' END"
_OUTCOME = "rule, CASE rule WHEN 'a' THEN 'likely-misleading' WHEN 'f' THEN 'unverified' ELSE 'likely-credible' END AS verdict, CASE WHEN rule = 'f' THEN 'low' WHEN rule = 'a' THEN ['high', 'medium', 'low'][1 + (pos > 0)::INTEGER + (coalesce(opinion, '') = 'supported')::INTEGER] WHEN opinion = 'supported' THEN 'high' ELSE 'medium' END AS confidence"
add("decide", decisions, f"{DECIDE}, ru AS (SELECT *, {_RULE} AS rule FROM de) SELECT claim_id, {_OUTCOME} FROM ru")


def flags(spark, d) -> DataFrame:
    """What a decision looks at: kinds of reviews, and how many distinct outlets report the claim."""
    f = facts(spark, d).groupBy("claim_id").agg(F.bool_or(F.col("rating_bucket").isin("false", "misleading")).alias("negative"), F.bool_or(F.col("rating_bucket") == "true").alias("positive"), F.bool_or(F.col("rating_bucket") == "mixed").alias("mixed"))
    c = E.corroborating(news(spark, d)).select("claim_id", F.size(F.array_distinct("domains")).alias("outlets"))
    return claims(spark, d).select("claim_id").join(f, "claim_id", "left").join(c, "claim_id", "left").na.fill(False).na.fill(0, ["outlets"])


add("decide_flags", flags, f"{DECIDE} SELECT claim_id, neg > 0 AS negative, pos > 0 AS positive, mix > 0 AS mixed, dom::INTEGER AS outlets FROM de")

#: What stands before an outlet's domain: nothing, subdomains, and what makes it another domain.
PREFIXES = ["", "m.", "www.", "not-", "en.www."]


def registered(spark, d) -> DataFrame:
    """A domain made from each outlet in turn for every page, and whether it is reputable."""
    i = F.col("page_id")
    rows = read(spark, d, "pages").select("page_id", F.concat(pick(PREFIXES, F.floor(i / len(L.OUTLETS))), pick(L.OUTLETS, i)).alias("raw"))
    return rows.select("page_id", E.domain(F.col("raw")).alias("domain")).withColumn("reputable", E.reputable(F.col("domain")))


REGISTERED = rf"""o AS (SELECT page_id, trim(regexp_replace(lower({sql_list(PREFIXES)}[(page_id // {len(L.OUTLETS)}) % {len(PREFIXES)} + 1] || {sql_list(L.OUTLETS)}[page_id % {len(L.OUTLETS)} + 1]), '^www\.', '')) AS domain FROM pages)"""
add("outlet_registry", registered, f"WITH {REGISTERED} SELECT page_id, domain, EXISTS (SELECT 1 FROM (SELECT unnest({sql_list(L.OUTLETS)}) AS x) t WHERE domain = x OR ends_with(domain, '.' || x)) AS reputable FROM o")
