"""Raw replies of the lookup services: a row for each attempt, with its HTTP code and its body.

A call table is calls(claim_id, attempt, code, body). attempt counts from 0; code is null where no
answer came. The functions below make such tables from the given ones: an event is an attempt (ten
events are the attempts of one claim's requests, and its value chooses the code), and the claim's
page supplies what the service found. Bodies are JSON text, some of them cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimworks.sources.tables import claims, read, sql_list

#: First and last event of a claim that is an attempt of the service.
SLOTS = {"factcheck": (0, 1), "news": (2, 2), "grounded": (3, 5), "opinion": (6, 8)}
#: Codes of attempts; 0: no answer.
CODES = {
    "factcheck": [200, 200, 500, 200, 404, 200, 200, 503, 200, 0, 200],
    "news": [200, 200, 200, 429, 200, 200, 0, 200, 200],
    "grounded": [200, 429, 200, 500, 200, 200, 503, 200, 402, 200, 200, 0, 200],
    "opinion": [200, 503, 200, 200, 429, 200, 403, 0, 200],
}
#: One attempt in so many has a body that is cut off.
BROKEN = 17
RATINGS = ["False", "Mostly False.", "TRUE!", "Half-true", "Misleading: old video", "  Pants on Fire ", "", "Correct", "No idea", "Missing context (edited)", "Partly true", "“Fake news” — doctored"]
VERDICTS = ["supported", "contradicted", "unverifiable", "supported", "maybe"]
CITED = ["F1", "N1", " N2 ", "F1,S1", "", "Z9,F1", "S1"]


def pick(values, key) -> Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def attempts(spark, sf_dir: str, service: str) -> DataFrame:
    """claim_id, attempt, code, v (a number of the event), title, host (of the claim's page)."""
    low, high = SLOTS[service]
    slot = F.col("event_id") % 10
    e = read(spark, sf_dir, "events").filter(slot.between(low, high))
    e = e.select(F.expr("event_id div 10").alias("claim_id"), (slot - low).cast("int").alias("attempt"), F.round(F.col("value") * 100).cast("long").alias("v"))
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    code = pick(CODES[service], F.col("v"))
    return e.withColumn("code", F.when(code > 0, code)).join(p, F.expr("claim_id div 4") == F.col("page_id"), "left").drop("page_id")


def _cut(rows: DataFrame, body: Column) -> DataFrame:
    body = F.when(F.col("code").between(200, 299), F.coalesce(body, F.lit("{}"))).otherwise("Bad gateway")
    return rows.select("claim_id", "attempt", "code", F.when(F.col("code").isNotNull(), F.when(F.col("v") % BROKEN == 3, F.left(body, F.lit(20))).otherwise(body)).alias("body"))


def factcheck_calls(spark, sf_dir: str) -> DataFrame:
    """Up to three claims of one or two reviews; some lack a text, their reviews or parts of them."""
    rows = attempts(spark, sf_dir, "factcheck")
    i, host, title = F.col("claim_id"), F.col("host"), F.col("title")

    def review(k: int) -> Column:
        j = 5 * i + k
        publisher = F.struct(F.when(j % 7 == 0, "").otherwise(F.upper(host)).alias("name"), F.when(j % 14 != 0, host).alias("site"))
        url = F.when(j % 11 == 3, "").otherwise(F.concat(F.lit("https://"), host, F.lit("/"), (j % 3).cast("string")))
        date = F.concat(F.lit("2024-05-"), F.lpad((j % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
        return F.struct(publisher.alias("publisher"), url.alias("url"), F.when(j % 4 != 0, title).alias("title"), F.when(j % 6 != 0, date).alias("reviewDate"), pick(RATINGS, j).alias("textualRating"))

    about = F.concat(F.lit("About "), title)
    texts = [about, F.when(i % 3 != 1, about), about]
    found = [F.array(review(0), review(1)), F.array(review(2), review(3)), F.when(i % 5 != 4, F.array(review(4)))]
    body = F.to_json(F.struct(F.array(*[F.struct(t.alias("text"), r.alias("claimReview")) for t, r in zip(texts, found, strict=True)]).alias("claims")))
    return _cut(rows, F.when(title.isNotNull(), body))


def news_calls(spark, sf_dir: str) -> DataFrame:
    """Five articles; every third title begins with the claim's opening."""
    opening = claims(spark, sf_dir).select(F.col("claim_id").alias("id"), F.substring_index("text", ".", 1).alias("opening"))
    rows = attempts(spark, sf_dir, "news").join(opening, F.col("claim_id") == F.col("id"), "left")
    i, host, title = F.col("claim_id"), F.col("host"), F.col("title")

    def article(k: int) -> Column:
        j = 5 * i + k
        domain = [host, F.concat(F.lit("WWW."), host), F.concat(F.lit("m."), host), F.concat(host, F.lit(".test")), F.when(j % 7 != 0, F.concat(F.lit("x"), host))][k]
        words = F.when(j % 13 == 5, "").when(j % 3 == 0, F.concat(F.coalesce("opening", F.lit("")), F.lit(" "), title)).otherwise(title)
        seen = F.when(j % 5 == 0, "soon").otherwise(F.concat(F.lit("202406"), F.lpad((j % 28 + 1).cast("string"), 2, "0"), F.lit("T101500Z")))
        return F.struct(F.concat(F.lit("https://"), host, F.lit(f"/{k}")).alias("url"), words.alias("title"), domain.alias("domain"), seen.alias("seendate"))

    body = F.to_json(F.struct(F.array(*[article(k) for k in range(5)]).alias("articles")))
    return _cut(rows, F.when(title.isNotNull(), body))


def _model_calls(rows: DataFrame, content: Column) -> DataFrame:
    return _cut(rows, F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))))


def grounded_calls(spark, sf_dir: str) -> DataFrame:
    """Answers that should cite evidence: JSON, JSON within prose, prose, or JSON of another shape."""
    v, title = F.col("v"), F.col("title")
    cited = F.split(pick(CITED, v), ",")
    answer = F.to_json(F.struct(pick(VERDICTS, v).alias("verdict"), (v % 23 * 5.0).alias("confidence"), F.concat(F.lit(" About "), title).alias("reasoning"), F.when(pick(CITED, v) == "", F.array().cast("array<string>")).otherwise(cited).alias("citedEvidenceIds")))
    content = F.when(v % 9 == 4, "I can't say.").when(v % 9 == 7, F.concat(F.lit("Sure! "), answer, F.lit(" Done."))).when(v % 19 == 2, F.lit('{"verdict": "supported" ')).otherwise(answer)
    return _model_calls(attempts(spark, sf_dir, "grounded"), content)


def opinion_calls(spark, sf_dir: str) -> DataFrame:
    """Answers without evidence; some in a code fence, some with a confidence that is no number."""
    v, title = F.col("v"), F.col("title")
    plain = F.to_json(F.struct(F.when(v % 6 != 0, pick(["likely-false", "uncertain", "likely-true"], v)).alias("verdict"), F.when(v % 8 == 1, "high").otherwise((v % 300 - 50).cast("string")).alias("confidence"), F.concat(title, F.lit(" and so on")).alias("reasoning")))
    content = F.when(v % 5 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).otherwise(plain)
    return _model_calls(attempts(spark, sf_dir, "opinion"), content)


# The same tables for DuckDB; what the bodies hold as rows instead of JSON.

PAGES_SQL = "pg AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(url, '//([^/]+)', 1) AS h FROM pages)"


def attempts_sql(service: str, name: str) -> str:
    """name(i: claim, attempt, v, code, broken, t, h)."""
    low, high = SLOTS[service]
    codes = CODES[service]
    return f"""{name} AS (SELECT event_id // 10 AS i, (event_id % 10 - {low})::INTEGER AS attempt, round(value * 100)::BIGINT AS v, nullif({codes}[round(value * 100)::BIGINT % {len(codes)} + 1], 0) AS code,
  round(value * 100)::BIGINT % {BROKEN} = 3 AND t IS NOT NULL AS broken, t, h FROM events LEFT JOIN pg ON page_id = event_id // 40 WHERE event_id % 10 BETWEEN {low} AND {high})"""


REVIEWS_SQL = rf"""rv AS (SELECT i AS claim_id, (k // 2)::INTEGER AS ci, CASE WHEN k // 2 <> 1 OR i % 3 <> 1 THEN 'About ' || t END AS text, (k % 2)::INTEGER AS ri, CASE WHEN j % 7 = 0 THEN '' ELSE upper(h) END AS name, CASE WHEN j % 14 <> 0 THEN h END AS site,
  CASE WHEN j % 11 = 3 THEN '' ELSE 'https://' || h || '/' || (j % 3)::VARCHAR END AS url, CASE WHEN j % 4 <> 0 THEN t END AS title,
  CASE WHEN j % 6 <> 0 THEN '2024-05-' || lpad((j % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' END AS date, {sql_list(RATINGS)}[j % {len(RATINGS)} + 1] AS rating
  FROM (SELECT i, t, h, k, 5 * i + k AS j FROM fs, (SELECT unnest(range(0, 5)) AS k) WHERE status = 'ok' AND t IS NOT NULL) WHERE k < 4 OR i % 5 <> 4)"""

ARTICLES_SQL = r"""nf AS (SELECT i AS claim_id, k AS pos, 'https://' || h || '/' || k AS url, CASE WHEN j % 13 = 5 THEN '' WHEN j % 3 = 0 THEN coalesce(string_split(text, '.')[1], '') || ' ' || t ELSE t END AS title,
  trim(regexp_replace(lower([h, 'WWW.' || h, 'm.' || h, h || '.test', CASE WHEN j % 7 <> 0 THEN 'x' || h END][k + 1]), '^www\.', '')) AS domain,
  CASE WHEN j % 5 = 0 THEN 'soon' ELSE '202406' || lpad((j % 28 + 1)::VARCHAR, 2, '0') || 'T101500Z' END AS seendate
  FROM (SELECT i, t, h, text, k, 5 * i + k AS j FROM ns, (SELECT unnest(range(0, 5)) AS k) WHERE status = 'ok' AND t IS NOT NULL))"""

GROUNDED_SQL = rf"""CASE WHEN v % 9 = 4 THEN 'I can''t say.' WHEN v % 19 = 2 AND v % 9 <> 7 THEN '{{"verdict": "supported" ' ELSE CASE WHEN v % 9 = 7 THEN 'Sure! ' ELSE '' END ||
  to_json({{'verdict': {sql_list(VERDICTS)}[v % {len(VERDICTS)} + 1], 'confidence': v % 23 * 5.0, 'reasoning': ' About ' || t, 'citedEvidenceIds': list_filter(string_split({sql_list(CITED)}[v % {len(CITED)} + 1], ','), lambda x: x <> '')}})::VARCHAR || CASE WHEN v % 9 = 7 THEN ' Done.' ELSE '' END END"""

OPINION_SQL = """CASE WHEN v % 6 <> 0 THEN ['likely-false', 'uncertain', 'likely-true'][v % 3 + 1] ELSE 'uncertain' END AS verdict,
  floor(greatest(0, least(100, CASE WHEN v % 8 = 1 THEN 0 ELSE v % 300 - 50 END)) + 0.5)::INTEGER AS confidence, left(coalesce(t || ' and so on', ''), 800) AS reasoning"""
