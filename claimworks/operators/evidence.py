"""Fact-checks, news coverage, grounded answers and the final decision, as joins and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimworks.functions import lexicon as L
from claimworks.functions.text import flat, strings, tokenize


def rating_norm(rating: Column) -> Column:
    s = F.regexp_replace(F.lower(rating), "[’‘]", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9' ]+", " "), r"\s+", " "))


def rating_lead(rating: Column) -> Column:
    """The text before the first mark that ends a clause."""
    return F.regexp_extract(rating, "^([^.:;!—–(,]*)", 1)


def rating_bucket(rating: Column) -> Column:
    """Bucket of the whole rating, else of its lead clause, else unknown."""
    table = F.create_map(*[F.lit(x) for name, bucket in L.RATINGS.items() for x in (name, bucket)])
    at = lambda s: F.try_element_at(table, s)
    return F.coalesce(at(rating_norm(rating)), at(rating_norm(rating_lead(rating))), F.lit("unknown"))


def fact_check_query(text: Column) -> Column:
    """At most 200 characters, cut at the last space behind the 120th, if there is one."""
    line = flat(text)
    cut = F.left(line, F.lit(200))
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    return F.when(F.length(line) <= 200, line).when(F.contains(cut, F.lit(" ")) & (space > 120), F.left(cut, space)).otherwise(cut)


def filled(c: Column) -> Column:
    """null for an empty string."""
    return F.when(c != "", c)


def normalise_claims(raw: DataFrame, most: int = 8) -> DataFrame:
    """raw(claim_id, ci, text, ri, name, site, url, title, date, rating), one row per review:
    reviews with a URL, the first per claim and URL in (ci, ri) order, at most eight a claim,
    numbered F1, F2, ... A review without publisher, title or rating gets the stated defaults."""
    rows = raw.filter(filled(F.col("url")).isNotNull())
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("claim_id", "url").orderBy("ci", "ri"))).filter("n = 1")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("claim_id").orderBy("ci", "ri"))).filter(F.col("n") <= most)
    rating = F.trim(F.coalesce("rating", F.lit("")))
    return rows.select(
        "claim_id", "n", F.concat(F.lit("F"), F.col("n")).alias("id"), F.coalesce(filled(F.col("name")), filled(F.col("site")), F.lit("Unknown publisher")).alias("publisher"), "url",
        F.left(F.coalesce("title", "text", F.lit("")), F.lit(300)).alias("title"), F.when(rating == "", "No rating given").otherwise(rating).alias("rating"),
        F.when(rating == "", "unknown").otherwise(rating_bucket(rating)).alias("rating_bucket"), F.col("date").alias("reviewed_at"), F.left(F.coalesce("text", F.lit("")), F.lit(300)).alias("claim_text"),
    )


def news_terms(text: Column, begin: int = 600) -> Column:
    """Up to six distinctive tokens in order of first appearance. Where the text's beginning has a
    seventh, the six are whole tokens of it, as a cut one is the last; other texts are read whole."""

    def distinct(part):
        kept = F.filter(tokenize(part), lambda t: (F.length(t) >= 4) & ~t.isin(L.NEWS_STOP) & ~F.rlike(t, F.lit("^[0-9]+$")))
        return F.array_distinct(kept)

    first = distinct(F.left(text, F.lit(begin)))
    return F.slice(F.when(F.size(first) > 6, first).otherwise(distinct(text)), 1, 6)


def news_window(text: Column) -> Column:
    """What stands before a word is looked at behind its first letter, else it is at every place."""
    first = "".join(sorted({w[0] for w in L.BREAKING}))
    words = "|".join(f"(?<={w[0]}){w[1:]}" for w in L.BREAKING)
    return F.when(F.rlike(text, F.lit(f"(?i)[{first}](?<![A-Za-z0-9_].)(?:{words})(?![A-Za-z0-9_])")), 7).otherwise(90)


def domain(d: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(d), r"^www\.", ""))


def reputable(d: Column, outlets=tuple(L.OUTLETS)) -> Column:
    """Whether a normalised domain is an outlet or one of its subdomains."""
    return F.exists(strings(outlets), lambda o: (d == o) | F.endswith(d, F.concat(F.lit("."), o)))


def title_match(title: Column, terms: Column) -> Column:
    """Share of the key terms in the title's tokens, half-up to two places; 0 without terms."""
    share = F.try_divide(F.size(F.array_intersect(terms, tokenize(title))), F.size(terms))
    return F.floor(F.coalesce(share, F.lit(0.0)) * 100 + 0.5) / 100


def seen_at(s: Column) -> Column:
    return F.try_to_timestamp(s, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def rank_news(feed: DataFrame, claims: DataFrame, outlets=tuple(L.OUTLETS), most: int = 8) -> DataFrame:
    """feed(claim_id, pos, url, title, domain, seendate), claims(claim_id, text): the first article
    of each domain, reputable ones and better matches first, at most eight a claim, N1, N2, ...
    Claims of fewer than four key terms get none. Articles without URL, title or domain don't count."""
    terms = claims.select("claim_id", news_terms(F.col("text")).alias("terms")).filter(F.size("terms") >= 4)
    rows = feed.filter("coalesce(url, '') <> '' and coalesce(title, '') <> '' and coalesce(domain, '') <> ''").withColumn("domain", domain(F.col("domain")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("claim_id", "domain").orderBy("pos"))).filter("n = 1")
    rows = rows.join(terms, "claim_id").withColumns({"reputable": reputable(F.col("domain"), outlets), "match_ratio": title_match(F.col("title"), F.col("terms"))})
    order = Window.partitionBy("claim_id").orderBy(F.desc("reputable"), F.desc("match_ratio"), "pos")
    rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return rows.select("claim_id", "n", F.concat(F.lit("N"), F.col("n")).alias("id"), F.left("title", F.lit(300)).alias("title"), "url", "domain", seen_at(F.col("seendate")).alias("seen_at"), "reputable", "match_ratio")


def corroborating(articles: DataFrame) -> DataFrame:
    """claim_id, domains in ranked order, corroborated: reputable domains that match by 0.6 at least."""
    rows = articles.filter("reputable and match_ratio >= 0.6").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("n", "domain"))).alias("d"))  # at most eight a claim
    return rows.select("claim_id", F.transform("d", lambda x: x["domain"]).alias("domains"), (F.size("d") >= 2).alias("corroborated"))


def parse_grounded(rows: DataFrame) -> DataFrame:
    """rows(claim_id, raw, allowed): ok, reason, verdict, confidence, reasoning, cited. A raw text
    that isn't JSON is read from its first to its last brace."""
    shape = "verdict string, confidence double, reasoning string, citedEvidenceIds array<string>"
    parsed = lambda c: F.when(F.coalesce(F.get_json_object(c, "$").isNotNull(), F.lit(False)) & F.startswith(F.trim(c), F.lit("{")), F.from_json(c, shape))
    inner = F.regexp_extract("raw", r"(?s)\{.*\}", 0)
    rows = rows.withColumn("v", F.coalesce(parsed(F.col("raw")), parsed(F.when(inner != "", inner)))).withColumn("inner", inner)
    v, ids = F.col("v"), F.array_distinct(F.transform("v.citedEvidenceIds", lambda x: F.trim(x)))
    text = F.trim(F.col("v.reasoning"))
    good = F.col("v.verdict").isin("supported", "contradicted", "unverifiable") & F.col("v.confidence").between(0, 100) & F.length(text).between(1, 2000) & (F.size("v.citedEvidenceIds") <= 30) & ~F.exists("v.citedEvidenceIds", lambda x: x.isNull())
    unknown = F.array_except(ids, "allowed")
    reason = F.when(v.isNull() & (F.col("inner") == ""), "no-json").when(v.isNull(), "bad-json").when(~F.coalesce(good, F.lit(False)), "schema").when(F.size(unknown) > 0, F.concat(F.lit("unknown-ids:"), F.array_join(unknown, ","))).when((F.col("v.verdict") != "unverifiable") & (F.size(ids) == 0), "no-citations")
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.select("claim_id", ok.alias("ok"), "reason", F.when(ok, F.col("v.verdict")).alias("verdict"), F.when(ok, F.floor(F.col("v.confidence") + 0.5).cast("int")).alias("confidence"), F.when(ok, F.left(text, F.lit(1200))).alias("reasoning"), F.when(ok, F.array_join(ids, ",")).alias("cited"))


def parse_opinion(rows: DataFrame) -> DataFrame:
    """rows(claim_id, raw): verdict (uncertain unless it is one of three), confidence clamped to 0..100
    (default 0) and reasoning (at most 800 characters) of an answer that may stand in a code fence. An
    answer that isn't JSON gives no row."""
    body = F.trim(F.regexp_replace("raw", "(?i)^```(?:json)?\\s*|\\s*```$", ""))
    at = lambda k: F.get_json_object(body, f"$.{k}")
    number = F.coalesce(at("confidence").try_cast("double"), F.lit(0.0))
    verdict = F.when(at("verdict").isin("likely-false", "likely-true", "uncertain"), at("verdict")).otherwise("uncertain")
    rows = rows.filter(F.get_json_object(body, "$").isNotNull())
    return rows.select("claim_id", verdict.alias("verdict"), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)) + 0.5).cast("int").alias("confidence"), F.left(F.coalesce(at("reasoning"), F.lit("")), F.lit(800)).alias("reasoning"))


def clean_prompt(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[<>]", ""), r"\s+", " "))


def evidence_items(fact_checks: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, id, kind, text of three kinds of evidence. sources(claim_id, rank, name, url)."""
    day = lambda c: F.coalesce(F.left(c.cast("string"), F.lit(10)), F.lit("date unknown"))
    quote = F.lit('"')
    a = fact_checks.select("claim_id", "id", F.lit("fact-check").alias("kind"), F.concat("publisher", F.lit(" rated the claim "), quote, F.coalesce(filled(F.col("claim_text")), F.col("title")), quote, F.lit(" as "), quote, "rating", quote, F.lit(" ("), day(F.col("reviewed_at")), F.lit(").")).alias("text"))
    b = articles.select("claim_id", "id", F.lit("article").alias("kind"), F.concat("domain", F.when(F.col("reputable"), " (reputable outlet)").otherwise(""), F.lit(", "), day(F.col("seen_at")), F.lit(": "), quote, "title", quote).alias("text"))
    c = sources.select("claim_id", F.concat(F.lit("S"), F.col("rank")).alias("id"), F.lit("official-source").alias("kind"), F.concat("name", F.lit(" — "), "url").alias("text"))
    return a.unionByName(b).unionByName(c)


def outcome() -> dict[str, Column]:
    """verdict, confidence, rule from negative, positive, mixed, domains (counts) and opinion. Fact-checks that dispute a claim come first, then those that confirm
    it, then two outlets; an opinion only moves the confidence or takes a credible outcome back."""
    n, p, m, d = (F.col("negative") > 0, F.col("positive") > 0, F.col("mixed") > 0, F.col("domains") >= 2)
    against, credible = n, ~n & (p | (d & ~m))
    back = F.coalesce(F.col("opinion") == "contradicted", F.lit(False))
    agrees = F.coalesce(F.col("opinion") == "supported", F.lit(False))
    steps = p.cast("int") + agrees.cast("int")
    verdict = F.when(against, "likely-misleading").when(credible & ~back, "likely-credible").otherwise("unverified")
    confidence = F.when(against, F.when(steps == 0, "high").when(steps == 1, "medium").otherwise("low")).when(credible & ~back, F.when(agrees, "high").otherwise("medium")).otherwise("low")
    rule = F.when(against, "a").when(credible & ~back, F.when(p, "b").otherwise("c")).otherwise("f")
    return {"verdict": verdict, "confidence": confidence, "rule": rule}


def decide(rows: DataFrame) -> DataFrame:
    """rows(claim_id and the columns of outcome) -> claim_id, verdict, confidence, rule."""
    return rows.select("claim_id", *[c.alias(n) for n, c in outcome().items()])
