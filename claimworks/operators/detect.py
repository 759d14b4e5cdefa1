"""Language risk of claims: one narrow projection from text to signals, scores and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimworks.functions import lexicon as L
from claimworks.functions.text import among, around, clamp, count_terms, find_terms, half_up, has, has_any, joined, reduced, tokenize, trimmed

#: What stands before a match is looked at behind its first character, else it is at every place.
NUMBER = r"(?i)\d(?<![A-Za-z0-9_]\d)[\d,.]*\s?(?:%|percent|crore|lakh|million|billion|kg|km)?"
DAY = "^(0?[1-9]|[12][0-9]|3[01])(st|nd|rd|th)?$"
YEAR = "^(19|20)[0-9]{2}$"
ORDINAL_YEAR = "^(19|20)[0-9]{2}(st|nd|rd|th)?$"

#: Bodies by number of tokens, longest first; equal lengths in list order.
BY_LENGTH = sorted(L.BODIES, key=lambda b: -len(b.split()))


BODY_WORDS = sorted({w for b in [*L.BODIES, "who"] for w in b.split()})

#: A word of each body that it can't do without: most texts have none, so they aren't searched for bodies.
BODY_KEYS = sorted({max(b.split(), key=len) for b in [*L.BODIES, "who"]})

#: The words of all lists of terms.
RUMOURS = ["rumour", "rumours", "rumor", "false"]
_LISTS = [L.SENSATIONAL, L.HEDGING, L.EMOTION, L.URGENCY, L.FORWARD, L.CLICKBAIT, L.DEBUNK, RUMOURS, *L.TOPICS.values()]
WORDS = sorted({w for terms in _LISTS for t in terms for w in t.split()})

#: Those of them that are no term by themselves: they count beside another word only.
PARTS = sorted(set(WORDS) - {t for terms in _LISTS for t in terms})

#: Words without which nothing is found: a word of each term and body that it can't do without, and months.
KEYS = sorted({*(max(t.split(), key=len) for terms in [*_LISTS, L.BODIES] for t in terms), "who", *L.MONTHS})

#: What counts near a key only; so do numbers that can be a day.
BESIDE = sorted({*WORDS, *BODY_WORDS, *L.VERBS, "according", "to", "as", "per"} - {*KEYS})

#: In how many tokens from a key: a verb is up to six behind a body's key, "according" up to seven before it.
REACH = 8


def near(tokens: Column) -> Column:
    """The keys and years, what counts beside them, and marks for other tokens, without what lies more
    than REACH tokens from all keys. Dates, bodies, attributions and terms are the same as in all tokens.
    What has an apostrophe after or before a word of an attribution counts as that word there."""
    key = lambda t: t.isin(*KEYS) | is_year(t) | (F.contains(t, F.lit("'")) & F.rlike(t, F.lit("^(to|per)'|'(according|as)$")))
    return F.split(around(tokens, key, lambda t: t.isin(*BESIDE) | ((t < ":") & (F.length(t) <= 6)), REACH * (1 + max(map(len, BESIDE))) + max(map(len, KEYS)) + 2), " ")


def ascii_letters(raw: Column, tokens: Column) -> Column:
    """The number of letters A-Z and a-z: those of the tokens, but where a letter becomes one of them
    in lower case."""
    j = F.array_join(tokens, "")
    return F.when(F.contains(raw, F.lit("\u212a")) | F.contains(raw, F.lit("\u0130")), letters(raw, "[A-Za-z]+")).otherwise(F.length(j) - letters(j, "[0-9']+"))


def letters(raw: Column, runs: str) -> Column:
    """How many characters the runs of a pattern have; runs are fewer than what stands between characters."""
    return F.length(F.array_join(F.regexp_extract_all(raw, F.lit(runs), F.lit(0)), ""))


def language(raw: Column, plain: Column) -> Column:
    """plain: the number of letters A-Z and a-z."""
    others = F.when(F.octet_length(raw) == F.length(raw), 0).otherwise(letters(raw, r"[\p{L}&&[^\x{0}-\x{7F}]]+"))
    all_letters = plain + others
    return F.when(all_letters == 0, "non-english").when(F.try_divide(plain, all_letters) >= 0.8, "english").otherwise("non-english")


def debunk(j: Column) -> Column:
    return has_any(j, L.DEBUNK) | (has_any(j, RUMOURS[:3]) & has(j, "false"))


def sensational(j: Column, framing: Column) -> Column:
    """(term, weight) of the terms that occur; some don't count in a text that debunks."""
    counts = lambda t: has(j, t) & ~framing if t in L.SUPPRESSED else has(j, t)
    return F.array_compact(F.array(*[F.when(counts(t), F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight"))) for t, w in L.SENSATIONAL.items()]))


def upper_tokens(raw: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(raw, F.lit("[A-Z](?<![A-Za-z0-9_][A-Z])[A-Z]+(?![A-Za-z0-9_])"), F.lit(0)))


def capital_who(raw: Column) -> Column:
    """Whether WHO is among the upper tokens."""
    return F.contains(raw, F.lit("WHO")) & F.rlike(raw, F.lit("(?<![A-Za-z0-9_])WHO(?![A-Za-z0-9_])"))


def is_year(token: Column) -> Column:
    return (F.length(token) == 4) & F.rlike(token, F.lit(YEAR))


def told(tokens: Column) -> Column:
    """The tokens without which there are no dates and no bodies: months, years and the bodies' keys."""
    return F.filter(tokens, lambda t: t.isin(*L.MONTHS, *BODY_KEYS) | is_year(t))


def dates(tokens: Column) -> Column:
    """Months beside a day or a year first, then years that no month has used."""
    at = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    months = F.filter(at, lambda x: x["t"].isin(L.MONTHS))
    like = lambda t, p: F.coalesce(F.rlike(t, F.lit(p)), F.lit(False))

    def parts(x):
        before, after, second = (F.get(tokens, x["i"] + k) for k in (-1, 1, 2))
        day, next_day = like(before, DAY), like(after, DAY)
        follows = next_day | like(after, ORDINAL_YEAR)
        year = next_day & like(second, YEAR)
        pick = lambda ok, t, k: F.when(ok, F.struct(F.lit(k).cast("int").alias("k"), t.alias("t")))
        return F.struct(x["i"].alias("i"), F.filter(F.array(pick(day, before, -1), pick(F.lit(True), x["t"], 0), pick(follows, after, 1), pick(year, second, 2)), lambda y: y.isNotNull()).alias("p"))

    found = F.transform(months, parts)
    first = F.transform(F.filter(found, lambda f: F.size(f["p"]) > 1), lambda f: F.array_join(F.transform(f["p"], lambda y: y["t"]), " "))
    used = F.flatten(F.transform(found, lambda f: F.transform(f["p"], lambda y: F.when(y["k"] != 0, f["i"] + y["k"]).otherwise(-1))))
    years = F.filter(at, lambda x: is_year(x["t"]) & ~F.array_contains(used, x["i"]))
    return F.concat(first, F.transform(years, lambda x: x["t"]))


def numbers(raw: Column) -> Column:
    return F.transform(F.regexp_extract_all(raw, F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+$", ""))


def bodies(tokens: Column, raw: Column) -> Column:
    """(index, name) of named bodies, longest first and without overlaps; WHO only in capitals.
    A body found is replaced by its name and a filler for each further token, so that shorter ones
    can't match there and positions stay. Words of no body are out of the way first."""
    s = F.concat(F.lit(" "), F.array_join(among(tokens, BODY_WORDS), "  "), F.lit(" "))
    for b in BY_LENGTH:
        words = b.split()
        s = F.replace(s, F.lit(f" {'  '.join(words)} "), F.lit(" " + "  ".join(["{" + "_".join(words) + "}", *["~"] * (len(words) - 1)]) + " "))
    s = F.when(capital_who(raw), F.replace(s, F.lit(" who "), F.lit(" {WHO} "))).otherwise(s)
    at = F.transform(F.split(F.trim(s), "  "), lambda t, i: F.struct(i.alias("index"), t.alias("t")))
    found = F.filter(at, lambda x: F.startswith(x["t"], F.lit("{")))
    return F.transform(found, lambda x: F.struct(x["index"].alias("index"), F.replace(F.regexp_replace(x["t"], "[{}]", ""), F.lit("_"), F.lit(" ")).alias("name")))


def attribution(tokens: Column, found: Column) -> Column:
    """What the text attributes to a body: a verb in the three tokens behind it, or "according to"
    or else "as per" in the five before it."""

    def one(b):
        n = F.size(F.split(b["name"], " "))
        verb = F.get(F.filter(F.slice(tokens, b["index"] + n + 1, 3), lambda t: t.isin(L.VERBS)), F.lit(0))
        start = F.greatest(b["index"] - 5, F.lit(0))
        before = F.array_join(F.slice(tokens, start + 1, b["index"] - start), " ")
        mark = lambda p: F.rlike(before, F.lit(f"(?<![a-z0-9_]){p}(?![a-z0-9_])"))
        lead = F.when(mark("according to"), "according to").when(mark("as per"), "as per")
        return F.filter(F.array(F.concat(b["name"], F.lit(" "), verb), F.concat(lead, F.lit(" "), b["name"])), lambda x: x.isNotNull())

    return F.array_distinct(F.flatten(F.transform(found, one)))


def topic_hits(j: Column, raw: Column, tokens: Column) -> Column:
    """Hits of every topic in order, (topic, ord, hits)."""
    who = (capital_who(raw) & F.array_contains(tokens, "who")).cast("int")
    return F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(i).alias("ord"), (count_terms(j, words) + (who if t == "health" else F.lit(0))).alias("hits")) for i, (t, words) in enumerate(L.TOPICS.items())])


def topics_ranked(hits: Column) -> Column:
    found = F.filter(hits, lambda x: x["hits"] > 0)
    order = F.array_sort(F.transform(found, lambda x: F.struct((-x["hits"]).alias("a"), x["ord"].alias("b"), x["topic"].alias("topic"))))
    return F.when(F.size(found) > 0, F.transform(order, lambda x: x["topic"])).otherwise(F.array(F.lit("general")))


def source_match(hits: Column) -> Column:
    """Official sources by relevance, the sum of their topics' hits; the first always stays."""
    def one(order, source):
        name, _, _, topics = source
        mine = [hits[list(L.TOPICS).index(t)]["hits"] for t in topics if t != "general"]
        pairs = F.array(*[F.struct((-m).alias("a"), F.lit(i).alias("b"), F.lit(t).alias("topic")) for i, (m, t) in enumerate(zip(mine, [t for t in topics if t != "general"], strict=True))])
        total = sum(mine[1:], mine[0])
        best = F.element_at(F.array_sort(pairs), 1)
        return F.struct((-total).alias("a"), F.lit(order).alias("b"), F.lit(name).alias("id"), F.when(total > 0, best["topic"]).otherwise("general").alias("topic"), total.alias("relevance"))

    rows = F.array(*[one(i, s) for i, s in enumerate(L.SOURCES)])
    kept = F.array_sort(F.filter(rows, lambda x: (x["relevance"] > 0) | (x["b"] == 0)))
    return F.transform(kept, lambda x: F.struct(x["id"], x["topic"], x["relevance"]))


def tokens_of(claims: DataFrame) -> DataFrame:
    """claims(claim_id, text) with raw (trimmed), tokens and their joined form j."""
    rows = claims.withColumn("raw", trimmed(F.col("text"))).withColumn("tokens", tokenize(F.col("raw")))
    return rows.withColumn("j", joined(F.col("tokens")))


def signals(claims: DataFrame) -> DataFrame:
    """All signals of claims(claim_id, text), one row each; null texts count as empty. A body's index is
    its place in near."""
    rows = tokens_of(claims.withColumn("text", F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("plain", ascii_letters(F.col("raw"), F.col("tokens"))).withColumn("near", near(F.col("tokens")))
    rows = rows.withColumn("of_lists", reduced(F.col("near"), WORDS, PARTS)).withColumn("told", told(F.col("near")))  # each list is looked for in what any of them can match
    raw, tokens, j = F.col("raw"), F.col("near"), F.col("of_lists")
    told_of = lambda test, found, kind: F.when(F.exists("told", test), found).otherwise(F.array().cast(kind))
    rows = rows.withColumns({
        "language": language(raw, F.col("plain")), "debunk": debunk(j), "hedging": find_terms(j, L.HEDGING), "emotion": find_terms(j, L.EMOTION),
        "urgency": find_terms(j, L.URGENCY), "forward": find_terms(j, L.FORWARD), "clickbait": find_terms(j, L.CLICKBAIT),
        "dates": told_of(lambda t: ~t.isin(*BODY_KEYS), dates(tokens), "array<string>"), "numbers": numbers(raw),
        "bodies": told_of(lambda t: t.isin(*BODY_KEYS), bodies(tokens, raw), "array<struct<index: int, name: string>>"),
        "caps": F.coalesce(F.try_divide(letters(raw, "[A-Z]+"), F.col("plain")), F.lit(0.0)),
        "bangs": F.regexp_count(raw, F.lit("[!?]+")), "word_count": F.size("tokens"), "hits": topic_hits(j, raw, tokens),
    })
    return rows.withColumns({"sensational": sensational(j, F.col("debunk")), "attribution": attribution(tokens, F.col("bodies")), "topics": topics_ranked(F.col("hits"))}).withColumn("weight", F.aggregate("sensational", F.lit(0), lambda a, x: a + x["weight"]))


def scores(rows: DataFrame) -> DataFrame:
    """signals with the six scores, risk, language risk, verdict and evidence strength."""
    n = lambda c: F.size(F.col(c))
    over = F.greatest(F.lit(0.0), F.col("caps") - 0.12)
    rows = rows.withColumns({
        "s_sensational": half_up(clamp(100 - F.col("weight") * 3, 5)), "s_emotion": clamp(96 - n("emotion") * 22, 8), "s_urgency": clamp(95 - n("urgency") * 25, 10),
        "s_clickbait": clamp(94 - n("clickbait") * 30, 10), "s_style": half_up(clamp(98 - over * 260 - F.col("bangs") * 12, 8.0, 100.0)), "s_specificity": clamp(26 + n("numbers") * 11 + n("dates") * 14, 0, 96),
        "risk_score": half_up(clamp(F.col("weight") * 2 + n("emotion") * 12 + n("urgency") * 18 + n("forward") * 10 + n("clickbait") * 20 + over * 120 + F.col("bangs") * 6, 0.0, 100.0)),
    })
    risk = F.when(F.col("language") == "non-english", "unknown").when(F.col("risk_score") >= 60, "high").when(F.col("risk_score") >= 25, "medium").otherwise("low")
    rows = rows.withColumn("language_risk", risk)
    pressed = (n("urgency") > 0) | (n("forward") > 0)
    rows = rows.withColumn("verdict", F.when((F.col("language_risk") == "high") & pressed, "likely-misleading").otherwise("unverified"))
    return rows.withColumn("strength", F.when(F.col("verdict") == "likely-misleading", "weak").otherwise("none"))


def detect(claims: DataFrame) -> DataFrame:
    """claims(claim_id, text) -> signals and scores, one row per claim, in one stage."""
    return scores(signals(claims))


#: id, label and score column of the eight aspects; two have no score.
ASPECTS = [("sensational", "Sensational vocabulary", "s_sensational"), ("attribution", "Claimed attribution", None), ("emotion", "Emotional tone", "s_emotion"), ("urgency", "Urgency & forwarding pressure", "s_urgency"), ("specificity", "Checkable details", "s_specificity"), ("style", "Writing style", "s_style"), ("clickbait", "Clickbait framing", "s_clickbait"), ("corroboration", "Corroboration", None)]


def aspects(scored: DataFrame) -> DataFrame:
    """claim_id, pos, aspect, label, score, verdict: eight rows a claim."""
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(a).alias("aspect"), F.lit(label).alias("label"), (F.col(c) if c else F.lit(None)).cast("int").alias("score")) for i, (a, label, c) in enumerate(ASPECTS)])
    out = scored.select("claim_id", F.explode_outer(rows).alias("x")).select("claim_id", "x.*")
    return out.withColumn("verdict", F.when(F.col("score").isNull(), "unchecked").when(F.col("score") >= 70, "pass").when(F.col("score") >= 45, "warn").otherwise("fail"))


def key_terms() -> Column:
    return F.slice(F.array_distinct(F.concat(F.transform("sensational", lambda x: x["term"]), "urgency", "clickbait", "emotion")), 1, 6)


def summary() -> Column:
    unread, pressing, before, after = L.SUMMARIES
    return F.when(F.col("language_risk") == "unknown", unread).when(F.col("verdict") == "likely-misleading", pressing).otherwise(F.concat(F.lit(before), F.col("language_risk"), F.lit(after)))
