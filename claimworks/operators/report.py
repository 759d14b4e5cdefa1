"""What a result says: notices, evidence and detail of aspects, reasons of decisions, prompts and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimworks.functions import messages as M
from claimworks.operators.evidence import clean_prompt


def sentences(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]))


def notices() -> Column:
    """Notices of a scored claim."""
    return sentences((F.col("language") == "non-english", M.NOT_ENGLISH), (F.col("debunk"), M.DEBUNKS))


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def aspect_reports(scored: DataFrame) -> DataFrame:
    """claim_id, aspect, detail, evidence (an array): eight rows a claim. Sensational terms come by
    weight, equal ones in list order; at most six items, four of clickbait, four numbers and two dates."""
    size = lambda c: F.size(F.col(c))
    by_weight = F.array_sort(F.transform("sensational", lambda x, i: F.struct((-x["weight"]).alias("w"), i.alias("i"), x["term"].alias("t"))))
    pressure = F.array_distinct(F.concat("urgency", "forward"))
    none = F.array().cast("array<string>")
    found = {
        "sensational": (size("sensational") > 0, F.slice(F.transform(by_weight, lambda x: x["t"]), 1, 6)), "attribution": (size("attribution") > 0, F.slice("attribution", 1, 6)),
        "emotion": (size("emotion") > 0, F.slice("emotion", 1, 6)), "urgency": (F.size(pressure) > 0, F.slice(pressure, 1, 6)),
        "specificity": (size("numbers") + size("dates") > 0, F.concat(F.slice("numbers", 1, 4), F.slice("dates", 1, 2))),
        "style": ((F.col("caps") > 0.2) | (F.col("bangs") > 2), F.array(F.concat(F.floor(F.col("caps") * 100 + 0.5).cast("string"), F.lit(M.UPPERCASE)), F.concat(F.col("bangs").cast("string"), F.lit(M.MARKS)))),
        "clickbait": (size("clickbait") > 0, F.slice("clickbait", 1, 4)), "corroboration": (F.lit(False), none),
    }
    said = {
        "sensational": F.concat(counted(size("sensational"), "sensational term"), F.lit(M.DETECTED)),
        "specificity": F.concat(counted(size("numbers"), "figure"), F.lit(" and "), counted(size("dates"), "date"), F.lit(M.CHECKABLE)),
    }

    def detail(a):
        yes, no = M.DETAILS[a]
        text = F.when(found[a][0], said.get(a, F.lit(yes)))
        return (text.when(size("bodies") > 0, M.ONLY_NAMED) if a == "attribution" else text).otherwise(no)

    rows = F.array(*[F.struct(F.lit(a).alias("aspect"), detail(a).alias("detail"), items.alias("evidence")) for a, (_, items) in found.items()])
    return scored.select("claim_id", F.explode(rows).alias("x")).select("claim_id", "x.*")


def reasons(rows: DataFrame) -> DataFrame:
    """rows(claim_id, negative, positive, mixed: arrays of (publisher, rating), domains: array, opinion,
    language_risk) -> claim_id, headline, reasons, next_steps, by the rules of evidence.decide. Null
    arrays count as empty."""
    kinds = ("negative", "positive", "mixed", "domains")
    rows = rows.withColumns({k: F.coalesce(k, F.array().cast(rows.schema[k].dataType)) for k in kinds})
    lead, whole, partly = M.RATED
    rated = lambda k, end: F.transform(k, lambda f: F.concat(f["publisher"], F.lit(lead), f["rating"], F.lit(end)))
    n, p, m = (F.size(k) > 0 for k in kinds[:3])
    outlets = F.size("domains")
    opinion = F.coalesce("opinion", F.lit(""))
    loud = F.coalesce(F.col("language_risk") == "high", F.lit(False))
    credible = ~n & (p | ((outlets >= 2) & ~m))
    back = opinion == "contradicted"
    reported = F.concat(F.lit(M.OUTLETS[0]), outlets.cast("string"), F.lit(M.OUTLETS[1]), F.array_join("domains", ", "), F.lit(M.OUTLETS[2]))
    against = F.concat(rated("negative", whole), sentences((p, M.OTHERS_TRUE), (opinion == "supported", M.READ_SUPPORTS), (loud, M.LOUD)))
    for_it = F.concat(F.when(p, rated("positive", whole)).otherwise(F.array(reported)), sentences((back, M.READ_CONFLICTS), (opinion == "supported", M.READ_AGREES)))
    single = F.concat(F.lit(M.ONE_OUTLET[0]), F.get("domains", F.lit(0)), F.lit(M.ONE_OUTLET[1]))
    open_case = F.concat(rated("mixed", partly), sentences((outlets == 1, single), (loud, M.LOUD)))
    rule = F.when(n, "a").when(credible & back, "back").when(credible & p, "b").when(credible, "c").otherwise("f")
    steps = {k: F.array(*map(F.lit, v)) for k, v in M.STEPS.items()}
    headline = F.coalesce(*[F.when(F.col("rule") == k, t) for k, t in M.HEADLINES.items()])
    return rows.withColumn("rule", rule).select(
        "claim_id", headline.alias("headline"), F.when(n, against).when(credible, for_it).otherwise(open_case).alias("reasons"),
        F.when(n, steps["a"]).when(credible & ~back, steps["credible"]).otherwise(steps["f"]).alias("next_steps"),
    )


def agree(engine: Column, opinion: Column) -> Column:
    """Whether the engine's verdict and an opinion say the same; null without either."""
    same = {"likely-misleading": "likely-false", "likely-credible": "likely-true", "unverified": "uncertain"}
    pairs = [(engine == e) & (opinion == o) for e, o in same.items()]
    return F.when(engine.isNotNull() & opinion.isNotNull(), pairs[0] | pairs[1] | pairs[2])


def gateway_message(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, text) for s, text in M.GATEWAY.items()], F.lit(M.BUSY))


def valid_evidence(items: DataFrame, most: int = 30) -> DataFrame:
    """items(claim_id, id, kind, text) -> claim_id, valid: at most 30 items, all of a known form. A
    null id, kind or text isn't valid."""
    good = F.rlike("id", F.lit("^[FNS][0-9]{1,2}$")) & F.col("kind").isin("fact-check", "article", "official-source") & (F.length("text") <= 600)
    return items.groupBy("claim_id").agg((F.bool_and(F.coalesce(good, F.lit(False))) & (F.count("*") <= most)).alias("valid"))


def prompts(claims: DataFrame, items: DataFrame) -> DataFrame:
    """claim_id, prompt: the cleaned claim and its items, fact-checks, articles and official sources
    in the order of their numbers (evidence_items gives 21 a claim at most)."""
    place = F.struct(F.array_position(F.array(*map(F.lit, "FNS")), F.left("id", F.lit(1))).alias("a"), F.substring("id", 2, 9).cast("int").alias("b"), F.concat(F.lit("["), "id", F.lit("] ("), "kind", F.lit(") "), clean_prompt(F.col("text"))).alias("line"))
    block = items.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["line"]), "\n").alias("block"))
    text = F.concat(F.lit("<claim>\n"), clean_prompt(F.col("text")), F.lit("\n</claim>\n\n<evidence>\n"), F.coalesce("block", F.lit("(no evidence items)")), F.lit("\n</evidence>"))
    return claims.join(block, "claim_id", "left").select("claim_id", text.alias("prompt"))


def image_status(image: Column, most_bytes: int = 8 << 20) -> Column:
    """ok, or why a data URL isn't taken: no-data-url, type, size (decoded bytes by its length)."""
    kind = F.lower(F.substring_index(F.substring(image, 6, 1 << 30), ";", 1))
    size = F.floor((F.length(image) - F.instr(image, ",")) * 0.75)
    return F.when(~F.startswith(image, F.lit("data:")) | image.isNull(), "no-data-url").when(~kind.isin(M.IMAGES), "type").when(size > most_bytes, "size").otherwise("ok")
