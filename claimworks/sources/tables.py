"""Input tables, and the claims that the queries score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Openings put before the documents' texts, which hold none of the lexicons' words.
TEMPLATES = [
    "SHOCKING: they don't want you to know this miracle cure! Share before it's deleted!!!",
    "The Ministry of Finance announced a budget change on 1 April 2024, officials said.",
    "According to the India Meteorological Department, heavy rain of 115 mm is expected on 3rd March.",
    "WHO says the outbreak is over. Who knew?",
    "Fact check: the viral rumours about currency notes are false.",
    "URGENT forward this to everyone immediately, the government has banned SIM cards",
    "Leaked documents expose a conspiracy; as per the Reserve Bank of India Governor nothing is wrong.",
    "You won't believe what happened next! This one trick will shock you",
    "ISRO confirmed the satellite launch on 12 August 2025 at a cost of 6.5 crore.",
    "The Election Commission issued voting rules for 2026 in May.",
    "Researchers published a peer reviewed study on vaccines in 2019 and 2021.",
    "Breaking: train fares up 20% from today, hospital says ministry stated it.",
    "The hoax claims that Aadhaar OTP was hacked, allegedly by anonymous accounts.",
    "Farmers protest as wheat prices fall 10 percent; army on the border.",
    "Act now, 100% guaranteed returns, only today, hurry! HURRY!",
    "Mainstream media is hiding the hidden truth about big pharma, wake up",
    "A calm sentence without anything to find.",
    "The Ministry of Health told UIDAI and the World Health Organization stated the same.",
    "RBI clarified that the repo rate stays; cert in notified banks. Price 3,500 km",
    "Terrifying chaos, panic and war: furious crowds slammed and destroyed the airport",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, text: every document's whole text behind an opening."""
    openings = F.array(*map(F.lit, TEMPLATES))
    docs = read(spark, sf_dir, "documents")
    opening = F.get(openings, (F.col("doc_id") % len(TEMPLATES)).cast("int"))
    return docs.select(F.col("doc_id").alias("claim_id"), F.concat(opening, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


CLAIMS_SQL = f"claims AS (SELECT doc_id AS claim_id, {sql_list(TEMPLATES)}[doc_id % {len(TEMPLATES)} + 1] || ' ' || coalesce(text, '') AS text FROM documents)"
