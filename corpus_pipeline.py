"""A corpus pipeline of five stages, each calling an operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.llm import _store, jaccard_join, langid, line_dedup, mixing, packing
from claimworks.llm.queries import tokenizer_path

#: Documents whose share of n-grams known in their best language is below this are rejected.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned on all labelled rows: documents without a language go. Where lang is
    null it becomes the predicted language."""
    out = langid.predict(docs, langid.learn(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    out = out.filter(f"lang_pred <> 'und' and score >= {LEAST_SCORE}")
    return out.select(*[F.coalesce("doc.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; documents stay, if need be with an empty text."""
    out = line_dedup.dedup_lines(docs, counts=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays: the one with the smallest id."""
    return jaccard_join.one_per_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document comes once for each round."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as packed sequences of at most 4,096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", language), ("line dedup", line_dedup_stage), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Tokens and SimHashes are beyond SQL. tests/llm/test_pipeline.py checks each stage and their order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written as Parquet and read again."""
    docs = _store.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _store.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
