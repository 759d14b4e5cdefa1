"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.llm import alignment, fingerprints, hard_negatives, html_extract, jaccard_join, langid, line_dedup, lm_scoring, metric_topk, mixing, packing, token_counts, toxicity
from claimworks.llm._store import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.stupid_backoff(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", "lines.n_lines", "lines.n_removed")


def op4_metric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_topk.top_k(read(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), k=3, num=90)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.learn(docs.filter(~held))
    return langid.predict(docs, model, "doc_id", held.alias("held_out"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = langid.held_out(F.col("doc_id"), 3, 1)
    return toxicity.score(docs, toxicity.fit(docs, labels.filter(~held)), "doc_id", held.alias("held_out"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path())


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_packing, op3_line_dedup, op4_metric_topk, op5_jaccard_join, op6_language_id, op7_toxicity, op8_fingerprints, op9_html_extraction, op10_mixing, op11_token_alignment, op12_token_counts, op13_hard_negatives)}
ORACLE_SQL = {"op1_lm_scoring": lm_scoring.ORACLE_SQL, "op4_metric_topk": metric_topk.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL, "op5_jaccard_join": jaccard_join.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
