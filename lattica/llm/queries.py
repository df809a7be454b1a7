"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import embeddings, line_dedup, mixing, packing, pii, quality_rules, rule_ensemble, simhash, toxicity, url_filter
from lattica.llm.common import id_hash_mod, table


def tokenizer_path() -> str:
    """Where the vocabulary file of the packing query lies; the operator takes it as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.col("by"))


def _learnable(spark: SparkSession, sf_dir: str, modulus: int, held_out: int) -> DataFrame:
    """Labels of the documents that a model may learn from."""
    return table(spark, sf_dir, "labels").where(id_hash_mod(F.col("doc_id"), modulus) != held_out)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = rule_ensemble.score_quality(docs, rule_ensemble.fit(docs, _learnable(spark, sf_dir, 5, 0)))
    return scored.select("doc_id", (id_hash_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES["v2"])
    base = F.col("fails").bitwiseAND(F.lit(quality_rules.BASE.mask)) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, _learnable(spark, sf_dir, 4, 2))
    scored = toxicity.score_texts(docs, net)
    return scored.select("doc_id", (id_hash_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "base", "secrets", "n_all")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_embeddings": op7_embeddings,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.MIX_SQL, "op6_quality_rules": quality_rules.RULES_SQL}
