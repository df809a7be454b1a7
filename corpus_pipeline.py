"""A corpus pipeline over ``documents``: toxicity, line dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import jaccard, line_dedup, mixing, packing, toxicity
from lattica.llm.common import shared_folder, table
from lattica.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score from which a document is rejected as toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below TOXIC, by a network trained on all labels. Null and empty texts score as texts without words, repeated rows alike; an empty table stays empty."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs.select(*COLUMNS), net, text=True).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete passages that an earlier document holds. A document that loses every line with a word goes; one that had none (null and empty texts too) stays. An empty table stays empty."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS))
    whole = done.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return whole.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least document of each component of texts whose five-word shingles are similar by 0.8 or more; documents are told apart by doc_id and text.

    Texts without words are alike, so one stays; repeated rows are one, rows without a doc_id come last. An empty table stays empty.
    """
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(line_dedup.NO_ID)).alias("id")
    keyed = docs.select(*COLUMNS, id_, F.xxhash64("text").alias("version"))
    kept = keyed.join(jaccard.representatives(keyed), ["id", "version"], "left_semi")
    # rows of one id and text differ in the other columns alone; the least of those stays, so reruns agree
    return kept.groupBy("id", "version").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row")).select(*[f"row.{c}" for c in COLUMNS])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: repeated rows alike, texts without words by their rate too. Null sources are one source. An empty table stays empty."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences. Null and empty texts are one piece of length 1, repeated rows have places of their own; an empty table gives none."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Training and recurrent scoring have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again in the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
