"""Documents to token ids: quality rules, near duplicates, decontamination, personal data, BPE.

Every stage takes `(spark, docs, sf_dir)` and gives a DataFrame, which is stored and read again as the next one's `docs`.
All but the last keep the columns of `documents`. Rows with null or empty text are rejected by the first stage.
What a stage gives is computed when the caller writes it, so every stage lowers the session's Arrow batches; `run` gives
the setting back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cidrloom.llm import op2_quality, op3_jaccard, op4_bpe, op7_decontaminate, op8_pii
from cidrloom.llm.kit import limit_batches, new_path, small_batches, table

NEAR, NEAR_WORDS = (80, 100), 5  # near copies share 80 % of their five-word shingles


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return op2_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return op3_jaccard.one_of_each(docs, similarity=NEAR, width=NEAR_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return op7_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return op8_pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    made = op4_bpe.tokenise(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding", token_ids),
]

ORACLE_SQL = None  # SQL expresses neither the R-tree join nor the merges; tests hold run() against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            path = new_path(spark, name.replace(" ", "-"))
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
