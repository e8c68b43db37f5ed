"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Quality rules reject documents, line dedup cuts repeated runs (documents of which nothing is left go), one document of each
near-duplicate group stays, documents that hold benchmark items go, and what is left is encoded to SentencePiece ids.
Every stage but the last returns the columns of documents. ``ORACLE_SQL`` is None: the learned rules and the ids are beyond
SQL; ``tests/llm/test_pipeline.py`` runs all stages against a brute-force version.

Empty texts and texts without a word fail the quality rules. A stage on an empty table gives an empty table. See the
operators for nulls, ties, repeated rows and clashing names; n_chars is set anew where a text was cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import decontam, line_dedup, ngram_join, quality, sp_codec
from formline.llm.common import fresh
from formline.session import run_dir, staged

PIECES = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, rules)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs go; so do documents that lose all their words."""
    name = fresh("n_deleted", docs)
    done = line_dedup.dedup(docs, deleted=name).where(f"`{name}` = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col(f"`{name}`") > 0, length).otherwise(F.col("n_chars")))
    return done.select(*[f"`{c}`" for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip and parity."""
    return sp_codec.encode(docs.select("doc_id", "text"), public_tokenizers.path(PIECES)).drop("text")


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", cut_repeats), ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", no_benchmark), ("sentencepiece", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
