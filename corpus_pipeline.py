"""Five stages that turn ``documents`` into packed training sequences.

Every stage reads what the one before it kept, as a Parquet table, and all but the last return the columns of
``documents``: junk and toxic documents go, then those without a recognisable language, then all but one of each class of
near duplicates (five-word shingles, similarity 0.8), then those contaminated by benchmark items; what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontamination, language_id, minhash, packing, quality
from codeloom.llm.common import materialise
from codeloom.session import table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(spark, docs, quality.train(spark, docs, table(spark, sf_dir, "labels")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(spark, docs, language_id.train(spark, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(spark, docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, packing.encode_pieces(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("quality_classifier", classify_quality),
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the trained stages nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written and read again before the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
