"""The corpus pipeline: five stages over ``documents``, each an operator of
``askwell.llm``, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of its input and acts on all rows
it gets: toxic documents go, one document of each near-duplicate group stays,
repeated passages are cut out, personal data is masked, and what is left is
packed into sequences.  Null texts pass the text stages unchanged; an empty
table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askwell.llm import packing, pii, simhash, suffix_dedup, toxicity
from askwell.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, shingle=4, max_bits=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs, length=100)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.without_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]

#: The stages learn models and walk trees, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
