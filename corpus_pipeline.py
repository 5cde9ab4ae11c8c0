"""A training corpus from ``documents``: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes all rows that the one before has kept, written as Parquet and read again.  Stages but the last return
the columns of ``documents``.  Rows without text have no words and go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewmetrics.llm import decontaminate, near_dup, packing, pii, quality
from crewmetrics.llm.scratch import written

#: a parameter: the file of the tokenizer that the packed ids are from
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: a parameter: whoever holds it can make the same surrogates
PII_KEY = "pipeline key"
SEQUENCE = 2048


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, 80 % alike."""
    return near_dup.deduplicated(docs, shingle=5, percent=80)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = pii.replace_entities(docs, PII_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER, SEQUENCE)


STAGES = [
    ("quality rules", good), ("near duplicates", distinct), ("benchmark decontamination", unseen), ("personal data", private), ("packing", packed),
]

#: SQL can express neither the forest nor the tokenizer; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
