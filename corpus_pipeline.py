"""Documents to a training corpus: the stages, each reading what its predecessor kept.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
``documents``: the language stage puts the language it found into ``lang`` and drops
documents without one, near-duplicates keep the first document of a group, contaminated
documents go, and the mix repeats or cuts documents to meet the sources' weights.  The
last stage writes the shards and returns their token sequences in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import language
from quire.llm.decontaminate import decontaminate
from quire.llm.mixing import mix
from quire.llm.near_dup import drop_near_duplicates
from quire.llm.stage import stage
from quire.llm.tokens import written_order


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.relabel(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return written_order(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Trained models and binary tokens have no SQL form; the tests hold each stage's result
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
